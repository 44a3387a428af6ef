"""Table schemas shared by readers, operators and tests."""

from __future__ import annotations

from pyspark.sql import types as T

# Stored field names and their order.
EVENT = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("terminal_id", T.StringType()),
        T.StructField("cwd", T.StringType()),
        T.StructField("stdin", T.StringType()),
        T.StructField("stdout", T.StringType()),
        T.StructField("stderr", T.StringType()),
        T.StructField("exit_code", T.LongType()),
        T.StructField("duration_ms", T.LongType()),
    ]
)

PROCESSED = T.StructType(
    EVENT.fields
    + [
        T.StructField("processed_stdout", T.StringType()),
        T.StructField("tool_name", T.StringType()),
        T.StructField("repeat_count", T.LongType()),
    ]
)

CACHED = T.StructType(
    PROCESSED.fields + [T.StructField("cache_version", T.IntegerType())]
)

META = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("started_at", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("version", T.StringType()),
    ]
)

FRAGMENT = T.StructType(
    [
        T.StructField(
            "message", T.StructType([T.StructField("content", T.StringType())])
        ),
        T.StructField("done", T.BooleanType()),
    ]
)

TRANSCRIPT = T.StructType(
    [
        T.StructField("session_id", T.StringType()),
        T.StructField("terminal_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("payload", T.BinaryType()),
    ]
)

# Format versions written into tables.
CACHE_VERSION = 2
META_VERSION = "0.1.0"


def with_engine_columns(schema: T.StructType) -> T.StructType:
    """``schema`` plus the log position and the parsed timestamp."""
    return T.StructType(
        schema.fields
        + [
            T.StructField("seq", T.LongType()),
            T.StructField("ts", T.TimestampType()),
        ]
    )
