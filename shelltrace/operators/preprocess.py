"""Output preprocessing: one narrow stage, shared by batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelltrace.functions import extractors, terminal
from shelltrace.operators.ordered import LogOrder
from shelltrace.operators.sequence import dedup_consecutive
from shelltrace.schema import CACHE_VERSION


def process_events(events: DataFrame, limits: terminal.Limits | None = None) -> DataFrame:
    """Add ``tool_name``, ``processed_stdout`` and ``repeat_count`` = 1.

    Strip control sequences, name the tool, extract its findings and cut them
    to the tool's byte budget, the built-in ones unless ``limits`` says
    otherwise. Nothing is shuffled.
    """
    tool, output = F.col("tool_name"), F.col("processed_stdout")
    return (
        events.withColumns(
            {
                "processed_stdout": terminal.clean_output(F.col("stdout")),
                "tool_name": terminal.base_tool(F.col("stdin")),
            }
        )
        .withColumn("tool_name", extractors.effective_tool(tool, output))
        .withColumn("processed_stdout", extractors.extract(tool, output))
        .withColumns(
            {
                "processed_stdout": terminal.truncate_bytes(
                    output, terminal.byte_limit(tool, limits)
                ),
                "repeat_count": F.lit(1).cast("long"),
            }
        )
    )


def preprocess(
    events: DataFrame,
    order: LogOrder | None = None,
    limits: terminal.Limits | None = None,
) -> DataFrame:
    """Process every event, then collapse consecutive repeats."""
    return dedup_consecutive(process_events(events, limits), order)


def to_cached(events: DataFrame, limits: terminal.Limits | None = None) -> DataFrame:
    """Processed rows with the version of the cache format."""
    return process_events(events, limits).withColumn(
        "cache_version", F.lit(CACHE_VERSION).cast("int")
    )


def from_cached(cached: DataFrame) -> DataFrame:
    """Cached rows back to processed rows."""
    return cached.drop("cache_version")
