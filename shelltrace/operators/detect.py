"""Session type detection from weighted signals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelltrace.functions import patterns as P
from shelltrace.functions import terminal
from shelltrace.functions import text as X
from shelltrace.session import broadcast_if_bounded

DEFAULT_TYPE = "educational"
_WEIGHT = "decimal(10,2)"
_TOOL = "tool:"
_TOOLS_SCHEMA = "tool string, type string, weight string, reason string"
_SIGNALS_SCHEMA = (
    "key string, type string, weight string, reason string, signal_ord int"
)


@dataclass(frozen=True)
class CommandSignal:
    """A signal raised by commands that match ``pattern``."""

    key: str
    pattern: str
    type: str
    weight: str
    reason: str


COMMAND_SIGNALS = tuple(CommandSignal(*signal) for signal in P.COMMAND_SIGNALS)


def tool_weights(spark: SparkSession) -> DataFrame:
    """The default ``(tool, type, weight, reason)`` table."""
    rows = [
        (tool, session_type, weight, reason + tool)
        for session_type, reason, tools in (
            ("pentest", P.PENTEST_REASON, P.PENTEST_TOOLS),
            ("debug", P.DEV_REASON, P.DEV_TOOLS),
        )
        for tool, weight in tools.items()
    ]
    return spark.createDataFrame(rows, _TOOLS_SCHEMA)


def signal_table(
    spark: SparkSession,
    weights: DataFrame | None = None,
    command_signals: tuple[CommandSignal, ...] = COMMAND_SIGNALS,
) -> DataFrame:
    """What each signal means: ``(key, type, weight, reason, signal_ord)``.

    ``signal_ord`` orders the signals of one event, tools first.
    """
    tools = (tool_weights(spark) if weights is None else weights).select(
        tool_key(F.col("tool")).alias("key"),
        "type",
        "weight",
        "reason",
        F.lit(0).alias("signal_ord"),
    )
    patterns = [
        (s.key, s.type, s.weight, s.reason, i + 1)
        for i, s in enumerate(command_signals)
    ]
    if patterns:
        tools = tools.unionByName(spark.createDataFrame(patterns, _SIGNALS_SCHEMA))
    return tools.withColumn("weight", F.col("weight").cast(_WEIGHT))


def tool_key(tool: Column) -> Column:
    return F.concat(F.lit(_TOOL), tool)


def event_signals(
    events: DataFrame,
    weights: DataFrame | None = None,
    command_signals: tuple[CommandSignal, ...] = COMMAND_SIGNALS,
) -> DataFrame:
    """Keys of the signals each event raises: ``(session_id, seq, key)``.

    An event that raises none has one row with a NULL key.
    """
    command = X.trim_space(F.col("stdin"))
    by_pattern = [
        F.when(F.col("_command").rlike(s.pattern), F.lit(s.key))
        for s in command_signals
    ]
    rows = events.select(
        "session_id",
        "seq",
        command.alias("_command"),
        tool_key(terminal.base_tool(F.col("stdin"))).alias("_key"),
    )
    if weights is None:
        tools = [_TOOL + t for t in (*P.PENTEST_TOOLS, *P.DEV_TOOLS)]
        by_tool = F.when(F.col("_key").isin(*tools), F.col("_key"))
    else:
        known = weights.select(tool_key(F.col("tool")).alias("_key")).distinct()
        known = known.withColumn("_known", F.col("_key"))
        rows = rows.join(broadcast_if_bounded(known), "_key", "left")
        by_tool = F.col("_known")
    keys = F.array_compact(F.array(by_tool, *by_pattern))
    return rows.select("session_id", "seq", F.explode_outer(keys).alias("key"))


def session_signals(
    events: DataFrame,
    weights: DataFrame | None = None,
    command_signals: tuple[CommandSignal, ...] = COMMAND_SIGNALS,
) -> DataFrame:
    """Each signal once per session, at its first occurrence.

    Only a key and a position are shuffled; what the key means is looked up
    afterwards. Sessions that raise no signal keep a row with a NULL key.
    """
    first = (
        event_signals(events, weights, command_signals)
        .groupBy("session_id", "key")
        .agg(F.min("seq").alias("first_seq"))
    )
    table = signal_table(events.sparkSession, weights, command_signals)
    # Without a weights table of the caller's, a fixed list.
    table = F.broadcast(table) if weights is None else broadcast_if_bounded(table)
    return first.join(table, "key", "left").select(
        "session_id", "key", "type", "weight", "reason", "first_seq", "signal_ord"
    )


def classify_sessions(signals: DataFrame) -> DataFrame:
    """Score each type and keep the best: ``(session_id, session_type,
    confidence, reasons)``.

    Equal scores go to the later name, so pentest wins over debug.
    """
    ordered = F.array_sort(
        F.collect_list(F.struct("first_seq", "signal_ord", "reason"))
    )
    by_type = signals.groupBy("session_id", "type").agg(
        F.coalesce(F.sum("weight"), F.lit(0)).cast("double").alias("score"),
        ordered.alias("reasons"),
    )
    best = by_type.groupBy("session_id").agg(
        F.max(F.struct("score", "type", "reasons")).alias("b")
    )
    confidence = F.col("b.score") / (F.col("b.score") + 1)
    weak = F.col("confidence") < P.MIN_CONFIDENCE
    return best.select("session_id", "b.type", "b.reasons", confidence.alias("confidence")).select(
        "session_id",
        F.when(weak, F.lit(DEFAULT_TYPE)).otherwise(F.col("type")).alias("session_type"),
        "confidence",
        F.when(weak, F.array(F.lit(P.NO_SIGNAL_REASON)))
        .otherwise(F.col("reasons.reason"))
        .alias("reasons"),
    )


def detect_sessions(
    events: DataFrame,
    weights: DataFrame | None = None,
    command_signals: tuple[CommandSignal, ...] = COMMAND_SIGNALS,
) -> DataFrame:
    """Session type, confidence and reasons of every session."""
    return classify_sessions(session_signals(events, weights, command_signals))
