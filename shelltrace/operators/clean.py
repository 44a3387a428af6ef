"""Row filters, redaction and recording limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelltrace.functions import patterns as P
from shelltrace.functions import terminal
from shelltrace.functions import text as X
from shelltrace.operators.joins import join_by_session
from shelltrace.operators.ordered import LogOrder, choose_order, first_rows


def drop_blank(events: DataFrame) -> DataFrame:
    """Drop events without a command."""
    return events.where(~terminal.is_blank(F.col("stdin")))


def drop_trivial(events: DataFrame) -> DataFrame:
    """Drop commands that say nothing about the session."""
    return events.where(~terminal.is_trivial(F.col("stdin")))


def redact_events(events: DataFrame) -> DataFrame:
    """Replace secrets in command and output columns."""
    return events.withColumns(
        {c: terminal.redact(F.col(c)) for c in ("stdin", "stdout", "stderr")}
    )


def clean_events(events: DataFrame) -> DataFrame:
    """Filters first, then redaction; one narrow stage."""
    return events.transform(drop_blank).transform(drop_trivial).transform(redact_events)


def cap_events(
    events: DataFrame,
    max_events: int = P.MAX_EVENTS_PER_TERMINAL,
    order: LogOrder | None = None,
) -> DataFrame:
    """Keep the first ``max_events`` events of each terminal."""
    keys = ("session_id", "terminal_id")
    return first_rows(events, order or choose_order(events, keys), max_events)


def cap_duration(
    events: DataFrame,
    sessions: DataFrame,
    max_seconds: int = P.MAX_SESSION_SECONDS,
) -> DataFrame:
    """Drop events later than ``max_seconds`` after the session's start.

    0 turns the limit off. Events without session metadata are kept.
    """
    if max_seconds == 0:
        return events
    limits = sessions.select(
        "session_id",
        (
            F.unix_micros(X.parse_time(F.col("started_at"))) + max_seconds * 1_000_000
        ).alias("_until"),
    )
    in_time = F.col("_until").isNull() | (F.unix_micros("ts") <= F.col("_until"))
    return join_by_session(events, limits, how="left").where(in_time).drop("_until")


def cap_outputs(
    events: DataFrame, max_bytes: int = P.MAX_OUTPUT_BYTES
) -> DataFrame:
    """Keep the first ``max_bytes`` bytes of each output."""
    return events.withColumn(
        "stdout", terminal.cap_output(F.col("stdout"), max_bytes)
    )


def manual_events(records: DataFrame) -> DataFrame:
    """Events from hand-recorded commands, which have no output.

    ``exit_code`` and ``duration_ms`` are text; malformed numbers become 0.
    """
    empty = F.lit("")
    return records.select(
        "timestamp",
        "session_id",
        "terminal_id",
        "cwd",
        "stdin",
        empty.alias("stdout"),
        empty.alias("stderr"),
        X.parse_int(F.col("exit_code")).alias("exit_code"),
        X.parse_int(F.col("duration_ms")).alias("duration_ms"),
    )
