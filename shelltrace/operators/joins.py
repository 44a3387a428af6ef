"""Look-ups from events to small or per-session tables.

A null key is a key like any other: rows of sessions without an id meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelltrace.session import BROADCAST_ROWS, broadcast_if_bounded

# A session above this many rows is spread over several join tasks.
ROWS_PER_JOIN_TASK = 1_000_000
# Tasks that a session of a stream is spread over, whose rows cannot be counted.
STREAM_SHARES = 16


def join_by(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join on equal ``keys``, nulls being equal; ``left`` gives the keys."""
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys]
    right = right.withColumnsRenamed({c: f"_of_{c}" for c in keys})
    return left.join(right, same, how).drop(*[f"_of_{c}" for c in keys])


def join_by_session(
    rows: DataFrame,
    sessions: DataFrame,
    how: str = "inner",
    max_broadcast_rows: int = BROADCAST_ROWS,
    rows_per_task: int = ROWS_PER_JOIN_TASK,
    spread: str = "seq",
) -> DataFrame:
    """Join many rows per session to one row per session.

    A session table of proven small size is broadcast. Beyond that the join
    shuffles, and each session above ``rows_per_task`` rows is split into that
    many shares, its single session row being copied to every share. The rows
    of a stream cannot be counted: there every session has ``STREAM_SHARES``.
    """
    key = ["session_id"]
    if sessions.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        return join_by(rows, F.broadcast(sessions), key, how)
    if rows.isStreaming:
        shares = F.lit(STREAM_SHARES)
        spread_rows, copies = rows, sessions
    else:
        large = (
            rows.groupBy("session_id")
            .count()
            .where(F.col("count") > rows_per_task)
            .select(
                "session_id",
                F.ceil(F.col("count") / rows_per_task).cast("int").alias("_shares"),
            )
        )
        if large.isEmpty():
            return join_by(rows, sessions, key, how)
        # At most total rows / rows_per_task sessions are large.
        large = broadcast_if_bounded(large)
        shares = F.coalesce("_shares", F.lit(1))
        spread_rows = join_by(rows, large, key, "left")
        copies = join_by(sessions, large, key, "left")
    spread_rows = spread_rows.withColumn("_share", F.pmod(F.xxhash64(spread), shares).cast("int"))
    copies = copies.withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1)))
    return join_by(
        spread_rows.drop("_shares"), copies.drop("_shares"), ["session_id", "_share"], how
    ).drop("_share")
