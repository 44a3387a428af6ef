"""The stored table of processed events, and its freshness.

The table is a :class:`VersionedTable`: files lie by a hash bucket of the
session, a rebuild swaps the buckets of its sessions, and readers see a
rebuild whole or not at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelltrace import schema as S
from shelltrace.operators.clean import clean_events
from shelltrace.operators.joins import join_by, join_by_session
from shelltrace.operators.preprocess import to_cached
from shelltrace.session import write_through
from shelltrace.sources.versions import BUCKETS, Listing, VersionedTable

TABLE = S.with_engine_columns(S.CACHED)


def processed_table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> VersionedTable:
    """The table at ``path``; ``buckets`` counts when it is first written."""
    return VersionedTable(spark, path, TABLE, buckets=buckets)


def build_processed(events: DataFrame) -> DataFrame:
    """Rows to store: filtered and redacted before anything is written, and
    not yet collapsed, so that counts compare with the filtered log."""
    return to_cached(clean_events(events)).select(*TABLE.fieldNames())


def append_processed(rows: DataFrame, path: str) -> Listing:
    return processed_table(rows.sparkSession, path).append(rows)


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    """Stored rows; a missing table gives none."""
    return processed_table(spark, path).read()


def rebuild_processed(events: DataFrame, path: str) -> Listing:
    """Replace the stored rows of every session in ``events``.

    Only the buckets of those sessions are rewritten. ``events`` holds whole
    session logs; those without an id are a session.
    """
    table = processed_table(events.sparkSession, path)
    return table.replace_keys(events.select("session_id"), build_processed(events))


def staleness(
    raw_counts: DataFrame, cached: DataFrame, version: int = S.CACHE_VERSION
) -> DataFrame:
    """Whether each session's stored rows are unusable:
    ``(session_id, n_raw, n_cached, is_stale)``.

    They are when missing, when their number differs from ``n_raw``, or when
    any row has another version. ``raw_counts`` is ``(session_id, n_raw)``.
    """
    stored = cached.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_cached"),
        F.min("cache_version").alias("_oldest"),
        F.max("cache_version").alias("_newest"),
    )
    fresh = (
        (F.col("n_cached") == F.col("n_raw"))
        & (F.col("_oldest") == version)
        & (F.col("_newest") == version)
    )
    return join_by(raw_counts, stored, ["session_id"], "left").select(
        "session_id",
        "n_raw",
        F.coalesce("n_cached", F.lit(0).cast("long")).alias("n_cached"),
        F.coalesce(~fresh, F.lit(True)).alias("is_stale"),
    )


def usable_processed(cached: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Stored rows where fresh, rows processed now elsewhere."""
    raw_counts = cleaned.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_raw"))
    stale = staleness(raw_counts, cached).where("is_stale").select("session_id")
    stale = write_through(stale, "stale")
    columns = [c for c in TABLE.fieldNames() if c != "cache_version"]
    # Sessions without stored rows are stale, so every raw row has one source.
    redone = to_cached(join_by_session(cleaned, stale, "left_semi")).select(*columns)
    reused = join_by_session(cached, stale, "left_anti").select(*columns)
    known = raw_counts.select("session_id")
    return join_by_session(reused, known, "left_semi").unionByName(redone)
