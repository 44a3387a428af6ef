"""Session metadata."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelltrace import schema as S
from shelltrace.functions import text as X


def read_session_documents(
    spark: SparkSession, path: str, missing_ok: bool = True
) -> DataFrame:
    """Metadata files of one JSON document each, below ``path`` (a pattern)."""
    try:
        meta = (
            spark.read.option("multiLine", True)
            .option("mode", "DROPMALFORMED")
            .schema(S.META)
            .json(path)
        )
    except AnalysisException as e:
        if missing_ok and e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], S.META)
        raise
    return meta.fillna("")


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """The sessions table; a missing one has no rows."""
    try:
        return spark.read.schema(S.META).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], S.META)
        raise


def new_sessions(
    requests: DataFrame, now=None, version: str = S.META_VERSION
) -> DataFrame:
    """A metadata row per request row, which names the ``model``."""
    started = F.current_timestamp() if now is None else now
    return requests.select(
        F.uuid().alias("session_id"),
        X.utc_seconds(started).alias("started_at"),
        "model",
        F.lit(version).alias("version"),
    )


def append_sessions(sessions: DataFrame, path: str) -> None:
    sessions.select(*S.META.fieldNames()).write.mode("append").parquet(path)


def resolve_session(sessions: DataFrame, session_id: str | None = None) -> DataFrame:
    """The named session, or the one started last: at most one row."""
    if session_id is not None:
        return sessions.where(F.col("session_id") == session_id)
    latest = F.max_by(F.struct(*sessions.columns), F.struct("started_at", "session_id"))
    return sessions.agg(latest.alias("s")).where("s is not null").select("s.*")


def require_session(sessions: DataFrame, session_id: str | None = None):
    """The resolved session as a row; an error when there is none."""
    row = resolve_session(sessions, session_id).first()
    if row is None:
        raise LookupError(
            "no session recorded" if session_id is None else f"no session {session_id!r}"
        )
    return row
