"""Events processed and stored as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shelltrace.operators.clean import cap_duration
from shelltrace.sources.processed import build_processed, processed_table


def preprocess_stream(
    events: DataFrame,
    sessions: DataFrame | None = None,
    max_seconds: int = 0,
) -> DataFrame:
    """The rows to store for a stream of events.

    Every stage is stateless, so nothing is kept between batches. With
    ``sessions`` and ``max_seconds``, events past a session's maximum duration
    are dropped.
    """
    if sessions is not None and max_seconds > 0:
        events = cap_duration(events, sessions, max_seconds)
    return build_processed(events)


def run_preprocess(
    events: DataFrame,
    path: str,
    checkpoint: str,
    sessions: DataFrame | None = None,
    max_seconds: int = 0,
) -> None:
    """Append the available input of a stream to the processed table.

    A batch is a version of the table, in files of bounded number and size; one
    that is run again after a failure is not added again. Buckets that have
    gathered many small files are compacted at the end.
    """
    table = processed_table(events.sparkSession, path)

    def add(rows: DataFrame, batch: int) -> None:
        table.append(rows, stream=checkpoint, batch=batch)

    query = (
        preprocess_stream(events, sessions, max_seconds)
        .writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    table.compact()
