"""Consecutive repeats and chunks of a session log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelltrace.operators.joins import join_by
from shelltrace.operators.ordered import (
    Before,
    LogOrder,
    choose_order,
    fold_ends,
    fold_path,
    number_rows,
    start_states,
)
from shelltrace.session import write_through

# Chunk parameters.
MAX_COMMANDS = 10
GAP_SECONDS = 5 * 60
MIN_COMMANDS = 3
# Events whose splits are folded as one list.
FOLD_EVENTS = 512


def content_key() -> Column:
    """Digest of command and processed output, to compare rows narrowly."""
    return F.unhex(
        F.sha2(
            F.concat_ws(
                ":",
                F.octet_length("stdin").cast("string"),
                "stdin",
                "processed_stdout",
            ),
            256,
        )
    )


def dedup_consecutive(
    events: DataFrame,
    order: LogOrder | None = None,
    same: tuple[str, ...] = ("stdin", "processed_stdout"),
) -> DataFrame:
    """Collapse adjacent rows with equal ``same`` columns to the first.

    The first row's ``repeat_count`` grows by the rows collapsed into it. In
    slices, texts are compared by a digest: only positions and digests are
    ordered, and the first rows' other columns are joined once.
    """
    order = order or choose_order(events)
    texts = [c for c in same if events.schema[c].dataType.simpleString() == "string"]
    if order.sliced and texts:
        stored = write_through(events, "events")
        place = [*order.keys, order.seq]
        content = F.unhex(F.sha2(F.to_json(F.struct(*same)), 256)).alias("_content")
        narrow = stored.select(*place, "repeat_count", content)
        first = _collapsed(narrow, order, ("_content",)).drop("_content")
        whole = join_by(stored.drop("repeat_count"), first, place)
        return whole.select(*events.columns)
    return _collapsed(events, order, same)


def _collapsed(events: DataFrame, order: LogOrder, same: tuple[str, ...]) -> DataFrame:
    value = F.struct(*same)
    df = order.carry(
        order.start(events),
        _previous=Before(F.max_by(value, order.seq), "last"),
        _before=Before(F.count(F.lit(1)), "sum"),
        _total=Before(F.count(F.lit(1)), "total"),
    )
    previous = F.coalesce(F.lag(value).over(order.rows()), F.col("_previous"))
    df = df.withColumns(
        {
            "_first": previous.isNull() | (value != previous),
            "_row": F.row_number().over(order.rows()) + F.col("_before"),
        }
    ).where("_first")
    df = order.carry(df, _next=Before(F.min("_row"), "next"))
    next_row = F.coalesce(
        F.lead("_row").over(order.rows()), F.col("_next"), F.col("_total") + 1
    )
    repeats = F.col("repeat_count") + next_row - F.col("_row") - 1
    return order.finish(
        df.withColumn("repeat_count", repeats.cast("long")).drop(
            "_previous", "_before", "_total", "_first", "_row", "_next"
        )
    )


def split_chunks(
    events: DataFrame,
    order: LogOrder | None = None,
    max_commands: int = MAX_COMMANDS,
    gap_seconds: float = GAP_SECONDS,
) -> DataFrame:
    """Add ``event_index`` and ``split_start``, before any merging.

    A chunk begins after a pause of ``gap_seconds`` or after ``max_commands``
    events. ``split_start`` is the ``event_index`` of the chunk's first event.
    """
    if max_commands <= 0:
        max_commands = MAX_COMMANDS
    order = order or choose_order(events)
    micros = F.unix_micros("ts")
    df = order.carry(
        order.start(events),
        _last=Before(F.max_by(micros, order.seq), "last"),
        _before=Before(F.count(F.lit(1)), "sum"),
    )
    pause = micros - F.coalesce(F.lag(micros).over(order.rows()), F.col("_last"))
    df = df.withColumns(
        {
            "event_index": (
                F.row_number().over(order.rows()) - 1 + F.col("_before")
            ).cast("long"),
            "_paused": F.coalesce(
                pause >= F.lit(int(gap_seconds * 1_000_000)), F.lit(False)
            ),
        }
    )
    resumed = F.when(F.col("_paused"), F.col("event_index"))
    df = order.carry(df, _resumed=Before(F.max(resumed), "last"))
    run_start = F.coalesce(
        F.max(resumed).over(order.so_far()), F.col("_resumed"), F.lit(0)
    )
    split_start = F.col("event_index") - (F.col("event_index") - run_start) % F.lit(
        max_commands
    )
    return order.finish(
        df.withColumn("split_start", split_start.cast("long")).drop(
            "_last", "_before", "_paused", "_resumed"
        )
    )


def split_table(split_events: DataFrame, order: LogOrder) -> DataFrame:
    """One row per unmerged chunk; at most a chunk's events enter a group."""
    return split_events.groupBy(*order.keys, "split_start").agg(
        F.count(F.lit(1)).alias("n_commands"),
        F.min_by("ts", order.seq).alias("start_time"),
        F.max_by("ts", order.seq).alias("end_time"),
    )


def merge_small(
    splits: DataFrame, order: LogOrder, min_commands: int = MIN_COMMANDS
) -> DataFrame:
    """Assign ``chunk_index``: small chunks join the next, a small last one
    joins the one before. Returns ``splits`` with the merged chunk's index,
    first event, size and times."""
    order = order.by("split_start")
    least = max(min_commands, 1)

    def step(pending: Column, size: Column) -> Column:
        return F.when(pending + size >= least, F.lit(0)).otherwise(pending + size)

    # A split that is large enough by itself closes a chunk whatever came
    # before, so what follows it is a segment that can be folded alone.
    large = (F.col("n_commands") >= least).cast("long")
    rows = order.carry(order.start(splits), _before=Before(F.sum(large), "sum"))
    segment = F.coalesce(F.sum(large).over(order.before()), F.lit(0)) + F.col("_before")
    in_segment = (*order.keys, "_segment")
    # At most a block's events make splits of it, however long a segment is.
    blocks = (
        rows.withColumn("_segment", segment)
        .withColumn("_block", F.expr(f"split_start div {FOLD_EVENTS}"))
        .groupBy(*in_segment, "_block")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("split_start", "n_commands", "start_time", "end_time"))
            ).alias("_splits")
        )
    )
    sizes = F.col("_splits.n_commands")
    blocks = blocks.withColumn("_ends", fold_ends(sizes, least, step))
    if order.sliced:
        states = start_states(
            blocks.select(*in_segment, "_block", "_ends"), in_segment, "_block", "_ends"
        )
        blocks = join_by(blocks, states, (*in_segment, "_block"))
    else:
        by_block = W.partitionBy(*in_segment).orderBy("_block")

        def after(frame) -> Column:
            return F.aggregate(
                F.collect_list("_ends").over(frame), F.lit(0), lambda s, end: F.get(end, s)
            )

        blocks = blocks.withColumns(
            {
                "state": after(by_block.rowsBetween(W.unboundedPreceding, -1)),
                "end_state": after(
                    by_block.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
                ),
            }
        )
    rows = (
        blocks.withColumn("_pending", fold_path(sizes, F.col("state"), step))
        .select(
            *order.keys,
            "end_state",
            "_pending",
            F.posexplode("_splits").alias("_i", "_split"),
        )
        .select(
            *order.keys,
            "_split.*",
            "end_state",
            (F.get("_pending", F.col("_i")) == 0).alias("_opens"),
        )
    )
    rows = order.start(rows)
    last_open = F.max(F.when(F.col("_opens"), F.col("split_start")))
    rows = order.carry(rows, _last_open=Before(last_open, "max"))
    left_over = (
        (F.col("end_state") > 0)
        & (F.col("split_start") == F.col("_last_open"))
        & (F.col("split_start") > 0)
    )
    rows = rows.withColumn("_opens", (F.col("_opens") & ~left_over).cast("long"))
    rows = order.carry(rows, _before=Before(F.sum("_opens"), "sum"))
    rows = rows.withColumn(
        "chunk_index",
        (F.sum("_opens").over(order.so_far()) + F.col("_before") - 1).cast("long"),
    )
    # A merged chunk holds a bounded number of splits.
    chunk = W.partitionBy(*order.keys, "chunk_index")
    in_chunk = chunk.orderBy("split_start").rowsBetween(
        W.unboundedPreceding, W.unboundedFollowing
    )
    return rows.select(
        *order.keys,
        "split_start",
        "chunk_index",
        F.min("split_start").over(chunk).alias("chunk_start"),
        F.sum("n_commands").over(chunk).alias("n_commands"),
        F.first("start_time").over(in_chunk).alias("start_time"),
        F.last("end_time").over(in_chunk).alias("end_time"),
    )


def chunk_table(merged: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """One row per chunk: size, start and end in log order."""
    return merged.where(F.col("split_start") == F.col("chunk_start")).select(
        *keys, "chunk_index", "n_commands", "start_time", "end_time"
    )


def assign_chunks(
    events: DataFrame,
    order: LogOrder | None = None,
    max_commands: int = MAX_COMMANDS,
    gap_seconds: float = GAP_SECONDS,
    min_commands: int = MIN_COMMANDS,
) -> DataFrame:
    """Add ``chunk_index``, ``chunk_position`` (from 1) and the chunk's size
    and times to each event.

    The event table is read twice, for the chunk boundaries and for the
    result, so pass a stored table or only the columns that are needed.
    """
    order = order or choose_order(events)
    split = split_chunks(events, order, max_commands, gap_seconds)
    merged = merge_small(split_table(split, order), order, min_commands)
    position = F.col("event_index") - F.col("chunk_start") + 1
    return (
        join_by(split, merged, (*order.keys, "split_start"))
        .withColumn("chunk_position", position.cast("long"))
        .drop("split_start", "chunk_start")
    )


def number_events(events: DataFrame, order: LogOrder | None = None) -> DataFrame:
    """Add ``event_index``, the zero-based position in the session."""
    return number_rows(events, order or choose_order(events), "event_index")
