"""Command lists and prompts as ordered text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelltrace.functions import text as X
from shelltrace.operators.joins import join_by, join_by_session
from shelltrace.operators.ordered import LogOrder, assemble, choose_order
from shelltrace.operators.sequence import number_events

# Documents longer than this are emitted in several parts.
MAX_PART_BYTES = 64 * 1024 * 1024

# Formats of the rendered texts, here and the headers of command
# lines, chunks, sessions and phases below.
_FORMATS = {
    "failed": "!",
    "passed": " ",
    "output": "--- output ---\n",
    "end_output": "--- end output ---\n",
}


def _s(value: Column) -> Column:
    return value.cast("string")


def command_line(number: Column, with_repeats: bool = True) -> Column:
    """One command with its output block, numbered ``number``."""
    marker = F.when(F.col("exit_code") != 0, F.lit(_FORMATS["failed"])).otherwise(
        F.lit(_FORMATS["passed"])
    )
    repeated = F.when(
        F.col("repeat_count") > 1,
        F.concat(F.lit(" (repeated "), _s(F.col("repeat_count")), F.lit("x)")),
    ).otherwise(F.lit(""))
    output = F.col("processed_stdout")
    line_end = F.when(output.endswith("\n"), F.lit("")).otherwise(F.lit("\n"))
    block = F.when(output == "", F.lit("")).otherwise(
        F.concat(
            F.lit(_FORMATS["output"]), output, line_end, F.lit(_FORMATS["end_output"])
        )
    )
    return F.concat(
        F.lit("#"),
        _s(number),
        F.lit(" "),
        marker,
        F.lit("["),
        _s(F.col("exit_code")),
        F.lit(" | "),
        _s(F.col("duration_ms")),
        F.lit("ms | "),
        F.col("cwd"),
        F.lit("] "),
        F.col("stdin"),
        *([repeated] if with_repeats else []),
        F.lit("\n"),
        block,
    )


def command_lists(
    events: DataFrame,
    order: LogOrder | None = None,
    max_part_bytes: int | None = MAX_PART_BYTES,
) -> DataFrame:
    """The numbered command list of each session: ``(session_id, part, text)``."""
    order = order or choose_order(events)
    numbered = number_events(events, order)
    rendered = numbered.select(
        *order.keys,
        order.seq,
        command_line(F.col("event_index") + 1).alias("text"),
    )
    return assemble(rendered, order, "text", max_part_bytes)


def chunk_prompts(chunked_events: DataFrame) -> DataFrame:
    """The prompt of each chunk: ``(session_id, chunk_index, text)``.

    Chunk sizes are bounded, so a chunk is assembled in one group.
    """
    lines = chunked_events.select(
        "session_id",
        "chunk_index",
        "n_commands",
        "start_time",
        "end_time",
        "chunk_position",
        command_line(F.col("chunk_position"), with_repeats=False).alias("line"),
    )
    header = F.concat(
        F.lit("Chunk "),
        _s(F.col("chunk_index") + 1),
        F.lit(" ("),
        _s(F.col("n_commands")),
        F.lit(" commands, "),
        X.clock(F.col("start_time")),
        F.lit(" - "),
        X.clock(F.col("end_time")),
        F.lit("):\n\n"),
    )
    first = F.when(F.col("chunk_position") == 1, header).otherwise(F.lit(""))
    return (
        lines.select(
            "session_id",
            "chunk_index",
            "chunk_position",
            F.concat(first, "line").alias("text"),
        )
        .groupBy("session_id", "chunk_index")
        .agg(
            F.expr(
                "listagg(text, '') within group (order by chunk_position)"
            ).alias("text")
        )
    )


def join_summaries(chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """Attach each chunk's trimmed ``summary``, null where there is none."""
    trimmed = summaries.select(
        "session_id", "chunk_index", X.trim_space(F.col("summary")).alias("summary")
    )
    return join_by(chunks, trimmed, ["session_id", "chunk_index"], "left")


def final_prompts(
    chunks: DataFrame,
    sessions: DataFrame,
    context: str,
    max_part_bytes: int | None = MAX_PART_BYTES,
    order: LogOrder | None = None,
) -> DataFrame:
    """The report prompt from chunk summaries: ``(session_id, part, text)``.

    ``chunks`` has ``summary``; ``sessions`` has ``started_at``. A session that
    lacks a summary has no prompt.
    """
    order = (order or choose_order(chunks, seq="position")).by("position")
    totals = (
        chunks.groupBy("session_id")
        .agg(
            F.sum("n_commands").alias("total"),
            F.count(F.lit(1)).alias("n_chunks"),
            F.count("summary").alias("_n_summaries"),
        )
        .where("n_chunks = _n_summaries")
    )
    chunks = join_by_session(
        chunks, totals.select("session_id"), "left_semi", spread="chunk_index"
    )
    headers = join_by(
        totals, sessions.select("session_id", "started_at"), ["session_id"]
    ).select(
        "session_id",
        F.lit(0).cast("long").alias("position"),
        F.concat(
            F.lit("Context: "),
            F.lit(context),
            F.lit("\n\nSession: "),
            F.coalesce("session_id", F.lit("")),
            F.lit(" | Started: "),
            F.col("started_at"),
            F.lit(" | Total commands: "),
            _s(F.col("total")),
            F.lit(" | Chunks: "),
            _s(F.col("n_chunks")),
            F.lit("\n\n"),
        ).alias("text"),
    )
    phases = chunks.select(
        "session_id",
        (F.col("chunk_index") + 1).alias("position"),
        F.concat(
            F.lit("Phase "),
            _s(F.col("chunk_index") + 1),
            F.lit(" ("),
            X.clock(F.col("start_time")),
            F.lit(" - "),
            X.clock(F.col("end_time")),
            F.lit(", "),
            _s(F.col("n_commands")),
            F.lit(" commands):\n"),
            F.col("summary"),
            F.lit("\n\n"),
        ).alias("text"),
    )
    return assemble(headers.unionByName(phases), order, "text", max_part_bytes)
