"""From recorded events to the prompts and reports of many sessions.

Wide rows (command output) are shuffled by ``(session_id, seq)`` and by
``(session_id, chunk_index)`` only, so a session holding a large share of the
table does not load one task. Log order is worked out on a narrow table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelltrace.operators import render, templates
from shelltrace.operators.clean import clean_events
from shelltrace.operators.detect import detect_sessions
from shelltrace.operators.joins import join_by, join_by_session
from shelltrace.operators.ordered import Before, LogOrder, assemble, choose_order
from shelltrace.operators.preprocess import process_events
from shelltrace.operators.sequence import (
    GAP_SECONDS,
    MAX_COMMANDS,
    MIN_COMMANDS,
    assign_chunks,
    content_key,
    dedup_consecutive,
)
from shelltrace.session import cut_lineage, write_through

# When a session is reported in chunks, and the default context.
CHUNK_THRESHOLD = 15
DEFAULT_CONTEXT = "General terminal session"

SUMMARY_SYSTEM = """You condense one part of a recorded terminal session.
Write a single paragraph of three to five sentences that covers the tools used
and their targets, the results obtained, errors, and any sensitive data seen.
Mention nothing that the record does not show."""

# Rows of one prompt's text; the command list may occur more than once.
_OCCURRENCE = 1 << 44


@dataclass(frozen=True)
class ReportPlan:
    """The tables a report is made of, one row per session or chunk."""

    sessions: DataFrame
    """``session_id, started_at, template, system, route, n_events``"""
    direct_prompts: DataFrame
    """``session_id, part, system, text``"""
    chunk_prompts: DataFrame
    """``session_id, chunk_index, system, text``"""
    chunks: DataFrame
    """``session_id, chunk_index, n_commands, start_time, end_time``"""
    context: str
    max_part_bytes: int
    order: LogOrder

    def final_prompts(self, summaries: DataFrame) -> DataFrame:
        """``session_id, part, system, text`` from the chunk summaries."""
        chunks = render.join_summaries(self.chunks, summaries)
        prompts = render.final_prompts(
            chunks, self.sessions, self.context, self.max_part_bytes, self.order
        )
        return join_by(prompts, self.sessions.select("session_id", "system"), ["session_id"])


def plan_reports(
    events: DataFrame,
    sessions: DataFrame,
    context: str = "",
    template: str | None = None,
    chunk_size: int = MAX_COMMANDS,
    gap_seconds: float = GAP_SECONDS,
    min_commands: int = MIN_COMMANDS,
    max_part_bytes: int = render.MAX_PART_BYTES,
) -> ReportPlan:
    """Plan the reports of every session in ``events``.

    Raw events are filtered, redacted, preprocessed and stored once; sessions
    left without events get no report.
    """
    cleaned = clean_events(events)
    processed = write_through(
        process_events(cleaned)
        .withColumn("content_key", content_key())
        .drop("stdout", "stderr"),
        "processed",
    )
    return plan_processed(
        processed,
        sessions,
        context,
        template,
        chunk_size,
        gap_seconds,
        min_commands,
        max_part_bytes,
    )


def plan_processed(
    processed: DataFrame,
    sessions: DataFrame,
    context: str = "",
    template: str | None = None,
    chunk_size: int = MAX_COMMANDS,
    gap_seconds: float = GAP_SECONDS,
    min_commands: int = MIN_COMMANDS,
    max_part_bytes: int = render.MAX_PART_BYTES,
    order: LogOrder | None = None,
) -> ReportPlan:
    """Plan reports from a stored table of processed, redacted events."""
    context = context or DEFAULT_CONTEXT
    if "content_key" not in processed.columns:
        processed = processed.withColumn("content_key", content_key())
    narrow = processed.select("session_id", "seq", "ts", "repeat_count", "content_key")
    order = order or choose_order(narrow)
    kept = dedup_consecutive(narrow, order, same=("content_key",)).drop("content_key")
    kept = order.finish(
        order.carry(
            order.start(kept), n_events=Before(F.count(F.lit(1)), "total")
        )
    )
    kept = cut_lineage(kept)

    is_chunked = (
        F.col("n_events") >= CHUNK_THRESHOLD if chunk_size > 0 else F.lit(False)
    )
    types = templates.choose_templates(
        detect_sessions(processed), template
    )
    routed = (
        kept.groupBy("session_id")
        .agg(F.count(F.lit(1)).alias("n_events"))
        .withColumn(
            "route", F.when(is_chunked, F.lit("chunked")).otherwise(F.lit("direct"))
        )
    )
    session_plan = cut_lineage(
        join_by(
            templates.with_template(join_by(routed, types, ["session_id"])),
            sessions.select("session_id", "started_at"),
            ["session_id"],
            "left",
        ).fillna("", ["started_at"])
    )

    wide = processed.select(
        "session_id",
        "seq",
        "cwd",
        "stdin",
        "exit_code",
        "duration_ms",
        "processed_stdout",
    )
    chunked = cut_lineage(
        assign_chunks(
            kept.where(is_chunked).drop("n_events"),
            order,
            chunk_size,
            gap_seconds,
            min_commands,
        ).drop("ts")
    )
    chunks = chunked.where("chunk_position = 1").select(
        "session_id", "chunk_index", "n_commands", "start_time", "end_time"
    )
    chunk_prompts = render.chunk_prompts(
        join_by(wide, chunked, ["session_id", "seq"])
    ).withColumn("system", F.lit(SUMMARY_SYSTEM))

    # Numbered before commands and output are joined to them.
    direct = render.number_events(kept.where(~is_chunked).drop("ts"), order)
    bounded = chunk_size > 0
    direct_prompts = _direct_prompts(
        join_by(wide, direct, ["session_id", "seq"]),
        session_plan.where("route = 'direct'"),
        context,
        order,
        None if bounded else max_part_bytes,
    )
    return ReportPlan(
        session_plan,
        direct_prompts,
        chunk_prompts,
        chunks,
        context,
        max_part_bytes,
        order,
    )


def _direct_prompts(events, session_plan, context, order, max_part_bytes):
    """User templates filled with metadata and the command list."""
    values = {
        "Context": F.lit(context),
        "SessionID": F.coalesce("session_id", F.lit("")),
        "StartedAt": F.col("started_at"),
        "CommandCount": F.col("n_events").cast("string"),
    }
    line = render.command_line(F.col("event_index") + 1)
    names = templates.list_templates()
    sections = {
        n: templates.around_commands(templates.get_template(n).user) for n in names
    }
    most_lists = max(len(s) for s in sections.values()) - 1
    # Literal text: one row per section of the session's template.
    around = F.lit(None).cast("array<string>")
    for name in names:
        texts = F.array(*[templates.fill(p, values) for p in sections[name]])
        around = F.when(F.col("template") == name, texts).otherwise(around)
    literals = session_plan.select(
        "session_id", F.posexplode(around).alias("_section", "text")
    ).select(
        "session_id",
        (F.col("_section").cast("long") * F.lit(_OCCURRENCE)).alias("seq"),
        "text",
    )
    # Command lines: once per occurrence of the list in the template.
    lists = {n: len(s) - 1 for n, s in sections.items()}
    lines = events.select(
        "session_id", (F.col("event_index") + 1).alias("_at"), line.alias("text")
    )
    if most_lists == 1 and min(lists.values()) == 1:
        lines = lines.withColumn("seq", F.col("_at"))
    else:
        occurrences = F.create_map(
            *[F.lit(v) for pair in lists.items() for v in pair]
        )
        per_session = session_plan.select(
            "session_id", occurrences[F.col("template")].alias("_lists")
        ).where("_lists > 0")
        lines = (
            join_by_session(lines, per_session, spread="_at")
            .withColumn(
                "_list", F.explode(F.sequence(F.lit(0), F.col("_lists") - 1))
            )
            .withColumn(
                "seq", F.col("_list").cast("long") * F.lit(_OCCURRENCE) + F.col("_at")
            )
        )
    rows = literals.unionByName(lines.select("session_id", "seq", "text"))
    text = assemble(rows, order.by("seq"), "text", max_part_bytes)
    return join_by(text, session_plan.select("session_id", "system"), ["session_id"])
