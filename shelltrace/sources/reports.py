"""Model requests, model responses and finished reports.

Calling a model is outside: prompts leave as a table of request bodies and
responses come back as a table of stream fragments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelltrace import schema as S
from shelltrace.functions import text as X
from shelltrace.operators.joins import join_by
from shelltrace.operators.ordered import Before, LogOrder, assemble, choose_order
from shelltrace.operators.render import MAX_PART_BYTES

# Request options.
TEMPERATURE = 0.3
KEEP_ALIVE = 0


def chat_request(model: Column, system: Column, user: Column) -> Column:
    """The JSON body of a streamed chat request."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.to_json(
        F.struct(
            F.lit(KEEP_ALIVE).alias("keep_alive"),
            F.array(message("system", system), message("user", user)).alias("messages"),
            model.alias("model"),
            F.struct(F.lit(TEMPERATURE).alias("temperature")).alias("options"),
            F.lit(True).alias("stream"),
        )
    )


def chat_requests(prompts: DataFrame) -> DataFrame:
    """Add ``request`` to prompts with ``model``, ``system`` and ``text``.

    A part of a prompt is no request; the ledger keeps parts together.
    """
    if "part" in prompts.columns:
        raise ValueError("prompts in parts are requests of plans.ledger")
    return prompts.withColumn(
        "request", chat_request(F.col("model"), F.col("system"), F.col("text"))
    )


def parse_fragments(lines: DataFrame) -> DataFrame:
    """Decode ``value`` into ``content`` and ``done``, keeping other columns.

    A fragment that is not valid stops the query: a response without it would
    pass for whole.
    """
    fragment = F.from_json("value", S.FRAGMENT, {"mode": "FAILFAST"})
    decoded = lines.withColumn("_f", fragment)
    return decoded.select(
        *[c for c in lines.columns if c != "value"],
        F.coalesce("_f.message.content", F.lit("")).alias("content"),
        F.coalesce("_f.done", F.lit(False)).alias("done"),
    )


def assemble_responses(
    fragments: DataFrame,
    max_part_bytes: int | None = MAX_PART_BYTES,
    order: LogOrder | None = None,
) -> DataFrame:
    """Join each response's fragments up to the first that is ``done``:
    ``(request_id, part, content, n_tokens)``.

    ``fragments`` has ``request_id, seq, content, done``.
    """
    order = order or choose_order(fragments, ("request_id",))
    first_done = F.min(F.when(F.col("done"), F.col(order.seq)))
    rows = order.carry(order.start(fragments), _end=Before(first_done, "min")).where(
        F.col("_end").isNull() | (F.col(order.seq) <= F.col("_end"))
    )
    rows = order.carry(rows, n_tokens=Before(F.count(F.lit(1)), "total"))
    return assemble(
        order.finish(rows), order, "content", max_part_bytes, keep=("n_tokens",)
    )


def render_reports(
    responses: DataFrame,
    sessions: DataFrame,
    generator: str = "shelltrace",
    generated_at: Column | None = None,
) -> DataFrame:
    """Report documents: a header line, a blank line and the response.

    ``responses`` is ``(session_id, part, content)``; the first part carries
    the header. A session without metadata has the version ``unknown``.
    """
    now = F.current_timestamp() if generated_at is None else generated_at
    header = F.concat(
        F.lit(f"<!-- Generated by {generator} "),
        F.coalesce("version", F.lit("unknown")),
        F.lit(" | Session "),
        F.coalesce("session_id", F.lit("")),
        F.lit(" | "),
        X.utc_seconds(now),
        F.lit(" -->\n\n"),
    )
    return join_by(
        responses, sessions.select("session_id", "version"), ["session_id"], "left"
    ).select(
        "session_id",
        "part",
        X.utc_seconds(now).alias("generated_at"),
        F.concat(
            F.when(F.col("part") == 0, header).otherwise(F.lit("")), "content"
        ).alias("body"),
    )


def write_reports(reports: DataFrame, path: str) -> None:
    reports.write.mode("append").parquet(path)
