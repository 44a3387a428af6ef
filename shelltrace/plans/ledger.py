"""Requests to a model, their answers, and what became of each session.

Every request has a key, and its body leaves with it. A body longer than a
part leaves as several rows, ``offset`` telling where each piece belongs in the
body's bytes; the pieces in order are the body. Answers come back as fragments
under the same key. A request is

* ``whole`` when every fragment up to the first that is ``done``, or to the
  last where none is, is valid;
* ``broken`` when one of these is not;
* ``missing`` when it has no fragment at all.

One broken answer so fails its own request, and with it its session, and no
other. Fragments are counted per request before anything is joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelltrace.operators.joins import join_by
from shelltrace.operators.ordered import LogOrder
from shelltrace.plans.report import ReportPlan
from shelltrace.session import write_through
from shelltrace.sources import reports

_KEY = ("session_id", "kind", "position")
_FILE = "request_id string, part bigint, n_parts bigint, offset bigint, body string"


def request_id(session_id: Column, kind: Column, position: Column) -> Column:
    """The key of a request; a session without an id has keys of its own."""
    return F.concat_ws(":", kind, position.cast("string"), session_id)


def _escaped(text: Column) -> Column:
    """``text`` as it stands between the quotes of a JSON string."""
    whole = F.to_json(F.struct(text.alias("x")))
    return F.substring(whole, F.lit(7), F.length(whole) - 8)


def requests(prompts: DataFrame, model: Column) -> DataFrame:
    """Bodies of ``prompts``: ``request_id session_id kind position part
    n_parts offset body``.

    ``prompts`` has ``session_id, kind, position, part, system, text``.
    """
    # The text is a string like any other, so a body is cut around it.
    mark = "\x00"
    body = reports.chat_request(model, F.col("system"), F.lit(mark))
    around = F.split(body, r"\\u0000")
    rows = write_through(
        prompts.select(
            request_id(F.col("session_id"), F.col("kind"), F.col("position")).alias("request_id"),
            *_KEY,
            "part",
            around[0].alias("head"),
            _escaped(F.col("text")).alias("piece"),
            F.get(around, F.lit(1)).alias("tail"),
        ),
        "request-pieces",
    )
    # Parts of a request are bounded in size, and so few; their texts stay out.
    of_request = W.partitionBy("request_id")
    before = of_request.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    is_last = F.col("part") == F.col("n_parts") - 1
    sized = (
        rows.select(
            "request_id", "part", F.octet_length("piece").cast("long").alias("size"),
            F.octet_length("head").cast("long").alias("head_size"),
        )
        .withColumn("n_parts", F.count(F.lit(1)).over(of_request))
        .withColumn("_before", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .select(
            "request_id",
            "part",
            "n_parts",
            F.when(F.col("part") > 0, F.col("_before") + F.col("head_size"))
            .otherwise(F.lit(0))
            .alias("offset"),
        )
    )
    joined = join_by(rows, sized, ("request_id", "part"))
    return joined.select(
        "request_id",
        *_KEY,
        "part",
        "n_parts",
        "offset",
        F.concat(
            F.when(F.col("part") == 0, F.col("head")).otherwise(F.lit("")),
            "piece",
            F.when(is_last, F.col("tail")).otherwise(F.lit("")),
        ).alias("body"),
    )


def write_requests(rows: DataFrame, path: str) -> None:
    """One JSON object per line: the key, the piece and where it belongs."""
    rows.select("request_id", "part", "n_parts", "offset", "body").write.mode("append").json(path)


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """The written pieces."""
    return spark.read.schema(_FILE).json(path)


def stitched(pieces: DataFrame) -> DataFrame:
    """``request_id body``, for a sender that can hold a whole body."""
    return pieces.groupBy("request_id").agg(
        F.expr("listagg(body, '') within group (order by offset)").alias("body")
    )


def checked_fragments(lines: DataFrame) -> DataFrame:
    """Decode ``value`` into ``content``, ``done`` and ``valid``."""
    json = F.try_parse_json("value")

    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(json, path, "variant"))

    def fits(path: str, *kinds: str) -> Column:
        found = kind(path)
        return found.isNull() | found.isin("VOID", *kinds) | (
            found.startswith("OBJECT<") if "OBJECT" in kinds else F.lit(False)
        )

    valid = (
        json.isNotNull()
        & fits("$", "OBJECT")
        & fits("$.message", "OBJECT")
        & fits("$.message.content", "STRING")
        & fits("$.done", "BOOLEAN")
    )
    return lines.select(
        *[c for c in lines.columns if c != "value"],
        F.coalesce(valid, F.lit(False)).alias("valid"),
        F.coalesce(F.try_variant_get(json, "$.message.content", "string"), F.lit("")).alias(
            "content"
        ),
        F.coalesce(F.try_variant_get(json, "$.done", "boolean"), F.lit(False)).alias("done"),
    )


@dataclass(frozen=True)
class Answers:
    """Requests with what came back for them."""

    statuses: DataFrame
    """``request_id session_id kind position status n_fragments``"""
    contents: DataFrame
    """``request_id session_id kind position part content`` of whole answers"""
    strays: DataFrame
    """``request_id n_fragments`` of answers that nobody asked for"""


def match_answers(
    asked: DataFrame, lines: DataFrame, order: LogOrder | None = None
) -> Answers:
    """Join requests to the fragments in ``lines``, ``request_id seq value``."""
    keys = asked.select("request_id", *_KEY).distinct()
    fragments = write_through(checked_fragments(lines), "fragments")
    found = fragments.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_fragments"),
        F.min(F.when(F.col("valid") & F.col("done"), F.col("seq"))).alias("_done"),
        F.min(F.when(~F.col("valid"), F.col("seq"))).alias("_bad"),
    )
    broken = F.col("_bad").isNotNull() & (
        F.col("_done").isNull() | (F.col("_bad") < F.col("_done"))
    )
    status = (
        F.when(F.col("n_fragments").isNull(), "missing")
        .when(F.coalesce(broken, F.lit(False)), "broken")
        .otherwise("whole")
    )
    matched = write_through(
        keys.withColumn("_asked", F.lit(True))
        .join(found, "request_id", "full")
        .withColumn("status", status),
        "answers",
    )
    statuses = matched.where("_asked").select(
        "request_id",
        *_KEY,
        "status",
        F.coalesce("n_fragments", F.lit(0).cast("long")).alias("n_fragments"),
    )
    whole = statuses.where("status = 'whole'").select("request_id", *_KEY)
    # Two written tables, so a request with very many fragments can be split.
    usable = fragments.where("valid").join(whole.select("request_id"), "request_id", "left_semi")
    contents = reports.assemble_responses(usable, order=order).drop("n_tokens")
    return Answers(
        statuses,
        contents.join(whole, "request_id"),
        matched.where("_asked is null").select("request_id", "n_fragments"),
    )


def first_requests(plan: ReportPlan, model: Column) -> DataFrame:
    """Chunk summaries, and reports of sessions short enough for one prompt."""
    columns = [*_KEY, "part", "system", "text"]
    chunks = plan.chunk_prompts.withColumns(
        {
            "kind": F.lit("chunk"),
            "position": F.col("chunk_index"),
            "part": F.lit(0).cast("long"),
        }
    ).select(columns)
    direct = plan.direct_prompts.withColumns(
        {"kind": F.lit("direct"), "position": F.lit(0).cast("long")}
    ).select(columns)
    return requests(chunks.unionByName(direct), model)


def final_requests(plan: ReportPlan, answers: Answers, model: Column) -> DataFrame:
    """Reports from the chunk summaries, where a session has all of them."""
    summaries = (
        answers.contents.where("kind = 'chunk'")
        .groupBy("session_id", F.col("position").alias("chunk_index"))
        .agg(F.expr("listagg(content, '') within group (order by part)").alias("summary"))
    )
    final = plan.final_prompts(summaries).withColumns(
        {"kind": F.lit("final"), "position": F.lit(0).cast("long")}
    )
    return requests(final.select(*_KEY, "part", "system", "text"), model)


def report_contents(first: Answers, final: Answers) -> DataFrame:
    """``session_id part content`` of every report that came back whole."""
    columns = ["session_id", "part", "content"]
    direct = first.contents.where("kind = 'direct'").select(columns)
    return direct.unionByName(final.contents.select(columns))


def outcomes(plan: ReportPlan, sessions: DataFrame, first: Answers, final: Answers) -> DataFrame:
    """``session_id route outcome position n_requests n_whole`` per session.

    ``outcome`` is ``reported``, ``no metadata``, or the kind and the status of
    the first request that failed, whose ``position`` is given.
    """
    every = first.statuses.unionByName(final.statuses)
    failed = F.when(F.col("status") != "whole", F.struct("position", "kind", "status"))
    counts = every.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.count_if(F.col("status") == "whole").alias("n_whole"),
        F.min(failed).alias("_failed"),
    )
    known = sessions.select("session_id", F.lit(True).alias("_known")).distinct()
    rows = join_by(plan.sessions.select("session_id", "route"), counts, ["session_id"], "left")
    rows = join_by(rows, known, ["session_id"], "left")
    return rows.select(
        "session_id",
        "route",
        F.when(F.col("_known").isNull(), "no metadata")
        .when(F.col("_failed").isNull(), "reported")
        .otherwise(F.concat_ws(" ", "_failed.kind", "_failed.status"))
        .alias("outcome"),
        F.col("_failed.position").alias("position"),
        F.coalesce("n_requests", F.lit(0)).cast("long").alias("n_requests"),
        F.coalesce("n_whole", F.lit(0)).cast("long").alias("n_whole"),
    )
