"""Deduplication of lines by hashes of whole windows.

A run is a sequence of lines of one document, blank ones left out. A run of at
least ``min_words`` words that repeats an earlier run, in an earlier document
or further up in its own, is deleted; shorter repeats stay. Documents are in
order of id (null last), then of a hash of their text.

1. Lines are hashed without the blanks around them.
2. A window is the shortest run of at least ``min_words`` words that begins at
   a line, and likewise one that ends at a line. Every line keeps its windows;
   none is thinned out. A window is known by the hash of all its lines, and
   carries its smallest line hash along, which equal windows share.
3. Windows that are equal learn the first position of their equals; those that
   occur once are done.
4. Nothing is extended: the windows of all lines of a run together reach from
   its first to its last line, so the union of the repeated windows is the
   repeated runs, each as long as it matches.

The first copy of a line is never deleted, so no content is lost. Nothing is
done per pair of copies: a window learns the first position of its equals from
an aggregate, however many there are.

Nulls and corner cases: a null or empty text has no lines to delete and stays
as it is; lines within a deleted run that hold only blanks go with it; rows
that repeat a document's id and text are one document, and each is returned
with the same text. An empty table gives an empty result. Columns other than
those named are passed through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelltrace.llm.common import blank_words, text_key
from shelltrace.session import write_through

MIN_WORDS = 50
_BLANK = " \t\n\x0b\x0c\r"


def line_positions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines with words: ``id key pos hash words``, once per document."""
    lines = docs.select(
        docs[id_col].alias("id"),
        text_key(docs[text_col]).alias("key"),
        F.posexplode(F.split(docs[text_col], "\n")).alias("pos", "line"),
    )
    return (
        lines.select(
            "id",
            "key",
            "pos",
            F.xxhash64(F.trim("line", F.lit(_BLANK))).alias("hash"),
            F.size(blank_words(F.col("line"))).alias("words"),
        )
        .where("words > 0")
        .repartition("key", "id")
        .dropDuplicates(["key", "id", "pos"])
    )


def windows(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``id key first last print content``: windows with their fingerprints.

    ``content`` hashes the hashes of all lines of the window.
    """
    order = W.partitionBy("key", "id").orderBy("pos")
    running = F.sum("words").over(order.rowsBetween(W.unboundedPreceding, 0))
    reach = min_words - 1
    # Frames in words: lines that begin before the window is full, or end
    # after it has begun.
    down = W.partitionBy("key", "id").orderBy("begin").rangeBetween(0, reach)
    up = W.partitionBy("key", "id").orderBy("end").rangeBetween(-reach, 0)

    def over(frame) -> list[Column]:
        return [
            F.min("pos").over(frame).alias("first"),
            F.max("pos").over(frame).alias("last"),
            F.sum("words").over(frame).alias("n"),
            F.min(F.struct("hash", "pos")).over(frame)["hash"].alias("print"),
            F.xxhash64(F.collect_list("hash").over(frame)).alias("content"),
        ]

    placed = (
        lines.withColumn("end", running.cast("long"))
        .withColumn("begin", F.col("end") - F.col("words"))
        .withColumn("_down", F.struct(*over(down)))
        .withColumn("_up", F.struct(*over(up)))
    )
    both = F.inline(F.array_distinct(F.array("_down", "_up")))
    return (
        placed.select("id", "key", both)
        .where(F.col("n") >= min_words)
        .drop("n")
        .dropDuplicates(["key", "id", "first", "last"])
    )


def repeated_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """Runs to delete: ``id key runs``, sorted disjoint ``(first, last)`` lines."""
    found = write_through(
        windows(line_positions(docs, id_col, text_col), min_words), "line-windows"
    )
    place = F.struct(F.col("id").isNull().alias("last"), "id", "key", "first")
    firsts = (
        found.groupBy("print", "content")
        .agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place"))
        .where("n > 1")
    )
    # Written first: of two scans adaptive execution can split a common window.
    firsts = write_through(firsts, "line-firsts")
    later = (
        found.join(firsts, ["print", "content"])
        .where(place > F.col("place"))
        .select("id", "key", F.col("first"), F.col("last"))
    )
    order = W.partitionBy("key", "id").orderBy("first", "last")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    upto = F.max("last").over(earlier)
    begins = F.when(upto.isNull() | (F.col("first") > upto), 1).otherwise(0)
    return (
        later.withColumn("begins", begins)
        .withColumn(
            "run", F.sum("begins").over(order.rowsBetween(W.unboundedPreceding, 0))
        )
        .groupBy("key", "id", "run")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .groupBy("key", "id")
        .agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))
    )


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """``docs`` without repeated runs, and ``n_lines`` and ``n_deleted``.

    Where ``docs`` has columns of these names, they are replaced.
    """
    runs = repeated_runs(docs, id_col, text_col, min_words).select(
        F.col("id").alias("_id"), F.col("key").alias("_key"), "runs"
    )
    runs = runs.withColumnRenamed("runs", "_runs")
    lines = F.split(F.col(text_col), "\n")
    kept = F.filter(
        lines,
        lambda _, i: ~F.exists("_runs", lambda r: i.between(r["first"], r["last"])),
    )
    deleted = F.aggregate(
        "_runs", F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1
    )
    others = [c for c in docs.columns if c not in ("n_lines", "n_deleted")]
    return (
        docs.select(*others)
        .withColumn("_key2", text_key(F.col(text_col)))
        .join(
            runs,
            (F.col("_key2") == F.col("_key")) & F.col(id_col).eqNullSafe(F.col("_id")),
            "left",
        )
        .withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
        .withColumn("n_deleted", F.coalesce(deleted, F.lit(0)).cast("long"))
        .withColumn(
            text_col,
            F.when(F.col("_runs").isNull(), F.col(text_col)).otherwise(
                F.array_join(kept, "\n")
            ),
        )
        .select(*others, "n_lines", "n_deleted")
    )
