"""From raw documents to a training mix: one function per stage.

A stage takes ``(spark, docs, sf_dir)``; ``docs`` is what its predecessor
wrote. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelltrace.llm import decontaminate, lines, mix, near, toxic  # noqa: E402
from shelltrace.llm.common import text_key  # noqa: E402
from shelltrace.session import write_through  # noqa: E402


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic."""
    judged = toxic.toxicity(docs, _table(spark, sf_dir, "labels"))
    return judged.where(~F.col("toxic")).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated runs of lines, if anything is left of them.

    ``n_chars`` is that of the new text.
    """
    done = lines.dedup_lines(docs)
    words_left = F.trim("text", F.lit(" \t\n\x0b\x0c\r")) != ""
    return done.where((F.col("n_deleted") == 0) | words_left).select(
        *[
            F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col(c)).alias(c)
            if c == "n_chars"
            else c
            for c in docs.columns
        ]
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the first by id, then by text.

    Of rows that repeat id and text one is left. Documents without words are
    no duplicates of each other.
    """
    found = near.near_duplicates(docs)
    wordless = F.col("n_shingles") == 0
    # Ids repeat and may be null, so the text's key belongs to the component's.
    first = F.col("id").eqNullSafe(F.col("component_id")) & (
        F.col("text_key") == F.col("component_key")
    )
    kept = (
        found.where(wordless | first)
        .select(
            F.col("id").alias("_id"),
            F.col("text_key").alias("_key"),
            wordless.alias("_wordless"),
        )
        .distinct()
    )
    kept = write_through(kept, "kept-documents")
    rows = docs.withColumn("_key2", text_key(F.col("text"))).join(
        kept,
        (F.col("_key2") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")),
    )
    # Repeated rows differ in nothing that tells them apart, so any one stays.
    once = rows.where(~F.col("_wordless")).dropDuplicates(["_key2", "doc_id"])
    return once.union(rows.where("_wordless")).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    found = decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark"))
    hit = found.where("contaminated").select(
        F.col("id").alias("_id"), F.col("text_key").alias("_key")
    )
    return (
        docs.withColumn("_key2", text_key(F.col("text")))
        .join(
            hit,
            (F.col("_key2") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")),
            "left_anti",
        )
        .select(docs.columns)
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the words that the mix takes of it, and its source's target."""
    taken = mix.Mix(docs).taken()
    return taken.withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
]

#: A fitted classifier and pseudorandom draws are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_through(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
