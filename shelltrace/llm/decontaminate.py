"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of consecutive words, a window into shingles. A
document that holds a window holds each of its shingles, so one of them finds
it: shingles are ordered by how often the documents hold them, and only the
rarest ones of a window, its prefix, are joined with the documents' shingles.
With ``containment`` below 1 the prefix has one shingle for each that may be
missing, and one more. A candidate must have room for the whole window around
the shingle (length and position), and is verified on the words themselves.

Nulls and corner cases: a null text has no words; an item of fewer words than
a window, but not none, is one window; items that share an id are one item;
the words of items with a null id are hit, but the items are not counted. Rows
that repeat a document are judged one by one. Ids keep their type. Columns
other than those named are ignored; an empty table of items hits nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelltrace.llm.common import bounded, compared_words, text_key
from shelltrace.session import write_through

WINDOW = 10
SHINGLE_WORDS = 5
#: A side of the joins is broadcast up to so many rows, of a window each.
BROADCAST_WINDOWS = 200_000


def _shingle(words: Column, at: Column, n: int) -> Column:
    """Hash of ``n`` words from position ``at``."""
    return F.xxhash64(F.lit(n), *[F.get(words, at + i) for i in range(n)])


def item_windows(
    items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """Distinct ``(item, win)``: the windows of each item, as arrays of words."""
    words = items.select(
        items[id_col].cast("string").alias("item"),
        compared_words(items[text_col]).alias("w"),
    ).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    return (
        words.select("item", "w", F.explode(starts).alias("s"))
        .select("item", F.slice("w", F.col("s") + 1, F.lit(window)).alias("win"))
        .distinct()
    )


def _positions(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """Each word position of each document, with its shingles' hashes.

    The words stay beside it without being copied, as long as no shuffle
    comes between.
    """
    at = F.explode(F.sequence(F.lit(0), F.size("w") - 1))
    docs = docs.select("*", at.alias("at"))
    keys = [_shingle(F.col("w"), F.col("at"), n) for n in lengths]
    if len(keys) == 1:
        return docs.withColumn("key", keys[0])
    return docs.withColumn("key", F.explode(F.array(*keys)))


def find_windows(
    docs: DataFrame,
    wins: DataFrame,
    containment: float = 1.0,
    shingle_words: int = SHINGLE_WORDS,
    text_col: str = "text",
) -> DataFrame:
    """Occurrences of windows: ``docs``' other columns, ``start``, ``size``, ``win``.

    ``wins`` has one row per distinct ``win``.
    """
    others = [c for c in docs.columns if c != text_col]
    length = F.least(F.size("win"), F.lit(shingle_words))
    shingles = wins.select(
        "win",
        length.alias("n"),
        F.explode(F.sequence(F.lit(0), F.size("win") - length)).alias("off"),
    )
    lengths = sorted(r[0] for r in shingles.select("n").distinct().collect())
    if not lengths:
        lengths = [shingle_words]
    key = F.coalesce(
        *[
            F.when(F.col("n") == n, _shingle(F.col("win"), F.col("off"), n))
            for n in lengths
        ]
    )
    shingles = write_through(shingles.withColumn("key", key), "item-shingles")
    small = bounded(shingles, BROADCAST_WINDOWS * 10)

    def held(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    texts = docs.select(*others, compared_words(docs[text_col]).alias("w")).where(
        F.size("w") > 0
    )
    positions = _positions(texts, lengths)
    # How often the documents hold each shingle.
    counts = (
        positions.select("key")
        .join(held(shingles.select("key").distinct()), "key", "left_semi")
        .groupBy("key")
        .count()
    )
    needed = F.ceil(F.col("m") * F.lit(containment)).cast("int")
    ranked = (
        shingles.join(held(counts), "key", "left")
        .groupBy("win")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        F.coalesce("count", F.lit(0)).alias("count"), "off", "key", "n"
                    )
                )
            ).alias("by_rarity"),
            F.count(F.lit(1)).alias("m"),
        )
    )
    # A window of which a needed shingle occurs nowhere cannot occur.
    possible = F.size(F.filter("by_rarity", lambda x: x["count"] > 0)) >= needed
    prefixes = write_through(
        ranked.where(possible)
        .select(
            "win",
            "m",
            F.inline(F.slice("by_rarity", F.lit(1), F.col("m") - needed + 1)),
        )
        .where("count > 0"),
        "item-prefixes",
    )
    start = F.col("at") - F.col("off")
    fits = (start >= 0) & (start + F.size("win") <= F.col("size_w"))
    if containment >= 1.0:
        def same(words: Column, at: Column) -> Column:
            return F.slice(words, at + 1, F.size("win")) == F.col("win")
    else:
        def same(words: Column, at: Column) -> Column:
            agree = F.filter(
                F.sequence(F.lit(0), (F.col("m") - 1).cast("int")),
                lambda i: F.slice(words, at + i + 1, F.col("n"))
                == F.slice("win", i + 1, F.col("n")),
            )
            return F.size(agree) >= needed

    positions = positions.withColumn("size_w", F.size("w"))
    prefixes = prefixes.select("key", "off", "win", "n", "m")
    if small and bounded(prefixes, BROADCAST_WINDOWS):
        found = positions.join(F.broadcast(prefixes), "key").where(
            fits & F.when(fits, same(F.col("w"), start))
        )
    else:
        # The words around a position go through the shuffle, not the text.
        reach = wins.agg(F.coalesce(F.max(F.size("win")), F.lit(1))).first()[0]
        low = F.greatest(F.col("at") - reach, F.lit(0))
        near = positions.select(
            *others,
            "at",
            "key",
            "size_w",
            low.alias("low"),
            F.slice("w", low + 1, F.lit(2 * reach)).alias("near"),
        )
        found = near.join(prefixes, "key").where(
            fits & F.when(fits, same(F.col("near"), start - F.col("low")))
        )
    return found.select(
        *others, start.alias("start"), F.size("win").alias("size"), "win"
    )


def covered(spans: Column) -> Column:
    """Words in the union of ``spans``, a sorted array of ``(start, end)``."""
    state = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    return F.aggregate(
        spans,
        state,
        lambda s, x: F.struct(
            (
                s["n"] + F.greatest(x["end"] - F.greatest(x["start"], s["upto"]), F.lit(0))
            ).alias("n"),
            F.greatest(x["end"], s["upto"]).alias("upto"),
        ),
        lambda s: s["n"].cast("long"),
    )


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    containment: float = 1.0,
) -> DataFrame:
    """Per document: ``id text_key n_words n_hit n_items items contaminated``.

    ``items`` lists the ids, as strings in order, of the items with a window
    in the document.
    """
    pairs = write_through(item_windows(items, item_id, item_text, window), "item-windows")
    wins = pairs.select("win").distinct()
    keyed = docs.select(
        docs[id_col].alias("id"),
        text_key(docs[text_col]).alias("text_key"),
        docs[text_col].alias("text"),
    )
    found = find_windows(keyed, wins, containment)
    found = found.groupBy("id", "text_key").agg(
        F.sort_array(
            F.collect_set(
                F.struct("start", (F.col("start") + F.col("size")).alias("end"))
            )
        ).alias("spans"),
        F.collect_set("win").alias("wins"),
    )
    found = write_through(
        found.select("id", "text_key", covered(F.col("spans")).alias("n_hit"), "wins"),
        "contaminated",
    )
    named = (
        found.select("id", "text_key", F.explode("wins").alias("win"))
        .join(pairs.where("item is not null"), "win")
        .groupBy("id", "text_key")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    hits = found.drop("wins").alias("f").join(
        named.alias("n"),
        F.col("f.id").eqNullSafe(F.col("n.id"))
        & (F.col("f.text_key") == F.col("n.text_key")),
        "left",
    ).select(
        F.col("f.id").alias("_id"), F.col("f.text_key").alias("_key"), "n_hit", "items"
    )
    counted = keyed.select(
        "id", "text_key", F.size(compared_words(F.col("text"))).cast("long").alias("n_words")
    )
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    return counted.join(
        hits,
        F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")),
        "left",
    ).select(
        "id",
        "text_key",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items_found).cast("long").alias("n_items"),
        items_found.alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
