"""Importance resampling towards a target distribution.

1. Features are runs of words, hashed to buckets. Their counts over all
   documents and over the target's texts give each bucket a gain, the scaled
   logarithm of the ratio of its smoothed shares.
2. The gains are one array, fixed in size by the number of buckets. The weight
   of a document is the floored mean of the gains of its features; with noise
   (Gumbel, from a digest of the id) the highest scores are a weighted draw
   without replacement.
3. Scores are written as a table. Its cutoff is found by bisection: a job
   counts the rows between the thresholds of several halvings, exactly, and
   the next one goes on in the interval that holds the cutoff. Rows that tie
   at the cutoff are cut off in the same way by id, then by text, then by
   row, so that exactly as many are drawn as are asked for.
4. The drawn rows are partitioned by ranges of the score; ranks are places
   within a range after the sizes of the ranges before. All other rows are
   passed by the cutoff alone, so nothing is joined.

No row, key or source is ever gathered: counts are aggregated before they are
shuffled, and the shuffle by ranges has rows of four numbers, ordered by a key
that no two rows share.

Nulls and corner cases: a null or empty text has no features and the weight 0;
ids are integers, a null id is drawn after the others that tie; rows that
repeat an id are drawn one by one, and rows that are equal are
interchangeable; an empty table of documents gives an empty result, an empty
target gives every bucket the gain of an unseen feature. Columns other than
those named are ignored.
"""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelltrace.llm.common import compared_words, positions, text_key
from shelltrace.session import write_through

BUCKETS = 10_000
LONGEST_RUN = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
SCALE = 1000
#: Thresholds whose counts one job takes: so many halvings at once.
HALVINGS = 6
#: In place of a null id, behind all others.
_LAST = (1 << 63) - 1


def feature_buckets(
    text: Column, longest: int = LONGEST_RUN, buckets: int = BUCKETS
) -> Column:
    """Buckets of all runs of 1 to ``longest`` words, repeats counted."""
    def bucket(feature: Column) -> Column:
        return F.pmod(F.crc32(feature), F.lit(buckets)).cast("int")

    def runs(words: Column, n: int) -> Column:
        if n == 1:
            return F.transform(words, bucket)
        starts = F.filter(
            F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))),
            lambda i: i + (n - 1) <= F.size(words),
        )
        return F.transform(starts, lambda i: bucket(F.array_join(F.slice(words, i, n), " ")))

    if longest == 1:
        return runs(compared_words(text), 1)
    # An array of one, so that the words are made once and not for every run.
    return F.flatten(
        F.transform(
            F.array(compared_words(text)),
            lambda words: F.concat(*[runs(words, n) for n in range(1, longest + 1)]),
        )
    )


def bucket_counts(rows: DataFrame, text_col: str, longest: int, buckets: int) -> dict[int, int]:
    """Features of all ``rows`` by bucket; at most ``buckets`` entries."""
    found = rows.select(
        F.explode(feature_buckets(F.col(text_col), longest, buckets)).alias("bucket")
    )
    return dict(map(tuple, found.groupBy("bucket").count().collect()))


def bucket_gains(
    docs: dict[int, int], target: dict[int, int], buckets: int = BUCKETS
) -> list[int]:
    """The gain of each bucket."""
    all_docs, all_target = sum(docs.values()) + buckets, sum(target.values()) + buckets

    def gain(b: int) -> int:
        ratio = float((target.get(b, 0) + 1) * all_docs) / float((docs.get(b, 0) + 1) * all_target)
        return math.floor(SCALE * math.log(ratio))

    return [gain(b) for b in range(buckets)]


def _floor_div(a: Column, b: Column) -> Column:
    """Whole quotient towards minus infinity; ``b`` is positive."""
    return ((a - F.pmod(a, b)) / b).cast("long")


def noise(id_: Column, seed: int) -> Column:
    """Scaled Gumbel noise from a digest of ``seed`` and the id."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / float(1 << 32))))


def scores(
    docs: DataFrame,
    gains: list[int],
    id_col: str = "doc_id",
    text_col: str = "text",
    longest: int = LONGEST_RUN,
    seed: int = SEED,
) -> DataFrame:
    """``id text_key n_features n_words weight score`` per row."""
    # One string is a smaller plan than as many numbers.
    table = F.split(F.lit(" ".join(map(str, gains))), " ").cast("array<long>")
    rows = docs.select(
        docs[id_col].cast("long").alias("id"),
        text_key(docs[text_col]).alias("text_key"),
        feature_buckets(docs[text_col], longest, len(gains)).alias("_b"),
        *([F.size(compared_words(docs[text_col])).alias("n_words")] if longest > 1 else []),
    )
    n = F.size("_b").cast("long")
    total = F.aggregate(
        "_b", F.lit(0).cast("long"), lambda sum_, b: sum_ + F.get(table, b)
    )
    rows = rows.select(
        "id",
        "text_key",
        n.alias("n_features"),
        (F.col("n_words") if longest > 1 else n).cast("long").alias("n_words"),
        F.when(n > 0, _floor_div(total, n)).otherwise(F.lit(0)).cast("long").alias("weight"),
    )
    return rows.withColumn("score", F.col("weight") + noise(F.col("id"), seed))


def _cut(rows: DataFrame, key: str, need: int) -> tuple[int, int]:
    """The ``need``-th smallest value of ``key`` and how many rows are below it.

    ``rows`` has at least ``need`` rows, and ``need`` is positive.
    """
    low, high = rows.agg(F.min(key), F.max(key)).first()
    below = 0
    while low < high:
        width = -(-(high - low + 1) // (1 << HALVINGS))
        part = F.expr(f"cast((cast({key} as decimal(38,0)) - {low}) div {width} as int)")
        inside = rows.where(F.col(key).between(low, high))
        counts = dict(map(tuple, inside.groupBy(part.alias("part")).count().collect()))
        for at in sorted(counts):
            if below + counts[at] >= need:
                break
            below += counts[at]
        low, high = low + at * width, min(high, low + (at + 1) * width - 1)
    return low, below


def drawn(scored: DataFrame, need: int) -> Column:
    """Whether a row of ``scored`` is among the first ``need``.

    ``scored`` is a written table with ``place`` numbers, smaller ones first,
    in the order of :data:`ORDER`; the last of them differs from row to row.
    """
    if need <= 0:
        return F.lit(False)
    rows, taken, tied = scored, F.lit(False), F.lit(True)
    for key in ORDER:
        cutoff, below = _cut(rows, key, need)
        taken = taken | (tied & (F.col(key) < cutoff))
        tied = tied & (F.col(key) == cutoff)
        need -= below
        rows = rows.where(F.col(key) == cutoff)
        if rows.count() == need:
            break
    return taken | tied


#: The order of the draw: by score, id, text and row.
ORDER = ("by_score", "by_id", "text_key", "row")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    longest: int = LONGEST_RUN,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """``id n_features weight score rank`` per document.

    ``percent`` of the documents with at least ``min_words`` words are drawn
    towards the texts of ``target``; the rank of the others is null.
    """
    gains = bucket_gains(
        bucket_counts(docs, text_col, longest, buckets),
        bucket_counts(target, target_col, longest, buckets),
        buckets,
    )
    scored = scores(docs, gains, id_col, text_col, longest, seed)
    scored = write_through(
        scored.withColumn("by_score", -F.col("score"))
        .withColumn("by_id", F.coalesce("id", F.lit(_LAST)))
        .withColumn("row", F.monotonically_increasing_id()),
        "scores",
    )
    able = F.col("n_words") >= min_words
    need = percent * scored.where(able).count() // 100
    taken = able & drawn(scored.where(able), need)
    columns = ["id", "n_features", "weight", "score"]
    left = scored.where(~taken).select(*columns, F.lit(None).cast("long").alias("rank"))
    if need <= 0:
        return left
    ranked = positions(scored.where(taken), ORDER, "place")
    ranked = ranked.select(*columns, (F.col("place") + 1).alias("rank"))
    return ranked.unionByName(left)
