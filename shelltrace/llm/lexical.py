"""Ranked lexical search in buckets of impact vectors by length.

A document is a vector of integer impacts, one per term that some query holds;
a query is a vector of its terms' weights times their occurrences. The score is
the inner product. All documents are searched for each query's ``k`` best:

1. Impact vectors are written in order of their length (Euclidean norm), and
   dealt into buckets of nearly equal length; a bucket is known by its greatest
   length and its greatest coordinate.
2. A query's largest coordinates, up to a number of postings, give partial
   scores. The best documents by them are scored in full, and the ``k``-th of
   these scores is the threshold: no document below it can be in the result.
3. What a part of a query can add to the score of a document in a bucket is at
   most the product of the lengths (Cauchy-Schwarz), and at most the sum of the
   coordinates times the bucket's greatest. A bucket in which the whole query
   stays below the threshold is pruned. In the others, the query's smallest
   coordinates are left out for as long as they alone stay below: only the
   postings of its other terms, the focus, are looked up.
4. A document's score over the focus, plus what the rest of its length can add,
   is a bound of its score; documents whose bound is below the threshold are
   dropped. The survivors' scores are computed exactly in integers.

Bounds are in doubles with a margin for rounding, and only what is strictly
below the threshold is dropped, so the result is exact, ties included.

Frequent terms have small weights and are mostly no part of a focus, so their
postings are not looked up. Scores are aggregated before they are shuffled.
Queries are searched in blocks of a bounded number of coordinates, and only
what a block holds is broadcast. Documents that tie at the threshold all
survive, in as many tasks as they are in, and the best are taken by tasks first.

Nulls and corner cases: a null or empty text has no terms; such a document is
found by no query, such a query finds nothing; each row of queries is a query
of its own, whatever its id; documents with equal scores rank by id, null last,
those that repeat an id by row. Ids may have any type that sorts. Columns other
than those named are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelltrace.llm.common import compared_words
from shelltrace.session import write_through

# Scale of weights and impacts, and how length dampens impacts.
WEIGHT_SCALE = 1000
IMPACT_SCALE = 1_000_000_000
OCCURRENCE = 1000
DAMPING = 8
LENGTH_PERCENT = 75

TOP = 10
#: Coordinates of all queries of a block.
BLOCK_COORDINATES = 200_000
#: Postings that give a query's first threshold, and the documents scored for it.
SEED_POSTINGS = 2_000
SEED_DOCUMENTS = 64
#: Lengths within a bucket differ by less than this factor.
WIDTH = 1.1
_MARGIN = 1 + 1e-9

#: Bytes to bytes: A-Z in lower case, what separates words as blanks.
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def _counter(known):
    """A reader of texts that counts the terms which ``known`` holds."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value.get
        for batch in batches:
            at = batch.schema.get_field_index("text")
            sizes, ends, terms, times = [], [0], [], []
            for text in batch.column(at):
                words = (text.as_py() or b"").translate(_PLAIN).split()
                counts = Counter(map(number, words))
                counts.pop(None, None)
                sizes.append(len(words))
                terms += counts.keys()
                times += counts.values()
                ends.append(len(terms))
            entries = pa.StructArray.from_arrays(
                [pa.array(terms, pa.int32()), pa.array(times, pa.int64())], ["t", "tf"]
            )
            others = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in others],
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries),
                ],
                [*[batch.schema.names[i] for i in others], "n", "terms"],
            )

    return count


def counted_documents(
    docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str
) -> DataFrame:
    """``row id n terms`` of documents with terms: all terms are counted in
    ``n``, those of the vocabulary listed with their occurrences. Written."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        docs[id_col].alias("id"),
        docs[text_col].cast("binary").alias("text"),
    )
    entry = T.StructType().add("t", T.IntegerType()).add("tf", T.LongType())
    schema = (
        T.StructType(rows.schema.fields[:2])
        .add("n", T.LongType())
        .add("terms", T.ArrayType(entry))
    )
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return write_through(rows.mapInArrow(_counter(known), schema).where("n > 0"), "terms")


def impact_vectors(counted: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """``row id v norm2 bucket`` in order of length, written.

    ``v`` lists ``(t, x)``, a coordinate and its impact.
    """
    m = F.expr(f"{100 - LENGTH_PERCENT} + (({LENGTH_PERCENT} * n * {n_docs}) div {n_terms})")
    impact = F.expr(
        f"transform(terms, e -> struct(e.t as t,"
        f" ({IMPACT_SCALE} * e.tf) div ({OCCURRENCE} * e.tf + {DAMPING} * m) as x))"
    )
    rows = counted.withColumn("m", m).select("row", "id", impact.alias("v"))
    squares = F.aggregate(
        "v", F.lit(0.0), lambda sum_, e: sum_ + e["x"].cast("double") * e["x"]
    )
    rows = rows.withColumn("norm2", squares).where("norm2 > 0")
    length = F.floor(F.log(F.col("norm2")) / (2 * F.log(F.lit(WIDTH))))
    rows = rows.withColumn("bucket", length.cast("int"))
    # Equal lengths are told apart by row, so copies do not meet in one range.
    ordered = rows.repartitionByRange(F.desc("norm2"), "row")
    return write_through(ordered.sortWithinPartitions(F.desc("norm2"), "row"), "impacts")


class Block:
    """Queries of a block, ``q t weight df``, against the impact vectors."""

    def __init__(self, vectors: DataFrame, queries: DataFrame, k: int):
        self.vectors, self.k = vectors, k
        self.queries = write_through(queries, "queries")
        stats = vectors.groupBy("bucket").agg(
            F.max("norm2").alias("norm2"),
            F.max(F.array_max(F.transform("v", lambda e: e["x"]))).alias("x"),
        )
        # As many as there are lengths apart by a factor, some hundreds at most.
        self.buckets, length, cap = [], 0.0, 0.0
        for bucket, norm2, x in sorted(map(tuple, stats.collect())):
            # Never falling, so that a term in focus stays so in longer buckets.
            length, cap = max(length, norm2**0.5), max(cap, float(x))
            self.buckets.append((bucket, length, cap))

    def _bounds(self) -> Column:
        return F.array(
            *[
                F.struct(F.lit(b).alias("bucket"), F.lit(n).alias("length"), F.lit(c).alias("cap"))
                for b, n, c in self.buckets
            ]
        )

    def _sums(self, rows: DataFrame, focus: DataFrame) -> DataFrame:
        """``q row bucket`` with sums over the coordinates in ``focus``."""
        postings = rows.select("row", "bucket", "norm2", F.inline("v"))
        met = postings.join(F.broadcast(focus), "t").where("bucket >= from_bucket")
        return met.groupBy("q", "row").agg(
            F.sum(F.col("weight") * F.col("x")).alias("score"),
            F.sum(F.col("x").cast("double") * F.col("x")).alias("met2"),
            F.first("norm2").alias("norm2"),
            F.first("bucket").alias("bucket"),
        )

    def exact(self, pairs: DataFrame) -> DataFrame:
        """``q row id score`` of the written ``(q, row)``, in integers."""
        found = self.vectors.join(pairs, "row").select("q", "row", "id", F.inline("v"))
        weights = F.broadcast(self.queries.select("q", "t", "weight"))
        return (
            found.join(weights, ["q", "t"])
            .groupBy("q", "row")
            .agg(F.sum(F.col("weight") * F.col("x")).alias("score"), F.first("id").alias("id"))
        )

    def best(self, scored: DataFrame, k: int, *ties: str | Column) -> DataFrame:
        """The first ``k`` of each query, with ``rank``."""
        order = W.partitionBy("q").orderBy(F.desc("score"), *ties, "row")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def thresholds(self) -> DataFrame:
        """``q theta``: what the ``k``-th best document scores at least."""
        before = (
            W.partitionBy("q")
            .orderBy(F.desc("weight"), "t")
            .rowsBetween(W.unboundedPreceding, -1)
        )
        seeds = self.queries.withColumn(
            "_before", F.coalesce(F.sum("df").over(before), F.lit(0))
        ).where(F.col("_before") < SEED_POSTINGS)
        sums = self._sums(
            self.vectors, seeds.select("q", "t", "weight", F.lit(-(1 << 30)).alias("from_bucket"))
        )
        pairs = write_through(
            self.best(sums, max(SEED_DOCUMENTS, self.k)).select("q", "row"), "seeds"
        )
        found = self.best(self.exact(pairs), self.k).where(F.col("rank") == self.k)
        known = found.select("q", F.col("score").alias("theta"))
        # Of fewer documents, every score above 0 counts.
        every = self.queries.select("q").distinct().join(known, "q", "left")
        return every.select("q", F.greatest("theta", F.lit(1)).cast("double").alias("theta"))

    def focus(self) -> DataFrame:
        """``q t weight theta tail2 tail from_bucket``: the smallest bucket from
        which on a term is looked up, null for none. Written.

        ``tail2`` and ``tail`` are the sums, of squares and plain, of the
        coordinates from this one down.
        """
        down = W.partitionBy("q").orderBy("weight", F.desc("t"))
        weight = F.col("weight").cast("double")
        tails = self.queries.join(F.broadcast(write_through(self.thresholds(), "thetas")), "q")
        tails = tails.withColumn("tail2", F.sum(weight * weight).over(down)).withColumn(
            "tail", F.sum(weight).over(down)
        )
        reach = F.filter(
            self._bounds(),
            lambda b: F.least(b["length"] * F.sqrt("tail2"), b["cap"] * F.col("tail")) * _MARGIN
            >= F.col("theta"),
        )
        return write_through(
            tails.withColumn("from_bucket", F.get(reach, F.lit(0))["bucket"]), "focus"
        )

    def search(self) -> DataFrame:
        """``q row id score rank`` of each query's best documents."""
        focus = self.focus()
        least = focus.agg(F.min("from_bucket")).first()[0]
        if least is None:
            least = 1 << 30
        alive = self.vectors.where(F.col("bucket") >= least)
        looked_up = focus.where("from_bucket is not null")
        sums = self._sums(alive, looked_up.select("q", "t", "weight", "from_bucket"))
        # What is left of a query in a bucket: its largest coordinate not looked up.
        left = (
            focus.select("*", F.inline(self._bounds()))
            .groupBy("q", "bucket")
            .agg(
                F.first("theta").alias("theta"),
                F.first("cap").alias("cap"),
                F.max(F.when(_out(), F.col("tail2"))).alias("tail2"),
                F.max(F.when(_out(), F.col("tail"))).alias("tail"),
            )
            .fillna(0.0, ["tail2", "tail"])
        )
        joined = sums.join(F.broadcast(write_through(left, "tails")), ["q", "bucket"])
        beside = F.sqrt(F.greatest(F.col("norm2") - F.col("met2"), F.lit(0.0)) + 1e-9 * F.col("norm2"))
        rest = F.least(beside * F.sqrt("tail2"), F.col("cap") * F.col("tail")) * _MARGIN
        survivors = joined.where(F.col("score") * _MARGIN + rest >= F.col("theta"))
        pairs = write_through(survivors.select("q", "row"), "survivors")
        scored = self.exact(pairs).where("score > 0")
        return self.best(scored, self.k, F.asc_nulls_last("id"))


def _out() -> Column:
    return F.col("from_bucket").isNull() | (F.col("from_bucket") > F.col("bucket"))


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_coordinates: int = BLOCK_COORDINATES,
) -> DataFrame:
    """``item rank id score``: the ``k`` best documents of each item."""
    spark = docs.sparkSession
    asked = write_through(
        items.select(
            F.monotonically_increasing_id().alias("q"),
            items[item_col].alias("item"),
            compared_words(items[item_text_col]).alias("words"),
        ),
        "items",
    )
    terms = write_through(
        asked.select("q", F.explode("words").alias("term"))
        .groupBy("q", "term")
        .agg(F.count(F.lit(1)).alias("qtf")),
        "item-terms",
    )
    blocks = max(1, -(-terms.count() // block_coordinates))
    found = []
    for block in range(blocks):
        mine = terms.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block)
        # At most as many as a block has coordinates.
        listed = sorted(r[0] for r in mine.select("term").distinct().collect())
        numbered = spark.createDataFrame(
            [(term, t) for t, term in enumerate(listed)], "term string, t int"
        )
        vocabulary = {term.encode(): t for t, term in enumerate(listed)}
        counted = counted_documents(docs, vocabulary, id_col, text_col)
        n_docs, n_terms = counted.agg(
            F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))
        ).first()
        df = (
            counted.select(F.explode("terms").alias("e"))
            .groupBy(F.col("e.t").alias("t"))
            .agg(F.count(F.lit(1)).alias("df"))
        )
        df = write_through(df, "frequencies")
        weight = F.floor(
            WEIGHT_SCALE * F.log((F.lit(2.0) * n_docs + 2.0) / (F.lit(2.0) * F.col("df") + 1.0))
        )
        weights = df.withColumn("weight", weight).where("weight > 0")
        queries = mine.join(F.broadcast(numbered), "term").select("q", "t", "qtf")
        vectors = impact_vectors(counted, n_docs, max(n_terms, 1))
        queries = queries.join(F.broadcast(weights), "t").select(
            "q", "t", (F.col("weight") * F.col("qtf")).alias("weight"), "df"
        )
        block_of_queries = Block(vectors, queries, k)
        # Without buckets, no document holds a term of the block.
        if block_of_queries.buckets:
            found.append(block_of_queries.search())
    if not found:
        return asked.where(F.lit(False)).select(
            "item",
            F.lit(0).alias("rank"),
            F.lit(None).cast(docs.schema[id_col].dataType).alias("id"),
            F.lit(0).cast("long").alias("score"),
        )
    ranks = write_through(reduce(DataFrame.unionByName, found), "ranks")
    return ranks.join(asked.select("q", "item"), "q").select("item", "rank", "id", "score")
