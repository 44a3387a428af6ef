"""Mixing sources to target weights.

Every source is a stream of words, its documents end to end in a pseudorandom
order, cut into blocks of a fixed number of words. The mix draws blocks:

1. A source's target is its share of the mixed words by weight, at most
   ``max_repeats`` times its size; what is above is shared anew by weight.
2. Each draw of a source falls on an output shard uniformly at random, so the
   counts per shard are multinomial draws, conditioned on the sources' totals.
3. The k-th draw of a source is mapped to a block through a pseudorandom
   permutation of the source's block numbers, one per pass over the source.
4. Draws and documents meet in a join by block number.

The block at the end of a stream is shorter and comes last in its pass; the
last draw may be cut, so that a source gives its target to the word.

Nulls and corner cases: a null text has no words and is never drawn; a null
source is a source of its own, last in order; rows with the same id are
documents of their own; ids and sources keep their types. Columns other than
those named are ignored. An empty table gives an empty mix.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelltrace.llm.common import blank_words, bounded, text_key
from shelltrace.session import write_through

BLOCK_WORDS = 256
SHARD_BLOCKS = 4096
WEIGHTS = (3, 1, 2)
#: Documents whose offsets are summed in one window.
BUCKET_ROWS = 65_536
MIN_BUCKETS = 256
#: Draws that one row is expanded into at a time.
_DRAWS_AT_ONCE = 16_384
_TASKS = 10_000
_ROUNDS = 4
_WALK = 64


@dataclass(frozen=True)
class Mix:
    """A mix of ``docs``; ``taken`` and ``slots`` are its results."""

    docs: DataFrame
    id_col: str = "doc_id"
    text_col: str = "text"
    source_col: str = "source"
    weights: tuple[float, ...] = WEIGHTS
    #: Words of the mix as a share of all words.
    share: float = 1.5
    max_repeats: int = 2
    block_words: int = BLOCK_WORDS
    shard_blocks: int = SHARD_BLOCKS
    seed: int = 7

    @cached_property
    def sized(self) -> DataFrame:
        """``(id, source, size)``, written so that texts are read once."""
        d = self.docs
        return write_through(
            d.select(
                d[self.id_col].alias("id"),
                d[self.source_col].alias("source"),
                F.size(blank_words(d[self.text_col])).cast("long").alias("size"),
                text_key(d[self.text_col]).alias("text_key"),
            ),
            "mix-sizes",
        )

    @cached_property
    def sources(self) -> DataFrame:
        """One row per source: ``sid source source_size target take blocks draws``."""
        by_code_point = W.orderBy(F.col("source").asc_nulls_last())
        cheapest = W.orderBy("ratio", "sid")
        earlier = cheapest.rowsBetween(W.unboundedPreceding, -1)
        later = cheapest.rowsBetween(W.currentRow, W.unboundedFollowing)
        everything = W.partitionBy()
        weight = F.element_at(
            F.array(*[F.lit(float(w)) for w in self.weights]),
            (F.col("sid") % len(self.weights) + 1).cast("int"),
        )
        total = F.sum("source_size").over(everything) * self.share
        ranked = (
            self.sized.groupBy("source")
            .agg(F.sum("size").alias("source_size"))
            .withColumn("sid", F.row_number().over(by_code_point) - 1)
            .withColumn("weight", weight)
            .withColumn("cap", (F.col("source_size") * self.max_repeats).cast("double"))
            .withColumn("ratio", F.col("cap") / F.col("weight"))
            .withColumn("total", F.least(total, F.sum("cap").over(everything)))
        )
        # In order of cap by weight, a source is at its cap as long as an
        # equal share of what the earlier ones leave would take it there.
        rate = (F.col("total") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / (
            F.sum("weight").over(later)
        )
        filled = ranked.withColumn("rate", rate).withColumn(
            "level",
            F.min(F.when(F.col("rate") <= F.col("ratio"), F.struct("ratio", "rate")))
            .over(everything)["rate"],
        )
        target = F.least(
            F.coalesce(F.col("level") * F.col("weight"), F.col("cap")), "cap"
        )
        size, take, b = F.col("source_size"), F.col("take"), self.block_words
        rest = F.when(size > 0, take % size).otherwise(F.lit(0).cast("long"))
        blocks = F.ceil(size / b)
        return write_through(
            filled.withColumn("target", target)
            .withColumn("take", F.round("target").cast("long"))
            .withColumn("blocks", blocks)
            .withColumn("rest", rest)
            .withColumn(
                "draws",
                F.when(
                    size > 0, F.expr("take div source_size") * blocks + F.ceil(rest / b)
                ).otherwise(F.lit(0).cast("long")),
            )
            .select(
                "sid source source_size target take blocks rest draws".split()
            ),
            "mix-sources",
        )

    def _plan(self, *columns: str) -> DataFrame:
        plan = self.sources.select(*columns)
        return F.broadcast(plan) if bounded(plan) else plan

    @cached_property
    def documents(self) -> DataFrame:
        """``(id source sid size source_size target offset)``: places of documents
        with words in the streams.

        Offsets are summed in buckets that hold documents of all sources, and
        carried over by one row per source and bucket, so that no source is
        gathered.
        """
        rows = self.sized.count()
        buckets = max(MIN_BUCKETS, -(-rows // BUCKET_ROWS))
        plan = self._plan("sid", F.col("source").alias("_s"), "source_size", "target")
        docs = (
            self.sized.where("size > 0")
            .join(plan, F.col("source").eqNullSafe(F.col("_s")))
            .drop("_s")
            # The text tells rows apart that have no id; an order by number of
            # row would not be the same in every run.
            .withColumn("h", F.xxhash64(F.lit(self.seed), "id", "size", "text_key"))
            .withColumn("bucket", F.pmod("h", F.lit(buckets)))
        )
        before = W.partitionBy("sid").orderBy("bucket").rowsBetween(
            W.unboundedPreceding, -1
        )
        starts = (
            docs.groupBy("sid", "bucket")
            .agg(F.sum("size").alias("_n"))
            .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
            .drop("_n")
        )
        within = (
            W.partitionBy("bucket", "sid")
            .orderBy("h", "id", "size", "text_key")
            .rowsBetween(W.unboundedPreceding, W.currentRow)
        )
        return (
            docs.repartition("bucket")
            .withColumn("_upto", F.sum("size").over(within))
            .join(starts, ["sid", "bucket"])
            .withColumn("offset", F.col("_start") + F.col("_upto") - F.col("size"))
            .select("id", "source", "sid", "size", "source_size", "target", "offset")
        )

    @cached_property
    def pieces(self) -> DataFrame:
        """Documents cut at block borders: ``block``, ``start`` and ``words`` in it."""
        b = self.block_words
        first = F.expr(f"offset div {b}")
        last = F.expr(f"(offset + size - 1) div {b}")
        start = F.greatest(F.col("offset") - F.col("block") * b, F.lit(0))
        end = F.least(F.col("offset") + F.col("size") - F.col("block") * b, F.lit(b))
        return (
            self.documents.withColumn("block", F.explode(F.sequence(first, last)))
            .withColumn("start", start)
            .withColumn("words", end - F.col("start"))
        )

    @cached_property
    def draws(self) -> DataFrame:
        """One row per draw: ``sid k pass block words shard``.

        ``words`` is what the draw takes from the start of its block.
        """
        b, seed = self.block_words, self.seed
        total = self.sources.agg(F.coalesce(F.sum("draws"), F.lit(0))).first()[0]
        shards = max(1, -(-total // self.shard_blocks))
        chunk = _DRAWS_AT_ONCE
        # A number of its own: few short rows become very many here.
        tasks = max(1, min(-(-total // chunk), _TASKS))
        some = (
            self.sources.where("draws > 0")
            .withColumn("whole", F.expr(f"source_size div {b}"))
            .withColumn(
                "passes",
                F.array(
                    *[
                        permutation(F.col("whole"), F.lit(seed), F.col("sid"), F.lit(p))
                        for p in range(self.max_repeats + 1)
                    ]
                ),
            )
            .withColumn("_c", F.explode(F.expr(f"sequence(0L, (draws - 1) div {chunk})")))
            .repartition(tasks, "sid", "_c")
        )
        k = F.explode(
            F.expr(f"sequence(_c * {chunk}L, least(draws, (_c + 1) * {chunk}L) - 1)")
        )
        tail = F.col("source_size") - F.col("whole") * b
        last = (F.col("k") == F.col("draws") - 1) & (F.col("rest") > 0)
        return (
            some.withColumn("k", k)
            .withColumn("pass", F.expr("k div blocks"))
            .withColumn("j", F.expr("k % blocks"))
            .withColumn(
                "block",
                F.when(
                    F.col("j") < F.col("whole"),
                    permuted(
                        F.col("j"), F.col("whole"), F.get("passes", F.col("pass").cast("int"))
                    ),
                ).otherwise(F.col("whole")),
            )
            .withColumn(
                "words",
                F.when(last, F.col("rest") - F.col("j") * b)
                .when(F.col("j") < F.col("whole"), F.lit(b))
                .otherwise(tail),
            )
            .withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "sid", "k"), F.lit(shards)))
            .select("sid", "k", "pass", "block", "words", "shard")
        )

    def shard_counts(self) -> DataFrame:
        """The multinomial counts: ``shard sid blocks``."""
        return self.draws.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("blocks"))

    def slots(self) -> DataFrame:
        """The mix: ``shard slot id from_word words``, in order of slots.

        A slot is filled by the pieces of its block; ``from_word`` counts in
        the document. A shard is bounded by ``shard_blocks``.
        """
        order = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(self.seed + 1), "sid", "k"), "sid", "k")
        slots = self.draws.withColumn("slot", F.row_number().over(order) - 1)
        taken = F.least(F.col("_limit"), F.col("start") + F.col("words")) - F.col("start")
        return (
            self.pieces.join(
                slots.withColumnRenamed("words", "_limit").hint("merge"), ["sid", "block"]
            )
            .withColumn("taken", taken)
            .where("taken > 0")
            .select(
                "shard",
                "slot",
                "pass",
                "source",
                "id",
                F.greatest(
                    F.col("block") * self.block_words - F.col("offset"), F.lit(0)
                ).alias("from_word"),
                F.col("taken").alias("words"),
            )
        )

    def taken(self) -> DataFrame:
        """Per document ``id source size source_size target taken``."""
        # At most max_repeats draws, and one that is cut, meet in a block.
        limits = self.draws.groupBy("sid", "block").agg(
            F.collect_list("words").alias("_limits")
        )
        # Estimates do not foresee how many draws a source has.
        limits = limits.hint("merge")
        words = F.aggregate(
            F.coalesce("_limits", F.array().cast("array<bigint>")),
            F.lit(0).cast("long"),
            lambda n, limit: n
            + F.greatest(
                F.least(limit, F.col("start") + F.col("words")) - F.col("start"), F.lit(0)
            ),
        )
        kept = ["id", "source", "sid", "size", "source_size", "target"]
        drawn = (
            self.pieces.join(limits, ["sid", "block"], "left")
            .withColumn("_n", words)
            .groupBy(*kept, "offset")
            .agg(F.sum("_n").alias("taken"))
        )
        plan = self._plan(F.col("source").alias("_s"), "source_size", "target")
        empty = (
            self.sized.where("size = 0")
            .join(plan, F.col("source").eqNullSafe(F.col("_s")))
            .select("id", "source", "size", "source_size", "target")
            .withColumn("taken", F.lit(0).cast("long"))
        )
        return drawn.drop("offset", "sid").unionByName(empty)


def _bits(n: Column) -> Column:
    """Bits that the numbers below ``n`` need; 1 at least."""
    return F.greatest(F.ceil(F.log2(n.cast("double"))), F.lit(1)).cast("int")


def _ones(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1


def permutation(n: Column, *key) -> Column:
    """The constants of a pseudorandom permutation of ``0..n-1``, by ``key``."""
    room = _ones(F.least(F.lit(62) - _bits(n), F.lit(31)))
    return F.array(
        *[
            F.struct(
                F.xxhash64(F.lit(i), *key)
                .bitwiseAND(room)
                .bitwiseOR(F.lit(1).cast("long"))
                .alias("odd"),
                F.xxhash64(F.lit(-1 - i), *key).bitwiseAND(_ones(_bits(n))).alias("add"),
            )
            for i in range(_ROUNDS)
        ]
    )


def permuted(j: Column, n: Column, constants: Column) -> Column:
    """Image of ``j`` under the permutation of ``0..n-1``.

    Multiplications by odd numbers and shifted xors permute the numbers of as
    many bits as ``n - 1`` has; the walk repeats that until it is below ``n``,
    which every second step does on average. ``n`` is below 2^48.
    """
    half = F.ceil(_bits(n) / 2).cast("int")

    def mixed(x: Column) -> Column:
        def one(x: Column, c: Column) -> Column:
            y = (x * c["odd"] + c["add"]).bitwiseAND(_ones(_bits(n)))
            return y.bitwiseXOR(F.call_function("shiftright", y, half))

        return F.aggregate(constants, x, one)

    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(_WALK)),
        j,
        lambda x, i: F.when((i > 1) & (x < n), x).otherwise(mixed(x)),
    )
    return F.when(walked >= n, F.raise_error(F.lit("walk too long")).cast("long")).otherwise(walked)
