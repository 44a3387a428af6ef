"""Helpers shared by the operators of this package."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelltrace.session import BROADCAST_ROWS, cut_lineage, write_through

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Separators of words in running text: space and the ASCII controls 9 to 13.
_BLANKS = "\t\n\x0b\x0c\r"
#: What separates the words that texts are compared by.
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z in lower case, all else as it is."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )


def blank_words(text: Column) -> Column:
    """Words between blanks, as an array; none in a null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), _BLANKS, " " * len(_BLANKS))
    return F.array_remove(F.split(spaced, " "), "")


def compared_words(text: Column) -> Column:
    """Lower-cased words of ASCII letters, digits and all other characters."""
    return F.array_remove(
        F.split(ascii_lower(F.coalesce(text, F.lit(""))), _NO_WORD), ""
    )


def text_key(text: Column) -> Column:
    """Sets rows apart that share an id but not their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows."""
    return df.limit(rows + 1).count() <= rows


def positions(rows: DataFrame, order: tuple[str, ...], name: str) -> DataFrame:
    """``rows`` with their place, from 0, in the order of the columns ``order``.

    Rows are partitioned by ranges of the order, and a place is that within
    the range after the sizes of the ranges before. No two rows may have equal
    ``order`` columns, so that no range need be larger than another.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The number's upper bits are the range, the lower ones the place in it.
    number = F.col("_at")
    placed = write_through(
        ordered.withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftright(number, 33))
        .withColumn("_at", number.bitwiseAND(F.lit((1 << 33) - 1))),
        f"{name}-ranges",
    )
    # As many rows as there are shuffle partitions.
    sizes = sorted(map(tuple, placed.groupBy("_range").count().collect()))
    before = accumulate((n for _, n in sizes), initial=0)
    starts = rows.sparkSession.createDataFrame(
        [(r, b) for (r, _), b in zip(sizes, before)], "_range long, _before long"
    )
    joined = placed.join(F.broadcast(starts), "_range")
    return joined.withColumn(name, F.col("_before") + number).drop("_range", "_at", "_before")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of ``edges``: ``(node, component)``.

    The component is its smallest node. Alternates stars around the larger
    and the smaller neighbours until nothing changes, a logarithmic number of
    rounds in practice; each round is a checkpointed table of at most as many
    rows as there are edges, and a node with very many neighbours is never
    gathered: its minimum is aggregated before the shuffle.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(
        "a is not null and b is not null and a <> b"
    )
    stars = cut_lineage(_oriented(pairs).distinct())
    before = None
    while True:
        for larger in (True, False):
            stars = cut_lineage(_star(stars, larger))
        now = stars.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if now == before:
            break
        before = now
    roots = stars.select(F.col("b").alias("node")).distinct()
    return (
        stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
        .union(roots.select("node", F.col("node").alias("component")))
        .distinct()
    )


def _oriented(pairs: DataFrame) -> DataFrame:
    """Each pair once, the larger node as ``a``."""
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _star(stars: DataFrame, larger: bool) -> DataFrame:
    """Link each node's larger (or other) neighbours to its smallest one."""
    if larger:
        around = stars.union(stars.select("b", "a")).toDF("node", "near")
    else:
        around = stars.toDF("node", "near")
    least = around.groupBy("node").agg(F.min("near").alias("_m"))
    least = least.withColumn("least", F.least("node", "_m")).drop("_m")
    # Written first: of two scans adaptive execution can split a node with
    # very many neighbours.
    least = write_through(least, "stars")
    joined = around.join(least, "node")
    if larger:
        out = joined.where("near > node").select("near", "least")
    else:
        out = joined.select("near", "least").union(
            least.select("node", "least")
        )
    return out.toDF("a", "b").where("a <> b").distinct()
