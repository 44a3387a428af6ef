"""N-gram Jaccard join over a forest of MinHash tries.

Documents are sets of shingles of five words; two are linked when the Jaccard
similarity of their sets is at least the threshold.

1. Documents with equal sets form a class; from here on a class is one row,
   however many copies it has.
2. Each class has a signature of MinHash values, dealt out as labels to trees.
   A tree is a trie of its classes' labels: a node is a beginning of a label,
   and holds the classes that share it.
3. Matching begins with whole labels and shortens them step by step. What the
   matches of a depth find, by the similarity that their signatures show, tells
   how much that depth overlooks: a pair of similarity s is met with a known
   chance, so each one found stands for a few that were not
   (:func:`estimated_recall`). The beginnings are shortened until the estimate
   reaches the target, so the depth follows from the data. Nodes that hold too
   many classes are not expanded into pairs: all are tied to the smallest one.
4. Candidates of small nodes stay if their whole signatures agree about as
   much as those of linked classes do; the chance of losing a link at the
   threshold here is about 1.7e-8. What the rest ties together is a cluster.
5. Within each cluster every two classes are compared exactly, on their texts,
   in units of two blocks of a bounded number of classes; large clusters have
   many units. Units return sums and local components, no pairs.

Nulls and corner cases: a null text or one without words has no shingles and is
a class and a component of its own; one of fewer words has a single shingle of
all of them. Ids are ordered with nulls last. Rows that repeat a document are
documents of their own and count as linked. Ids may be of any type that can be
ordered. Columns other than those named are ignored. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from shelltrace.llm.common import bounded, compared_words, components, text_key
from shelltrace.session import write_through

SHINGLE_WORDS = 5
THRESHOLD = 0.8
TREES = 20
LEVELS = 6
TARGET_RECALL = 0.9995
#: Nodes of up to so many classes are expanded into pairs.
NODE_CLASSES = 24
#: Classes of a block; a unit of exact comparison has two.
BLOCK_CLASSES = 128
#: Standard deviations by which a signature may fall short of the threshold.
_SLACK = 6.0
_COLUMNS = 1 << 14

_U = np.uint64


def chance_met(similarity: float | Column, depth: int, trees: int):
    """How likely two classes share a node of ``depth`` in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(29))


def shingles(words: np.ndarray, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of the distinct runs of ``n`` words, sorted; words are hashes."""
    if not len(words):
        return words
    n = min(n, len(words))
    size = len(words) - n + 1
    out = np.full(size, n, dtype=_U)
    for i in range(n):
        out = _mixed(out * _U(0x100000001B3) + words[i : i + size])
    return np.unique(out)


def _functions(count: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    high = np.iinfo(np.uint64).max
    return (
        rng.integers(0, high, count, dtype=np.uint64) | _U(1),
        rng.integers(0, high, count, dtype=np.uint64),
    )


def signatures(sets: list[np.ndarray], count: int) -> np.ndarray:
    """MinHash values of non-empty ``sets``, one row each."""
    out = np.empty((len(sets), count), dtype=np.uint32)
    if not sets:
        return out
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    a, b = _functions(count)
    for i in range(count):
        values = ((flat * a[i] + b[i]) >> _U(32)).astype(np.uint32)
        out[:, i] = np.minimum.reduceat(values, starts)
    return out


def _word_arrays(column: pa.Array) -> list[np.ndarray]:
    flat = column.values.to_numpy(zero_copy_only=False).view(_U)
    ends = column.offsets.to_numpy()
    return [flat[s:e] for s, e in zip(ends[:-1], ends[1:])]


def _node(tree: int, label: np.ndarray) -> int:
    data = tree.to_bytes(4, "little") + label.tobytes()
    return int.from_bytes(
        hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True
    )


#: Shingles that signatures are worked out for at once.
_AT_ONCE = 1 << 20


def _signer(trees: int, levels: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            words = _word_arrays(batch.column(names.index("words")))
            sets = [shingles(w) for w in words]
            values: list = [None] * len(sets)
            full = [i for i, s in enumerate(sets) if len(s)]
            at = 0
            while at < len(full):
                upto, total = at, 0
                while upto < len(full) and (upto == at or total < _AT_ONCE):
                    total += len(sets[full[upto]])
                    upto += 1
                rows = signatures([sets[i] for i in full[at:upto]], trees * levels)
                for i, row in zip(full[at:upto], rows):
                    values[i] = row.tobytes()
                at = upto
            digests = [
                hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                for s in sets
            ]
            keep = [batch.column(i) for i, n in enumerate(names) if n != "words"]
            yield pa.RecordBatch.from_arrays(
                [
                    *keep,
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(values, pa.binary()),
                ],
                names=[*[n for n in names if n != "words"], "n_shingles", "class", "signature"],
            )

    return sign


def _hashed_words(text: Column) -> Column:
    return F.transform(compared_words(text), lambda w: F.xxhash64(w))


def signed(docs: DataFrame, id_col: str, text_col: str, trees: int, levels: int) -> DataFrame:
    """``id text_key n_shingles class signature`` per document."""
    rows = docs.select(
        docs[id_col].alias("id"),
        text_key(docs[text_col]).alias("text_key"),
        _hashed_words(docs[text_col]).alias("words"),
    )
    schema = (
        f"id {rows.schema['id'].dataType.simpleString()}, text_key long,"
        " n_shingles long, class binary, signature binary"
    )
    return rows.mapInArrow(_signer(trees, levels), schema)


def _nodes(trees: int, levels: int, depth: int):
    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes = batch.column("class").to_pylist()
            rows = [
                np.frombuffer(s, dtype=np.uint32).reshape(trees, levels)[:, :depth]
                for s in batch.column("signature").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([c for c in classes for _ in range(trees)], pa.binary()),
                    pa.array(
                        [_node(t, r[t]) for r in rows for t in range(trees)], pa.int64()
                    ),
                ],
                names=["class", "node"],
            )

    return nodes


@F.pandas_udf(DoubleType())
def _similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of equal values of two signatures."""
    equal = [
        np.mean(np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)) for x, y in zip(a, b)
    ]
    return pd.Series(equal, dtype=float)


def estimated_recall(pairs: DataFrame, threshold: float, depth: int, trees: int) -> float:
    """The share of the linked pairs that matching to ``depth`` has met.

    A pair met with the chance p stands for 1 / p pairs. ``pairs`` has
    ``alike``, the similarity that signatures show.
    """
    alike = F.greatest("alike", F.lit(threshold))
    met, all_ = (
        pairs.where(F.col("alike") >= threshold)
        .agg(F.count(F.lit(1)), F.sum(1 / chance_met(alike, depth, trees)))
        .first()
    )
    return met / all_ if met else chance_met(threshold, depth, trees)


def candidate_edges(
    classes: DataFrame, threshold: float, target: float, trees: int, levels: int
) -> DataFrame:
    """``(a, b)`` classes that the forest ties together.

    ``classes`` has ``class`` and ``signature``.
    """
    spread = math.sqrt(threshold * (1 - threshold) / (trees * levels))
    known = classes.select("class", "signature")
    for depth in range(levels, 0, -1):
        pairs, stars = _matched(classes, trees, levels, depth)
        # Estimates do not foresee how many pairs there are.
        checked = write_through(
            pairs.hint("merge")
            .join(known.toDF("a", "sa"), "a")
            .hint("merge")
            .join(known.toDF("b", "sb"), "b")
            .select("a", "b", _similarity("sa", "sb").alias("alike"))
            .where(F.col("alike") >= threshold - _SLACK * spread),
            "forest-pairs",
        )
        if estimated_recall(checked, threshold, depth, trees) >= target:
            break
    return checked.select("a", "b").union(stars)


def _matched(
    classes: DataFrame, trees: int, levels: int, depth: int
) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes that share a small node of ``depth``, and the classes
    of large ones with the node's smallest."""
    members = write_through(
        classes.select("class", "signature").mapInArrow(
            _nodes(trees, levels, depth), "class binary, node long"
        ),
        "forest-nodes",
    )
    nodes = (
        members.groupBy("node")
        .agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("least"))
        .where("n > 1")
    )
    # Written first: of two scans adaptive execution can split a full node.
    nodes = write_through(nodes, "forest-counts")
    shared = write_through(members.join(nodes, "node"), "forest-shared")
    stars = shared.where((F.col("n") > NODE_CLASSES) & (F.col("class") != F.col("least")))
    small = shared.where(F.col("n") <= NODE_CLASSES)
    listed = small.groupBy("node").agg(F.sort_array(F.collect_list("class")).alias("m"))
    # Within a small node each class meets the ones after it.
    pairs = (
        listed.select(F.posexplode("m").alias("i", "a"), "m")
        .select("a", F.explode(F.slice("m", F.col("i") + 2, F.lit(NODE_CLASSES))).alias("b"))
        .distinct()
    )
    return pairs, stars.select(F.col("class").alias("a"), F.col("least").alias("b"))


def _counted(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets of ``left`` and ``right``."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    _, column, often = np.unique(flat, return_inverse=True, return_counts=True)
    common = often[column] > 1
    owner, column = owner[common], column[common]
    _, column = np.unique(column, return_inverse=True)
    width = int(column.max()) + 1 if len(column) else 0
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    for low in range(0, width, _COLUMNS):
        s, e = np.searchsorted(column, [low, low + _COLUMNS])
        held = np.zeros((len(sets), _COLUMNS), dtype=np.float32)
        held[owner[s:e], column[s:e] - low] = 1
        # Whole numbers up to the number of columns are exact in single precision.
        out += (held[left] @ held[right].T).astype(np.int64)
    return out


def _compared(rows: list[tuple], threshold: float) -> list[tuple]:
    """``(class, links, root)`` of a unit's ``(class, side, size, shingles)``."""
    sets = [r[3] for r in rows]
    sides = np.array([r[1] for r in rows])
    one = np.flatnonzero(sides == 0)
    other = np.flatnonzero(sides == 1)
    same = not len(other)
    left, right = (one, one) if same else (one, other)
    if not len(left):
        return []
    lengths = np.array([len(s) for s in sets], dtype=np.int64)
    common = _counted(sets, left, right)
    either = lengths[left][:, None] + lengths[right][None, :] - common
    linked = common >= threshold * either - 1e-9
    if same:
        np.fill_diagonal(linked, False)
    sizes = np.array([r[2] for r in rows], dtype=np.int64)
    links = np.zeros(len(rows), dtype=np.int64)
    np.add.at(links, left, linked @ sizes[right])
    if not same:
        np.add.at(links, right, linked.T @ sizes[left])
    root = np.arange(len(rows))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(*np.nonzero(linked)):
        p, q = find(left[x]), find(right[y])
        if p != q:
            root[max(p, q)] = min(p, q)
    return [
        (rows[i][0], int(links[i]), rows[find(i)][0])
        for i in range(len(rows))
        if links[i]
    ]


def _comparer(threshold: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []
        for batch in batches:
            found: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("unit", "class", "side", "size")]
            words = _word_arrays(batch.column("words"))
            for u, c, side, size, w in zip(*columns, words):
                if u != unit:
                    found += _compared(rows, threshold) if rows else []
                    unit, rows = u, []
                rows.append((c, side, size, shingles(w.copy())))
            yield _links(found)
        if rows:
            yield _links(_compared(rows, threshold))

    return compare


def _links(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([f[0] for f in found], pa.binary()),
            pa.array([f[1] for f in found], pa.int64()),
            pa.array([f[2] for f in found], pa.binary()),
        ],
        names=["class", "links", "root"],
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    target_recall: float = TARGET_RECALL,
    trees: int = TREES,
    levels: int = LEVELS,
) -> DataFrame:
    """``id text_key n_shingles class_id n_links component_id component_key``.

    One row per document. ``class_id`` is the smallest id with the same
    shingles, ``component_id`` the smallest that links lead to, the document's
    own included. ``component_key`` is the ``text_key`` of the component's
    first document by id, then by key: ids may repeat, the two together tell
    components apart. ``n_links`` counts the other documents that are linked
    directly.
    """
    rows = write_through(signed(docs, id_col, text_col, trees, levels), "signatures")
    nulls_last = F.struct(F.col("id").isNull().alias("last"), "id", "text_key")
    classes = write_through(
        rows.where("class is not null")
        .groupBy("class")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.min(nulls_last).alias("first"),
            F.first("signature").alias("signature"),
        ),
        "shingle-classes",
    )
    edges = candidate_edges(classes, threshold, target_recall, trees, levels)
    clusters = write_through(components(edges), "near-clusters")
    sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK_CLASSES).cast("int")
    block = F.pmod(F.xxhash64("class"), blocks).cast("int")
    placed = (
        clusters.withColumnRenamed("node", "class")
        .join(sizes, "component")
        .withColumn("blocks", blocks)
        .withColumn("block", block)
        .join(classes.select("class", "size", "first"), "class")
    )
    placed = write_through(
        placed.select(
            "class",
            "size",
            "component",
            "blocks",
            "block",
            F.col("first.id").alias("_id"),
            F.col("first.text_key").alias("_key"),
        ),
        "near-placed",
    )
    texts = docs.select(
        docs[id_col].alias("id"),
        text_key(docs[text_col]).alias("text_key"),
        docs[text_col].alias("text"),
    )
    # Texts of one document per class; a repeated row is as good as the first.
    texts = texts.join(
        F.broadcast(placed) if bounded(placed) else placed,
        (F.col("text_key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")),
    ).dropDuplicates(["class"])
    i, j = F.least("block", "_x"), F.greatest("block", "_x")
    units = (
        texts.withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.concat_ws("-", F.hex("component"), i, j).alias("unit"),
            F.col("class"),
            F.when(F.col("block") == i, 0).otherwise(1).alias("side"),
            "size",
            "text",
        )
        .repartition("unit")
        .sortWithinPartitions("unit")
        .select("unit", "class", "side", "size", _hashed_words(F.col("text")).alias("words"))
    )
    linked = write_through(
        units.mapInArrow(_comparer(threshold), "class binary, links long, root binary"),
        "near-links",
    )
    joined = components(linked.select(F.col("class").alias("a"), F.col("root").alias("b")))
    first = F.min("first").alias("first")
    firsts = (
        joined.withColumnRenamed("node", "class")
        .join(classes.select("class", "first"), "class")
        .groupBy("component")
        .agg(first)
    )
    ends = (
        joined.withColumnRenamed("node", "class")
        .join(firsts, "component")
        .select(
            "class",
            F.col("first.id").alias("component_id"),
            F.col("first.text_key").alias("component_key"),
        )
    )
    counts = linked.groupBy("class").agg(F.sum("links").alias("links"))
    facts = (
        classes.select(
            "class",
            "size",
            F.col("first.id").alias("class_id"),
            F.col("first.text_key").alias("_class_key"),
        )
        .join(counts, "class", "left")
        .join(ends.withColumn("_c", F.lit(True)), "class", "left")
    )
    whole = rows.drop("signature").join(facts, "class", "left")
    own = F.col("class").isNull()
    return whole.select(
        "id",
        "text_key",
        "n_shingles",
        F.when(own, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(own, F.lit(0).cast("long"))
        .otherwise(F.col("size") - 1 + F.coalesce("links", F.lit(0)))
        .alias("n_links"),
        F.when(own, F.col("id"))
        .when(F.col("_c"), F.col("component_id"))
        .otherwise(F.col("class_id"))
        .alias("component_id"),
        F.when(own, F.col("text_key"))
        .when(F.col("_c"), F.col("component_key"))
        .otherwise(F.col("_class_key"))
        .alias("component_key"),
    )
