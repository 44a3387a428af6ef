"""Near duplicates of embeddings by a robust-pruned flat graph.

Vectors are compared only within their label. Equal vectors are one point of
the graph, however many copies there are.

1. Centres are picked among the points of each label, evenly by hash, so many
   that a shard stays bounded. A point goes to the shards of all centres whose
   angle is within ``reach`` of its nearest one: shards overlap. With a reach
   of the threshold's angle at least, of two linked points one is always in
   the other's nearest shard: from one point to the other, the difference of
   the angles to the two nearest centres changes its sign, and changes by at
   most twice their angle.
2. In each shard every point gets neighbours by robust pruning: the nearest
   candidate stays and rules out those that are much closer to it than to the
   point, and so on. A second round adds all reverse edges.
3. The adjacency lists that a point has in its shards are united.
4. Each point is searched for in its nearest shard, from the medoids of the
   graph's connected parts and from itself, along the united edges: the best few points met are expanded until nothing better
   turns up, then all that lie within the range, widened by a margin, until no
   such point is left.
5. What is found is verified in double precision.

``audit_recall`` measures the links found against those that brute force finds
for the stated queries.

Nulls and corner cases: vectors that are null, zero, or hold null or
non-finite components, and those without a label, link with nothing and are
components of their own, as are vectors of another length than their partner.
Ids are ordered with nulls last; rows that repeat an id are vectors of their
own. Columns other than those named are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from shelltrace.llm.common import bounded, components
from shelltrace.session import write_through

THRESHOLD = 0.98
#: Points of a shard, on average over its own; overlap comes on top.
SHARD_POINTS = 1_000
#: Centres of a label up to which they are compared with all its points.
MAX_CENTRES = 4_096
#: Centres are sent to all workers up to so many bytes.
CENTRE_BYTES = 64 << 20
#: Degrees by which the reach exceeds the threshold's angle, for rounding.
REACH_SLACK = 0.05
DEGREE = 24
ALPHA = 1.2
BEAM = 32
#: The range is widened by this much cosine while the search expands it.
MARGIN = 0.06
_BATCH = 256


def usable_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id label vector ok``; the vector in double precision."""
    v = df[vector_col].cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return df.select(
        df[id_col].alias("id"),
        df[label_col].cast("string").alias("label"),
        v.alias("vector"),
        F.coalesce(finite & some & df[label_col].isNotNull(), F.lit(False)).alias("ok"),
    )


def _unit(rows: list) -> np.ndarray:
    v = np.stack([np.frombuffer(x) for x in rows]) if len(rows) else np.zeros((0, 1))
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@F.pandas_udf(BinaryType())
def _packed(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, np.float64).tobytes())


def points_of(usable: DataFrame) -> DataFrame:
    """Distinct vectors per label: ``label point vector size first``."""
    packed = usable.where("ok").select("id", "label", _packed("vector").alias("vector"))
    # 0.0 and -0.0 differ in their bytes only; such vectors are found as links.
    return packed.groupBy("label", "vector").agg(
        F.count(F.lit(1)).alias("size"),
        F.min(F.struct(F.col("id").isNull().alias("last"), "id")).alias("first"),
    ).withColumn("point", F.xxhash64("label", "vector"))


def assigned(points: DataFrame, shard_points: int, reach: float) -> DataFrame:
    """``label shard point vector own``: points in the shards of their centres.

    The centres are a sample of points, as many per label as there are shards
    and at most ``MAX_CENTRES``: a bounded table per label.
    """
    sizes = points.groupBy("label", F.octet_length("vector").alias("w")).agg(
        F.count(F.lit(1)).alias("n")
    )
    wanted = F.least(F.ceil(F.col("n") / shard_points), F.lit(MAX_CENTRES))
    narrow = points.select("label", "point", "vector", F.octet_length("vector").alias("w"))
    share = F.pmod(F.xxhash64("point", F.lit(5)), F.lit(1 << 30)) / (1 << 30)
    sampled = (
        narrow.join(F.broadcast(sizes) if bounded(sizes) else sizes, ["label", "w"])
        .where(share < 2 * wanted / F.col("n"))
        .groupBy("label", "w")
        .agg(
            F.slice(F.sort_array(F.collect_list(F.struct("point", "vector"))), 1, 2 * MAX_CENTRES)
            .getField("vector")
            .alias("centres")
        )
    )
    sampled = write_through(sampled, "shard-centres")
    size = sampled.agg(F.sum(F.size("centres").cast("long") * F.col("w"))).first()[0] or 0
    shared = None
    if size <= CENTRE_BYTES:
        held = {(r.label, r.w): [bytes(c) for c in r.centres] for r in sampled.collect()}
        shared = points.sparkSession.sparkContext.broadcast(held)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cosine = {}
        for batch in batches:
            out = []
            for (label, w), part in batch.groupby(["label", "w"], sort=False):
                key = (label, w)
                centres = shared.value.get(key) if shared else part["centres"].iloc[0]
                if centres is None or len(centres) == 0:
                    out.append(part.assign(shard=f"{w}-0", own=True))
                    continue
                if key not in cosine:
                    # Of a label that comes with its rows, one is held at a time.
                    cosine = (cosine if shared else {}) | {key: _unit(list(centres))}
                unit = _unit(part["vector"].tolist())
                angle = np.degrees(np.arccos(np.clip(unit @ cosine[key].T, -1, 1)))
                nearest = angle.argmin(axis=1)
                rows, shards = np.nonzero(angle <= angle.min(axis=1, keepdims=True) + reach)
                held = part.iloc[rows]
                out.append(
                    held.assign(shard=[f"{w}-{s}" for s in shards], own=nearest[rows] == shards)
                )
            yield pd.concat(out)[["label", "shard", "point", "vector", "own"]]

    # Centres of very many labels come with the rows, of one label in a task.
    joined = narrow if shared else narrow.join(sampled, ["label", "w"], "left")
    return joined.mapInPandas(
        assign, "label string, shard string, point long, vector binary, own boolean"
    )


def robust_prune(
    i: int, candidates: np.ndarray, near: np.ndarray, unit: np.ndarray, degree: int, alpha: float
) -> np.ndarray:
    """Neighbours of ``i`` among ``candidates``, whose cosines to it are ``near``."""
    order = np.argsort(-near, kind="stable")
    left = candidates[order]
    away = 1 - near[order]
    chosen = []
    while len(left) and len(chosen) < degree:
        best = left[0]
        chosen.append(best)
        between = 1 - unit[left] @ unit[best]
        stays = (alpha * between > away) & (left != best)
        left, away = left[stays], away[stays]
    return np.array(chosen, dtype=np.int64)


def build_graph(unit: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[np.ndarray]:
    """Adjacency lists of a shard's points."""
    n = len(unit)
    pool = min(n - 1, 3 * degree)
    graph: list[np.ndarray] = []
    for low in range(0, n, _BATCH):
        block = unit[low : low + _BATCH] @ unit.T
        block[np.arange(len(block)), np.arange(low, low + len(block))] = -2
        for i, row in enumerate(block, low):
            near = np.argpartition(-row, pool - 1)[:pool] if pool else np.zeros(0, int)
            graph.append(robust_prune(i, near, row[near], unit, degree, alpha))
    back: list[list[int]] = [[] for _ in range(n)]
    for i, near in enumerate(graph):
        for j in near:
            back[j].append(i)
    for i in range(n):
        # Not pruned again: of points that almost coincide all but one would go,
        # and nothing would lead to them.
        graph[i] = np.union1d(graph[i], back[i]).astype(np.int64)
    return graph


def medoids(unit: np.ndarray, graph: list[np.ndarray]) -> np.ndarray:
    """The medoid of each connected part of the graph.

    Dense groups may have no edge to the rest, so one medoid does not lead to
    all points.
    """
    n = len(unit)
    part = np.arange(n)
    flat = np.concatenate([np.append(near, i) for i, near in enumerate(graph)])
    starts = np.concatenate([[0], np.cumsum([len(near) + 1 for near in graph])[:-1]])
    while True:
        least = np.minimum.reduceat(part[flat], starts)
        least = least[least]
        if (least == part).all():
            break
        part = least
    sums = np.zeros_like(unit)
    np.add.at(sums, part, unit)
    order = np.lexsort((-(unit * sums[part]).sum(axis=1), part))
    return order[np.flatnonzero(np.diff(part[order], prepend=-1))]


def range_search(
    query: int, unit: np.ndarray, graph: list[np.ndarray], starts: np.ndarray, threshold: float,
    beam: int = BEAM, margin: float = MARGIN,
) -> np.ndarray:
    """Points within ``threshold`` of ``query`` that the graph leads to."""
    goal = unit[query]
    seen = np.zeros(len(unit), dtype=bool)
    pool = np.union1d(starts, [query])
    seen[pool] = True
    cosine = unit[pool] @ goal
    order = np.argsort(-cosine, kind="stable")
    pool, cosine = pool[order], cosine[order]
    done = np.zeros(len(pool), dtype=bool)
    wide = threshold - margin
    while True:
        # The best few, and all within the widened range.
        open_ = ~done & ((np.arange(len(pool)) < beam) | (cosine >= wide))
        if not open_.any():
            break
        turn = np.flatnonzero(open_)[:8]
        done[turn] = True
        fresh = np.unique(np.concatenate([graph[p] for p in pool[turn]]))
        fresh = fresh[~seen[fresh]]
        if len(fresh):
            seen[fresh] = True
            pool = np.concatenate([pool, fresh])
            cosine = np.concatenate([cosine, unit[fresh] @ goal])
            done = np.concatenate([done, np.zeros(len(fresh), dtype=bool)])
            order = np.argsort(-cosine, kind="stable")
            keep = order[(np.arange(len(order)) < 2 * beam) | (cosine[order] >= wide)]
            pool, cosine, done = pool[keep], cosine[keep], done[keep]
    found = pool[(cosine >= threshold - 1e-9) & (pool != query)]
    return np.sort(found)


def _build(shard: pd.DataFrame) -> pd.DataFrame:
    shard = shard.sort_values("point", kind="stable")
    graph = build_graph(_unit(shard["vector"].tolist()))
    points = shard["point"].to_numpy()
    return pd.DataFrame(
        {
            "label": shard["label"],
            "point": points,
            "near": [points[g].tolist() for g in graph],
        }
    )


def _searcher(threshold: float):
    def search(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values("point", kind="stable")
        unit = _unit(shard["vector"].tolist())
        points = shard["point"].to_numpy()
        graph = []
        for near in shard["near"]:
            near = np.asarray(near, dtype=np.int64)
            at = np.clip(np.searchsorted(points, near), 0, len(points) - 1)
            graph.append(at[points[at] == near])
        starts = medoids(unit, graph)
        out_a, out_b = [], []
        for i in np.flatnonzero(shard["own"].to_numpy()):
            found = range_search(i, unit, graph, starts, threshold)
            a = np.minimum(points[i], points[found])
            out_a.append(a)
            out_b.append(np.maximum(points[i], points[found]))
        flat = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
        return pd.DataFrame({"a": flat(out_a), "b": flat(out_b)})

    return search


@F.pandas_udf(DoubleType())
def _verified(a: pd.Series, b: pd.Series) -> pd.Series:
    left, right = _unit(a.tolist()), _unit(b.tolist())
    return pd.Series((left * right).sum(axis=1))


def vector_links(
    points: DataFrame,
    threshold: float = THRESHOLD,
    shard_points: int = SHARD_POINTS,
    reach: float | None = None,
) -> DataFrame:
    """Linked points ``(a, b)``, each pair once, found by graph search.

    ``reach`` is in degrees; by default the threshold's angle.
    """
    if reach is None:
        reach = float(np.degrees(np.arccos(threshold))) + REACH_SLACK
    shards = write_through(assigned(points, shard_points, reach), "vector-shards")
    graph = shards.groupBy("label", "shard").applyInPandas(
        _build, "label string, point long, near array<long>"
    )
    union = (
        graph.groupBy("label", "point")
        .agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    )
    placed = shards.join(write_through(union, "vector-graph"), ["label", "point"])
    found = (
        placed.groupBy("label", "shard")
        .applyInPandas(_searcher(threshold), "a long, b long")
        .distinct()
    )
    known = points.select("point", "vector")
    return (
        found.hint("merge")
        .join(known.toDF("a", "va"), "a")
        .hint("merge")
        .join(known.toDF("b", "vb"), "b")
        .where(_verified("va", "vb") >= threshold)
        .select("a", "b")
    )


def near_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``id n_links component_id kept`` per row."""
    usable = usable_vectors(df, id_col, vector_col, label_col)
    packed = write_through(
        usable.select(
            "id",
            "ok",
            F.when(F.col("ok"), F.xxhash64("label", _packed("vector"))).alias("point"),
        ),
        "vector-rows",
    )
    points = write_through(points_of(usable), "vector-points")
    links = write_through(vector_links(points, threshold), "vector-links")
    sizes = points.select("point", "size", "first")
    both = links.union(links.select("b", "a").toDF("a", "b"))
    counts = (
        both.join(sizes.withColumnRenamed("point", "b"), "b")
        .groupBy("a")
        .agg(F.sum("size").alias("links"))
        .withColumnRenamed("a", "point")
    )
    joined = components(links).withColumnRenamed("node", "point")
    firsts = (
        joined.join(sizes, "point")
        .groupBy("component")
        .agg(F.min("first").alias("_first"))
    )
    facts = (
        sizes.join(counts, "point", "left")
        .join(joined.join(firsts, "component").select("point", "_first"), "point", "left")
        .select(
            "point",
            (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce(F.col("_first"), F.col("first"))["id"].alias("component_id"),
        )
    )
    component = F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("id"))
    return (
        packed.join(facts, "point", "left")
        .select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
    )


def audit_recall(
    df: DataFrame,
    links: DataFrame,
    points: DataFrame,
    threshold: float = THRESHOLD,
    every: int = 50,
    id_col: str = "vec_id",
) -> float:
    """Share of the links of every ``every``-th id that ``links`` holds.

    The queries meet all points in blocks of their label, in a join.
    """
    queries = points.where(F.pmod(F.col("first.id"), F.lit(every)) == 0)
    queries = queries.select("label", F.col("point").alias("q"), F.col("vector").alias("vq"))
    asked = queries.groupBy("label", F.pmod("q", F.lit(64)).alias("_b")).agg(
        F.collect_list(F.struct("q", "vq")).alias("block")
    )

    def brute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})]
            for p, v, block in zip(batch["point"], batch["vector"], batch["block"]):
                q = np.array([x["q"] for x in block])
                hit = _unit([x["vq"] for x in block]) @ _unit([v])[0] >= threshold
                hit &= q != p
                out.append(pd.DataFrame({"a": np.minimum(q[hit], p), "b": np.maximum(q[hit], p)}))
            yield pd.concat(out)

    true = (
        points.select("label", "point", "vector")
        .join(asked, "label")
        .mapInPandas(brute, "a long, b long")
        .distinct()
    )
    true = write_through(true, "vector-audit")
    total = true.count()
    return 1.0 if not total else true.join(links, ["a", "b"]).count() / total
