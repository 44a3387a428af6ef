"""URL filters over a sorted array of digests.

Rules are ``(host, path, verdict)``. A rule fits its host and all subdomains,
where the path of the URL starts with the rule's; the longest rule wins.

1. The rules' strings, host and path, are hashed to 64 bits (xxhash), sorted
   and laid out as an array of keys, one of places and one of the strings.
   Each Python worker maps them into memory from a file, so that the pages
   are the machine's and not the worker's.
2. A URL asks for every suffix of its host that has as many labels as the host
   of some rule, with every prefix of its path that is as long as the path of
   some rule. All keys of a batch are looked up in one binary search.
3. What is found is compared with the stored string, so that two strings with
   the same key are told apart.

The arrays go to the workers as a broadcast as long as the rules are few and
short; beyond that, distinct questions are matched to shards of the rules by
ranges of the key, one array per shard.

Nulls and corner cases: a null URL, or one without ``://``, has an empty host
and path and fits no rule; rules with a null host or path are ignored; of
equal rules the verdict that sorts first holds; an empty table of rules fits
nothing. The result has the columns of ``pages`` that are asked for by name,
so clashing names do not matter. Rows that repeat are judged one by one.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelltrace.llm.common import ascii_lower
from shelltrace.session import write_through

#: Rules are broadcast up to so many bytes of strings and keys.
BROADCAST_BYTES = 64 << 20
#: Rules of a shard beyond that, and distinct questions that a task puts to it.
SHARD_RULES = 1 << 20
TASK_QUESTIONS = 1 << 20


class Digests(NamedTuple):
    """Sorted keys, and where in ``text`` the string of each key is."""

    keys: np.ndarray
    ends: np.ndarray
    text: np.ndarray


def digest_bytes(keys: np.ndarray, strings: list[str]) -> bytes:
    """The arrays of :class:`Digests` in a row, sorted by key."""
    order = np.argsort(keys, kind="stable")
    encoded = [strings[i].encode() for i in order]
    ends = np.cumsum([len(x) for x in encoded], dtype=np.int64)
    head = np.array([len(keys)], dtype=np.int64)
    sorted_keys = np.asarray(keys, dtype=np.int64)[order]
    return b"".join([head.tobytes(), sorted_keys.tobytes(), ends.tobytes(), *encoded])


def mapped(data: bytes) -> Digests:
    """``data`` as arrays mapped from an unnamed file."""
    with tempfile.TemporaryFile() as f:
        f.write(data)
        f.flush()
        raw = np.memmap(f, dtype=np.uint8, mode="r")
    n = int(raw[:8].view(np.int64)[0])
    return Digests(
        raw[8 : 8 + 8 * n].view(np.int64),
        raw[8 + 8 * n : 8 + 16 * n].view(np.int64),
        raw[8 + 16 * n :],
    )


def probe(digests: Digests, keys: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """Which of ``strings`` are stored; ``keys`` are theirs."""
    found = np.zeros(len(keys), dtype=bool)
    if not len(digests.keys):
        return found
    low = np.searchsorted(digests.keys, keys, "left")
    high = np.searchsorted(digests.keys, keys, "right")
    for i in np.flatnonzero(low < high):
        wanted = strings[i].encode()
        for at in range(low[i], high[i]):
            start = digests.ends[at - 1] if at else 0
            if digests.text[start : digests.ends[at]].tobytes() == wanted:
                found[i] = True
                break
    return found


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z in lower case and path; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def questions(host: Column, path: Column, depths: list[int], lengths: list[int]) -> Column:
    """Host suffixes of ``depths`` labels with path prefixes of ``lengths``."""
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1

    def known(values: list[Column]) -> Column:
        return F.filter(F.array(*values), lambda x: x.isNotNull())

    suffixes = known(
        [F.when(labels >= n, F.substring_index(host, ".", -n)) for n in sorted(depths)]
    )
    prefixes = known(
        [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in sorted(lengths)]
    )
    every = F.flatten(
        F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p)))
    )
    return F.when(host != "", every).otherwise(F.array().cast("array<string>"))


def _lookup(shared):
    held: list[Digests] = []

    @F.pandas_udf("array<string>")
    def known(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        if not held:
            held.append(mapped(shared.value))
        for asked, keys in batches:
            sizes = np.array([len(x) for x in asked], dtype=np.int64)
            strings = np.concatenate([np.asarray(x, dtype=object) for x in asked] or [[]])
            flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in keys] or [[]])
            found = probe(held[0], flat.astype(np.int64), strings)
            ends = np.cumsum(sizes)
            yield pd.Series(
                [
                    strings[end - n : end][found[end - n : end]].tolist()
                    for n, end in zip(sizes, ends)
                ],
                dtype=object,
            )

    return known


def _probe_shard(_, rules: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    digests = mapped(digest_bytes(rules["key"].to_numpy(), rules["rule"].tolist()))
    found = probe(digests, asked["key"].to_numpy(), asked["rule"].to_numpy(dtype=object))
    return asked.loc[found, ["rule"]]


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``id host path rule verdict`` per row of ``pages``.

    ``rules`` has ``host``, ``path`` and ``verdict``; ``default`` is the
    verdict where no rule fits.
    """
    spark = pages.sparkSession
    rule = F.concat(ascii_lower(F.col("host")), "path")
    dots = F.length("host") - F.length(F.replace("host", F.lit("."), F.lit("")))
    rules = write_through(
        rules.select(
            rule.alias("rule"),
            F.length("path").alias("n"),
            (dots + 1).alias("depth"),
            "verdict",
        )
        .where("rule is not null")
        .groupBy("rule")
        .agg(
            F.min("verdict").alias("verdict"),
            F.collect_set("n").alias("n"),
            F.collect_set("depth").alias("depth"),
        )
        .withColumn("key", F.xxhash64("rule")),
        "url-rules",
    )
    # At most as many as a path has characters, or a host has labels.
    lengths = [r[0] for r in rules.select(F.explode("n")).distinct().collect()]
    depths = [r[0] for r in rules.select(F.explode("depth")).distinct().collect()]
    host, path = host_and_path(pages[url_col])
    judged = pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path"))
    if not lengths:
        return judged.withColumn("rule", F.lit(None).cast("string")).withColumn(
            "verdict", F.lit(default)
        )
    judged = judged.withColumn("asked", questions(F.col("host"), F.col("path"), depths, lengths))
    size = rules.agg(F.sum(F.octet_length("rule") + 80)).first()[0]
    if size <= broadcast_bytes:
        rows = rules.select("key", "rule", "verdict").collect()
        shared = spark.sparkContext.broadcast(
            digest_bytes(np.array([r.key for r in rows]), [r.rule for r in rows])
        )
        keys = F.transform("asked", lambda x: F.xxhash64(x))
        # Rules and URLs agree on the string, so a rule is known by it.
        judged = judged.withColumn("fits", _lookup(shared)("asked", keys))
        judged = judged.withColumn("rule", _longest(F.col("fits"))).drop("asked", "fits")
        verdicts = F.broadcast(rules.select("rule", F.col("verdict").alias("_v")))
    else:
        judged = judged.withColumn("_row", F.monotonically_increasing_id())
        judged = write_through(judged, "url-questions")
        count = rules.count()
        shards = -(-count // SHARD_RULES)
        shard = F.pmod(F.shiftrightunsigned("key", 16), F.lit(shards)).alias("shard")
        asked = judged.select("_row", F.explode("asked").alias("rule"))
        distinct = write_through(
            asked.select("rule").distinct().withColumn("key", F.xxhash64("rule")), "url-asked"
        )
        # More groups than shards: the questions of a shard are spread.
        salts = -(-distinct.count() // (shards * TASK_QUESTIONS)) or 1
        spread = F.pmod(F.hash("rule"), F.lit(salts)).alias("salt")
        known = (
            rules.select("key", "rule", shard)
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            .groupBy("shard", "salt")
            .cogroup(distinct.select("key", "rule", shard, spread).groupBy("shard", "salt"))
            .applyInPandas(_probe_shard, "rule string")
        )
        best = (
            asked.join(write_through(known, "url-known"), "rule")
            .groupBy("_row")
            .agg(_longest(F.collect_list("rule")).alias("rule"))
        )
        judged = judged.drop("asked").join(best, "_row", "left").drop("_row")
        verdicts = rules.select("rule", F.col("verdict").alias("_v"))
    return judged.join(verdicts, "rule", "left").select(
        "id",
        "host",
        "path",
        "rule",
        F.coalesce("_v", F.lit(default)).alias("verdict"),
    )


def _longest(fits: Column) -> Column:
    ranked = F.transform(fits, lambda x: F.struct(F.length(x).alias("n"), x.alias("rule")))
    return F.array_max(ranked)["rule"]
