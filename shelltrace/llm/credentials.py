"""Secret scans by corpus-wide ownership frequency.

1. Every whole text is searched for credentials: assignments to names such as
   ``token``, access keys, and runs of hexadecimal digits. Other long tokens
   that mix letters and digits are candidates as well, where they overlap none
   of these.
2. Each candidate's value is hashed; neither the value nor the text leaves the
   scan. Hashes are aggregated by owner and repository, then by hash, so that
   a value that a third of all documents hold is counted before it is
   shuffled.
3. A value held by more than ``max_owners`` owners or ``max_repos``
   repositories is ``copied``: an example that was taken over from document to
   document. Others are ``live`` when they look like drawn at random, and
   ``weak`` when they do not, as words and placeholders do.
4. Spans of a document are all credentials of the first kind, whatever their
   class, and those other tokens that are live.

Spans are in code points, the end exclusive, and cover the whole match; the
value is what is assigned, or the whole match.

Nulls and corner cases: a null or empty text has no spans; null owners are one
owner, null repositories one repository of their owner; ids may be null,
repeat and have any type, each row is judged on its own; a value that repeats
in one repository is held by one. Columns other than those named are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelltrace.llm.common import text_key
from shelltrace.session import write_through

#: Kinds of spans in the order in which those that begin together are listed.
KINDS = ("assign", "access", "hex", "owned")
_BASE = len(KINDS) - 1

# Forms of credentials, least lengths, words of placeholders.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_LEAST_ASSIGNED = 6
# Greedy runs, so a shorter match is no part of one that is long enough.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}")
_PLACEHOLDER = re.compile(
    r"example|sample|changeme|dummy|placeholder|your|xxxx|1234567|abcdef", re.IGNORECASE
)

MAX_OWNERS = 1
MAX_REPOS = 2
#: Bits per character, and characters, from which a value looks random.
LIVE_BITS = 3.0
LIVE_LENGTH = 16

_FOUND = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.IntegerType()),
            T.StructField("kind", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("digest", T.BinaryType()),
            T.StructField("random", T.BooleanType()),
        ]
    )
)


def entropy(value: str) -> float:
    """Bits per character of ``value``'s own letter frequencies."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_random(value: str) -> bool:
    """Long, mixed of letters and digits, of high entropy, no placeholder."""
    digits = sum(c in "0123456789" for c in value)
    letters = sum(c.isalpha() for c in value)
    return (
        len(value) >= LIVE_LENGTH
        and digits >= 2
        and letters >= 2
        and entropy(value) >= LIVE_BITS
        and not _PLACEHOLDER.search(value)
    )


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """``(start, kind, end, value)`` of every candidate, in order."""
    found = [
        (m.start(), 0, m.end(), m.group(2))
        for m in _ASSIGN.finditer(text)
        if len(m.group(2)) >= _LEAST_ASSIGNED
    ]
    for kind, form in enumerate((_ACCESS, _HEX), 1):
        found += [(m.start(), kind, m.end(), m.group()) for m in form.finditer(text)]
    found.sort()
    tokens, at, reach = [], 0, 0
    for m in _TOKEN.finditer(text):
        # All that begins before the token's end; the farthest end decides.
        while at < len(found) and found[at][0] < m.end():
            reach = max(reach, found[at][2])
            at += 1
        if reach <= m.start() and looks_random(m.group()):
            tokens.append((m.start(), _BASE, m.end(), m.group()))
    return sorted(found + tokens)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept_type = pa.list_(
        pa.struct(
            [
                ("start", pa.int32()),
                ("kind", pa.int32()),
                ("end", pa.int32()),
                ("digest", pa.binary()),
                ("random", pa.bool_()),
            ]
        )
    )
    for batch in batches:
        at = batch.schema.get_field_index("text")
        found = [
            [
                (start, kind, end, hashlib.sha256(value.encode()).digest(), looks_random(value))
                for start, kind, end, value in candidates(text or "")
            ]
            for text in batch.column(at).to_pylist()
        ]
        columns = [batch.column(i) for i in range(batch.num_columns) if i != at]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(found, type=kept_type)], [*names, "found"]
        )


def scan(docs: DataFrame, id_col: str, text_col: str, owner: Column, repo: Column) -> DataFrame:
    """``row id text_key owner repo found`` per document, written."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        docs[id_col].alias("id"),
        text_key(docs[text_col]).alias("text_key"),
        owner.cast("string").alias("owner"),
        repo.cast("string").alias("repo"),
        docs[text_col].cast("string").alias("text"),
    )
    schema = T.StructType([f for f in rows.schema if f.name != "text"]).add("found", _FOUND)
    return write_through(rows.mapInArrow(_scan, schema), "candidates")


def ownership(scanned: DataFrame) -> DataFrame:
    """``digest n_rows n_repos n_owners`` of all values, written."""
    held = scanned.select("owner", "repo", F.inline("found"))
    by_repo = held.groupBy("digest", "owner", "repo").agg(F.count(F.lit(1)).alias("n_rows"))
    by_owner = by_repo.groupBy("digest", "owner").agg(
        F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_repos")
    )
    return write_through(
        by_owner.groupBy("digest").agg(
            F.sum("n_rows").alias("n_rows"),
            F.sum("n_repos").alias("n_repos"),
            F.count(F.lit(1)).alias("n_owners"),
        ),
        "ownership",
    )


def judged_candidates(
    scanned: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS
) -> DataFrame:
    """``row id text_key start kind end digest n_rows n_repos n_owners class``."""
    held = scanned.select("row", "id", "text_key", F.inline("found"))
    # Two scans, so that adaptive execution can split a value held by many.
    joined = held.join(ownership(scanned), "digest")
    copied = (F.col("n_owners") > max_owners) | (F.col("n_repos") > max_repos)
    return joined.withColumn(
        "class",
        F.when(copied, "copied").when(F.col("random"), "live").otherwise("weak"),
    ).drop("random")


def _named(spans: Column) -> Column:
    """``kind:start:end`` of each span by start and kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"]),
        ),
        ",",
    )


def secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner: Column | None = None,
    repo: Column | None = None,
    max_owners: int = MAX_OWNERS,
    max_repos: int = MAX_REPOS,
) -> DataFrame:
    """``id n_assign n_access n_hex base spans n_live n_copied`` per document.

    ``base`` names the spans of the first three kinds, ``spans`` all of them.
    ``n_live`` and ``n_copied`` count a document's candidates by class. The
    owner is the column ``source`` unless told otherwise, and so is the
    repository.
    """
    owner = docs["source"] if owner is None else owner
    scanned = scan(docs, id_col, text_col, owner, owner if repo is None else repo)
    judged = judged_candidates(scanned, max_owners, max_repos)
    live = F.col("class") == "live"
    span = F.struct("start", "kind", "end")
    per_row = judged.groupBy("row").agg(
        F.collect_list(F.when((F.col("kind") == _BASE) & live, span)).alias("added"),
        F.count_if(live).alias("n_live"),
        F.count_if(F.col("class") == "copied").alias("n_copied"),
    )
    base = F.transform(
        F.filter("found", lambda x: x["kind"] < _BASE),
        lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")),
    )

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    rows = scanned.withColumn("base", base).join(per_row, "row", "left")
    return rows.select(
        "id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(_BASE)],
        _named(F.col("base")).alias("base"),
        _named(F.concat("base", F.coalesce("added", none))).alias("spans"),
        F.coalesce("n_live", F.lit(0).cast("long")).alias("n_live"),
        F.coalesce("n_copied", F.lit(0).cast("long")).alias("n_copied"),
    )
