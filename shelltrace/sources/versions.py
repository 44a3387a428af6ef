"""A stored table whose live files are named by a versioned list.

A write adds Parquet files in a folder of its own, the segment, and then a new
version of the list. A version is one small document, put in its place by a
rename that fails where another writer came first, so a reader sees the table
before a write or after it, never a part of it, and a write that was ended
half-way leaves nothing that anyone reads. Files are kept until
:func:`drop_unlisted`; readers of an older version go on undisturbed.

A segment has a folder per bucket, a hash of the key, and the list tells which
buckets of a segment are live. A rewrite of some keys swaps their buckets only;
compaction swaps buckets that have many segments. The number of buckets is
the table's own, set when its first version is written. Rows of a bucket lie
together, in files bounded in size, sorted by key.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "_bucket"
BUCKETS = 64
#: Segments of a bucket from which on it is compacted.
MAX_SEGMENTS = 8
_TRIES = 20


class Conflict(RuntimeError):
    """Another writer's version came first."""


@dataclass(frozen=True)
class Listing:
    """A version of the list: which buckets of which segments are live."""

    version: int = 0
    buckets: int = BUCKETS
    segments: dict[str, list[int]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)
    """Last batch of each stream that has been added."""

    def without(self, gone: set[int]) -> Listing:
        left = {s: [b for b in live if b not in gone] for s, live in self.segments.items()}
        return replace(self, segments={s: live for s, live in left.items() if live})

    def with_segment(self, segment: str | None, live: list[int]) -> Listing:
        added = {segment: sorted(live)} if segment and live else {}
        return replace(self, segments=self.segments | added)

    def crowded(self, most: int = MAX_SEGMENTS) -> set[int]:
        """Buckets that have more than ``most`` segments."""
        counts: dict[int, int] = {}
        for live in self.segments.values():
            for bucket in live:
                counts[bucket] = counts.get(bucket, 0) + 1
        return {bucket for bucket, n in counts.items() if n > most}


class VersionedTable:
    """The table at ``path`` with rows of ``schema``, bucketed by ``key``.

    Rows of a bucket are sorted by ``order`` within their files.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        key: str = "session_id",
        order: tuple[str, ...] = ("session_id", "seq"),
        buckets: int = BUCKETS,
    ):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.key, self.order, self.buckets = key, order, buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        conf = spark._jsc.hadoopConfiguration()
        self._lists = self._hadoop.Path(f"{self.path}/_versions")
        self._fs = self._lists.getFileSystem(conf)
        self._files = self._hadoop.FileContext.getFileContext(self._lists.toUri(), conf)

    # Versions

    def listing(self, version: int | None = None) -> Listing:
        """The given version of the list, or the latest."""
        if not self._fs.exists(self._lists):
            return Listing(buckets=self.buckets)
        if version is None:
            names = [s.getPath().getName() for s in self._fs.listStatus(self._lists)]
            known = [int(n.removesuffix(".json")) for n in names if n[0].isdigit()]
            if not known:
                return Listing(buckets=self.buckets)
            version = max(known)
        text = self.spark.read.text(self._version_path(version), wholetext=True).first()[0]
        return Listing(**json.loads(text))

    def _version_path(self, version: int) -> str:
        return f"{self.path}/_versions/{version:020d}.json"

    def _publish(self, listing: Listing) -> Listing:
        """Make ``listing`` the next version, unless another one is."""
        new = replace(listing, version=listing.version + 1)
        draft = self._hadoop.Path(f"{self.path}/_versions/_{uuid.uuid4().hex}")
        stream = self._fs.create(draft)
        try:
            stream.write(bytearray(json.dumps(new.__dict__).encode()))
        finally:
            stream.close()
        kinds = getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        no_options = self.spark.sparkContext._gateway.new_array(kinds, 0)
        try:
            target = self._hadoop.Path(self._version_path(new.version))
            self._files.rename(draft, target, no_options)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {new.version} of {self.path} exists") from e
            raise
        return new

    def _retry(self, change: Callable[[], Listing]) -> Listing:
        """Work out and publish a change anew until no other writer was first."""
        for _ in range(_TRIES):
            try:
                return self._publish(change())
            except Conflict:
                continue
        raise Conflict(f"{self.path} changes too often")

    # Rows

    def _bucketed(self, df: DataFrame, buckets: int) -> DataFrame:
        bucket = F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")
        return df.select(*self.schema.fieldNames(), bucket.alias(BUCKET))

    def _write(self, df: DataFrame, buckets: int) -> tuple[str | None, list[int]]:
        """A new segment: its name and buckets."""
        name = uuid.uuid4().hex
        path = f"{self.path}/{name}"
        # A bucket's rows meet in one task, or in several where they are many.
        rows = self._bucketed(df, buckets).hint("rebalance", BUCKET)
        rows.sortWithinPartitions(BUCKET, *self.order).write.partitionBy(BUCKET).parquet(path)
        folders = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop.Path(path))]
        live = [int(f.split("=")[1]) for f in folders if f.startswith(f"{BUCKET}=")]
        return name, live

    def _read(self, segments: dict[str, list[int]], keep_bucket: bool = False) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        if not segments:
            rows = self.spark.createDataFrame([], schema)
        else:
            parts = [
                self.spark.read.schema(schema)
                .option("basePath", f"{self.path}/{segment}")
                .parquet(*[f"{self.path}/{segment}/{BUCKET}={b}" for b in live])
                for segment, live in segments.items()
            ]
            rows = reduce(DataFrame.unionByName, parts)
        return rows if keep_bucket else rows.drop(BUCKET)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; a missing table gives none."""
        return self._read(self.listing(version).segments)

    # Writes

    def append(self, df: DataFrame, stream: str | None = None, batch: int = 0) -> Listing:
        """Add rows; a batch of a stream that has been added is not added again."""
        listing = self.listing()
        if stream is not None and listing.batches.get(stream, -1) >= batch:
            return listing
        name, live = self._write(df, listing.buckets)

        def change() -> Listing:
            now = self.listing()
            if now.buckets != listing.buckets:
                raise ValueError("two writers began the table with other numbers of buckets")
            done = now.batches if stream is None else now.batches | {stream: batch}
            return replace(now.with_segment(name, live), batches=done)

        return self._retry(change)

    def replace_keys(self, keys: DataFrame, fresh: DataFrame) -> Listing:
        """Replace all rows whose key is in ``keys`` by ``fresh``.

        ``fresh`` has rows of these keys only. A null key is one of them if it
        is in ``keys``.
        """

        def change() -> Listing:
            now = self.listing()
            touched = self._bucketed_keys(keys, now.buckets)
            old = {s: [b for b in live if b in touched] for s, live in now.segments.items()}
            stored = self._read({s: live for s, live in old.items() if live})
            gone = keys.select(F.col(self.key).alias("_gone")).distinct()
            kept = stored.join(gone, F.col(self.key).eqNullSafe(F.col("_gone")), "left_anti")
            columns = self.schema.fieldNames()
            name, live = self._write(
                kept.select(columns).unionByName(fresh.select(columns)), now.buckets
            )
            return now.without(touched).with_segment(name, live)

        return self._retry(change)

    def _bucketed_keys(self, keys: DataFrame, buckets: int) -> set[int]:
        bucket: Column = F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")
        # At most as many as the table has buckets.
        return {r[0] for r in keys.select(bucket).distinct().collect()}

    def compact(self, most: int = MAX_SEGMENTS) -> Listing:
        """Put buckets that have more than ``most`` segments into one."""
        if not self.listing().crowded(most):
            return self.listing()

        def change() -> Listing:
            now = self.listing()
            many = now.crowded(most)
            old = {s: [b for b in live if b in many] for s, live in now.segments.items()}
            name, live = self._write(
                self._read({s: live for s, live in old.items() if live}), now.buckets
            )
            return now.without(many).with_segment(name, live)

        return self._retry(change)

    def drop_unlisted(self, versions: int = 10) -> int:
        """Delete segments that none of the last ``versions`` lists; how many.

        Not while a write is under way: what it has not listed yet goes too.
        """
        latest = self.listing().version
        kept: set[str] = set()
        for version in range(max(1, latest - versions + 1), latest + 1):
            kept |= set(self.listing(version).segments)
        folders = self._fs.listStatus(self._hadoop.Path(self.path))
        gone = [s.getPath() for s in folders if s.getPath().getName() not in kept | {"_versions"}]
        for path in gone:
            self._fs.delete(path, True)
        return len(gone)
