"""Web archives with an index that is written first and read by byte ranges.

Records are WARC/1.1, each a gzip member of its own, so that a reader can
start at any of them. Every write task appends its records to archives of its
own in the shared folder, under names no other attempt uses; the index has one
row per record with archive, offset, length, URL and digest. It is the only
way into the archives: what a lost or repeated task has left behind is never
referred to.

Reading takes the index rows of the selected records, in order of archive and
offset, merges ranges that are close to each other, and cuts the records out
of what each merged range returns.

Of records with equal payloads of at least ``min_bytes`` bytes, the one with
the smallest id is a response and the others revisit it; smaller payloads are
always responses.

Nulls and corner cases: a null payload is empty; a null URL is left out of the
record; ids are ordered with nulls last, and rows that share the smallest id
of their payload are all responses; ids, URLs and payloads may hold any text,
line ends in URLs are percent-encoded. Columns other than those named are
ignored. An empty table gives an empty index.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelltrace.llm.common import bounded
from shelltrace.session import scratch_path

MIN_BYTES = 100
#: An archive is closed when it has grown to so many bytes.
ARCHIVE_BYTES = 1 << 28
#: Ranges with at most so many bytes between them are read as one ...
GAP_BYTES = 1 << 16
#: ... up to so many bytes. A longer record is read by itself.
RANGE_BYTES = 1 << 23
_READ_TASKS = 100_000
_LINE = b"\r\n"

INDEX = (
    "id long, url string, archive string, offset long, length long,"
    " payload_bytes long, payload_digest string, record_type string, refers_to long"
)
RECORD = (
    "id long, url string, record_type string, payload_bytes long,"
    " payload_digest string, refers_to long, payload binary"
)


def _header(row: dict) -> bytes:
    revisit = row["record_type"] == "revisit"
    fields = {
        "WARC-Type": row["record_type"],
        "WARC-Record-ID": _record_id(row["id"]),
        "WARC-Target-URI": row["url"] and quote(row["url"], safe="%/:?#[]@!$&'()*+,;=~"),
        "WARC-Payload-Digest": f"sha256:{row['payload_digest']}",
        "WARC-Refers-To": _record_id(row["refers_to"]) if revisit else None,
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        if revisit
        else None,
        "X-Payload-Length": str(row["payload_bytes"]),
        "Content-Type": "text/html; charset=utf-8",
    }
    lines = [f"{k}: {v}" for k, v in fields.items() if v is not None]
    return _LINE.join([b"WARC/1.1", *(x.encode() for x in lines)])


def _record_id(number) -> str:
    return f"<urn:x-page:{'' if number is None else number}>"


def _record(row: dict) -> bytes:
    body = b"" if row["record_type"] == "revisit" else row["payload"]
    head = _header(row) + _LINE + f"Content-Length: {len(body)}".encode() + _LINE * 2
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head) + pack.compress(body + _LINE * 2) + pack.flush()


def parse_record(packed: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and body of one gzip member."""
    raw = zlib.decompress(packed, 31)
    head, _, rest = raw.partition(_LINE * 2)
    fields = dict(
        x.decode().split(": ", 1) for x in head.split(_LINE)[1:] if b": " in x
    )
    return fields, rest[: int(fields["Content-Length"])]


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        store, root = fs.FileSystem.from_uri(folder)
        out = name = None
        offset = 0
        for batch in batches:
            rows, found = batch.to_pylist(), []
            for row in rows:
                if out is None:
                    name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                packed = _record(row)
                out.write(packed)
                found.append(
                    row | {"archive": name, "offset": offset, "length": len(packed)}
                )
                offset += len(packed)
                if offset >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            for row in found:
                del row["payload"]
            yield pa.RecordBatch.from_pylist(found, schema=_INDEX_ARROW)
        if out is not None:
            out.close()

    return write


_INDEX_ARROW = pa.schema(
    [
        ("id", pa.int64()),
        ("url", pa.string()),
        ("archive", pa.string()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
    ]
)
_RECORD_ARROW = pa.schema(
    [
        ("id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
    ]
)


def _uri(folder: str) -> str:
    """As a URI; a plain path is a file."""
    return folder if ":/" in folder else f"file://{folder}"


def write_archives(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    folder: str | None = None,
    min_bytes: int = MIN_BYTES,
) -> DataFrame:
    """Write a record per row below ``folder``; returns the index table.

    ``folder`` is new, and every executor reaches it. The default is one in
    the cluster's shared folder.
    """
    spark = pages.sparkSession
    folder = _uri(folder or scratch_path(spark, "warc"))
    payload = F.coalesce(pages[payload_col], F.lit("")).cast("binary")
    rows = pages.select(
        pages[id_col].cast("long").alias("id"),
        pages[url_col].cast("string").alias("url"),
        payload.alias("payload"),
    ).select(
        "*",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
    )
    # Digests that several ids share; counted before anything is shuffled.
    shared = (
        rows.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first is not null")
        .select("payload_digest", "first")
    )
    shared = _written(shared, f"{folder}/shared-digests")
    if bounded(shared):
        shared = F.broadcast(shared)
    revisit = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    records = (
        rows.join(shared, "payload_digest", "left")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("first")))
        .select(
            "id",
            "url",
            "payload",
            "payload_bytes",
            "payload_digest",
            "record_type",
            "refers_to",
        )
    )
    store = f"{folder}/archives"
    # The folder is made by a write that all executors see.
    _written(records.limit(0).select("id"), store)
    index = records.mapInArrow(_writer(store), INDEX)
    return _written(
        index.withColumn("archive", F.concat(F.lit(f"{store}/"), "archive")),
        f"{folder}/index",
    )


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged_ranges(
    places: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = RANGE_BYTES
) -> list[tuple[int, int, list[int]]]:
    """``(start, end, members)`` of sorted ``(offset, length)`` places."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (offset, length) in enumerate(places):
        end = offset + length
        if out and offset <= out[-1][1] + gap and max(end, out[-1][1]) - out[-1][0] <= most:
            start, upto, members = out[-1]
            out[-1] = (start, max(end, upto), [*members, i])
        else:
            out.append((offset, end, [i]))
    return out


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened: tuple[str, object] | None = None
    for batch in batches:
        rows = batch.to_pylist()
        at = 0
        while at < len(rows):
            archive = rows[at]["archive"]
            upto = at
            while upto < len(rows) and rows[upto]["archive"] == archive:
                upto += 1
            if opened is None or opened[0] != archive:
                if opened:
                    opened[1].close()
                store, path = fs.FileSystem.from_uri(archive)
                opened = (archive, store.open_input_file(path))
            part = rows[at:upto]
            for start, end, members in merged_ranges(
                [(r["offset"], r["length"]) for r in part]
            ):
                data = opened[1].read_at(end - start, start)
                yield pa.RecordBatch.from_pylist(
                    [_returned(part[i], data, start) for i in members],
                    schema=_RECORD_ARROW,
                )
            at = upto
    if opened:
        opened[1].close()


def _returned(entry: dict, data: bytes, start: int) -> dict:
    offset = entry["offset"] - start
    fields, body = parse_record(data[offset : offset + entry["length"]])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and hashlib.sha256(body).hexdigest() != digest:
        raise ValueError(f"record {entry['id']} in {entry['archive']} is damaged")
    return {
        "id": _number(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "payload_bytes": int(fields["X-Payload-Length"]) if revisit else len(body),
        "payload_digest": digest,
        "refers_to": _number(fields["WARC-Refers-To"]) if revisit else None,
        "payload": None if revisit else body,
    }


def _number(record_id: str) -> int | None:
    text = record_id.removeprefix("<urn:x-page:").removesuffix(">")
    return int(text) if text else None


def read_records(index: DataFrame) -> DataFrame:
    """The records of ``index``, which may be any selection of its rows.

    The payload of a revisit is null; it is that of the record it refers to.
    """
    places = index.select("id", "archive", "offset", "length")
    # Few bytes of index stand for many of records.
    size = places.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, min(-(-size // RANGE_BYTES), _READ_TASKS))
    ranges = places.repartitionByRange(tasks, "archive", "offset")
    return ranges.sortWithinPartitions("archive", "offset").mapInArrow(_reader, RECORD)
