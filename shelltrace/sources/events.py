"""JSON-lines event logs and processed-event logs."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelltrace import schema as S
from shelltrace.functions import text as X
from shelltrace.operators.joins import join_by
from shelltrace.session import broadcast_if_bounded, listing_by_cores, prepare

_ROW_IN_PARTITION = (1 << 33) - 1
# Room for files of 512 GiB.
_POSITIONS_PER_FILE = 1 << 40
# Names of so many files are broadcast.
MAX_FILES = 1_000_000
_STORED = T.StructType([T.StructField("seq", T.LongType())])
# How Spark names the folder of a key.
_ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")
_NO_KEY = "__HIVE_DEFAULT_PARTITION__"


def _read_lines(
    spark: SparkSession, paths, columns: list[Column], nested: bool = False
) -> DataFrame | None:
    """Non-empty log lines with ``columns``, or None when nothing is there.

    Where folders are named after a key, Spark makes that a column, in a time
    that grows with the square of their number. ``nested`` reads the same files
    without, and files in folders of any other name too.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    try:
        with listing_by_cores(spark):
            lines = spark.read.option("recursiveFileLookup", nested).text(paths)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return lines.select("value", *columns).where(F.octet_length("value") > 0)


def log_position() -> Column:
    """A number that grows along each log file.

    Splits of a file start at different offsets, and a split has at most one
    line per byte, so twice the offset plus the line's number within its task
    is ordered and unique within the file.
    """
    return 2 * F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(
        F.lit(_ROW_IN_PARTITION)
    )


def _accepts(kind: Column, data_type: T.DataType) -> Column:
    names = {
        T.StringType(): ["STRING"],
        T.LongType(): ["BIGINT"],
        T.IntegerType(): ["BIGINT"],
        T.BooleanType(): ["BOOLEAN"],
    }
    return kind.isNull() | kind.isin("VOID", *names[data_type])


def parse_lines(
    lines: DataFrame, schema: T.StructType, optional: T.StructType | None = None
) -> DataFrame:
    """Strictly decode the JSON object in ``value`` into ``schema``.

    A line is dropped when it is not one JSON object, has text after it, or
    has a field of another type. Unknown fields are ignored; missing and null
    fields become ``''`` or 0. Field names are case-sensitive. ``optional``
    fields are NULL when missing or of another type.
    """
    value = F.col("value")
    # The parser stops at the end of the first value. A line can only end the
    # enclosing array early with a bracket; an object wrapper catches those.
    closed = F.when(
        F.contains(value, F.lit("]")),
        F.try_parse_json(F.concat(F.lit('{"line":'), value, F.lit("}"))).isNotNull(),
    ).otherwise(F.lit(True))
    wanted = T.StructType([*schema.fields, *(optional or [])])

    def strict(json: Column) -> Column:
        """The fields looked up and tested one by one."""
        kind = F.schema_of_variant(F.try_variant_get(json, "$[0]", "variant"))
        accepted = kind.startswith("OBJECT<") | (kind == "VOID")
        fields = []
        for f in schema.fields:
            path = f"$[0].{f.name}"
            item = F.try_variant_get(json, path, "variant")
            accepted = accepted & _accepts(F.schema_of_variant(item), f.dataType)
            zero = F.lit("") if isinstance(f.dataType, T.StringType) else F.lit(0)
            found = F.try_variant_get(json, path, f.dataType.simpleString())
            fields.append(F.coalesce(found, zero.cast(f.dataType)).alias(f.name))
        for f in optional or []:
            path, kind = f"$[0].{f.name}", f.dataType.simpleString()
            fields.append(F.try_variant_get(json, path, kind).alias(f.name))
        return F.when(accepted, F.struct(*fields))

    def decode(json: Column) -> Column:
        # Nearly all lines are as this library writes them: their type, read in
        # one pass, is the expected one, and one cast decodes the line.
        usual = F.schema_of_variant(json).isin(
            f"ARRAY<{_object_type(schema)}>", f"ARRAY<{_object_type(wanted)}>"
        )
        whole = F.try_variant_get(json, "$[0]", wanted.simpleString())
        alone = F.try_variant_get(json, "$[1]", "variant").isNull()
        row = F.when(usual, whole).otherwise(strict(json))
        return F.when(json.isNotNull() & alone & closed, row)

    # One expression, so that each line is parsed once: a filter on a parsed
    # column would be pushed below it and parse again.
    # Failing to parse costs more than parsing, so lines that by their first and
    # last character are no object are not tried.
    inner = F.trim(value, F.lit(" \t\r\n"))
    likely = (inner.startswith("{") & inner.endswith("}")) | (inner == "null")
    parsed = F.when(likely, F.try_parse_json(F.concat(F.lit("["), value, F.lit("]"))))
    rows = F.filter(F.transform(F.array(parsed), decode), lambda r: r.isNotNull())
    others = [c for c in lines.columns if c != "value"]
    return lines.select(*others, F.inline(rows))


def _object_type(schema: T.StructType) -> str:
    """How an object with all fields of ``schema`` describes itself."""
    names = {T.StringType(): "STRING", T.LongType(): "BIGINT", T.IntegerType(): "BIGINT"}
    fields = sorted((f.name, names[f.dataType]) for f in schema.fields)
    return f"OBJECT<{', '.join(f'{name}: {kind}' for name, kind in fields)}>"


def check_line_length(
    lines: DataFrame, max_line_bytes: int | None, on_long_line: str
) -> DataFrame:
    """Fail on, or skip, lines over the limit. ``None`` turns it off."""
    if max_line_bytes is None:
        return lines
    short = F.octet_length("value") <= max_line_bytes
    if on_long_line == "skip":
        return lines.where(short)
    if on_long_line != "error":
        raise ValueError("on_long_line is 'error' or 'skip'")
    message = F.lit(f"log line over {max_line_bytes} bytes")
    return lines.where(F.when(short, F.lit(True)).otherwise(F.raise_error(message)))


def _read_log(spark, paths, schema, max_line_bytes, on_long_line, nested=False) -> DataFrame:
    prepare(spark)
    columns = [
        log_position().alias("_position"),
        F.col("_metadata.file_path").alias("log_file"),
    ]
    lines = _read_lines(spark, paths, columns, nested)
    if lines is None:
        empty = S.with_engine_columns(schema).add("log_file", T.StringType())
        return spark.createDataFrame([], empty)
    lines = _after_earlier_files(lines, spark, paths, nested)
    lines = check_line_length(lines, max_line_bytes, on_long_line)
    return parse_lines(lines, schema, _STORED).select(
        *schema.fieldNames(),
        F.coalesce("seq", "_position").alias("seq"),
        X.parse_time(F.col("timestamp")).alias("ts"),
        "log_file",
    )


def read_events(
    spark: SparkSession,
    paths: str | list[str],
    max_line_bytes: int | None = None,
    on_long_line: str = "error",
    nested: bool = False,
) -> DataFrame:
    """Events of JSON-lines logs, with ``seq`` and ``ts``.

    ``seq`` is the position stored with the line or else that of the line among
    all lines, files being in the order of their names. Malformed lines are
    skipped; a missing path gives no rows. ``nested`` reads all folders below
    ``paths`` and is the way to read many of them.
    """
    return _read_log(spark, paths, S.EVENT, max_line_bytes, on_long_line, nested)


def read_processed_log(
    spark: SparkSession,
    paths: str | list[str],
    max_line_bytes: int | None = None,
    on_long_line: str = "error",
) -> DataFrame:
    """Processed events of JSON-lines caches; same rules as ``read_events``."""
    return _read_log(spark, paths, S.CACHED, max_line_bytes, on_long_line)


def _after_earlier_files(lines: DataFrame, spark: SparkSession, paths, nested) -> DataFrame:
    """``_position`` behind those of the files whose names sort first.

    Only names are read for it, as many as the driver has listed anyway.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", nested)
    with listing_by_cores(spark):
        files = reader.load(paths).select("_metadata.file_path")
    names = sorted(r[0] for r in files.distinct().collect())
    if len(names) < 2:
        return lines
    places = [(name, place * _POSITIONS_PER_FILE) for place, name in enumerate(names)]
    table = spark.createDataFrame(places, "log_file string, _start long")
    joined = join_by(lines, broadcast_if_bounded(table, MAX_FILES), ["log_file"])
    return joined.withColumn("_position", F.col("_position") + F.col("_start")).drop("_start")


def append_events(events: DataFrame, path: str) -> None:
    """Append events as JSON lines; null fields are written.

    ``seq`` is stored where there is one, as an append may spread a session
    over several files.
    """
    position = [c for c in _STORED.fieldNames() if c in events.columns]
    events.select(*S.EVENT.fieldNames(), *position).write.mode("append").option(
        "ignoreNullFields", "false"
    ).json(path)


def event_lines(events: DataFrame, schema: T.StructType = S.EVENT) -> DataFrame:
    """Each row as the JSON line a log holds, in column ``value``."""
    return events.withColumn(
        "value",
        F.to_json(F.struct(*schema.fieldNames()), {"ignoreNullFields": "false"}),
    )


def folder_name(column: str, key: str) -> str:
    """The folder that Spark gives the rows of a key; none is the empty one."""
    escaped = _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", key)
    return f"{column}={escaped or _NO_KEY}"


def _full_uri(spark: SparkSession, path: str) -> str:
    """``path`` on the file system that Spark finds it on."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = there.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.makeQualified(there).toUri().toString()


def _folder_writer(path: str, column: str) -> Callable:
    job = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        task = TaskContext.get().partitionId()
        attempt = uuid.uuid4().hex
        current = out = None
        files: dict[tuple[str, int], tuple[str, str]] = {}

        def close():
            if out is not None:
                out.close()
                folder, name = files[current]
                store.move(f"{folder}/.{attempt}-{name}", f"{folder}/{name}")

        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys, numbers, values = batch.columns
            # Where a row is of another file than the one before it.
            other = pc.or_(
                pc.not_equal(keys[1:], keys[:-1]), pc.not_equal(numbers[1:], numbers[:-1])
            )
            starts = [0, *(np.flatnonzero(other) + 1).tolist()]
            bounds = pa.array([*starts, len(values)], pa.int32())
            texts = pc.binary_join(pa.ListArray.from_arrays(bounds, values), "\n")
            for start, text in zip(starts, texts):
                key = (keys[start].as_py(), numbers[start].as_py())
                if key != current:
                    close()
                    folder = f"{root}/{folder_name(column, key[0])}"
                    current, files[key] = key, (folder, f"part-{task:05d}-{key[1]}-{job}.txt")
                    store.create_dir(folder)
                    hidden = f"{folder}/.{attempt}-{files[key][1]}"
                    out = store.open_output_stream(hidden, compression=None)
                out.write(text.as_buffer())
                out.write(b"\n")
        close()
        names = pa.array([name for _, name in files.values()], pa.string())
        yield pa.RecordBatch.from_arrays([names], ["file"])

    return write


def write_folders(
    lines: DataFrame, path: str, column: str, file: Column | None = None
) -> int:
    """Write ``value``, one or more lines, as text files in a folder for each
    ``column`` below ``path``; returns their number.

    Each task that has rows of a folder writes a file there, or one for each
    number in ``file``. The layout is that of Spark's own writer, which on a
    local disk starts two processes for every file to set its mode. A task
    writes under names Spark does not read and then gives each file a name that
    its other attempts give it too: a repeated task replaces files and leaves
    none twice.
    """
    columns = lines.select(
        F.coalesce(F.col(column).cast("string"), F.lit("")).alias("key"),
        (F.lit(0) if file is None else file).cast("long").alias("number"),
        F.coalesce("value", F.lit("")).alias("value"),
    ).sortWithinPartitions("key", "number")
    write = _folder_writer(_full_uri(lines.sparkSession, path), column)
    written = columns.mapInArrow(write, "file string")
    return written.agg(F.count("file")).first()[0]


def count_lines(
    spark: SparkSession, paths: str | list[str], nested: bool = False
) -> DataFrame:
    """Non-empty lines per log directory, malformed ones included:
    ``(session_id, n_lines)``, the session being the file's folder. ``nested``
    is that of ``read_events``."""
    lines = _read_lines(spark, paths, [F.col("_metadata.file_path").alias("file")], nested)
    if lines is None:
        return spark.createDataFrame([], "session_id string, n_lines long")
    # A file's lines share its name, which is taken apart once.
    files = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"))
    folder = F.element_at(F.split("file", "/"), -2)
    # Spark gives paths percent-encoded, with plus signs as they are.
    folder = F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))
    folder = F.regexp_replace(folder, "^session_id=", "")
    files = files.select(folder.alias("session_id"), "n_lines")
    return files.groupBy("session_id").agg(F.sum("n_lines").alias("n_lines"))
