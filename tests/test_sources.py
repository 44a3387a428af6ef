import json
import os
import re
from datetime import datetime, timezone
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelltrace import schema as S
from shelltrace.operators import clean
from shelltrace.operators.joins import join_by_session
from shelltrace.plans import catalog
from shelltrace.session import FOLDERS_PER_TASK, LISTING_TASKS_PER_CORE, spread_rows
from shelltrace.sources import events, processed, sessions

FIELDS = S.EVENT.fieldNames()


def line(**values):
    return json.dumps(values)


def write(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write("".join(text + "\n" for text in lines))
    return str(path)


def test_bad_lines_are_skipped(spark, tmp_path):
    good = line(session_id="s", stdin="ls", exit_code=1, duration_ms=5, timestamp="2024-01-01T00:00:01Z")
    path = write(
        tmp_path / "s" / "events.jsonl",
        [
            "", good, "{invalid json}", "", good + " trailing", good + "] x", good + "]",
            good + "} x", good + "," + good, "[1]", '"text"', "5", "true",
            line(stdin=5), line(exit_code="1"), line(exit_code=1.0), line(exit_code=1.5),
            line(exit_code=10**20), line(stdin={"a": 1}), line(stdin=["a"]),
            line(stdin="extra", other=[1, {"x": "]"}], cwd=None, exit_code=None),
            '{"stdin":"first","stdin":"last"}', "null", "  " + good + "  ",
        ],
    )
    df = events.read_events(spark, path).orderBy("seq")
    assert df.where("ts < '0001-01-02'").count() == 3
    rows = df.drop("ts").collect()
    assert [r.stdin for r in rows] == ["ls", "extra", "last", "", "ls"]
    assert rows[0].exit_code == 1 and rows[0].duration_ms == 5
    assert df.select("ts").first().ts == datetime(2024, 1, 1, 0, 0, 1)
    assert rows[1].cwd == "" and rows[1].exit_code == 0 and rows[1].stdout == ""


def test_missing_path_is_empty(spark, tmp_path):
    df = events.read_events(spark, str(tmp_path / "none"))
    assert df.count() == 0 and set(FIELDS) <= set(df.columns)
    assert events.count_lines(spark, str(tmp_path / "none")).count() == 0


def test_positions_follow_the_lines_of_a_split_file(spark, tmp_path):
    for name, n in (("a", 3000), ("b", 700), ("c", 1)):
        write(tmp_path / name / "events.jsonl", [line(session_id=name, stdin=str(i)) for i in range(n)])
    old = {
        k: spark.conf.get(k)
        for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    }
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        df = events.read_events(spark, str(tmp_path / "*" / "events.jsonl"))
        assert df.rdd.getNumPartitions() > 10
        rows = df.select("session_id", "seq", "stdin").collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for name, n in (("a", 3000), ("b", 700), ("c", 1)):
        mine = sorted((r.seq, int(r.stdin)) for r in rows if r.session_id == name)
        assert [i for _, i in mine] == list(range(n))
        assert len({seq for seq, _ in mine}) == n


def test_sessions_of_several_files_are_ordered_by_name(spark, tmp_path):
    for name, commands in (("2.jsonl", "cd"), ("1.jsonl", "ab"), ("3.jsonl", "e")):
        write(tmp_path / "log" / name, [line(session_id="s", stdin=c) for c in commands])
    df = events.read_events(spark, str(tmp_path / "log"))
    assert "".join(r.stdin for r in df.orderBy("seq").select("stdin").collect()) == "abcde"


def test_stored_positions_survive_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    for batch in ((3, 4), (0, 1, 2)):
        rows = event_rows(spark, [("s", i, f"c{i}", "") for i in batch])
        events.append_events(rows.repartition(2), path)
    got = events.read_events(spark, path).select("seq", "stdin").collect()
    assert sorted(map(tuple, got)) == [(i, f"c{i}") for i in range(5)]


def test_long_lines(spark, tmp_path):
    path = write(tmp_path / "s" / "e.jsonl", [line(stdin="ok"), line(stdin="x" * 100)])
    assert events.read_events(spark, path, 50, "skip").count() == 1
    assert events.read_events(spark, path, None).count() == 2
    with pytest.raises(Exception, match="log line over 50 bytes"):
        events.read_events(spark, path, 50).collect()


def test_append_then_read(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [("t", "s", "tty", "/", "cmd é\n\"", "out", "", 3, 9)]
    df = spark.createDataFrame(rows, S.EVENT)
    events.append_events(df, path)
    events.append_events(df, path)
    assert [tuple(r) for r in events.read_events(spark, path).select(*FIELDS).collect()] == rows * 2


def test_count_lines_includes_malformed_ones(spark, tmp_path):
    write(tmp_path / "s1" / "cache.jsonl", ["{}", "junk", "", "{}"] + ["x"] * 4)
    write(tmp_path / "s2" / "cache.jsonl", [""])
    write(tmp_path / "a b+c%" / "cache.jsonl", ["{}"])
    rows = events.count_lines(spark, str(tmp_path / "*" / "cache.jsonl")).collect()
    assert sorted(map(tuple, rows)) == [("a b+c%", 1), ("s1", 7)]


def test_processed_log(spark, tmp_path):
    path = write(
        tmp_path / "s" / "cache.jsonl",
        [line(stdin="a", repeat_count=2, cache_version=2), line(stdin="b", cache_version="2")],
    )
    row = events.read_processed_log(spark, path).drop("ts").collect()
    assert [(r.stdin, r.repeat_count, r.cache_version) for r in row] == [("a", 2, 2)]


def event_rows(spark, rows):
    df = spark.createDataFrame(rows, "session_id string, seq long, stdin string, stdout string")
    fixed = {
        "timestamp": F.lit("2024-01-01T00:00:00Z"), "terminal_id": F.lit("t"), "cwd": F.lit("/"),
        "stderr": F.lit(""), "exit_code": F.lit(0).cast("long"), "duration_ms": F.lit(1).cast("long"),
        "ts": F.lit("2024-01-01 00:00:00").cast("timestamp"),
    }
    return df.withColumns(fixed)


def test_stored_rows_are_redacted_and_rebuilt_by_session(spark, tmp_path):
    path = str(tmp_path / "processed")
    assert processed.read_processed(spark, path).count() == 0
    log = event_rows(
        spark, [(f"s{i}", j, f"curl token=x{j}", "key=1") for i in range(5) for j in range(3)]
    )
    processed.append_processed(processed.build_processed(log), path)
    stored = processed.read_processed(spark, path)
    assert {(r.stdin, r.processed_stdout) for r in stored.collect()} == {("curl [REDACTED]", "[REDACTED]")}
    processed.rebuild_processed(event_rows(spark, [("s1", 0, "id", ""), ("s9", 0, "w", "")]), path)
    counts = dict(map(tuple, processed.read_processed(spark, path).groupBy("session_id").count().collect()))
    assert counts == {"s0": 3, "s1": 1, "s2": 3, "s3": 3, "s4": 3, "s9": 1}
    # Nothing is left of s1, which may be alone in its bucket.
    for gone in ("s1", "s9"):
        processed.rebuild_processed(event_rows(spark, [(gone, 0, "ls", "")]), path)
    counts = dict(map(tuple, processed.read_processed(spark, path).groupBy("session_id").count().collect()))
    assert counts == {"s0": 3, "s2": 3, "s3": 3, "s4": 3}


def test_staleness(spark):
    raw = spark.createDataFrame(
        [("version", 1), ("fewer", 5), ("fresh", 3), ("none", 2)], "session_id string, n_raw long"
    )
    cached = spark.createDataFrame(
        [("version", 1), ("fewer", 2)] + [("fresh", 2)] * 3, "session_id string, cache_version int"
    )
    rows = {r.session_id: r.is_stale for r in processed.staleness(raw, cached).collect()}
    assert rows == {"version": True, "fewer": True, "fresh": False, "none": True}


def test_sessions(spark, tmp_path):
    path = str(tmp_path / "sessions")
    assert sessions.resolve_session(sessions.read_sessions(spark, path)).count() == 0
    rows = [("a", "2024-01-01T00:00:00Z", "m", "0.1.0"), ("b", "2024-01-02T00:00:00Z", "m", "0.1.0")]
    sessions.append_sessions(spark.createDataFrame(rows, S.META), path)
    table = sessions.read_sessions(spark, path)
    assert sessions.require_session(table).session_id == "b"
    assert sessions.require_session(table, "a").session_id == "a"
    with pytest.raises(LookupError):
        sessions.require_session(table, "zzz")
    new = sessions.new_sessions(spark.createDataFrame([("x",)], "model string")).first()
    assert len(new.session_id) == 36 and new.version == "0.1.0"
    assert datetime.strptime(new.started_at, "%Y-%m-%dT%H:%M:%SZ")


def test_session_documents(spark, tmp_path):
    for name in ("a", "b"):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "meta.json").write_text(json.dumps({"session_id": name, "model": "m"}, indent=2))
    pattern = str(tmp_path / "*" / "meta.json")
    rows = sessions.read_session_documents(spark, pattern).orderBy("session_id").collect()
    assert [tuple(r) for r in rows] == [("a", "", "m", ""), ("b", "", "m", "")]
    with pytest.raises(Exception):
        sessions.read_session_documents(spark, str(tmp_path / "zz.json"), missing_ok=False)


def test_duration_cap(spark):
    meta = spark.createDataFrame([("s", "2024-01-01T00:00:00Z")], "session_id string, started_at string")
    base = datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp()
    df = spark.createDataFrame(
        [("s", i, datetime.fromtimestamp(base + t, timezone.utc)) for i, t in enumerate((0, 28800, 28801))]
        + [("other", 9, datetime.fromtimestamp(base + 10**7, timezone.utc))],
        "session_id string, seq long, ts timestamp",
    )
    assert sorted(r.seq for r in clean.cap_duration(df, meta).collect()) == [0, 1, 9]
    assert clean.cap_duration(df, meta, 0).count() == 4


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_plain_join(spark, how):
    rows = spark.createDataFrame(
        [("hot" if i % 2 else f"s{i}", i) for i in range(300)], "session_id string, seq long"
    )
    dim = spark.createDataFrame([("hot", 1), ("s2", 2), ("s4", 3), ("zz", 4)], "session_id string, v int")
    plain = rows.join(dim, "session_id", how)
    salted = join_by_session(rows, dim, how, max_broadcast_rows=0, rows_per_task=20)
    assert sorted(map(str, salted.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    shares = salted._jdf.queryExecution().toString()
    assert "_share" in shares


def test_folders_are_written_in_many_tasks(spark, tmp_path, monkeypatch):
    n = 3 * FOLDERS_PER_TASK
    spark.range(n).selectExpr(
        "id as event_id", "timestamp_seconds(id) as ts", "id as user_id",
        "'view' as event_type", "1.0 as value", "'' as props",
    ).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(catalog, "scratch_path", lambda spark, name: str(tmp_path / name))
    assert catalog.session_documents(spark, str(tmp_path)).count() == n
    files = list(tmp_path.glob("documents/*/part-*.txt"))
    assert len(files) == n and len({f.name.split("-")[1] for f in files}) > 1


def test_rows_of_one_split_are_spread(spark, tmp_path):
    spark.range(1000, numPartitions=1).write.parquet(str(tmp_path / "one"))
    rows = spread_rows(spark.read.parquet(str(tmp_path / "one")), 50)
    assert rows.rdd.getNumPartitions() == 20
    assert max(map(len, rows.rdd.glom().collect())) <= 60


def test_lines_that_are_no_object_are_not_parsed(spark):
    good = ["{}", ' \t{"stdin":"a"}\r', "null", " null\t", '{"stdin":"}"}']
    bad = ["{", "}", "{}x", "x{}", "{},{}", "{}]", "[{}]", '"{}"', "nullnull", "{]}", "\v{}", "{}\x00"]
    lines = spark.createDataFrame([(x,) for x in good + bad], "value string")
    parsed = events.parse_lines(lines, S.EVENT)
    assert sorted(r.stdin for r in parsed.collect()) == ["", "", "", "a", "}"]
    assert "startswith(trim" in parsed._jdf.queryExecution().optimizedPlan().toString().lower()


KEYS = ["a", "b/c", "d=e%", "f g+h", "'#?*:{[]}^\"\\", None, ""]


def written_texts(path):
    """The lines of each folder's files, hidden ones included."""
    return {
        folder.name: sorted(sorted(f.read_text().split("\n")) for f in folder.iterdir())
        for folder in path.iterdir()
        if folder.is_dir()
    }


def test_folders_are_those_of_sparks_writer(spark, tmp_path):
    rows = [(k, None if i == 3 else f"{k}{i}" * i) for k in KEYS for i in range(9)]
    lines = spark.createDataFrame(rows, "session_id string, value string")
    lines = lines.repartition(1)
    lines.write.option("lineSep", "\n").partitionBy("session_id").text(str(tmp_path / "spark"))
    ours = tmp_path / "our files %20"
    assert events.write_folders(lines, str(ours), "session_id") == len(KEYS) - 1
    spark_texts = {
        f.parent.name: [sorted(f.read_text().split("\n"))]
        for f in (tmp_path / "spark").glob("*/part-*.txt")
    }
    assert written_texts(ours) == spark_texts
    split = lines.withColumn("n", F.length("value") % 3).where("n is not null")
    events.write_folders(split, str(tmp_path / "split"), "session_id", F.col("n"))
    counts = {k: len(v) for k, v in written_texts(tmp_path / "split").items()}
    assert counts["session_id=a"] == 3 and set(counts) == set(spark_texts)


def arrow_lines(rows):
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))],
        ["key", "number", "value"],
    )


def test_a_repeated_task_leaves_each_file_once(tmp_path, monkeypatch):
    monkeypatch.setattr(events.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 7))
    write = events._folder_writer(str(tmp_path / "log"), "session_id")
    first, second = arrow_lines([("a", 0, "1"), ("b", 0, "2")]), arrow_lines([("b", 0, "3")])

    def broken():
        yield first
        raise OSError("lost")

    with pytest.raises(OSError):
        list(write(broken()))
    for _ in range(2):
        assert sum(b.num_rows for b in write(iter([first, second]))) == 2
    files = {f.parent.name: f.read_text() for f in tmp_path.glob("log/*/part-*")}
    assert files == {"session_id=a": "1\n", "session_id=b": "2\n3\n"}
    assert len(list(tmp_path.glob("log/*/part-*"))) == 2


def users_with_events(spark, path, n):
    """A table of one event for each of ``n`` users."""
    spark.range(n).selectExpr(
        "id as event_id", "timestamp_seconds(id) as ts", "id as user_id",
        "'view' as event_type", "1.0 as value", "'' as props",
    ).coalesce(1).write.parquet(str(path / "events.parquet"))


@pytest.mark.parametrize("name, files", [("log_files_scan", 3), ("log_line_counts", 1)])
def test_session_files_are_listed_and_read_without_keys(spark, tmp_path, monkeypatch, name, files):
    n = 100
    users_with_events(spark, tmp_path, n)
    monkeypatch.setattr(catalog, "scratch_path", lambda spark, name: str(tmp_path / name))
    context = spark.sparkContext
    context.setJobGroup(name, name)
    try:
        found = getattr(catalog, name)(spark, str(tmp_path))
        tracker = context.statusTracker()
        jobs = map(tracker.getJobInfo, tracker.getJobIdsForGroup(name))
        tasks = [tracker.getStageInfo(s).numTasks for j in jobs for s in j.stageIds]
        # No task for each folder.
        assert max(tasks) <= LISTING_TASKS_PER_CORE * context.defaultParallelism < n
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"
    # The folders' keys are no column, which would take the square of their number.
    plan = found._jdf.queryExecution().analyzed().toString()
    assert re.search(r"Relation \[value#\d+(,_metadata#\d+)?\] text", plan)
    rows = {r[0]: r[1] for r in found.collect()}
    if files == 1:
        assert rows == {f"u{i}": 9 for i in range(n)}
    else:
        assert rows == {"": n} | {f"u{i}": 1 for i in range(n)}
    # Spark's writer leaves a checksum, and starts two processes, for each file.
    written = [f.name for f in tmp_path.glob("l*/session_id=u*/*")]
    assert n <= len(written) <= files * n and not any(f.startswith(".") for f in written)
