import random
import time

import pytest

import models
from test_sources import event_rows
from test_transcripts import BASE, streams, table
from shelltrace import schema as S
from shelltrace.plans import catalog
from shelltrace.sources.processed import build_processed, read_processed
from shelltrace.streaming import ingest, preprocess, reorder


def recorded(df):
    return sorted(
        (r.session_id, r.seq, r.stdin, r.cwd, r.exit_code, r.duration_ms, r.stdout)
        for r in df.collect()
    )


def run(spark, tmp_path, data, batches, **options):
    df = table(spark, data)
    feed = str(tmp_path / "feed")
    for i in range(batches):
        part = df.where(f"floor(seq * {batches} / 40) = {i}" if i < batches - 1
                        else f"floor(seq * {batches} / 40) >= {i}")
        part.coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(S.TRANSCRIPT).parquet(feed)
        ingest.run_ingest(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), **options)
    return spark.read.schema(ingest.EVENTS).parquet(str(tmp_path / "out"))


def test_state_survives_between_batches(spark, tmp_path):
    data = streams(6, 40)
    got = recorded(run(spark, tmp_path, data, 3, max_output_bytes=9))
    want = [
        (sid, *e[:5]) for sid in sorted(data) for e in models.transcript_events(data[sid], 9)
    ]
    assert len(want) > 30 and [g[:1] + g[2:] for g in got] == want


def test_event_cap_per_terminal(spark, tmp_path):
    rnd = random.Random(3)
    body = b"".join(
        b"\x1b]7770;S\x07x\x1b]7770;E;0;1;/;bHM=\x07" for _ in range(12)
    )
    cuts = sorted(rnd.sample(range(1, len(body)), 39))
    chunks = [body[a:b] for a, b in zip([0, *cuts], [*cuts, len(body)])]
    rows = run(spark, tmp_path, {"s": chunks}, 2, max_events=5).collect()
    assert len(rows) == 5 and {r.stdout for r in rows} == {"x"}
    assert min(r.ts for r in rows) >= BASE.replace(tzinfo=None)


def test_late_rows_stop_the_stream(spark, tmp_path):
    feed = str(tmp_path / "feed")
    df = table(spark, streams(6, 3))
    with pytest.raises(Exception, match="arrived after row"):
        for part in (df.where("seq >= 1"), df.where("seq < 1")):
            part.coalesce(1).write.mode("append").parquet(feed)
            stream = spark.readStream.schema(S.TRANSCRIPT).parquet(feed)
            ingest.run_ingest(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"))


def test_open_marker_costs_linear_time():
    terminal = ingest.Terminal((b"", False, b"", 0, 0, None), None, None)
    began = time.time()
    assert not list(terminal.read(b"\x1b]7770;"))
    for _ in range(2000):
        assert not list(terminal.read(b"x" * 4096))
    assert time.time() - began < 1
    assert not list(terminal.read(b"\x07\x1b]7770;S\x07out\x1b]77"))
    assert list(terminal.read(b"70;E;0\x07")) == [(1, b"out", b"E;0")]
    short = ingest.Terminal((b"", False, b"", 0, 0, None), None, None, max_marker=20)
    with pytest.raises(ValueError, match="longer than 20"):
        list(short.read(b"\x1b]7770;" + b"x" * 20))


def test_preprocess_stream_equals_batch(spark, tmp_path):
    log = event_rows(
        spark,
        [(f"s{i % 4}", i, ["cd /", "cat x", "nmap h", "echo token=1"][i % 4], "80/tcp open x\n") for i in range(20)],
    )
    log.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    preprocess.run_preprocess(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    columns = ["session_id", "seq", "stdin", "tool_name", "processed_stdout", "cache_version"]
    got = read_processed(spark, str(tmp_path / "out")).select(*columns)
    want = build_processed(log).select(*columns)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 15


class Waiting(dict):
    """A map state's methods."""

    containsKey, getValue, removeKey = dict.__contains__, dict.__getitem__, dict.pop

    def updateValue(self, key, value):
        self[key] = value


def read_in(order, chunks, ats=None, idle=None, **limits):
    limits = {"max_output": None, "max_events": None, "max_marker": 1 << 20} | limits
    reader = reorder.Reader(reorder._NEW, Waiting(), limits, idle)
    found = []
    for seq in order:
        found += reader.offer(seq, chunks[seq], ats[seq] if ats else 0)
        reader = reorder.Reader(reader.state(), reader.waiting, limits, idle)
    return found, reader


def test_any_order_reads_alike():
    rnd = random.Random(8)
    for chunks in streams(9, 30).values():
        places = list(range(len(chunks)))
        want, _ = read_in(places, chunks)
        shuffled = places + places[::7]
        rnd.shuffle(shuffled)
        got, reader = read_in(shuffled, chunks)
        assert got == want and not reader.waiting and reader.n_waiting == 0


def test_gaps_are_given_up_and_idle_terminals_begin_anew():
    start, end = b"\x1b]7770;S\x07x", b"\x1b]7770;E;0;1;/;bHM=\x07"
    chunks = [start, end, start, end, start, end, start, end]
    got, reader = read_in([0, 1, 2, 4, 5, 6, 7], chunks)
    assert len(got) == 1 and reader.n_waiting == 4
    assert [c[:3] for c in reader.give_up()] == [(4, b"x", b"E;0;1;/;bHM="), (6, b"x", b"E;0;1;/;bHM=")]
    ats = [0, 1, 2, 3, 104, 105, 106, 107]
    for idle, n in ((None, 1), (100, 2)):
        got, _ = read_in([7, 0, 2, 1, 3, 5, 4, 6], chunks, ats, idle, max_events=1)
        assert len(got) == n
    got, _ = read_in(range(8), chunks, [0, 200, 201, 202, 203, 204, 205, 206], 100)
    assert [g[1] for g in got] == [b"", b"x", b"x", b"x"]


def test_shuffled_stream_equals_batch(spark, tmp_path):
    data = streams(6, 40)
    df, feed = table(spark, data), str(tmp_path / "feed")
    for i in (2, 0, 1, 0):
        df.where(f"pmod(hash(seq), 3) = {i}").repartition(2).write.mode("append").parquet(feed)
    stream = spark.readStream.schema(S.TRANSCRIPT).option("maxFilesPerTrigger", 2).parquet(feed)
    reorder.run_unordered(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), max_output_bytes=9)
    got = recorded(spark.read.schema(ingest.EVENTS).parquet(str(tmp_path / "out")))
    want = [
        (sid, *e[:5]) for sid in sorted(data) for e in models.transcript_events(data[sid], 9)
    ]
    assert [g[:1] + g[2:] for g in got] == want


class Asked(dict):
    """A map state that counts what it is asked."""

    n = 0

    def _count(self, found):
        self.n += 1
        return found

    def containsKey(self, key):
        return self._count(key in self)

    def getValue(self, key):
        return self._count(self.get(key))

    def updateValue(self, key, value):
        self._count(self.__setitem__(key, value))

    def removeKey(self, key):
        self._count(self.pop(key))


def test_waiting_rows_ask_the_store_by_block():
    rnd = random.Random(5)
    start, end = b"\x1b]7770;S\x07", b"\x1b]7770;E;0;1;/;bHM=\x07"
    chunks = []
    for i in range(300):
        chunks += [start, b"x" * (reorder.BLOCK_PAYLOAD + i if i % 50 == 0 else i), end]
    places = list(range(len(chunks)))
    want, _ = read_in(places, chunks)
    rnd.shuffle(places)
    limits = {"max_output": None, "max_events": None, "max_marker": 1 << 20}
    state, store, found = reorder._NEW, Asked(), []
    for batch in (places[:400], places[400:650], places[650:] + places[:9]):
        reader = reorder.Reader(state, None, limits, None)
        reader.waiting = reorder.WaitingRows(store, nothing=reader.n_waiting == 0)
        for seq in sorted(batch):
            found += reader.offer(seq, chunks[seq], 0)
        reader.waiting.flush()
        state = reader.state()
    assert found == want and not store and reader.n_waiting == 0
    # Six long rows are asked for on their own.
    assert store.n < 120


def test_a_block_gives_the_first_of_the_rows_that_wait():
    start, end = b"\x1b]7770;S\x07x", b"\x1b]7770;E;0;1;/;bHM=\x07"
    limits = {"max_output": None, "max_events": None, "max_marker": 1 << 20}
    store = Asked()
    reader = reorder.Reader(reorder._NEW, None, limits, None)
    reader.waiting = reorder.WaitingRows(store, nothing=True)
    for seq in (900, 901, 130, 131, 902):
        assert not list(reader.offer(seq, end if seq % 2 else start, 0))
    assert [c[1] for c in reader.give_up()] == [b"x"] and reader.n_waiting == 3
    assert [c[1] for c in reader.give_up()] == [b"x"] and reader.n_waiting == 0
    reader.waiting.flush()
    assert not store


def small_events(spark, path, n_users, n_each=1):
    rows = spark.range(n_users * n_each).selectExpr(
        "id as event_id",
        "timestamp_seconds(1704067200 + id * 60) as ts",
        f"id % {n_users} as user_id",
        "element_at(array('view', 'click', 'signup', 'purchase', 'error'), cast(id % 5 as int) + 1) as event_type",
        "id * 0.5 as value",
        "'' as props",
    )
    rows.coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_a_larger_feed_has_no_more_batches(spark, tmp_path, monkeypatch):
    sf_dir = small_events(spark, tmp_path, 40, 5)
    changed = {
        "spark.sql.shuffle.partitions": "12",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    monkeypatch.setattr(catalog, "scratch_path", lambda spark, name: str(tmp_path / name))
    before = {key: spark.conf.get(key, None) for key in changed}
    try:
        for key, value in changed.items():
            spark.conf.set(key, value)
        assert catalog.stream_transcript(spark, sf_dir).count() == 200
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    commits = tmp_path.glob("checkpoint/commits/[0-9]*")
    assert 2 <= len(list(commits)) <= 12
