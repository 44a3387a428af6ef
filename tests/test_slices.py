"""Transcripts read in slices: shuffles, null keys and sparse numbers."""

import random
from datetime import datetime, timedelta, timezone

import pytest

import models
from shelltrace.operators import ordered
from shelltrace.operators.ordered import LogOrder
from shelltrace.sources.transcripts import KEYS, read_transcripts
from test_transcripts import command, cut, marker, random_stream

BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "session_id string, terminal_id string, seq long, ts timestamp, payload binary"


def rows_of(session, terminal, chunks, step=1):
    return [
        (session, terminal, i * step, BASE + timedelta(seconds=i), bytearray(c))
        for i, c in enumerate(chunks)
    ]


def test_rows_are_shuffled_by_slice_once(spark, monkeypatch):
    def no_cut(df):
        raise AssertionError("rows are checkpointed")

    monkeypatch.setattr(ordered, "cut_lineage", no_cut)
    chunks = [marker(b"S") + b"out" + command(b"id")] * 20
    table = spark.createDataFrame(rows_of("s", "t", chunks), SCHEMA)
    events = read_transcripts(table, order=LogOrder(KEYS, rows_per_slice=5))
    plan = events._jdf.queryExecution().executedPlan().toString()
    # Rows and summary share the first: it is listed in both.
    assert plan.count("hashpartitioning(_slice_hash") == 2
    assert plan.count("Exchange hashpartitioning") <= 6
    assert [r.stdout for r in events.collect()] == ["out"] * 20


@pytest.mark.parametrize("order", [LogOrder(KEYS, rows_per_slice=n) for n in (1, 1000)])
def test_null_keys_and_sparse_numbers(spark, order):
    rnd = random.Random(11)
    terminals = [(s, t) for s in (None, "", "a") for t in (None, "", "b")]
    streams = {k: cut(rnd, b"".join(random_stream(rnd) for _ in range(3))) for k in terminals}
    rows = [r for (s, t), chunks in streams.items() for r in rows_of(s, t, chunks, 313)]
    rnd.shuffle(rows)
    got = {k: [] for k in terminals}
    for r in read_transcripts(spark.createDataFrame(rows, SCHEMA), 9, order).orderBy("seq").collect():
        got[r.session_id, r.terminal_id].append(
            (r.stdin, r.cwd, r.exit_code, r.duration_ms, r.stdout)
        )
    want = {k: [e[:5] for e in models.transcript_events(c, 9)] for k, c in streams.items()}
    assert got == want


def test_marker_start_cut_over_many_slices(spark):
    stream = marker(b"S") + b"out" + command(b"id") + b"\x1b]77" + command(b"w")
    table = spark.createDataFrame(
        rows_of("s", "t", [stream[i : i + 1] for i in range(len(stream))]), SCHEMA
    )
    for n in (1, 2, 3, 7):
        events = read_transcripts(table, order=LogOrder(KEYS, rows_per_slice=n))
        rows = events.orderBy("seq").collect()
        assert [(r.stdin, r.stdout) for r in rows] == [("id", "out"), ("w", "")]
