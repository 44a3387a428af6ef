import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

import models
from shelltrace.operators import sequence
from shelltrace.operators.ordered import LogOrder, assemble, choose_order, first_rows

BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)
ORDERS = [LogOrder(), LogOrder(rows_per_slice=7), LogOrder(rows_per_slice=1)]


def frame(spark, sessions):
    rows = [
        (sid, i, BASE + timedelta(seconds=t), cmd, out, 1)
        for sid, events in sessions.items()
        for i, (t, cmd, out) in enumerate(events)
    ]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(
        rows,
        "session_id string, seq long, ts timestamp, stdin string,"
        " processed_stdout string, repeat_count long",
    )


def random_sessions(seed, count=40):
    rnd = random.Random(seed)
    sessions = {}
    for s in range(count):
        t, events = 0, []
        for _ in range(rnd.randrange(1, 60)):
            t += rnd.choice([1, 1, 1, 30, 299, 300, 301, 900, -50])
            events.append((t, rnd.choice("ab"), rnd.choice("xxy")))
        # A null key is a session like any other.
        sessions[f"s{s}" if s else None] = events
    return sessions


@pytest.mark.parametrize("order", ORDERS)
def test_dedup_matches_model(spark, order):
    sessions = random_sessions(3)
    got = sequence.dedup_consecutive(frame(spark, sessions), order)
    got = sorted((r.session_id or "", r.seq, r.repeat_count) for r in got.collect())
    want = sorted(
        (sid or "", i, n)
        for sid, events in sessions.items()
        for i, n in models.dedup([(c, o, 1) for _, c, o in events])
    )
    assert got == want


@pytest.mark.parametrize("order", ORDERS)
@pytest.mark.parametrize("limits", [(10, 300, 3), (5, 300, 1), (4, 1, 9), (2, 10**9, 3)])
def test_chunks_match_model(spark, order, limits):
    sessions = random_sessions(5)
    max_commands, gap, min_commands = limits
    got = sequence.assign_chunks(
        frame(spark, sessions), order, max_commands, gap, min_commands
    ).select(
        "session_id", "seq", "chunk_index", "chunk_position", "n_commands",
        "event_index", F.unix_seconds("start_time"), F.unix_seconds("end_time"),
    )
    base = int(BASE.timestamp())
    want = []
    for sid, events in sessions.items():
        times = [e[0] for e in events]
        for c, members in enumerate(models.chunks(times, max_commands, gap, min_commands)):
            for p, i in enumerate(members):
                want.append(
                    (sid or "", i, c, p + 1, len(members), i,
                     base + times[members[0]], base + times[members[-1]])
                )
    got = got.fillna("", ["session_id"])
    assert sorted(map(tuple, got.collect())) == sorted(want)


def sizes(spark, offsets, **limits):
    df = frame(spark, {"s": [(o, f"c{i}", "") for i, o in enumerate(offsets)]})
    rows = (
        sequence.assign_chunks(df, **limits)
        .select("chunk_index", "n_commands").distinct().orderBy("chunk_index").collect()
    )
    return [r.n_commands for r in rows]


def test_chunk_fixtures(spark):
    minutes = [0, 1, 2, 12, 13, 14]
    assert sizes(spark, [60 * m for m in minutes]) == [3, 3]
    assert sizes(spark, range(12), max_commands=5, min_commands=1) == [5, 5, 2]
    minutes = [0, 1, 2, 10, 20, 21, 22]
    assert sizes(spark, [60 * m for m in minutes]) == [3, 4]
    assert sizes(spark, [0]) == [1]


@pytest.mark.parametrize("order", ORDERS)
def test_assemble_parts_join_to_the_whole(spark, order):
    df = frame(spark, random_sessions(8)).withColumn(
        "text", F.concat("stdin", F.lit("é"), F.col("seq").cast("string"))
    )
    want = {r.session_id: r.text for r in assemble(df, LogOrder(), "text", None).collect()}
    parts = assemble(df, order, "text", 20).orderBy("session_id", "part").collect()
    got = {}
    for r in parts:
        assert len(r.text.encode()) < 20 + 6
        got[r.session_id] = got.get(r.session_id, "") + r.text
    assert got == want


@pytest.mark.parametrize("order", ORDERS)
def test_first_rows(spark, order):
    df = frame(spark, random_sessions(9)).where("seq % 3 > 0")
    got = first_rows(df, order, 4)
    rows = sorted((r.session_id or "", r.seq) for r in got.collect())
    assert rows == sorted(
        (r.session_id or "", r.seq) for r in df.where("seq in (1, 2, 4, 5)").collect()
    )


def test_choose_order_slices_only_large_sessions(spark):
    df = frame(spark, random_sessions(10))
    assert not choose_order(df).sliced
    assert choose_order(df, max_window_rows=30).sliced
