import base64
import random
from datetime import datetime, timedelta, timezone

import pytest

import models
from shelltrace.operators.ordered import LogOrder
from shelltrace.sources.transcripts import KEYS, encode_transcripts, read_transcripts

BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)
ORDERS = [LogOrder(KEYS), LogOrder(KEYS, rows_per_slice=5), LogOrder(KEYS, rows_per_slice=1)]
START, END = b"\x1b]7770;", b"\x07"


def marker(body):
    return START + body + END


def command(cmd, exit=b"0", duration=b"5", cwd=b"/tmp"):
    return marker(b";".join([b"E", exit, duration, cwd, base64.b64encode(cmd)]))


def random_stream(rnd):
    parts = []
    for _ in range(rnd.randrange(0, 14)):
        parts.append(
            rnd.choice(
                [
                    marker(b"S"),
                    marker(b"S"),
                    b"plain text ",
                    "é€ ".encode(),
                    b"\x1b[31mred\x1b[0m\x07",
                    b"\x1b]7770",
                    b"\x1b]77\x1b]7770;X\x0770;S\x07",
                    marker(b"other"),
                    marker(b"E;"),
                    marker(b"E;1;2;3"),
                    marker(b"E;0;1;/a;b;Y2Q="),
                    marker(b"E;x;9;/a;!!"),
                    marker(b"E;0;1;/q;" + START + b"YQ=="),
                    command(b"ls"),
                    command("echo é".encode(), b"-1", b"7x"),
                    command(b"id", b"2", b"99999", b"/home"),
                ]
            )
        )
    if rnd.random() < 0.2:
        parts.append(START + b"E;0;1")
    return b"".join(parts)


def cut(rnd, stream):
    widths = rnd.choice([[1], [1, 2, 3], [2, 30, 7], [4096]])
    chunks = []
    while stream:
        n = rnd.choice(widths)
        chunks.append(stream[:n])
        stream = stream[n:]
    return chunks


def streams(seed, count):
    rnd = random.Random(seed)
    return {f"s{i}": cut(rnd, random_stream(rnd)) for i in range(count)}


def table(spark, data):
    rows = [
        (sid, "t", i, BASE + timedelta(seconds=i), bytearray(c))
        for sid, chunks in data.items()
        for i, c in enumerate(chunks)
    ]
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(
        rows,
        "session_id string, terminal_id string, seq long, ts timestamp, payload binary",
    )


@pytest.mark.parametrize("order", ORDERS)
@pytest.mark.parametrize("cap", [262144, 9])
def test_random_cuts_match_model(spark, order, cap):
    data = streams(4, 60)
    got = read_transcripts(table(spark, data), cap, order).collect()
    got = sorted(
        (r.session_id, r.seq, r.stdin, r.cwd, r.exit_code, r.duration_ms, r.stdout,
         r.timestamp)
        for r in got
    )
    want = [
        (sid, *e[:5], (BASE + timedelta(seconds=e[5])).strftime("%Y-%m-%dT%H:%M:%SZ"))
        for sid, chunks in data.items()
        for e in models.transcript_events(chunks, cap)
    ]
    assert len(want) > 40
    assert [g[:1] + g[2:] for g in got] == want or sorted(
        g[:1] + g[2:] for g in got
    ) == sorted(want)
    by_session = {}
    for g in got:
        by_session.setdefault(g[0], []).append(g[2:])
    for sid, chunks in data.items():
        assert [e[:5] for e in by_session.get(sid, [])] == [
            e[:5] for e in models.transcript_events(chunks, cap)
        ]


def test_output_is_that_of_the_last_start(spark):
    stream = marker(b"S") + b"lost" + marker(b"S") + b"kept" + command(b"id") + b"x" + command(b"w")
    rows = read_transcripts(table(spark, {"s": [stream]})).orderBy("seq").collect()
    assert [(r.stdin, r.stdout, r.stderr) for r in rows] == [("id", "kept", ""), ("w", "", "")]


def test_fraction_of_the_time_is_shortened(spark):
    df = spark.createDataFrame(
        [("s", "t", 0, BASE + timedelta(microseconds=120000), bytearray(command(b"id")))],
        "session_id string, terminal_id string, seq long, ts timestamp, payload binary",
    )
    assert read_transcripts(df).first().timestamp == "2024-01-01T00:00:00.12Z"


def test_encode_then_read(spark):
    events = spark.createDataFrame(
        [("s", "t", i, BASE, f"cmd é {i}", f"out\n€{i}", "/d", i, 10 * i) for i in range(5)],
        "session_id string, terminal_id string, seq long, ts timestamp, stdin string,"
        " stdout string, cwd string, exit_code long, duration_ms long",
    )
    columns = ["session_id", "terminal_id", "stdin", "stdout", "cwd", "exit_code", "duration_ms"]
    back = read_transcripts(encode_transcripts(events)).select(*columns)
    assert sorted(back.collect()) == sorted(events.select(*columns).collect())
