"""Requests in parts, answers that are broken, missing or not asked for."""

import json

from pyspark.sql import functions as F

from shelltrace.plans import ledger

PROMPTS = "session_id string, kind string, position long, part long, system string, text string"


def prompts(spark):
    hostile = 'say "hi"\n\\u0000 é\t{}'
    return spark.createDataFrame(
        [
            ("s", "chunk", 0, 0, "be brief", hostile),
            ("s", "chunk", 1, 0, "be brief", ""),
            ("", "direct", 0, 0, "sys", "empty id"),
            (None, "direct", 0, 0, "sys", "a" * 50),
            (None, "direct", 0, 1, "sys", 'b"' * 40),
            (None, "direct", 0, 2, "sys", "c\n"),
        ],
        PROMPTS,
    )


def test_parts_are_one_body(spark, tmp_path):
    asked = ledger.requests(prompts(spark), F.lit("m"))
    path = str(tmp_path / "requests")
    ledger.write_requests(asked, path)
    pieces = ledger.read_requests(spark, path)
    bodies = {r.request_id: json.loads(r.body) for r in ledger.stitched(pieces).collect()}
    assert set(bodies) == {"chunk:0:s", "chunk:1:s", "direct:0:", "direct:0"}
    said = {k: [m["content"] for m in b["messages"]] for k, b in bodies.items()}
    assert said["chunk:0:s"] == ["be brief", 'say "hi"\n\\u0000 é\t{}']
    assert said["direct:0"] == ["sys", "a" * 50 + 'b"' * 40 + "c\n"]
    assert bodies["chunk:1:s"]["model"] == "m" and said["chunk:1:s"][1] == ""
    whole = {r.request_id: r.body.encode() for r in ledger.stitched(pieces).collect()}
    for r in pieces.collect():
        at = whole[r.request_id][r.offset : r.offset + len(r.body.encode())]
        assert at == r.body.encode() and r.n_parts == (3 if r.request_id == "direct:0" else 1)


def fragment(content, done=False):
    return json.dumps({"message": {"content": content}, "done": done})


def test_answers_are_matched(spark):
    asked = ledger.requests(prompts(spark), F.lit("m"))
    lines = [
        ("chunk:0:s", 1, fragment("b", True)),
        ("chunk:0:s", 0, fragment("a")),
        ("chunk:0:s", 2, "after the end, so no matter"),
        ("chunk:1:s", 0, fragment("a")),
        ("chunk:1:s", 1, '{"message":{"content":7}}'),
        ("chunk:1:s", 2, fragment("", True)),
        # Without an end the answer is what has come.
        ("direct:0:", 0, fragment("open")),
        ("direct:0:", 1, "null"),
        ("direct:0:", 2, "{}"),
        ("stray", 0, fragment("x", True)),
    ]
    found = ledger.match_answers(
        asked, spark.createDataFrame(lines, "request_id string, seq long, value string")
    )
    statuses = {r.request_id: (r.status, r.n_fragments) for r in found.statuses.collect()}
    assert statuses == {
        "chunk:0:s": ("whole", 3),
        "chunk:1:s": ("broken", 3),
        "direct:0:": ("whole", 3),
        "direct:0": ("missing", 0),
    }
    contents = {r.request_id: r.content for r in found.contents.collect()}
    assert contents == {"chunk:0:s": "ab", "direct:0:": "open"}
    assert [tuple(r) for r in found.strays.collect()] == [("stray", 1)]


def test_invalid_fragments(spark):
    values = [
        "{}", "null", '{"message":null}', '{"done":null,"x":[1]}', fragment("x"),
        "", "[]", "5", '"x"', '{"message":[]}', '{"message":{"content":1}}', '{"done":"yes"}', "{", None,
    ]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "seq int, value string")
    got = [r.valid for r in ledger.checked_fragments(df).orderBy("seq").collect()]
    assert got == [True] * 5 + [False] * 9
