"""Replies are to the message that shares most quoted lines."""

import random

import pytest

from shelltrace.llm import chat


def _replies(spark, rows):
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    return {(r.conv, r.turn): r.reply_to for r in chat.format_chats(df).collect()}


def _brute(rows):
    parsed = {}
    for conv, turn, _, text in rows:
        found = set()
        for line in text.split("\n"):
            level = len(line) - len(line.lstrip(">"))
            found.add((level, line.lstrip("> ")))
        parsed[conv, turn] = found
    out = {}
    for (conv, turn), mine in parsed.items():
        asked = {(n - 1, x) for n, x in mine if n}
        best = [
            (len(asked & theirs), t)
            for (c, t), theirs in parsed.items()
            if c == conv and t < turn and asked & theirs
        ]
        out[conv, turn] = max(best)[1] if best else None
    return out


def test_most_shared_lines_decide(spark):
    lines = [f"line {i}" for i in range(10)]
    quote = lambda text: "\n".join(">" + x for x in text.split("\n"))
    first = "\n".join(lines)
    second = quote(first) + "\nsecond"
    rows = [
        ("c", 1, "a", first),
        ("c", 2, "a", second),
        ("c", 3, "a", quote(first) + "\nthird"),
        ("c", 4, "a", quote(second)),
    ]
    assert _replies(spark, rows)["c", 4] == 2
    # Each line recurs singly in a later message; the original has them all.
    rows = [("d", 0, "a", first)]
    rows += [("d", i + 1, "a", line) for i, line in enumerate(lines)]
    rows += [("d", 20, "a", quote(first))]
    assert _replies(spark, rows)["d", 20] == 0


@pytest.mark.parametrize("most", [0, 3, 1_000])
def test_replies_as_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(chat, "COMMON", most)
    draw = random.Random(5)
    rows = []
    for conv in "ab":
        for turn in range(40):
            text = [
                ">" * draw.choice([0, 0, 1, 1, 2]) + f"x{min(draw.randrange(12), draw.randrange(12))}"
                for _ in range(draw.randrange(1, 7))
            ]
            rows.append((conv, turn, "a", "\n".join(text)))
    assert _replies(spark, rows) == _brute(rows)
