"""Operators that SQL cannot express, against plain Python or held-out rows."""

import random
import re

import pytest

from shelltrace.llm import chat, mix, private, toxic


def filled(sizes, weights, share, repeats):
    """Targets by pouring: whoever is full gets no more, the rest share it."""
    total = share * sum(sizes)
    caps = [repeats * s for s in sizes]
    targets, open_ = [0.0] * len(sizes), [i for i, c in enumerate(caps) if c]
    left = min(total, sum(caps))
    while open_ and left > 1e-9:
        rate = min(
            left / sum(weights[i] for i in open_),
            min((caps[i] - targets[i]) / weights[i] for i in open_),
        )
        for i in open_:
            targets[i] += rate * weights[i]
        left -= rate * sum(weights[i] for i in open_)
        open_ = [i for i in open_ if caps[i] - targets[i] > 1e-9]
    return targets


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_targets_are_poured(spark, seed):
    rng = random.Random(seed)
    names = ["", "B", "a", "z", "é", "日", None]
    rows = []
    for k, name in enumerate(names):
        for i in range(rng.choice([1, 3, 40])):
            n = rng.choice([0, 1, 7, 300])
            rows.append((rng.choice([None, k * 100 + i]), " ".join(["w"] * n) or None, name, 5, "x"))
    schema = "doc_id long, text string, source string, size int, target string"
    got = mix.Mix(spark.createDataFrame(rows, schema), block_words=8).taken().collect()
    assert len(got) == len(rows)
    sizes = [sum(len((r[1] or "").split()) for r in rows if r[2] == name) for name in names]
    # Sources by code point, null last; weights 3, 1, 2 over and over.
    targets = filled(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5, 2)
    for name, size, target in zip(names, sizes, targets):
        mine = [r for r in got if r.source == name]
        assert all(r.source_size == size and abs(r.target - target) < 1e-6 for r in mine)
        assert abs(sum(r.taken for r in mine) - target) <= 1
        assert all(0 <= r.taken <= 2 * r["size"] for r in mine)


def test_places_follow_threads(spark, monkeypatch):
    monkeypatch.setattr(chat, "SPAN", 3)
    monkeypatch.setattr(chat, "COMMON", 2)
    rng = random.Random(6)
    rows = []
    for conv in "ab":
        said = []
        for turn in range(30):
            quoted = rng.sample(said, min(len(said), rng.choice([0, 1, 1, 2])))
            own = f"{conv} line {rng.randrange(12)}"
            said.append(own)
            rows.append((conv, turn, "u", "\n".join([f"> {q}" for q in quoted] + [own]), 9))
    rows += [("a", 3, "u", rows[3][3], 9), (None, 1, None, "> x", 9), ("c", None, "u", None, 9)]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, place int")
    got = chat.format_chats(df).collect()
    assert len(got) == len(rows)
    reply = {(r.conv, r.turn): r.reply_to for r in got}

    def root(conv, turn):
        while reply[conv, turn] is not None:
            turn = reply[conv, turn]
        return turn

    # The message that shares most quoted lines, the latest among equals.
    lines = {(c, t): x.split("\n") for c, t, _, x, _ in rows if c and t is not None}
    for (conv, turn), mine in lines.items():
        asked = {x[2:] for x in mine if x.startswith("> ")}
        best = [
            (len(asked & {x for x in theirs if not x.startswith(">")}), t)
            for (c, t), theirs in lines.items()
            if c == conv and t < turn
        ]
        best = max((b for b in best if b[0]), default=(0, None))
        assert reply[conv, turn] == best[1]
    for conv in "ab":
        mine = [r for r in got if r.conv == conv]
        assert all(r.thread == root(conv, r.turn) for r in mine)
        in_place = sorted(mine, key=lambda r: r.place)
        assert [r.place for r in in_place] == list(range(len(mine)))
        assert [(r.thread, r.turn) for r in in_place] == sorted((r.thread, r.turn) for r in mine)
    assert all(r.place is None for r in got if r.conv is None or r.turn is None)


def test_toxic_documents_that_were_held_out(spark):
    rng = random.Random(3)
    plain = [f"word{i}" for i in range(400)]
    bad = [f"vile{i}" for i in range(12)]
    rows, truth = [], {}
    for i in range(900):
        words = rng.choices(plain, k=rng.randint(10, 80))
        truth[i] = i % 5 == 0
        if truth[i]:
            words += rng.choices(bad, k=6)
        rng.shuffle(words)
        rows.append((i, " ".join(words), 0.5, True))
    # A toxic word behind thousands of others, and rows without words or label.
    rows.append((2_000, " ".join(f"rare{i}" for i in range(5_000)) + " " + " ".join(bad), 0.5, True))
    rows += [(2_001, None, None, None), (2_002, "", None, None), (None, " ".join(bad), 0.1, None)]
    rows += [rows[0]] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_toxic double, toxic boolean")
    labels = [(i, 1, int(truth[i])) for i in range(0, 900) if i % 3] + [(7, None, 1), (None, 1, 0), (5_555, 0, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxic.toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    held_out = [r for r in got if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 3 == 0]
    right = [r.toxic == truth[r.doc_id] for r in held_out]
    assert sum(right) / len(right) >= 0.97
    by_id = {r.doc_id: r.toxic for r in got}
    assert by_id[2_000] and by_id[None] and not by_id[2_001] and not by_id[2_002]
    nothing = toxic.toxicity(docs.limit(0), labels)
    assert nothing.count() == 0


FORMS = {
    "mail": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
    "ip": r"\d+\.\d+\.\d+\.\d+",
    "phone": r"\+\d[\d ()-]+\d",
}


def test_surrogates_are_consistent_and_distinct(spark):
    rng = random.Random(9)
    mails = [f"{a}.{b}@{c}.org" for a in ("ann", "Bo") for b in ("k", "li") for c in ("site", "x-y")]
    ips = [f"10.{i}.{i * 7 % 250}.9" for i in range(1, 20)]
    phones = [f"+49 30 {i:03d} {i * 13 % 1000:03d}" for i in range(20)]
    entities = mails + ips + phones
    rows = []
    for i in range(60):
        picked = rng.choices(entities, k=4)
        rows.append((i, "see " + " and ".join(picked) + " there", len(picked)))
    rows += [(60, None, 0), (61, "", 0), (62, "nothing to see", 0), (1, rows[1][1], 4), (None, rows[2][1], 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_entities int")
    got = private.replace_private(df, "k")
    assert got.columns == ["doc_id", "text", "n_entities"]
    texts = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows)
    seen = {}
    for doc_id, text, n in rows:
        new = texts[doc_id]
        assert new.n_entities == n
        if not text:
            assert new.text == text
            continue
        olds, news = text[4:-6].split(" and ") if n else [], (new.text[4:-6].split(" and ") if n else [])
        if not n:
            assert new.text == text
        for old, replaced in zip(olds, news, strict=True):
            assert seen.setdefault(old.lower(), replaced) == replaced and replaced not in entities
            kind = next(k for k, f in FORMS.items() if re.fullmatch(f, old))
            assert re.fullmatch(FORMS[kind], replaced)
    assert len(set(seen.values())) == len(seen) > 30
    other = {r.doc_id: r.text for r in private.replace_private(df, "another").collect()}
    assert other[0] != texts[0].text


def test_texts_are_drawn_before_they_meet_their_labels(spark, monkeypatch):
    docs = spark.range(2000).selectExpr("id as doc_id", "concat('word', id, ' other', id % 7) as text")
    labels = spark.range(2000).selectExpr(
        "id as doc_id", "cast(id % 2 as int) as quality", "cast(id % 3 = 0 as int) as toxic"
    )
    written, write = [], toxic.write_through

    def counted(df, name):
        table = write(df, name)
        written.append(table.count())
        return table

    monkeypatch.setattr(toxic, "write_through", counted)
    categories = {"junk": labels["quality"] == 0, "toxic": labels["toxic"] == 1}
    toxic.fit_chain(docs, labels, categories, max_rows=200)
    toxic.fit_chain(docs, labels, categories)
    assert 100 < written[0] < 300 and written[1] == 2000
