"""Small cases of the operators, against plain Python."""

import itertools
import re

import numpy as np
import pytest

from shelltrace.llm import (
    chat,
    decontaminate,
    lines,
    mix,
    near,
    private,
    toxic,
    urls,
    vectors,
    warc,
)

DOCS = "doc_id long, text string, source string, extra int"


@pytest.fixture(scope="module")
def docs(spark):
    def words(a, n):
        return " ".join(f"w{a}x{i}" for i in range(n))

    rows = [
        (1, words(1, 60) + "\n" + words(2, 70), "a", 1),
        (2, words(3, 9) + "\n" + words(2, 70) + "\nend", "a", 1),
        (3, words(2, 70), "b", 2),
        (4, None, "b", 2),
        (5, "", None, None),
        (None, "x y", None, None),
        (7, words(5, 300), "c", 3),
        (8, words(5, 300) + " more", "c", 3),
        (8, words(5, 300) + " more", "c", 3),
    ]
    return spark.createDataFrame(rows, DOCS)


def test_mix_meets_targets(docs):
    m = mix.Mix(docs, block_words=16)
    rows = m.taken().collect()
    assert len(rows) == 9
    again = sorted(str(r) for r in mix.Mix(docs, block_words=16).taken().collect())
    assert again == sorted(str(r) for r in rows)
    for source in {r.source for r in rows}:
        mine = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 1
        assert sum(r["size"] for r in mine) == mine[0].source_size
    assert all(r.taken <= 2 * r["size"] for r in rows)
    slots = m.slots().collect()
    assert sum(s.words for s in slots) == sum(r.taken for r in rows)


def test_mix_of_nothing(spark):
    assert mix.Mix(spark.createDataFrame([], DOCS)).taken().count() == 0


def test_contamination(spark, docs):
    text = docs.where("doc_id = 1").first().text
    item = " ".join(text.split()[5:18])
    items = spark.createDataFrame(
        [(7, item.upper()), (8, "x, Y!"), (9, None), (None, "more"), (10, "none such here")],
        "item_id long, text string",
    )
    got = {(r.id, r.n_hit, tuple(r["items"])) for r in decontaminate.contamination(docs, items).collect()}
    assert (1, 13, ("7",)) in got
    assert (None, 2, ("8",)) in got
    assert (4, 0, ()) in got and (5, 0, ()) in got
    assert {(i, n) for i, n, _ in got if i == 8} == {(8, 1)}
    none = decontaminate.contamination(docs, items.limit(0))
    assert none.where("n_hit > 0").count() == 0 and none.count() == 9


def test_lines(docs):
    got = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    assert got[2].n_deleted == 1 and got[2].text.endswith("\nend")
    assert got[3].text == "" and got[1].n_deleted == 0
    assert got[4].text is None and got[5].text == ""


def test_near_duplicates(docs):
    rows = near.near_duplicates(docs).collect()
    assert len(rows) == 9
    got = {(r.id, r.class_id, r.component_id, r.n_links) for r in rows}
    assert (7, 7, 7, 2) in got and (8, 8, 7, 2) in got
    # 66 of 76 shingles are common to 2 and 3.
    assert (4, 4, 4, 0) in got and (3, 3, 2, 1) in got and (1, 1, 1, 0) in got


def test_near_large_group(spark):
    base = [f"t{i}" for i in range(120)]
    texts = [" ".join(w if i != k else "zz" for i, w in enumerate(base)) for k in range(60)]
    rows = near.near_duplicates(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ).collect()
    sets = [{tuple(t.split()[i : i + 5]) for i in range(116)} for t in texts]
    for r in rows:
        a = sets[r.id]
        want = sum(len(a & b) / len(a | b) >= 0.8 for b in sets) - 1
        assert (r.n_links, r.component_id) == (want, 0)


def test_toxic_chain():
    rng = np.random.default_rng(0)
    lists = [rng.choice(np.arange(10, 400), 30, False) for _ in range(300)]
    y = np.array([[i % 5 == 0, i % 3 == 0] for i in range(300)], dtype=float)
    for x, (junk, bad) in zip(lists, y):
        x[0], x[1] = (1 if junk else 3), (2 if bad else 4)
    rows = toxic.Rows.of(lists)
    models = toxic.fit_models(rows, y, np.arange(300) % 3, 512)
    first = toxic.predict(rows, np.zeros((300, 0)), models[0])
    second = toxic.predict(rows, first[:, None], models[1])
    assert ((second >= 0.5) == (y[:, 1] > 0)).mean() > 0.95
    assert len(models[1]) == len(models[0]) + 1


def test_urls(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://A.net/x"),
            (2, "https://example.net/en/1?q"),
            (3, "http://net"),
            (4, None),
            (5, "nothing"),
            (6, "http://xnet/"),
        ],
        "page_id long, url string",
    )
    rules = spark.createDataFrame(
        [("net", "/", "block"), ("example.net", "/en/", "allow"), (None, "/", "block")],
        "host string, path string, verdict string",
    )
    want = {1: "net/", 2: "example.net/en/", 3: None, 4: None, 5: None, 6: None}
    for limit in (1 << 20, 0):
        rows = urls.judge_urls(pages, rules, broadcast_bytes=limit).collect()
        assert {r.id: r.rule for r in rows} == want
        assert {r.id for r in rows if r.verdict == "block"} == {1}


def test_url_collisions():
    digests = urls.mapped(urls.digest_bytes(np.array([5, 5, 9]), ["a", "b", "c"]))
    asked = np.array(["b", "x", "c"], dtype=object)
    assert urls.probe(digests, np.array([5, 5, 9]), asked).tolist() == [True, False, True]


def test_warc(spark):
    long = "é" * 80
    pages = spark.createDataFrame(
        [(3, "http://a/ b", long), (1, None, long), (2, "u", "s"), (4, "v", "s"), (5, "w", None)],
        "page_id long, url string, html string",
    )
    index = warc.write_archives(pages)
    got = {r.id: r for r in warc.read_records(index).collect()}
    assert got[3].record_type == "revisit" and got[3].refers_to == 1
    assert bytes(got[1].payload).decode() == long and got[1].payload_bytes == 160
    assert got[4].record_type == "response" and got[5].payload_bytes == 0
    assert {r.id for r in warc.read_records(index.where("id = 2")).collect()} == {2}
    assert warc.merged_ranges([(0, 10), (10, 5), (900000, 5)]) == [
        (0, 15, [0, 1]),
        (900000, 900005, [2]),
    ]


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    near_ = base[:20] + rng.normal(size=(20, 16)) * 0.03
    every = np.concatenate([base, near_, base[:3]])
    rows = [(i, [float(x) for x in v], i % 20 % 2) for i, v in enumerate(every[:60])]
    rows += [(100, None, 1), (101, [0.0] * 16, 1), (102, rows[0][1], None), (103, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.id: r for r in vectors.near_vectors(df).collect()}
    held = [(i, np.array(v), k) for i, v, k in rows if v and any(v) and k is not None]
    links = {i: 0 for i, _, _ in held}
    for (i, u, k), (j, v, m) in itertools.combinations(held, 2):
        if k == m and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98:
            links[i] += 1
            links[j] += 1
    assert {i: got[i].n_links for i in links} == links
    assert all(got[i].n_links == 0 and got[i].kept for i in (100, 101, 102))


def test_vector_recall_is_audited(spark):
    """The share of the stated queries' links that the graph search finds."""
    rng = np.random.default_rng(4)
    base = np.repeat(rng.normal(size=(150, 24)), 6, axis=0)
    v = base + rng.normal(size=base.shape) * 0.08
    rows = [(i, [float(x) for x in u], i % 2) for i, u in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    points = vectors.points_of(vectors.usable_vectors(df, "vec_id", "embedding", "label")).cache()
    links = vectors.vector_links(points, shard_points=60)
    assert vectors.audit_recall(df, links, points, every=5) >= 0.9
    assert 0 < links.count() < 3 * len(rows)


def test_vector_groups_apart():
    """A search finds the members of a dense group that no edge leads to."""
    rng = np.random.default_rng(2)
    v = np.repeat(rng.normal(size=(3, 16)), 100, axis=0)
    v += rng.normal(size=v.shape) * 0.02
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    graph = vectors.build_graph(unit)
    starts = vectors.medoids(unit, graph)
    assert sorted(starts // 100) == [0, 1, 2]
    for i in range(0, 300, 7):
        true = np.flatnonzero(unit @ unit[i] >= 0.98)
        assert list(vectors.range_search(i, unit, graph, starts, 0.98)) == list(true[true != i])
    assert list(vectors.medoids(unit[:1], vectors.build_graph(unit[:1]))) == [0]


def test_chat(spark):
    rows = [
        ("c", 0, "user", "How are you?\nI am fine"),
        ("c", 1, "user", "Other topic"),
        ("c", 2, "assistant", "> how  are you?\nWell"),
        ("c", 3, "assistant", ">> how are you?\n> well\nGood"),
        ("c", 4, "assistant", "> other topic\nYes"),
        (None, 1, "user", "> x"),
        ("d", 0, "user", None),
    ]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = {(r.conv, r.turn): r for r in chat.format_chats(df).collect()}
    assert [got["c", i].place for i in range(5)] == [0, 3, 1, 2, 4]
    assert [got["c", i].reply_to for i in range(5)] == [None, None, 0, 2, 1]
    assert got["c", 3].text == "Good" and got[None, 1].place is None
    assert got["d", 0].text == ""


def test_private(spark):
    rows = [
        (1, "Mrs Jones, bob@x.com, 10.0.0.1 and 4041894974608795"),
        (2, "Bob@x.com again +1 (988) 555-2485"),
        (3, None),
        (4, "plain"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in private.replace_private(df, "a key").collect()}
    for secret in ("Jones", "bob@x.com", "10.0.0.1", "4041894974608795"):
        assert secret not in got[1].text
    mail = re.search(r"[\w.]+@[\w.]+", got[1].text)[0]
    assert mail in got[2].text and "555-2485" not in got[2].text
    assert got[3].text is None and got[4].text == "plain" and got[4].n_entities == 0
