"""The pipeline on a small corpus, against brute force."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from shelltrace.llm.common import text_key


def _words(a, n):
    return " ".join(f"w{a}x{i}" for i in range(n))


def _brute(rows, keys):
    """``(id, words)`` of what one document per component leaves."""
    def sets(text):
        words = (text or "").split()
        n = min(5, len(words))
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()

    docs = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, keys[r[1]]))
    shingles = [sets(t) for _, t in docs]
    part = list(range(len(docs)))
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(shingles):
            for j, y in enumerate(shingles):
                near = x and y and len(x & y) >= 0.8 * len(x | y)
                if near and part[i] != part[j]:
                    part[i] = part[j] = min(part[i], part[j])
                    changed = True
    left = Counter((d[0], len(d[1].split())) for i, d in enumerate(docs) if shingles[i] and part[i] == i)
    # Documents without words all stay.
    left.update((i, 0) for i, t in rows if not sets(t))
    return left


def test_pipeline_keeps_one_of_each_component(spark, tmp_path):
    rows = [
        # Unrelated texts under no id or under the same one; near copies of some.
        (None, _words(1, 40)),
        (None, _words(2, 41)),
        (None, _words(3, 42)),
        (None, _words(3, 42) + " more"),
        (None, _words(4, 39)),
        (2, _words(4, 39) + " tail"),
        (7, _words(5, 36)),
        (7, _words(6, 37)),
        (7, _words(6, 37)),
        (7, _words(7, 33) + " one two"),
        (7, _words(7, 33) + " one"),
        (8, _words(5, 36) + " end"),
        (9, _words(8, 30)),
        (None, ""),
        (None, None),
        (9, None),
    ]
    docs = spark.createDataFrame(
        [(i, t, "web", "a", len(t or "")) for i, t in rows],
        "doc_id long, text string, source string, lang string, n_chars int",
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(
        [(i, 1, 0) for i in (2, 7, 8, 9)], "doc_id long, quality int, toxic int"
    ).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(
        [(1, _words(99, 20))], "item_id long, text string"
    ).write.parquet(f"{tmp_path}/benchmark.parquet")
    keys = {r.text: r.k for r in docs.select("text", text_key(F.col("text")).alias("k")).collect()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == _brute(rows, keys)
