"""A versioned table: readers, writers that meet, compaction, nulls."""

import pytest
from pyspark.sql import types as T

from shelltrace.sources.versions import Conflict, Listing, VersionedTable

SCHEMA = T.StructType().add("session_id", "string").add("seq", "long").add("x", "string")


def rows(spark, *found):
    return spark.createDataFrame(list(found), SCHEMA)


def held(df):
    return sorted(map(tuple, df.collect()), key=str)


def table(spark, tmp_path, buckets=4):
    return VersionedTable(spark, str(tmp_path / "t"), SCHEMA, buckets=buckets)


def test_readers_see_whole_versions(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read().count() == 0 and t.listing().version == 0
    t.append(rows(spark, ("a", 0, "1"), ("b", 0, "1"), (None, 0, "1"), (None, 1, "1")))
    before = t.read()
    t.replace_keys(rows(spark, ("a", 0, "")), rows(spark, ("a", 0, "2"), ("a", 1, "2")))
    # A reader of the version before still sees that version.
    assert held(before) == [("a", 0, "1"), ("b", 0, "1"), (None, 0, "1"), (None, 1, "1")]
    assert held(t.read()) == [("a", 0, "2"), ("a", 1, "2"), ("b", 0, "1"), (None, 0, "1"), (None, 1, "1")]
    assert held(t.read(1)) == held(before)
    # A key without an id is replaced as a whole, not doubled.
    t.replace_keys(rows(spark, (None, 0, "")), rows(spark, (None, 7, "3")))
    assert held(t.read().where("session_id is null")) == [(None, 7, "3")]
    # A key can go for good.
    t.replace_keys(rows(spark, ("b", 0, ""), ("zz", 0, "")), rows(spark))
    assert held(t.read()) == [("a", 0, "2"), ("a", 1, "2"), (None, 7, "3")]


def test_a_writer_that_comes_second_starts_again(spark, tmp_path):
    t = table(spark, tmp_path)
    t.append(rows(spark, ("a", 0, "1")))
    stale = t.listing()
    t.append(rows(spark, ("b", 0, "1")))
    with pytest.raises(Conflict):
        t._publish(stale.with_segment("nowhere", [0]))
    tries = []

    def change():
        tries.append(t.listing())
        if len(tries) == 1:
            t.append(rows(spark, ("c", 0, "1")))
        return tries[-1]

    assert t._retry(change).version == 4 and len(tries) == 2
    assert held(t.read()) == [("a", 0, "1"), ("b", 0, "1"), ("c", 0, "1")]


def test_batches_are_added_once_and_compacted(spark, tmp_path):
    t = table(spark, tmp_path, buckets=2)
    for batch in (0, 1, 1, 0, 2):
        t.append(rows(spark, ("a", batch, "x"), ("b", batch, "x")), stream="s", batch=batch)
    want = [(k, i, "x") for k in "ab" for i in range(3)]
    assert held(t.read()) == want and t.listing().batches == {"s": 2}
    segments = len(t.listing().segments)
    t.compact(2)
    assert held(t.read()) == want and len(t.listing().segments) < segments
    assert t.compact(2) == t.listing()
    old = t.listing()
    assert t.drop_unlisted(versions=1) == segments
    assert held(t.read()) == want and t.listing() == old


def test_an_unfinished_write_is_not_seen(spark, tmp_path):
    t = table(spark, tmp_path)
    t.append(rows(spark, ("a", 0, "1")))
    t._write(rows(spark, ("a", 1, "1")), 4)
    assert held(t.read()) == [("a", 0, "1")]
    # The number of buckets is the table's own.
    assert table(spark, tmp_path, buckets=9).listing().buckets == 4
    assert Listing().crowded() == set()
