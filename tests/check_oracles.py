"""Compare catalog queries with their SQL: check_oracles.py SF_DIR [NAME...]."""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents"
    " embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def rows_by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda row: [(v is None, str(v)) for v in row]
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=key)


def difference(df, db, sql):
    """None when the results agree, else what differs."""
    got_columns = df.columns
    got = rows_by_name(got_columns, df.collect())
    result = db.execute(sql)
    want_columns = [d[0] for d in result.description]
    want = rows_by_name(want_columns, result.fetchall())
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} != {sorted(want_columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows, want {len(want)}"
    wrong = [(g, w) for g, w in zip(got, want) if g != w]
    if wrong:
        return f"{len(wrong)} of {len(got)} rows differ; first:\n  {wrong[0][0]}\n  {wrong[0][1]}"
    types = [
        (type(a).__name__, type(b).__name__)
        for a, b in zip(*(r[0] for r in (got, want)))
        if type(a) is not type(b)
    ] if got else []
    return f"types {types}" if types else None


def main():
    from pyspark.sql import SparkSession

    from shelltrace.plans.catalog import QUERIES
    from shelltrace.plans.oracles import ORACLES

    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db, failed = connect(sf_dir), 0
    for name in names:
        start = time.time()
        try:
            if name not in ORACLES:
                n = len(QUERIES[name](spark, sf_dir).collect())
                print(f"{name:28s} no SQL, {n} rows", flush=True)
                continue
            found = difference(QUERIES[name](spark, sf_dir), db, ORACLES[name])
        except Exception as e:
            found = f"{type(e).__name__}: {str(e)[:500]}"
        failed += found is not None
        print(f"{name:28s} {time.time() - start:6.2f}s {found or 'ok'}"[:1500], flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
