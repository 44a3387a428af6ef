"""Hostile texts of a megabyte, in a JVM that has compiled nothing yet."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

CODE = """
import string, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

spark = (
    SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "2").config("spark.driver.memory", "3g").getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
from shelltrace.llm import chat, private, urls

N = 1 << 20  # characters
names = [a + b.lower() + c.lower() + d.lower() for a in string.ascii_uppercase[:2]
         for b in string.ascii_uppercase for c in string.ascii_uppercase for d in "XY"]
texts = [
    ("marks", ">" * N + " end"),
    ("blank marks", " >" * (N // 2)),
    ("names", "Mrs " + " ".join(names) + " and others"),
    ("one name", "Mrs " + "Anna " * (N // 5)),
    ("token", "a" * N),
    ("digits", "1." * (N // 2)),
    ("labels", "x@" + "b." * (N // 2) + "c"),
    ("titles", "Mr " * (N // 3)),
]
df = spark.createDataFrame(texts, "doc_id string, text string")
turns = df.select(F.col("doc_id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("u").alias("role"), "text")
got = {{r.conv: r for r in chat.format_chats(turns).collect()}}
assert got["marks"].n_quoted == 1 and got["marks"].text == "" and len(got["token"].text) == N
done = {{r.doc_id: r for r in private.replace_private(df, "k").collect()}}
assert done["token"].n_entities == 0 and done["labels"].n_entities == 1
assert "Anna" not in done["one name"].text.split() and done["names"].n_entities == len(names)
host = "a." * (N // 2) + "net"
pages = spark.createDataFrame([(1, "http://" + host + "/x"), (2, "http://" + "/" * N)], "page_id int, url string")
rules = spark.createDataFrame([("net", "/", "block")], "host string, path string, verdict string")
judged = {{r.id: r.verdict for r in urls.judge_urls(pages, rules).collect()}}
assert judged == {{1: "block", 2: "allow"}}
print("done")
"""


def test_long_texts_end_in_a_cold_jvm():
    run = subprocess.run(
        [sys.executable, "-c", CODE.format(root=ROOT)],
        capture_output=True,
        text=True,
        timeout=240,
    )
    assert run.stdout.strip().endswith("done"), run.stderr[-3000:]
