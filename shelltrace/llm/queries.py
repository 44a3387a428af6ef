"""The operators of this package as queries over the driver's tables."""

from __future__ import annotations

from secrets import token_hex

from pyspark.sql import functions as F

from shelltrace.llm import (
    chat,
    credentials,
    decontaminate,
    importance,
    lexical,
    lines,
    mix,
    near,
    private,
    toxic,
    urls,
    vectors,
    warc,
)


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark, sf_dir):
    return (
        mix.Mix(_table(spark, sf_dir, "documents"))
        .taken()
        .select(
            F.col("id").alias("doc_id"), "size", "source_size", "target", "taken"
        )
    )


def op2_decontaminate(spark, sf_dir):
    found = decontaminate.contamination(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


#: (host, path, verdict)
URL_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def op3_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(_table(spark, sf_dir, "pages"), rules).withColumnRenamed(
        "id", "page_id"
    )


def op4_ngram_jaccard(spark, sf_dir):
    found = near.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.drop("text_key", "component_key").withColumnRenamed("id", "doc_id")


def op5_toxicity(spark, sf_dir):
    found = toxic.toxicity(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    )
    return found.select("doc_id", "p_junk", "p_toxic", "toxic")


def op6_chat_format(spark, sf_dir):
    done = chat.format_chats(_table(spark, sf_dir, "conversations"))
    return done.withColumnRenamed("conv", "conv_id")


def op7_private_surrogates(spark, sf_dir):
    # Without a key of the deployment, each run has one of its own.
    key = spark.conf.get(private.KEY_SETTING, None) or token_hex(16)
    done = private.replace_private(_table(spark, sf_dir, "documents"), key)
    return done.select("doc_id", "n_entities", "text")


def op8_line_dedup(spark, sf_dir):
    done = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_deleted", "text")


def op9_vector_dedup(spark, sf_dir):
    found = vectors.near_vectors(_table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("id", "vec_id")


def op10_warc(spark, sf_dir):
    index = warc.write_archives(_table(spark, sf_dir, "pages"))
    return warc.read_records(index).select(
        F.col("id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        "refers_to",
    )


def op11_importance(spark, sf_dir):
    found = importance.resample(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )
    return found.withColumnRenamed("id", "doc_id")


def op12_secret_scan(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    found = credentials.secrets(docs, repo=F.concat_ws("/", docs["source"], docs["lang"]))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2("base", 256).alias("base_sha256"),
        "spans",
        "n_live",
        "n_copied",
    )


def op13_lexical_search(spark, sf_dir):
    found = lexical.search(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )
    return found.select(
        F.col("item").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score"
    )


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_decontaminate": op2_decontaminate,
    "op3_url_filter": op3_url_filter,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_toxicity": op5_toxicity,
    "op6_chat_format": op6_chat_format,
    "op7_private_surrogates": op7_private_surrogates,
    "op8_line_dedup": op8_line_dedup,
    "op9_vector_dedup": op9_vector_dedup,
    "op10_warc": op10_warc,
    "op11_importance": op11_importance,
    "op12_secret_scan": op12_secret_scan,
    "op13_lexical_search": op13_lexical_search,
}
