"""One registered query for each operator of this package, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stylotrace.llm import bpe, chat, curriculum, exact, jaccard, kdshard, langid, linededup, prefixtrie, quality, toxicity, vptree, whitening

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), bpe.load_model(WORD_BPE))


@query
def op10_exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact.exact_dedup(docs, exact.half_of_ids()).drop("n_points")


@query
def op8_curriculum(spark, sf_dir):
    planned = curriculum.plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    first = F.round(F.array_min("positions"), 6).alias("position")
    rows = planned.select("doc_id", "size", "source_size", "target", "taken", first)
    return rows.orderBy(F.col("position").asc_nulls_last(), "doc_id")


@query
def op7_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return quality.classify(docs, table(spark, sf_dir, "labels"))


@query
def op4_near_copies(spark, sf_dir):
    return jaccard.near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op2_chat(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.digests(chat.format_chats(turns.unionByName(tricky)))


@query
def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, table(spark, sf_dir, "labels"))


@query
def op3_vptree(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vptree.nearest(vectors, vectors.where("vec_id % 20 = 0"))


@query
def op5_kd_shards(spark, sf_dir):
    dealt = kdshard.kd_shards(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), shards=40)
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op9_line_dedup(spark, sf_dir):
    return linededup.digests(linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def op12_language_id(spark, sf_dir):
    return langid.language_id(table(spark, sf_dir, "documents"))


@query
def op13_prefix_trie(spark, sf_dir):
    return prefixtrie.conversation_trie(table(spark, sf_dir, "conversations"))


@query
def op11_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
