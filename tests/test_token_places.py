"""Tokens are dealt over as many tasks as the size of the texts asks for."""

from pyspark.sql import functions as F

from stylotrace.operators import syntax, tokens

SENTENCE = "The cat was seen by seven dogs, and it quickly ran home; why? Nobody knows. "


def test_more_text_means_more_tasks_and_the_same_features(spark, monkeypatch):
    rows = [(k, SENTENCE * (1 + k % 5), "en") for k in range(60)] + [(7, "Again, the same id. " * 3, "en"), (60, None, None), (None, SENTENCE, "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names = [c for c in syntax.syntactic_features(df).columns if c != "doc_id"]
    few = syntax.syntactic_features(df).select("doc_id", *names)
    assert tokens.token_relation(df).rdd.getNumPartitions() == 4
    monkeypatch.setattr(tokens, "BYTES_IN_TASK", 1000)
    size = sum(len(text or "") for _, text, _ in rows)
    assert tokens.token_relation(df).rdd.getNumPartitions() == -(-size // 1000) > 10
    many = syntax.syntactic_features(df).select("doc_id", *names)
    assert few.exceptAll(many).count() == many.exceptAll(few).count() == 0 and many.count() == len(rows)


def test_tables_without_text_keep_the_partitions_of_shuffles(spark):
    df = spark.range(3).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit("en").alias("lang"))
    assert tokens.token_relation(df).rdd.getNumPartitions() == 4
