"""Streams of text files: quality gate, scoring, progress. The checkpoint is the resume point."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from stylotrace.fixed_values import CYRILLIC_LETTER, SYNTACTIC_FEATURES
from stylotrace.operators.explain import confidence, predict_with_explanation, verdict
from stylotrace.operators.models import Detector, load_detector, numeric_features
from stylotrace.operators.prep import length_columns, quality_gate, strip_echoed_title
from stylotrace.operators.surface import surface_features
from stylotrace.plans.closed_form import Discriminant
from stylotrace.session import materialise
from stylotrace.sources.published import publish


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def gate(texts: DataFrame, title: str | None = "title", letter: str = CYRILLIC_LETTER, min_words: int = 100) -> DataFrame:
    """Strip the echoed title, measure, judge. Works on a batch or a stream alike."""
    if title:
        texts = texts.withColumn("text", strip_echoed_title(F.col("text"), F.col(title)))
    return quality_gate(length_columns(texts), letter=letter, min_words=min_words)


def score(texts: DataFrame, model: Discriminant, threshold: float = 0.5) -> DataFrame:
    """Surface features, probability, verdict and confidence of arriving texts."""
    scored = model.transform(surface_features(texts))
    return scored.withColumn("verdict", verdict(F.col("p"), threshold)).withColumn(
        "confidence_level", confidence(F.col("p"))
    )


def progress(gated: DataFrame) -> DataFrame:
    """Running totals per reason."""
    return gated.groupBy("reason").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("length_words").alias("n_words"))


def append_to(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the rows of a stateless stream to Parquet, each exactly once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).outputMode("append").start()


def _each_batch(stream: DataFrame, write, checkpoint: str, mode: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).outputMode(mode).start()


def keep_totals(totals: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Publish the totals after every batch as the version with the batch's number; ``published.latest`` reads them.

    Readers see the totals after some whole batch, never a table that is being replaced.
    """

    def replace(batch: DataFrame, number: int) -> None:
        publish(batch, path, number)

    return _each_batch(totals, replace, checkpoint, "complete", available_now)


def explained(texts: DataFrame, detector: Detector, threshold: float = 0.5) -> DataFrame:
    """Verdict, probability, confidence, reasons and fired signals of texts, by a fitted detector.

    The token job and the surface features run on the texts themselves. Explanations always look at the syntactic
    features, whatever the detector's own inputs are; columns of the texts do not come back but for ``doc_id``.
    """
    ready = numeric_features(texts.select("doc_id", "text", *[c for c in ("lang",) if c in texts.columns]), "syntactic")
    scored = detector.predict(ready, threshold)
    found = predict_with_explanation(scored, SYNTACTIC_FEATURES, threshold=threshold)
    names = ["verdict", "probability", "confidence_level", "reasons", "feature_values", "n_triggered_signals", "signals"]
    return found.select("doc_id", *names)


def explain_arriving(
    stream: DataFrame, detector_path: str, path: str, checkpoint: str, threshold: float = 0.5, available_now: bool = True
) -> StreamingQuery:
    """Score and explain every arriving text with the detector stored at ``detector_path``, each exactly once.

    A batch is published as the version with its number, so a batch that is repeated after a failure replaces itself.
    ``published.all_versions`` reads the results.
    """
    detector = load_detector(stream.sparkSession, detector_path)

    def write(batch: DataFrame, number: int) -> None:
        publish(explained(materialise(batch), detector, threshold), path, number)

    return _each_batch(stream, write, checkpoint, "append", available_now)
