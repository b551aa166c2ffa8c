"""TF-IDF over words and word pairs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from stylotrace.fixed_values import TFIDF_PRESETS
from stylotrace.functions import text as T
from stylotrace.session import materialise

MAX_BROADCAST_TERMS = 100_000
MAX_LISTED_TERMS = 20_000  # terms that may be listed in a plan


def grams(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Words and pairs of neighbouring words, paired after the stop words are gone."""
    return T.ngrams_1_2(T.without_words(T.lexical_tokens(F.coalesce(text, F.lit(""))), list(stop_words)))


def ngrams(df: DataFrame, id_col: str = "doc_id", text: str = "text", stop_words: Sequence[str] = ()) -> DataFrame:
    """One row per (document, position, term)."""
    return df.select(id_col, F.posexplode(grams(F.col(text), stop_words)).alias("pos", "term"))


def term_counts(df: DataFrame, text: str = "text", stop_words: Sequence[str] = ()) -> DataFrame:
    """Document count and total count of every term.

    Terms are sorted inside each document, so that the first of equal terms can be told and both
    counts come from one aggregate per term with map-side combine; no (document, term) shuffle.
    """
    ordered = df.select(F.sort_array(grams(F.col(text), stop_words)).alias("_g"))
    first = lambda g, i: F.when((i > 0) & (F.get("_g", i - 1) == g), 0).otherwise(1)
    marked = ordered.select(F.inline(F.transform("_g", lambda g, i: F.struct(g.alias("term"), first(g, i).alias("first")))))
    return marked.groupBy("term").agg(F.sum("first").alias("df"), F.count(F.lit(1)).alias("total"))


def vocabulary(
    df: DataFrame,
    text: str = "text",
    min_df: int = 3,
    max_features: int | None = 3000,
    stop_words: Sequence[str] = (),
) -> DataFrame:
    """Terms in at least ``min_df`` documents, then the ``max_features`` most frequent; ties by term."""
    frequent = term_counts(df, text, stop_words).where(F.col("df") >= min_df)
    if max_features is None:
        return frequent
    return frequent.orderBy(F.desc("total"), "term").limit(max_features)


@dataclass
class TfidfModel:
    """A fitted vocabulary: ``term_id, term, df, total, idf`` (written to storage) and its settings."""

    terms: DataFrame
    size: int
    stop_words: list[str]
    sublinear: bool

    def _in_row(self, df: DataFrame, text: str) -> tuple[DataFrame, dict[str, Column]]:
        """``df`` with the known terms of each text counted in its row, and what is known of them.

        The vocabulary is a sorted list that goes along with the plan; a term's place in it is its index. ``at`` and
        ``tf`` list the places and counts of a text's terms, ``w`` their weights before and ``unit`` after the norm.
        """
        rows = self.terms.orderBy("term").collect()  # at most MAX_LISTED_TERMS
        counter = CountVectorizerModel.from_vocabulary([r["term"] for r in rows], inputCol="_grams", outputCol="_counts")
        counted = counter.transform(df.withColumn("_grams", grams(F.col(text), self.stop_words))).drop("_grams")
        counted = counted.withColumn("_counts", F.unwrap_udt("_counts"))
        listed = lambda c: F.array(*[F.lit(r[c]) for r in rows])
        damped = lambda tf: F.lit(1.0) + F.log(tf) if self.sublinear else tf
        weights = F.zip_with("_counts.indices", "_counts.values", lambda i, tf: damped(tf) * F.get(listed("idf"), i))
        counted = counted.withColumn("_w", weights)
        counted = counted.withColumn("_norm", F.sqrt(F.aggregate("_w", F.lit(0.0), lambda a, w: a + w * w)))
        return counted, {"at": F.col("_counts.indices"), "tf": F.col("_counts.values"), "term": listed("term"), "term_id": listed("term_id")}

    def transform(self, df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        """Long relation (document, term_id, term, tf, weight), rows of unit norm; unknown terms are dropped.

        Nothing is shuffled as long as the vocabulary can be listed; beyond that its terms are joined.
        """
        if 0 < self.size <= MAX_LISTED_TERMS:
            counted, known = self._in_row(df.select(id_col, text), text)
            entry = lambda i, k: F.struct(
                F.get(known["term_id"], i).alias("term_id"), F.get(known["term"], i).alias("term"),
                F.get(known["tf"], k).cast("bigint").alias("tf"), (F.get("_w", k) / F.col("_norm")).alias("weight"),
            )
            return counted.select(id_col, F.inline(F.transform(known["at"], entry)))
        known = self.terms.select("term_id", "term", "idf")
        if self.size <= MAX_BROADCAST_TERMS:
            known = F.broadcast(known)
        # Only occurrences of known terms are moved, and only once: both steps below are keyed by document.
        hits = ngrams(df, id_col, text, self.stop_words).join(known, "term").select(id_col, "term_id", "term", "idf")
        counts = hits.repartition(id_col).groupBy(id_col, "term_id", "term", "idf").agg(F.count(F.lit(1)).alias("tf"))
        tf = F.col("tf").cast("double")
        raw = counts.withColumn("_w", (F.lit(1.0) + F.log(tf) if self.sublinear else tf) * F.col("idf"))
        norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))
        return raw.select(id_col, "term_id", "term", "tf", (F.col("_w") / norm).alias("weight"))

    def vectors(self, df: DataFrame, text: str = "text", out: str = "features") -> DataFrame:
        """The same weights as one sparse ML vector per row, by place in the sorted vocabulary, without a shuffle.

        A vector is made from its indices and values alone and is never as long as the vocabulary. Spark has no function
        for that, but its JSON reader makes vectors out of their fields.
        """
        if not 0 < self.size <= MAX_LISTED_TERMS:
            raise ValueError(f"vectors need a vocabulary of 1 to {MAX_LISTED_TERMS} terms")
        counted, known = self._in_row(df, text)
        unit = F.transform("_w", lambda w: w / F.col("_norm"))
        fields = F.struct(F.lit(0).alias("type"), F.lit(self.size).alias("size"), known["at"].alias("indices"), unit.alias("values"))
        kind = StructType([StructField("v", VectorUDT())])
        packed = F.from_json(F.to_json(F.struct(fields.alias("v"))), kind)["v"]
        return counted.withColumn(out, packed).drop("_counts", "_w", "_norm")


def smooth_idf(df_col: Column, n_docs: int) -> Column:
    return F.log(F.lit(float(1 + n_docs)) / (F.lit(1.0) + df_col)) + 1.0


def fit_tfidf(
    df: DataFrame,
    text: str = "text",
    min_df: int = 3,
    max_features: int | None = 3000,
    stop_words: Sequence[str] = (),
    sublinear: bool = True,
) -> TfidfModel:
    n_docs = df.count()
    terms = vocabulary(df, text, min_df, max_features, stop_words)
    if max_features is None:
        # Without a bound on the vocabulary there is no dense numbering in one place; hash instead.
        numbered = terms.withColumn("term_id", F.xxhash64("term"))
    else:
        numbered = terms.withColumn("term_id", F.row_number().over(Window.orderBy("term")).cast("bigint") - 1)
    terms = materialise(numbered.withColumn("idf", smooth_idf(F.col("df"), n_docs)))
    return TfidfModel(terms, terms.count(), list(stop_words), sublinear)


def fit_preset(df: DataFrame, preset: str = "library", text: str = "text") -> TfidfModel:
    return fit_tfidf(df, text, **TFIDF_PRESETS[preset])
