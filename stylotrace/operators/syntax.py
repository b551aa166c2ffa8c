"""The 15 syntactic features of a document, all from one scan of its tokens."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from stylotrace.fixed_values import SYNTACTIC_FEATURES
from stylotrace.functions import text as T
from stylotrace.functions.numbers import entropy_bits, ratio
from stylotrace.operators.token_counts import counted
from stylotrace.operators.tokens import listed_tokens, token_relation

MIN_CHARS = 20
# Sums of logarithms and squares depend on their order in the last digits, but ranks need equal
# documents to be equal. The other features are single divisions of whole numbers.
FEATURE_DIGITS = 9
SUMMED_FEATURES = ["burstiness", "punct_entropy", "comma_cv", "pos_entropy"]


@F.pandas_udf(DoubleType())
def _deflate_ratio(text: pd.Series) -> pd.Series:
    def one(s: str) -> float:
        raw = s.encode("utf-8")
        return len(zlib.compress(raw, 9)) / len(raw) if raw else 0.0

    return text.fillna("").map(one)


def pos_compression(tokens: DataFrame) -> DataFrame:
    """``cr_pos`` per document: deflated size of the tag string over its plain size."""
    tags = tokens.where(~F.col("is_punct")).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "upos"))).alias("_tags")
    )
    line = F.array_join(F.transform("_tags", lambda t: t["upos"]), " ")
    return tags.select("doc_id", _deflate_ratio(line).alias("cr_pos"))


def _last_of_run(values: str) -> Column:
    """Of a sorted array column: the places, from 1, at which runs of equal values end."""
    ends = F.transform(values, lambda x, i: F.when(~x.eqNullSafe(F.get(F.col(values), i + 1)), i + 1))
    return F.filter(ends, lambda e: e.isNotNull())


def _run_lengths(ends: str) -> Column:
    return F.transform(ends, lambda e, k: e - F.coalesce(F.get(F.col(ends), k - 1), F.lit(0)))


def _total(values, of) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + of(x.cast("double")))


def _listed(tokens: DataFrame, carry: Sequence[str]) -> DataFrame:
    """One row per document: what is counted over its tokens, and the few things of each that have to be put in order.

    A row without a token (see ``raw_tokens``) keeps its document.
    """
    content = ~F.col("is_punct")
    comma = F.col("text") == ","
    verb = F.col("upos").isin("VERB", "AUX")
    passive = verb & (
        F.coalesce(F.col("voice") == "Pass", F.lit(False))
        | F.coalesce(F.col("dep").isin("nsubjpass", "auxpass"), F.lit(False))
    )
    flat = tokens.select(
        "doc_id",
        *carry,
        F.col("pos").isNotNull().alias("_token"),
        (F.col("pos").isNotNull() & content).alias("_content"),
        F.coalesce(F.col("verb_form").isin("Conv", "Part"), F.lit(False)).alias("_form"),
        passive.alias("_passive"),
        verb.alias("_verb"),
        "upos",
        F.when(content, F.lower("lemma")).alias("_lemma"),
        F.when(~content, F.col("text")).alias("_mark"),
        F.when(content, F.struct("pos", "upos")).alias("_tag"),
        F.when(comma, F.col("pos")).alias("_comma"),
        F.when(F.col("pos").isNotNull(), F.struct("sent_id", F.coalesce("depth", F.lit(0)).alias("depth"))).alias("_level"),
        F.when(content, F.col("sent_id")).alias("_sentence"),
    )
    return flat.groupBy("doc_id", *carry).agg(
        F.count_if("_token").alias("_tokens"),
        F.count_if("_content").alias("_content"),
        F.count_if("_form").alias("_forms"),
        F.count_if("_passive").alias("_passives"),
        F.count_if("_verb").alias("_verbal"),
        F.count_if(F.col("_content") & (F.col("upos") == "NOUN")).alias("_nouns"),
        F.count_if(F.col("_content") & (F.col("upos") == "VERB")).alias("_verbs"),
        *[F.collect_list(c).alias(c) for c in ("_lemma", "_mark", "_tag", "_comma", "_level", "_sentence")],
    )


def features_from_tokens(tokens: DataFrame, with_compression: bool = True, carry: Sequence[str] = ()) -> DataFrame:
    """The features per document of the token relation, and the columns that its tokens ``carry``.

    Tokens are read once and become one row per document, in which sorted arrays are counted by their runs. The
    arrays are as long as the array of tokens from which the document was split.
    """
    rows = _listed(tokens, carry)
    ordered = {c: F.sort_array(c) for c in ("_lemma", "_mark", "_comma", "_level", "_sentence")}
    rows = rows.withColumns(ordered | {"_tags": F.transform(F.array_sort("_tag"), lambda t: t["upos"])}).drop("_tag")
    # The last level of a sentence is its depth.
    last_level = F.filter("_level", lambda x, i: ~x["sent_id"].eqNullSafe(F.get(F.col("_level"), i + 1)["sent_id"]))
    trigram = lambda x, i: F.when(i > 1, F.concat_ws(" ", F.get("_tags", i - 2), F.get("_tags", i - 1), x))
    gap = lambda x, i: (x - F.get("_comma", i - 1)).cast("double")
    rows = rows.withColumns(
        {
            "_tag_kinds": F.sort_array("_tags"),
            "_trigrams": F.size(F.array_distinct(F.slice(F.transform("_tags", trigram), 3, F.greatest(F.size("_tags"), F.lit(1))))),
            "_gap": F.filter(F.transform("_comma", gap), lambda g: g.isNotNull()),
            "_level": F.transform(last_level, lambda x: x["depth"]),
        }
    )
    rows = rows.withColumns({f"_end{c}": _last_of_run(c) for c in ("_lemma", "_mark", "_tag_kinds", "_sentence")})
    rows = rows.withColumns({f"_run{c}": _run_lengths(f"_end{c}") for c in ("_lemma", "_mark", "_tag_kinds", "_sentence")})
    n_log_n = lambda n: n * F.log2(n)
    k, words, gaps = F.size("_level").cast("double"), F.col("_content").cast("double"), F.size("_gap")
    # Whole numbers up to the root, so that equal sentences give 0.
    spread = F.sqrt(F.greatest(k * _total("_run_sentence", lambda w: w * w) - words * words, F.lit(0.0))) / k
    gap_sum, gap_squares = _total("_gap", lambda g: g), _total("_gap", lambda g: g * g)
    some = F.col("_tokens") > 0
    mean_gap = gap_sum / gaps
    gap_std = F.sqrt(F.greatest(gap_squares / gaps - mean_gap * mean_gap, F.lit(0.0)))
    out = rows.select(
        "doc_id",
        *carry,
        F.when(some, words / k).alias("avg_sent_len"),
        F.when(some, spread).alias("burstiness"),
        entropy_bits(F.size("_mark"), _total("_run_mark", n_log_n)).alias("punct_entropy"),
        ratio(F.size("_mark"), F.col("_tokens")).alias("punct_density"),
        F.when(some, _total("_level", lambda d: d) / k).alias("avg_dep_depth"),
        (F.col("_nouns") / (F.col("_verbs") + F.lit(1e-9))).alias("nv_ratio"),
        ratio(F.size("_run_lemma"), F.col("_content")).alias("ttr"),
        ratio(F.size(F.filter("_run_lemma", lambda n: n == 1)), F.col("_content")).alias("hlr"),
        ratio(F.col("_forms"), F.col("_tokens")).alias("complexity_ratio"),
        ratio(F.col("_passives"), F.col("_verbal")).alias("passive_ratio"),
        F.when(gaps > 0, gap_std / mean_gap).otherwise(F.lit(0.0)).alias("comma_cv"),
        ratio(F.col("_trigrams"), F.col("_content")).alias("unique_trigrams_per_tok"),
        entropy_bits(F.col("_content"), _total("_run_tag_kinds", n_log_n)).alias("pos_entropy"),
        F.col("_tokens").cast("double").alias("total_tokens"),
        *([F.array_join("_tags", " ").alias("_line")] if with_compression else []),
    )
    out = out.withColumns({f: F.round(f, FEATURE_DIGITS) for f in SUMMED_FEATURES})
    if with_compression:
        out = out.withColumn("cr_pos", _deflate_ratio("_line")).drop("_line")
    return out


def syntactic_features(
    df: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    lang: str | None = "lang",
    with_compression: bool = True,
    annotate=token_relation,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``id_col``, the columns to ``keep`` and the features of every row; short, null and token-free texts get zeros.

    With the built-in annotator every row, also one that repeats an id, is counted on its own, from arrays of its tokens that
    never become rows (``token_counts``). A parser of the user's own returns tokens only; their features
    (``features_from_tokens``) are joined to the rows by id.
    """
    enough = F.char_length(T.strip(F.col(text))) >= MIN_CHARS
    names = [f for f in SYNTACTIC_FEATURES if with_compression or f != "cr_pos"]
    filled = [F.coalesce(f, F.lit(0.0)).alias(f) for f in names]
    if annotate is not token_relation:
        found = features_from_tokens(annotate(df.where(enough), id_col, text, lang), with_compression)
        rows = df.select(F.col(id_col).alias("doc_id"), *keep).join(found, "doc_id", "left")
        return rows.select(F.col("doc_id").alias(id_col), *keep, *filled)
    carried = [f"_carry{k}" for k in range(1 + len(keep))]
    rows = df.select(
        F.monotonically_increasing_id().alias("_row"),
        *[F.col(c).alias(name) for c, name in zip([id_col, *keep], carried, strict=True)],
        (F.col(lang) if lang else F.lit("en")).alias("lang"),
        F.when(enough, F.col(text)).alias("text"),
    )
    shape = ", ".join(f"{f}: double" for f in names)

    @F.arrow_udf(f"struct<{shape}>")
    def features(lang: pa.Array, sentences: pa.Array) -> pa.Array:
        return counted(lang, sentences, with_compression)

    listed = listed_tokens(rows, "_row", "text", "lang", carried)
    found = listed.select(*carried, features("lang", "sentences").alias("_f")).select(*carried, "_f.*")
    found = found.withColumns({f: F.round(f, FEATURE_DIGITS) for f in SUMMED_FEATURES})
    return found.select(*[F.col(c).alias(name) for c, name in zip(carried, [id_col, *keep], strict=True)], *filled)
