"""Surface features: character and word statistics of the text alone. Map-only, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylotrace.fixed_values import SURFACE_FEATURES, SURFACE_FEATURES_V1
from stylotrace.functions import text as T
from stylotrace.functions.numbers import ratio

PUNCT_CHARS = ".,!?;:-—()"  # fixed value: the ten characters counted as punctuation
QUOTE_CHARS = '"«»'
# Runs of small letters and blanks make up most of a text; a plain class skips them quickly.
_PLAIN = r"[a-zа-яёß-öø-ÿ\s]+"
# Everything that no count below looks at; runs of it shrink to one blank.
_REST = "[^" + T.UPPERCASE[1:-1] + T.DIGIT[1:-1] + r".,!?;:\-—()" + QUOTE_CHARS + "]+"


def _measured(df: DataFrame, text: str) -> DataFrame:
    """Split the text and reduce it to the characters of interest once; counts run on the result."""
    source = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns(
        {
            "_words": T.whitespace_words(source),
            "_kept": F.regexp_replace(F.regexp_replace(source, _PLAIN, " "), _REST, " "),
            "_chars": F.char_length(source),
        }
    )


def _measures() -> dict[str, Column]:
    kept, chars, words = F.col("_kept"), F.col("_chars"), F.col("_words")
    n_words = F.size(words)
    marks = lambda chars_in: T.count_chars(kept, chars_in)
    per_mille = lambda chars_in: ratio(marks(chars_in) * F.lit(1000.0), chars)
    sentences = F.greatest(T.count_matches(kept, "[.!?]+"), F.lit(1))
    return {
        "comma_density": per_mille(","),
        "dash_density": per_mille("-—"),
        "quote_density": per_mille(QUOTE_CHARS),
        "excl_density": per_mille("!"),
        "punct_intensity": per_mille(PUNCT_CHARS),
        "avg_word_len": ratio(F.char_length(F.array_join(words, "")), n_words),
        "avg_sent_len": n_words / sentences,
        "caps_ratio": ratio(T.count_matches(kept, T.UPPERCASE), chars),
        "digit_ratio": ratio(T.count_matches(kept, T.DIGIT), chars),
        "unique_word_ratio": ratio(F.size(F.array_distinct(F.transform(words, F.lower))), n_words),
    }


def surface_features(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Add the ten surface features, their names behind ``prefix``; null or blank texts get zeros."""
    measures = _measures()
    found = {prefix + f: F.when(F.size("_words") == 0, 0.0).otherwise(measures[f]).cast("double") for f in SURFACE_FEATURES}
    return _measured(df, text).withColumns(found).drop("_words", "_kept", "_chars")


def surface_features_v1(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Add the seven features of the first variant: word length counts blanks, only '' gives zeros."""
    measures = _measures() | {"avg_word_len": ratio(F.col("_chars"), F.size("_words"))}
    found = {prefix + f: F.when(F.col("_chars") == 0, 0.0).otherwise(measures[f]).cast("double") for f in SURFACE_FEATURES_V1}
    return _measured(df, text).withColumns(found).drop("_words", "_kept", "_chars")
