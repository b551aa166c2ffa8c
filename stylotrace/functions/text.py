"""Column expressions over text. All of them stay in the JVM and work on whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Unicode has it: ASCII spaces, the four information separators, NEL and all of \p{Z}.
WS = r"\t\n\x0b\x0c\r\x1c-\x1f \x{85}\p{Z}"
WS_RUN = f"[{WS}]+"
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WORD_TOKEN = r"[\p{L}\p{N}_]{2,}"
ANY_TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{WS}]"
# A sentence with its run of terminators; blanks between and behind these are no tokens. No loop backtracks.
SENTENCE = rf"[^.!?]*+[.!?][.!?{WS}]*+|[^.!?]++"
# Letters with the Uppercase property: \p{Lu} and the capital numerals and enclosed capitals.
UPPERCASE = (
    r"[\p{Lu}\x{2160}-\x{216F}\x{24B6}-\x{24CF}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}]"
)
# Characters with a digit value: \p{Nd} and superscript, subscript, circled and similar digits.
DIGIT = (
    r"[\p{Nd}\x{B2}\x{B3}\x{B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
    r"\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}\x{24F5}-\x{24FD}\x{24FF}"
    r"\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}"
    r"\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}]"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def whitespace_words(text: Column) -> Column:
    """Words between runs of whitespace, none of them empty."""
    return F.filter(F.split(text, WS_RUN), lambda w: w != "")


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in ``chars``."""
    rest = F.replace(text, F.lit(chars), F.lit("")) if len(chars) == 1 else F.translate(text, chars, "")
    return F.char_length(text) - F.char_length(rest)


def extract_all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def lexical_tokens(text: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return extract_all(F.lower(text), WORD_TOKEN)


def ngrams_1_2(tokens: Column) -> Column:
    """Single tokens followed by the pairs of neighbours."""
    n = F.size(tokens)
    pairs = F.zip_with(
        F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.when(n >= 2, F.concat(tokens, pairs)).otherwise(tokens)


def without_words(tokens: Column, words: list[str]) -> Column:
    if not words:
        return tokens
    return F.filter(tokens, lambda w: ~w.isin(words))
