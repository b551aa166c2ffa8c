"""From texts to the token relation: tokens, sentences, parts of speech, heads, depths.

Texts are partitioned by document once, before they are split into tokens. Every window and aggregate
below is keyed by the document and reuses that partitioning, so token rows are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stylotrace.functions import text as T
from stylotrace.operators import lexicon as lx

TOKEN_COLUMNS = [
    "doc_id", "sent_id", "pos", "text", "lower", "lemma", "upos", "head", "depth",
    "verb_form", "voice", "dep", "is_punct",
]
TOKENS_AT_ONCE = 1 << 15  # tokens of a user's parser that leave a task together, about
BYTES_IN_TASK = 2 << 20  # text that one task splits; its token rows are sorted in memory and take many times as much
TOKEN_SCHEMA = (
    "doc_id bigint, sent_id bigint, pos int, text string, lower string, lemma string, upos string, "
    "head int, depth int, verb_form string, voice string, dep string, is_punct boolean"
)


def whitespace_words(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    return df.select(id_col, F.posexplode(T.whitespace_words(F.col(text))).alias("pos", "word"))


def lexical_tokens(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    return df.select(id_col, F.posexplode(T.lexical_tokens(F.col(text))).alias("pos", "token"))


def _places(df: DataFrame, text: str) -> int:
    """Partitions for the tokens of all texts: as many as shuffles have, and more where these would hold too much text."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if df.isStreaming:  # the size of a stream is not known
        return least
    size = df.agg(F.sum(F.octet_length(text)).alias("size")).first()["size"] or 0  # one row
    return max(least, math.ceil(size / BYTES_IN_TASK))


def _by_document(df: DataFrame, id_col: str, text: str, lang: str | None, carry: Sequence[str]) -> DataFrame:
    language = F.coalesce(F.col(lang), F.lit("en")) if lang else F.lit("en")
    # A given number of partitions: texts grow many times over as token rows, so merging small
    # partitions by the size of the texts would be wrong.
    return df.select(
        F.col(id_col).alias("doc_id"), language.alias("lang"), *carry, F.col(text).alias("_text")
    ).repartition(_places(df, text), "doc_id")


def _sentences(text: Column) -> Column:
    """A text as its sentences, each an array of tokens."""
    return F.transform(T.extract_all(text, T.SENTENCE), lambda s: T.extract_all(s, T.ANY_TOKEN))


def listed_tokens(df: DataFrame, id_col: str, text: str, lang: str | None, carry: Sequence[str]) -> DataFrame:
    """One row per text, spread like tokens: ``doc_id``, ``lang``, what to ``carry``, and the text as arrays of tokens by sentence."""
    return _by_document(df, id_col, text, lang, carry).select("doc_id", "lang", *carry, _sentences(F.col("_text")).alias("sentences"))


def raw_tokens(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str | None = "lang",
    carry: Sequence[str] = (), outer: bool = False,
) -> DataFrame:
    """Word runs and single symbols with their position; null texts have none.

    ``carry`` names small columns that go along with every token. With ``outer`` a text without tokens has one row whose
    position and text are null.
    """
    by_doc = _by_document(df, id_col, text, lang, carry)
    found = T.extract_all(F.col("_text"), T.ANY_TOKEN)
    listed = F.posexplode_outer(found) if outer else F.posexplode(found)
    return by_doc.select("doc_id", "lang", *carry, listed.alias("pos", "text"))


def sentence_ids(tokens: DataFrame) -> DataFrame:
    """Add ``sent_id`` from 0: a sentence ends after a run of terminators."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    ends = F.col("text").isin(lx.TERMINATORS)
    starts = ~ends & F.coalesce(F.lag(ends).over(order), F.lit(False))
    counted = tokens.withColumn("_starts", starts.cast("bigint"))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counted.withColumn("sent_id", F.sum("_starts").over(running)).drop("_starts")


def sentence_tokens(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str | None = "lang",
    carry: Sequence[str] = (), outer: bool = False,
) -> DataFrame:
    """The rows of ``raw_tokens`` with the ``sent_id`` of ``sentence_ids``, without sorting any tokens.

    Terminators are tokens of their own, so texts are cut into sentences before these are cut into tokens. Only the
    places at which sentences start are running sums, over rows of whole sentences.
    """
    numbered = df.withColumn("_text_no", F.monotonically_increasing_id())  # an id may come twice
    by_doc = _by_document(numbered, id_col, text, lang, [*carry, "_text_no"])
    found = _sentences(F.col("_text"))
    explode = F.posexplode_outer if outer else F.posexplode
    whole = by_doc.select("doc_id", "_text_no", "lang", *carry, explode(found).alias("sent_id", "_found"))
    earlier = Window.partitionBy("doc_id", "_text_no").orderBy("sent_id").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(F.size("_found")).over(earlier), F.lit(0)).cast("int")
    sent_id = F.coalesce("sent_id", F.lit(0)).cast("bigint")
    placed = whole.select("doc_id", "lang", *carry, sent_id.alias("sent_id"), first.alias("_first"), "_found")
    listed = placed.select("doc_id", "lang", *carry, "sent_id", "_first", explode("_found").alias("_at", "text"))
    return listed.select("doc_id", "lang", *carry, (F.col("_first") + F.col("_at")).alias("pos"), "text", "sent_id")


def _first_rule(rules: list[tuple[str, str, str]], word: Column) -> Column:
    out = None
    for lang, value, pattern in rules:
        hit = (F.col("lang") == lang) & word.rlike(pattern)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def part_of_speech(tokens: DataFrame) -> DataFrame:
    """Add lower, lemma, upos, verb_form and whether the word is a form of "be"."""
    spark = tokens.sparkSession
    # The lexicon is a fixed table of under 200 words.
    words = spark.createDataFrame(lx.lexicon_rows(), "lang string, lower string, _closed string, is_be boolean")
    lower = F.col("lower")
    upos = (
        F.when(F.col("is_punct"), "PUNCT")
        .when(F.col("_closed").isNotNull(), F.col("_closed"))
        .when(lower.rlike(r"^\p{N}+$"), "NUM")
        .when(~lower.rlike(r"[\p{L}\p{N}_]"), "SYM")
        .otherwise(F.coalesce(_first_rule(lx.SUFFIX_RULES, lower), F.lit("NOUN")))
    )
    return (
        tokens.withColumn("lower", F.lower("text"))
        .withColumn("is_punct", F.col("text").rlike(r"^\p{P}+$") & (F.col("text") != "_"))
        .join(F.broadcast(words), ["lang", "lower"], "left")
        .withColumn("lemma", F.col("lower"))
        .withColumn("is_be", F.coalesce("is_be", F.lit(False)))
        .withColumn("upos", upos)
        .withColumn("verb_form", F.when(F.col("upos") == "VERB", _first_rule(lx.VERB_FORM_RULES, lower)))
        .drop("_closed")
    )


def _active(word: Column) -> Column:
    out = F.lit(False)
    for lang, pattern in lx.ACTIVE_PARTICIPLE.items():
        out = out | ((F.col("lang") == lang) & word.rlike(pattern))
    return out


def heads_and_depths(tokens: DataFrame) -> DataFrame:
    """Add ``head``, ``depth`` (number of ancestors), ``voice`` and ``dep`` by the annotator's rules.

    The root of a sentence is its first verb, else its first content word, else its first token.
    Content words hang on the content word before them, or on the root at the start and after a comma;
    function words hang on the next content word; punctuation hangs on the root. The rules make the
    depth of a token a running count, so no tree has to be walked here.
    """
    sentence = Window.partitionBy("doc_id", "sent_id")
    forward = sentence.orderBy("pos")
    # Ordered although order does not matter to it: it then shares the sort of the windows below.
    whole = forward.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = forward.rowsBetween(Window.unboundedPreceding, -1)
    upto = forward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    backward = sentence.orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    pos, content = F.col("pos"), F.col("_content")

    out = tokens.withColumn("_content", F.col("upos").isin(lx.CONTENT_POS))
    # One pass over the sorted sentence for everything that only looks at the tokens themselves.
    out = out.withColumns(
        {
            "_root": F.coalesce(
                F.min(F.when(F.col("upos") == "VERB", pos)).over(whole),
                F.min(F.when(content, pos)).over(whole),
                F.min(pos).over(whole),
            ),
            "_prev_content": F.last(F.when(content, pos), ignorenulls=True).over(before),
            "_after_comma": F.coalesce(F.lag(F.col("text") == ",").over(forward), F.lit(False)),
            "_seen": F.sum(content.cast("int")).over(upto),
            "_be_near": F.coalesce(F.lag("is_be", 1).over(forward), F.lit(False))
            | F.coalesce(F.lag("is_be", 2).over(forward), F.lit(False)),
        }
    ).withColumn("_is_root", pos == F.col("_root"))
    # A chain of content words restarts at the root and at every content word that hangs on the root.
    restarts = content & (F.col("_is_root") | F.col("_prev_content").isNull() | F.col("_after_comma"))
    level_at_restart = F.when(restarts, F.col("_seen") - F.when(F.col("_is_root"), 0).otherwise(1))
    out = out.withColumn("_restarts", restarts).withColumn("_level", level_at_restart)
    out = out.withColumn(
        "_content_depth",
        F.when(content, F.col("_seen") - F.last("_level", ignorenulls=True).over(upto)),
    )
    out = out.withColumns(
        {
            "_next_content": F.last(F.when(content, pos), ignorenulls=True).over(backward),
            "_next_depth": F.last("_content_depth", ignorenulls=True).over(backward),
        }
    )
    function_word = ~content & ~F.col("is_punct")
    head = (
        F.when(F.col("_is_root") | F.col("is_punct") | F.col("_restarts"), F.col("_root"))
        .when(function_word, F.coalesce("_next_content", "_root"))
        .otherwise(F.col("_prev_content"))
    )
    depth = (
        F.when(F.col("_is_root"), 0)
        .when(F.col("is_punct"), 1)
        .when(function_word, F.coalesce(F.col("_next_depth") + 1, F.lit(1)))
        .otherwise(F.col("_content_depth"))
    )
    passive = (F.col("verb_form") == "Part") & F.col("_be_near") & ~_active(F.col("lower"))
    return out.withColumns(
        {
            "head": head.cast("int"),
            "depth": depth.cast("int"),
            "voice": F.when(passive, "Pass"),
            "dep": F.when(F.col("_is_root"), "root").when(F.col("is_punct"), "punct").otherwise("dep"),
        }
    )


def token_relation(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str | None = "lang",
    carry: Sequence[str] = (), outer: bool = False,
) -> DataFrame:
    """One annotated row per token of every text, by the built-in rule annotator. ``carry`` and ``outer`` as above."""
    tokens = part_of_speech(sentence_tokens(df, id_col, text, lang, carry, outer))
    return heads_and_depths(tokens).select(*TOKEN_COLUMNS, *carry)


def annotate_with(
    df: DataFrame,
    make_annotator: Callable[[], Callable[[int, str], list[tuple]]],
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Token relation from a parser of the user's own.

    ``make_annotator`` runs once per task and returns a function from (doc_id, text) to the tokens of
    that text as tuples in the order of ``TOKEN_COLUMNS``. A null ``depth`` is filled by
    ``dependency_depth``.
    """

    def annotate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse, held = make_annotator(), []
        for batch in batches:
            for doc, body in zip(batch["doc_id"], batch["text"]):
                if body is not None:
                    held += parse(doc, body)
                    if len(held) >= TOKENS_AT_ONCE:
                        yield pd.DataFrame(held, columns=TOKEN_COLUMNS)
                        held = []
        if held:
            yield pd.DataFrame(held, columns=TOKEN_COLUMNS)

    return df.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInPandas(annotate, TOKEN_SCHEMA)


def dependency_depth(tokens: DataFrame) -> DataFrame:
    """Number of ancestors of every token, from heads alone. Roots are their own head.

    Heads stay inside a sentence, so each sentence becomes one array and pointers are doubled inside
    it: after k rounds a token knows its ancestors up to 2^k steps up. No join per round. Positions may have
    gaps (parsers that leave tokens out); a head that is no token of the sentence gives a null depth.
    """
    sentences = tokens.groupBy("doc_id", "sent_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "head"))).alias("_t")
    )
    first = F.get("_t", F.lit(0))["pos"]
    dense = F.element_at("_t", -1)["pos"] - first + 1 == F.size("_t")
    rounds = F.ceil(F.log2(F.size("_t") + F.lit(1))).cast("int")
    place = F.transform("_t", lambda t: t["pos"])
    sentences = sentences.withColumns({"_pos": place, "_rounds": rounds, "_dense": dense})
    steps = F.transform(F.sequence("_rounds", F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int"))

    def searched(head: Column) -> Column:
        """Where the head stands among the positions, by binary search; null if it is none of them."""
        last = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get("_pos", at + s) <= head, at + s).otherwise(at))
        return F.when(F.get("_pos", last) == head, last)

    # Consecutive positions, which nearly all sentences have, need no search.
    offsets = F.transform("_t", lambda t: t["head"] - first)
    found = F.when(F.col("_dense"), offsets).otherwise(F.transform("_t", lambda t: searched(t["head"])))
    sentences = sentences.select("doc_id", "sent_id", "_pos", "_rounds", found.alias("_h"))
    # A root is one step from nowhere, a head that is no token leaves the depth null.
    steps_up = F.transform("_h", lambda h, i: F.when(h == i, 0).when(F.get("_pos", h).isNotNull(), 1))
    doubled = F.aggregate(
        F.sequence(F.lit(1), F.greatest("_rounds", F.lit(1))),
        F.struct(F.transform("_h", lambda h: F.when(h.isNotNull(), h)).alias("h"), steps_up.alias("d")),
        lambda s, _: F.struct(
            F.transform(s["h"], lambda h: F.get(s["h"], h)).alias("h"),
            F.transform(s["d"], lambda d, i: d + F.get(s["d"], F.get(s["h"], i))).alias("d"),
        ),
    )
    with_depth = sentences.select("doc_id", "sent_id", "_pos", doubled["d"].alias("_d"))
    rows = F.transform("_pos", lambda p, i: F.struct(p.cast("int").alias("pos"), F.get("_d", i).alias("depth")))
    return with_depth.select("doc_id", "sent_id", F.inline(rows))


def fill_depth(tokens: DataFrame) -> DataFrame:
    """The token relation with ``depth`` computed from the heads."""
    depths = dependency_depth(tokens).select("doc_id", "pos", "depth")
    return tokens.drop("depth").join(depths, ["doc_id", "pos"]).select(*TOKEN_COLUMNS)
