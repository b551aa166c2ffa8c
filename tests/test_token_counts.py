"""Features counted over flat arrays, against those of the token relation."""

import random

import pyarrow as pa
import pytest

from stylotrace.operators import syntax, token_counts, tokens

PIECES = [
    "the ", "is ", "been seen ", "walking, ", "Geht ", "wurde gelaufen ", "está ", "ΟΔΟΣ ", "İstanbul ", "был читавший ", ". ", "! ", "? ", "... ", ",", "_ ",
    "__", "#", "€", "½ ", "Ⅷ ", "٣", "²", "日本語", "字。", "«", "—", "\x85", " ", "\n\n", "😀", "𝟘", "ẞ ", "(", "+", "fini ", "mente ", "A ", "ly ", "THE ", "kolumneied. ",
]


def odd_texts():
    rnd = random.Random(5)
    rows = [("".join(rnd.choices(PIECES, k=rnd.randint(0, 60))), rnd.choice(["en", "de", "fr", "es", "ru", "xx", None])) for _ in range(400)]
    return [*rows, (None, "en"), ("", "en"), ("short", None), ("." * 300, "en"), (" " * 300, "en"), (", " * 200, "de")]


def test_same_features_as_the_token_relation_gives(spark):
    rows = [(k, text, lang) for k, (text, lang) in enumerate(odd_texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = syntax.syntactic_features(df)
    want = syntax.syntactic_features(df, annotate=lambda d, i, t, g: tokens.token_relation(d, i, t, g))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() == len(rows)


def test_tokens_do_not_become_rows(spark):
    df = spark.createDataFrame([(1, "en", "One sentence, then another one.")], "doc_id long, lang string, text string")
    plan = syntax.syntactic_features(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan and "Join" not in plan, plan


@pytest.mark.parametrize("at_once, kept", [(1, 0), (50, 10)])
def test_texts_worked_on_together_do_not_change_features(monkeypatch, at_once, kept):
    rng = random.Random(2)
    texts = [None if k % 7 == 3 else [rng.choices(["The", "dogs", "ran", ",", "was", "seen", "!", "7"], k=rng.randint(0, 9)) for _ in range(k % 5)] for k in range(60)]
    lang, lists = pa.array([("en", "de", "fr")[k % 3] for k in range(60)]), pa.array(texts, pa.list_(pa.list_(pa.string())))
    whole = token_counts.counted(lang, lists)
    monkeypatch.setattr(token_counts, "TOKENS_AT_ONCE", at_once)
    monkeypatch.setattr(token_counts, "WORDS_KEPT", kept)
    assert token_counts.counted(lang, lists).equals(whole)
    assert token_counts.counted(lang.slice(20, 30), lists.slice(20, 30)).equals(whole.slice(20, 30))
    assert len(token_counts.counted(lang[:0], lists[:0])) == 0
