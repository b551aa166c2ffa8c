"""Language identification against a plain naive Bayes, its n-grams against loops, and held-out accuracy."""

import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest

from stylotrace.llm import langid

SCHEMA = "doc_id long, text string, lang string"
SF = "/root/testdata/sf0.01"
WORD = 0xFFFFFFFF


def bucket(gram: str, buckets: int) -> int:
    h = 0
    for c in gram:
        h = ((h ^ ord(c)) * 0x9E3779B1) & WORD
        h ^= h >> 15
    h = ((h + len(gram)) * 0x85EBCA6B) & WORD
    return (h ^ h >> 16) % buckets


def plain_ngrams(text: str, buckets: int) -> Counter:
    line = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    grams = [line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1)]
    return Counter(bucket(g, buckets) for g in grams if g.strip())


TEXTS = [
    "The cat, 2 dogs!!  and the bird", "Der Hund und die Katze", "a", "  ", "", None, "12 - 3", "été Noël", "中文字符 测试",
    "İstanbul", "the and of " * 40, "x\x1c y", "ein zwei drei", "one two three four", "\U0001f600 ok",
]


@pytest.mark.parametrize("piece", [1, 2, 5, 64, 1 << 19])
def test_ngrams_equal_loops_for_every_size_of_a_piece(monkeypatch, piece):
    monkeypatch.setattr(langid, "PIECE", piece)
    got = [Counter() for _ in TEXTS]
    for number, found in langid.ngrams(TEXTS, 512):
        for n, b in zip(number.tolist(), found.tolist()):
            got[n][b] += 1
    for text, counts in zip(TEXTS, got):
        assert counts == (plain_ngrams(text, 512) if langid.has_letter(text) else Counter()), text


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def brute(rows, buckets=langid.BUCKETS):
    counts, docs = {}, Counter()
    for i, text, lang in rows:
        if lang is not None and i is not None and not held_out(i):
            docs[lang] += 1
            counts.setdefault(lang, Counter()).update(plain_ngrams(text or "", buckets))
    out = []
    for i, text, _ in rows:
        if not docs or not langid.has_letter(text):
            out.append((i, held_out(i), "und", 0.0))
            continue
        grams, value = plain_ngrams(text, buckets), {}
        for lang in sorted(docs):
            total = sum(counts[lang].values()) + langid.SMOOTHING * buckets
            value[lang] = math.log(docs[lang] / sum(docs.values()))
            value[lang] += sum(n * math.log((counts[lang][b] + langid.SMOOTHING) / total) for b, n in grams.items())
        best = max(sorted(value), key=value.get)
        out.append((i, held_out(i), best, 1 / sum(math.exp(v - value[best]) for v in value.values())))
    return sorted(out, key=repr)


def corpus():
    words = {"en": "the cat and dog of house", "de": "der Hund und die Katze im Haus", "": "qu'est ce que c'est", "zh": "中文 字符 测试"}
    rng = np.random.default_rng(2)
    rows = []
    for i in range(240):
        lang = list(words)[i % 4]
        rows.append((i, " ".join(map(str, rng.choice(words[lang].split(), rng.integers(1, 12)))), lang if i % 7 else None))
    return rows + [(1000 + k, t, "en") for k, t in enumerate(TEXTS)] + [(None, "the dog", "en"), (3, rows[3][1], "zh"), (3, rows[3][1], "zh")]


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, langid.language_id(df).collect()), key=repr)
    want = brute(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_nothing_to_learn_from_empty_tables_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "the", None), (2, None, None)], SCHEMA)
    assert {(r.lang_pred, r.score) for r in langid.language_id(df).collect()} == {("und", 0.0)}
    assert langid.language_id(df.limit(0)).count() == 0
    rows = corpus()
    names = ["lang_pred", "score", "language", "bucket", "n", "held_out", "source"]
    wide = spark.createDataFrame([(*r, *names) for r in rows], SCHEMA + "".join(f", {c} string" for c in names))
    plain = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(plain)
    assert set(langid.predict(wide, model).columns) == {"doc_id", "lang", *names}
    assert sorted(map(tuple, langid.language_id(wide).collect()), key=repr) == sorted(map(tuple, langid.language_id(plain).collect()), key=repr)


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "MATRIX_LIMIT", 8 * langid.BUCKETS * 3)
    with pytest.raises(ValueError, match="languages"):
        langid.fit(spark.createDataFrame(corpus(), SCHEMA))


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = langid.language_id(docs).where("held_out").join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    judged = [r for r in rows if r.lang is not None and langid.has_letter(r.text)]
    assert len(judged) > 150
    assert sum(r.lang_pred == r.lang for r in judged) / len(judged) > 0.97
