import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stylotrace.fixed_values import SURFACE_FEATURES, SYNTACTIC_FEATURES
from stylotrace.functions import text as T
from stylotrace.operators import lexical, syntax, tokens
from stylotrace.operators.surface import surface_features, surface_features_v1

GOLDEN = {
    "Hello, world! It is 42 - OK.": [35.714286, 35.714286, 0, 35.714286, 142.857143, 3.142857, 3.5, 0.142857, 0.071429, 1, 4.0],
    "Да, это — тест; «Тест» номер 7!": [32.258065, 32.258065, 64.516129, 32.258065, 129.032258, 3.571429, 7.0, 0.064516, 0.032258, 1, 4.428571],
    "one two one": [0, 0, 0, 0, 0, 3.0, 3.0, 0, 0, 0.666667, 3.666667],
    "   ": [0] * 11,
}


def test_surface_golden(spark):
    df = spark.createDataFrame([(t,) for t in GOLDEN], "text string")
    full = {r["text"]: [r[f] for f in SURFACE_FEATURES] for r in surface_features(df).collect()}
    first = {r["text"]: r["avg_word_len"] for r in surface_features_v1(df).collect()}
    for text, expected in GOLDEN.items():
        assert full[text] + [first[text]] == pytest.approx(expected, abs=1e-6)


def test_surface_of_null_and_odd_texts(spark):
    texts = [None, "", "  ", "...!!!", "x² Ⅳ １２", "a b c d"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = [r.asDict() for r in surface_features(df).orderBy("i").collect()]
    for r in rows[:3]:
        assert all(r[f] == 0 for f in SURFACE_FEATURES)
    assert rows[4]["digit_ratio"] == pytest.approx(sum(c.isdigit() for c in texts[4]) / len(texts[4]))
    assert rows[4]["caps_ratio"] == pytest.approx(sum(c.isupper() for c in texts[4]) / len(texts[4]))
    assert rows[5]["avg_word_len"] == 1.0 and rows[5]["avg_sent_len"] == 4.0


def test_whitespace_and_tokens_match_python(spark):
    texts = ["a b\x1cc  d", " lead and trail ", "Слово_1 x yz", "\x85\x0bq"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.whitespace_words(F.col("t")).alias("w"), T.strip(F.col("t")).alias("s"))
    for r in rows.collect():
        assert r["w"] == r["t"].split() and r["s"] == r["t"].strip()


def depth_by_walking(heads):
    out = {}
    for t in heads:
        steps, at = 0, t
        while heads[at] != at:
            at = heads[at]
            steps += 1
        out[t] = steps
    return out


def test_dependency_depth_on_trees(spark):
    chains = {0: {i: max(i - 1, 0) for i in range(300)}, 1: {i: i // 2 for i in range(300)}, 2: {5: 5}, 3: {10: 11, 11: 11, 12: 13, 13: 11}}
    rows = [(1, s, t, h) for s, heads in chains.items() for t, h in heads.items()]
    got = tokens.dependency_depth(spark.createDataFrame(rows, "doc_id long, sent_id long, pos int, head int"))
    found = {(r["sent_id"], r["pos"]): r["depth"] for r in got.collect()}
    assert found == {(s, t): d for s, heads in chains.items() for t, d in depth_by_walking(heads).items()}


def entropy(labels):
    n = Counter(labels)
    return -sum(c / len(labels) * math.log2(c / len(labels)) for c in n.values()) if labels else 0.0


def features_by_hand(rows):
    content = [t for t in rows if not t["is_punct"]]
    tags = [t["upos"] for t in content]
    lemmas = Counter(t["lemma"].lower() for t in content)
    sents = sorted({t["sent_id"] for t in rows})
    lens = [sum(t["sent_id"] == s for t in content) for s in sents]
    depths = [max(t["depth"] for t in rows if t["sent_id"] == s) for s in sents]
    verbs = [t for t in rows if t["upos"] in ("VERB", "AUX")]
    gaps = np.diff([t["pos"] for t in rows if t["text"] == ","])
    raw = " ".join(tags).encode()
    return {
        "avg_sent_len": np.mean(lens),
        "burstiness": np.std(lens),
        "punct_entropy": entropy([t["text"] for t in rows if t["is_punct"]]),
        "punct_density": (len(rows) - len(content)) / len(rows),
        "avg_dep_depth": np.mean(depths),
        "nv_ratio": tags.count("NOUN") / (tags.count("VERB") + 1e-9),
        "ttr": len(lemmas) / len(content) if content else 0,
        "hlr": sum(c == 1 for c in lemmas.values()) / len(content) if content else 0,
        "complexity_ratio": sum(t["verb_form"] in ("Conv", "Part") for t in rows) / len(rows),
        "passive_ratio": sum(t["voice"] == "Pass" for t in verbs) / len(verbs) if verbs else 0,
        "comma_cv": np.std(gaps) / np.mean(gaps) if len(gaps) else 0,
        "cr_pos": len(zlib.compress(raw, 9)) / len(raw) if raw else 0,
        "unique_trigrams_per_tok": len(set(zip(tags, tags[1:], tags[2:]))) / len(tags) if tags else 0,
        "pos_entropy": entropy(tags),
        "total_tokens": len(rows),
    }


TEXTS = [
    (1, "The old report was quickly written by a careful team, and it showed, in detail, what happened. Nobody knew! Why?", "en"),
    (2, "Der Bericht wurde von einem Team geschrieben, aber er ist nicht fertig... Wirklich nicht?! 42 Seiten & mehr.", "de"),
    (3, "Отчёт был написан командой, и он показал, что случилось. Никто не знал!", "ru"),
    (4, "short", "en"),
    (5, None, "en"),
    (6, "?!...?!...?!...?!...?!...", "en"),
    (7, "one, two, three, four and, finally, the very last five of them all", None),
]


@pytest.fixture(scope="module")
def annotated(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string")
    return df, tokens.token_relation(df)


def test_token_relation_depths_agree_with_heads(annotated):
    _, relation = annotated
    rows = relation.collect()
    walked = {}
    for doc in {r["doc_id"] for r in rows}:
        walked |= {(doc, t): d for t, d in depth_by_walking({r["pos"]: r["head"] for r in rows if r["doc_id"] == doc}).items()}
    assert {(r["doc_id"], r["pos"]): r["depth"] for r in rows} == walked
    filled = {(r["doc_id"], r["pos"]): r["depth"] for r in tokens.fill_depth(relation).collect()}
    assert filled == walked


def test_syntactic_features_by_hand(annotated):
    df, relation = annotated
    by_doc = {}
    for r in relation.orderBy("doc_id", "pos").collect():
        by_doc.setdefault(r["doc_id"], []).append(r)
    got = {r["doc_id"]: r for r in syntax.syntactic_features(df).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7}
    for doc, row in got.items():
        if doc in (4, 5):
            assert all(row[f] == 0 for f in SYNTACTIC_FEATURES)
        else:
            for f, v in features_by_hand(by_doc[doc]).items():
                assert row[f] == pytest.approx(v, abs=1e-8, rel=1e-9), (doc, f)


def test_features_from_a_tag_sequence(spark):
    tags = "NOUN VERB NOUN VERB NOUN ADJ".split()
    rows = [(1, 0, i, f"w{i}", f"w{i}", f"w{i}", t, 0, 0, None, None, "dep", False) for i, t in enumerate(tags)]
    got = syntax.features_from_tokens(spark.createDataFrame(rows, tokens.TOKEN_SCHEMA)).first()
    assert got["unique_trigrams_per_tok"] == 0.5
    assert got["pos_entropy"] == pytest.approx(1.459148, abs=1e-6)
    assert got["cr_pos"] == pytest.approx(len(zlib.compress(" ".join(tags).encode(), 9)) / 28)
    commas = [(2, 0, i, "," if i in (2, 5, 12) else "w", "w", "w", "PUNCT" if i in (2, 5, 12) else "NOUN", 0, 0, None, None, "dep", i in (2, 5, 12)) for i in range(14)]
    got = syntax.features_from_tokens(spark.createDataFrame(commas, tokens.TOKEN_SCHEMA)).first()
    assert got["comma_cv"] == pytest.approx(0.4)


def test_own_annotator(spark):
    def make():
        def parse(doc, text):
            words = text.split()
            return [(doc, 0, i, w, w.lower(), w.lower(), "NOUN", max(i - 1, 0), None, None, None, "dep", False) for i, w in enumerate(words)]

        return parse

    df = spark.createDataFrame([(1, "alpha beta gamma delta epsilon"), (2, None)], "doc_id long, text string")
    relation = tokens.fill_depth(tokens.annotate_with(df, make))
    got = syntax.features_from_tokens(relation, with_compression=False).first()
    assert got["avg_dep_depth"] == 4 and got["total_tokens"] == 5 and got["ttr"] == 1


CORPUS = ["The cat sat on the mat", "the cat and the dog", "A dog, a cat; the mat!", "unknown things", ""]


def tfidf_by_hand(fit, apply, stop, min_df, limit, sublinear):
    import re

    def grams(t):
        w = [x for x in re.findall(r"\w\w+", t.lower()) if x not in stop]
        return w + [f"{a} {b}" for a, b in zip(w, w[1:])]

    docs = [grams(t) for t in fit]
    df, total = Counter(g for d in docs for g in set(d)), Counter(g for d in docs for g in d)
    terms = sorted((t for t in df if df[t] >= min_df), key=lambda t: (-total[t], t))[:limit]
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in terms}
    out = []
    for d in map(grams, apply):
        tf = Counter(g for g in d if g in idf)
        w = {t: (1 + math.log(n) if sublinear else n) * idf[t] for t, n in tf.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.append({t: x / norm for t, x in w.items()})
    return sorted(terms), out


@pytest.mark.parametrize("sublinear", [True, False])
def test_tfidf(spark, sublinear):
    df = spark.createDataFrame(list(enumerate(CORPUS)), "doc_id long, text string")
    model = lexical.fit_tfidf(df, min_df=2, max_features=5, stop_words=["on"], sublinear=sublinear)
    terms, weights = tfidf_by_hand(CORPUS, CORPUS, {"on"}, 2, 5, sublinear)
    assert [r["term"] for r in model.terms.orderBy("term_id").collect()] == terms
    got = [{} for _ in CORPUS]
    for r in model.transform(df).collect():
        got[r["doc_id"]][r["term"]] = r["weight"]
    for a, b in zip(got, weights):
        assert a == pytest.approx(b)
    for r in model.vectors(df).collect():
        dense = {terms[i]: v for i, v in enumerate(r["features"].toArray()) if v}
        assert dense == pytest.approx(weights[r["doc_id"]])


def test_dependency_depth_where_positions_have_gaps(spark):
    rows = [(1, 0, 0, 0), (1, 0, 2, 0), (1, 0, 5, 2), (2, 0, 7, 9), (2, 0, 9, 9), (2, 0, 30, 7), (2, 0, 31, 8)]
    got = tokens.dependency_depth(spark.createDataFrame(rows, "doc_id long, sent_id long, pos int, head int"))
    depth = {(r["doc_id"], r["pos"]): r["depth"] for r in got.collect()}
    assert depth == {(1, 0): 0, (1, 2): 1, (1, 5): 2, (2, 7): 1, (2, 9): 0, (2, 30): 2, (2, 31): None}


@pytest.mark.parametrize("sublinear", [False, True])
def test_tfidf_stays_in_the_row_and_vectors_equal_the_relation(spark, monkeypatch, sublinear):
    texts = [f"{'alpha beta ' * (i % 4)}gamma{i % 3} delta {'beta ' * (i % 5)}" for i in range(30)] + ["", None, "unknown words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = lexical.fit_tfidf(df, min_df=2, max_features=40, sublinear=sublinear)
    found = model.transform(df)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1  # the repartition above
    rows = {(r["doc_id"], r["term_id"]): (r["tf"], r["weight"]) for r in found.collect()}
    vectors = {r["doc_id"]: r["features"] for r in model.vectors(df).collect()}
    assert set(vectors) == set(range(len(texts)))
    cells = {(d, int(i)): v for d, x in vectors.items() for i, v in zip(x.indices, x.values)}
    assert set(cells) == set(rows) and all(cells[k] == pytest.approx(rows[k][1], rel=1e-14) for k in rows)
    assert all(x.size == model.size for x in vectors.values())
    # Joined terms, as for a vocabulary that is too long to be listed, give the same.
    monkeypatch.setattr(lexical, "MAX_LISTED_TERMS", 1)
    joined = {(r["doc_id"], r["term_id"]): (r["tf"], r["weight"]) for r in model.transform(df).collect()}
    assert joined.keys() == rows.keys()
    assert all(joined[k][0] == rows[k][0] and joined[k][1] == pytest.approx(rows[k][1], rel=1e-12) for k in rows)


def test_syntactic_features_are_one_scan_and_one_exchange(spark, tmp_path):
    texts = ["The house is seen by people, walking home quickly.", "short", "", None, "!?., !?., !?., !?., !?.,", "One two. Three four, five, six seven."]
    rows = [(i, t, "en", i % 2) for i, t in enumerate(texts)] + [(0, "Another text that repeats the id of the first one.", "en", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, y int").write.parquet(f"{tmp_path}/d")
    df = spark.read.parquet(f"{tmp_path}/d")
    found = syntax.syntactic_features(df, with_compression=False, keep=("y",))
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange " in line and "BroadcastExchange" not in line]
    assert plan.count("FileScan") == 1 and len(exchanges) == 1, plan
    got = sorted(map(tuple, found.collect()), key=repr)
    assert len(got) == len(rows)
    # Each row is counted on its own: alone it has the same features.
    for i, t, lang, y in rows:
        alone = syntax.syntactic_features(spark.createDataFrame([(i, t, lang, y)], df.schema), with_compression=False, keep=("y",))
        assert tuple(alone.first()) in got
    zeros = [r for r in got if r[2:] == (0.0,) * len(r[2:])]
    assert {r[0] for r in zeros} == {1, 2, 3}
    # A parser of the user's own goes through the join and gives the same for unique ids.
    unique = df.where("doc_id > 0")
    own = syntax.syntactic_features(unique, annotate=lambda d, i, t, g: tokens.token_relation(d, i, t, g))
    assert sorted(map(tuple, own.collect()), key=repr) == sorted(map(tuple, syntax.syntactic_features(unique).collect()), key=repr)


def test_all_features_are_one_pass_over_the_tokens(spark):
    """With the compression feature too: texts are cut once, and no window sorts the tokens of a whole document."""
    df = spark.createDataFrame([(1, "en", "One sentence, then another one. And, well, a third!")], "doc_id long, lang string, text string")
    plan = syntax.syntactic_features(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2 and plan.count("RepartitionByExpression") == 1
    assert "[doc_id" in plan and not any("Window" in line and "pos#" in line and "sent_id#" not in line for line in plan.splitlines())


def test_sentences_are_cut_as_their_tokens_say(spark):
    texts = [". . Hello  world.. \n\n Yes?! No ...x", None, "  ", "...", "a.b.c 3.14 ! ! z", "." * 20000 + "a", "wo rd, " * 5000, "\u2028!\x1f?b \U0001d7d8 c."]
    rows = [(i, "en", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, lang string, text string")
    for outer in (False, True):
        want = tokens.sentence_ids(tokens.raw_tokens(df, outer=outer)).select("doc_id", "pos", "text", "sent_id")
        got = tokens.sentence_tokens(df, outer=outer).select("doc_id", "pos", "text", "sent_id")
        assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 < want.count()


def test_equal_sentences_have_no_burstiness(spark):
    df = spark.createDataFrame([(1, "en", "One two three four five six seven. " * 33)], "doc_id long, lang string, text string")
    row = syntax.syntactic_features(df, with_compression=False).first()
    assert (row.burstiness, row.avg_sent_len, row.total_tokens) == (0.0, 7.0, 264.0)
