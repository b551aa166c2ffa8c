"""Toxicity: messages and gradients against enumeration, words and spans, learning, and defined results at the edges."""

import itertools

import numpy as np
import pytest

from stylotrace.llm import toxicity as tox

DOCS = "doc_id long, text string"
LABELS = "doc_id long, toxic int"


def enumerated(unary, transitions):
    """Log odds of each tag by summing over all tag sequences."""
    mass = np.zeros((len(unary), 2))
    for tags in itertools.product((0, 1), repeat=len(unary)):
        score = sum(u for u, t in zip(unary, tags) if t) + sum(transitions[a, b] for a, b in zip(tags, tags[1:]))
        for k, t in enumerate(tags):
            mass[k, t] += np.exp(score)
    return np.log(mass[:, 1] / mass[:, 0])


def test_messages_equal_enumeration():
    rng = np.random.default_rng(4)
    count = np.array([3, 0, 1, 6, 2])
    first, unary = np.cumsum(count) - count, rng.normal(0, 2, count.sum())
    transitions = np.array([[0.0, -0.7], [0.4, 1.3]])
    got = tox.messages(unary, first, count, transitions)
    for f, n in zip(first, count):
        assert got[f : f + n] == pytest.approx(enumerated(unary[f : f + n], transitions))
    nothing = np.array([], np.int64)
    assert len(tox.messages(np.empty(0), nothing, nothing, transitions)) == 0


def test_gradient_of_the_transitions_equals_differences():
    rng = np.random.default_rng(5)
    count = np.array([5, 4])
    first, unary = np.cumsum(count) - count, rng.normal(0, 1, 9)
    gold, transitions = rng.integers(0, 2, 9).astype(float), np.array([[0.0, -0.3], [0.2, 0.9]])
    inner = np.ones(9, bool)
    inner[first] = False

    def likelihood(t):
        total = 0.0
        for f, n in zip(first, count):
            score = lambda tags: sum(u for u, x in zip(unary[f : f + n], tags) if x) + sum(  # noqa: E731, B023
                t[int(a), int(b)] for a, b in zip(tags, tags[1:])
            )
            total += score(gold[f : f + n]) - np.log(sum(np.exp(score(tags)) for tags in itertools.product((0, 1), repeat=n)))
        return total

    odds = tox.messages(unary, first, count, transitions)
    got = tox._pair_gradient(unary, odds, gold, np.flatnonzero(inner), transitions)
    for cell in ((0, 1), (1, 0), (1, 1)):
        step = np.zeros((2, 2))
        step[cell] = 1e-5
        want = (likelihood(transitions + step) - likelihood(transitions - step)) / 2e-5
        assert got[cell] == pytest.approx(want, abs=1e-6)


def test_words_of_long_runs_cover_every_character():
    text = "ab " + "中" * 50 + "".join(chr(0x4E00 + k) for k in range(300)) + "  c\n" + "d" * 64
    seen = set()
    for a, b in tox.places(text):
        assert 0 < b - a <= tox.LONGEST
        seen.update(range(a, b))
    assert seen == {k for k, c in enumerate(text) if not c.isspace()}
    assert tox.runs_of(text) == [text[a:b] for a, b in tox.places(text)]
    one, other = "x" * 5000 + "a", "x" * 5000 + "b"  # they differ behind thousands of characters
    assert tox.runs_of(one) != tox.runs_of(other)
    assert [tox.clean(w) for w in ("--ab_c!!", "!?", "", "_X_", "a!b")] == ["ab_c", "", "", "x", "a!b"]


def corpus():
    rng = np.random.default_rng(6)
    words = [f"{a}{b}{c}" for a in "bcdfgl" for b in "aeiou" for c in "mnrst"]
    docs, labels = [], []
    for i in range(300):
        text = [str(w) for w in rng.choice(words, rng.integers(5, 60))]
        toxic = int(i % 5 == 1)
        if toxic:
            text.insert(int(rng.integers(0, len(text))), "vilevile")
        docs.append((i, " ".join(text)))
        labels.append((i, toxic))
    return docs, labels


def test_finds_the_offending_word_in_rows_it_has_not_learned_from(spark):
    docs, labels = corpus()
    docs += [(1000, None), (1001, ""), (1002, " \n"), (1003, "bam " * 50_000 + "vilevile"), (None, "bam can"), (1, docs[1][1])]
    frame = spark.createDataFrame(docs, DOCS).repartition(3)
    rows = tox.toxicity(frame, spark.createDataFrame(labels, LABELS)).collect()
    assert len(rows) == len(docs)
    by_id = {r.doc_id: r for r in rows}
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert len(held) > 30
    assert all(r.predicted == int(r.doc_id % 5 == 1) for r in held)
    texts = dict(docs)
    for r in held:
        for s in r.spans:
            assert texts[r.doc_id][s.start : s.stop] == "vilevile"
    assert all(0 <= r.score <= 1 for r in rows)
    for i in (1000, 1001, 1002):
        assert by_id[i].predicted == 0 and by_id[i].spans == []
    assert [texts[1003][s.start : s.stop] for s in by_id[1003].spans] == ["vilevile"]
    assert len({r.score for r in rows if r.doc_id == 1}) == 1


@pytest.mark.parametrize("kept", [[], [0], [1]])
def test_without_labels_of_both_kinds_nothing_offends(spark, kept):
    docs, labels = corpus()
    known = spark.createDataFrame([x for x in labels if x[1] in kept], LABELS)
    rows = tox.toxicity(spark.createDataFrame(docs, DOCS), known).collect()
    assert len(rows) == len(docs) and not any(r.spans for r in rows)


def test_empty_tables_and_clashing_names(spark):
    docs, labels = corpus()
    known = spark.createDataFrame(labels, LABELS)
    assert tox.toxicity(spark.createDataFrame([], DOCS), known).count() == 0
    assert tox.toxicity(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
    extra = ["_id", "draw", "toxic", "peak", "words", "score", "spans", "word", "context", "kind", "tags"]
    wide = spark.createDataFrame([(*d, *["x"] * len(extra)) for d in docs], DOCS + "".join(f", {c} string" for c in extra))
    clashing = spark.createDataFrame([(*x, "y", "z") for x in labels], LABELS + ", _id string, text string")
    plain = tox.toxicity(spark.createDataFrame(docs, DOCS), known)
    assert sorted(map(tuple, tox.toxicity(wide, clashing).collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_words_of_a_text_are_weighed_together_and_as_alone(monkeypatch):
    import zlib

    from stylotrace.llm import toxicity as module

    texts = ["a ab abc, Straße привет ...", "", "日本語" * 60, "a b a c \U0001d7d8x longer-words"]
    weights = np.random.default_rng(2).normal(size=module.DIMENSIONS).astype(np.float32)
    for word in ("", "ab", "straße", "日本語日本語日本語"):
        names = ["bias", f"w{word}", *[f"p{word[:k]}" for k in module.PREFIXES]]
        assert module.features(word) == [zlib.crc32(n.encode()) % module.DIMENSIONS for n in names]
    for bound in (200_000, 3):  # also where no word stays known
        monkeypatch.setattr(module, "KNOWN_WORDS", bound)
        known = module._Unary(weights)
        for text in texts:
            runs = module.runs_of(text)
            want = [weights[module.features(module.clean(r))].sum() for r in runs]
            assert known.of(runs).tolist() == np.array(want, np.float32).tolist()
