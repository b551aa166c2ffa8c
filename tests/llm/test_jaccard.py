"""The Jaccard join against brute force over all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from stylotrace.llm import jaccard


def shingle_set(text, width):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, width, threshold):
    sets = [shingle_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            smallest[root(i)] = min(smallest.get(root(i), d), d)
    return sorted(
        ((d, len(sets[i]), smallest.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr
    )


def corpus(seed, n=150):
    """Chains of near copies around the threshold, copies, a passage shared by many, and odd texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("aeiou") + str(rng.randrange(2000))
    passage = " ".join(word() for _ in range(30))
    texts, rows = [], []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            words = rng.choice(texts).split()
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(words) + 1)
                words[at : at + rng.randrange(2)] = [word()]
            text = rng.choice([" ", "\n"]).join(words)
        else:
            text = " ".join(word() for _ in range(rng.choice([1, 3, 5, 20, 60, 150])))
            if rng.random() < 0.3:
                text += " " + passage
        texts.append(text or "x")
        rows.append(text.upper() if rng.random() < 0.1 else text)
    rows += [None, "", " \x0b ", "a b c", "A  b\nc", "é É", "é é", passage, "w " * 3000]
    return [(i * 3 % 1009, t) for i, t in enumerate(rows)] + [(None, rows[0]), (None, None), (5, rows[1]), (5, rows[1])]


@pytest.mark.parametrize(("seed", "width", "threshold", "frequent"), [(1, 4, 85, 64), (2, 4, 85, 2), (3, 2, 60, 3)])
def test_against_brute_force(spark, monkeypatch, seed, width, threshold, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, node string").repartition(4)
    got = jaccard.near_copies(df, width, threshold).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, width, threshold)


def test_a_bound_on_broadcasts_changes_no_result(spark, monkeypatch):
    rows = corpus(4, 80)
    monkeypatch.setattr(jaccard, "FREQUENT", 1)
    monkeypatch.setattr(jaccard, "FREQUENT_LIMIT", 3)
    monkeypatch.setattr("stylotrace.llm.support.FEW_ROWS", 5)
    got = jaccard.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 4, 85)


def test_long_texts_are_cut_between_words(monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(str(rng.randrange(500)) for _ in range(n)) for n in (0, 1, 5, 40, 4000, 3, 9000)]
    texts.insert(3, None)
    whole = [s for group in jaccard.sets_of(pa.array(texts), 4) for s in zip(group.node.tolist(), group.n.tolist())]
    monkeypatch.setattr(jaccard, "CHUNK", 1 << 10)
    jaccard._powers.clear()
    pieces = [s for group in jaccard.sets_of(pa.array(texts), 4) for s in zip(group.node.tolist(), group.n.tolist())]
    jaccard._powers.clear()
    assert pieces == whole and [n for _, n in whole] == [len(shingle_set(t, 4)) for t in texts]


def test_one_of_each_and_empty_table(spark):
    rows = [(4, "a b c d e", "k"), (2, "A b c d e", None), (9, None, "z"), (None, "a b c d e", "n"), (7, "q", "1"), (7, "q", "1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((tuple(r) for r in kept.collect()), key=repr) == sorted(
        [(2, "A b c d e", None), (9, None, "z"), (None, "a b c d e", "n"), (7, "q", "1")], key=repr
    )
    assert jaccard.near_copies(df.limit(0)).count() == 0 and jaccard.one_of_each(df.limit(0)).count() == 0


def test_mix_is_a_bijection_on_a_sample():
    values = np.arange(100_000, dtype=np.uint64)
    assert len(np.unique(jaccard.mix(values, 3))) == len(values)


def test_order_by_text_is_that_of_a_lexical_sort():
    from stylotrace.llm.jaccard import by_text

    rng = np.random.default_rng(5)
    for texts in (3, 70_000):
        text = np.sort(rng.integers(0, texts, 200_000))
        key = rng.permutation(1 << 20)[:200_000].astype(np.uint64) << np.uint64(40)
        assert (by_text(text, key, texts) == np.lexsort((key, text))).all()
