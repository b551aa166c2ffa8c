"""Quality: evidence and site posteriors against loops, sparse and null sites, and the edges."""

import math

import pytest
import regex
from pyspark.sql import functions as F

from stylotrace.llm import quality

DOCS = "doc_id long, text string, source string, lang string"
LABELS = "doc_id long, quality int"
BLANKS = " \t\n\x0b\x0c\r"


def bins(text):
    text = text or ""
    size = max(len(text), 1)
    count = lambda p: len(regex.findall(p, text))
    words = [w for w in regex.split(f"[{BLANKS}]", text) if w]
    value = {
        "upper": count(r"\p{Lu}") / max(count(r"\p{L}"), 1),
        "odd": count(r"""[^\p{L}\p{N}\s.,;:!?'"()-]""") / size,
        "marks": count(r"[.,;:!?]") / size,
        "digits": count(r"\p{N}") / size,
        "distinct": len(set(words)) / max(len(words), 1),
    }
    return {m: sum(v > e for e in quality.EDGES[m]) for m, v in value.items()}


def strength(groups, means):
    """Prior rows by the method of moments; groups are lists of p, means what they vary around."""
    k, n = len(groups), sum(map(len, groups))
    if not n or k < 2 or n <= k:
        return quality.SHRINK_RANGE[1]
    average = [sum(g) / len(g) for g in groups]
    inside = max(sum(sum(p * p for p in g) - len(g) * a * a for g, a in zip(groups, average)), 0.0) / (n - k)
    between = sum(len(g) * (a - m) ** 2 for g, a, m in zip(groups, average, means)) - (k - 1) * inside
    between /= n - sum(len(g) ** 2 for g in groups) / n
    found = inside / between if between > 0 else quality.SHRINK_RANGE[1]
    return min(max(found, quality.SHRINK_RANGE[0]), quality.SHRINK_RANGE[1])


def brute(docs, labels):
    """[(doc_id, evidence, host posterior, path posterior, score)] by loops over all rows."""
    rows = [(i, bins(t), s, g) for i, t, s, g in docs]
    known = [(b, q) for i, b, _, _ in rows for j, q in labels if i == j and q in (0, 1)]
    ratio, total = {}, [0, 0]
    for m, edges in quality.EDGES.items():
        total = [sum(q == c for _, q in known) for c in (0, 1)]
        for b in range(len(edges) + 1):
            bad, good = (
                (sum(x[m] == b and q == c for x, q in known) + quality.SMOOTHING) / (total[c] + quality.SMOOTHING * (len(edges) + 1)) for c in (0, 1)
            )
            ratio[m, b] = quality.DEPTH * math.log(good / bad)
    share = (total[1] + 1) / (sum(total) + 2)
    prior = math.log(share / (1 - share))
    evidence = [sum(ratio[m, b[m]] for m in b) for _, b, _, _ in rows]
    p = [1 / (1 + math.exp(-e - prior)) for e in evidence]
    hosts, paths = {}, {}
    for (_, _, s, g), x in zip(rows, p):
        hosts.setdefault(s, []).append(x)
        paths.setdefault((s, g), []).append(x)
    mean = sum(p) / len(p)
    k_host = strength(list(hosts.values()), [mean] * len(hosts))
    host = {h: (sum(x) + k_host * mean) / (len(x) + k_host) for h, x in hosts.items()}
    k_path = strength(list(paths.values()), [host[h] for h, _ in paths])
    out = []
    for (i, _, s, g), e, x in zip(rows, evidence, p):
        mine = paths[s, g]
        path = (sum(mine) + k_path * host[s]) / (len(mine) + k_path)
        others = (sum(mine) - x + k_path * host[s]) / (len(mine) - 1 + k_path)
        others = min(max(others, 1e-9), 1 - 1e-9)
        out.append((i, e, host[s], path, 1 / (1 + math.exp(-math.log(others / (1 - others)) - e))))
    return out


GOOD = "The house stands at the river. People walk there in the evening, and the lights are on."
BAD = "BUY NOW!!! $$$ 100% FREE *** CLICK >>> 777 BUY NOW BUY NOW BUY NOW"


def corpus():
    docs, labels = [], []
    for i in range(240):
        site = i % 6
        bad = (i * 7) % 10 < (8 if site == 0 else 2)
        text = (BAD if bad else GOOD) + f" {i} " + "word " * (i % 9)
        docs.append((i, text, f"host{site}" if site < 5 else None, ["en", "de", None][i % 3]))
        if i % 2:
            labels.append((i, int(not bad)))
    docs += [(1000, "Lone text of its own host.", "tiny", "xx"), (1001, None, "tiny", "xx"), (1002, "", None, None), (1003, "中文。" * 50, "host1", "en")]
    return docs, [*labels, (9999, 1), (3, None), (5, 7)]


def test_against_brute_force(spark):
    docs, labels = corpus()
    got = quality.classify(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS)).collect()
    found = {r.doc_id: (r.evidence, r.host_posterior, r.path_posterior, r.score) for r in got}
    want = brute(docs, labels)
    assert len(got) == len(want) == len(found)
    for i, *values in want:
        assert found[i] == pytest.approx(tuple(values), rel=1e-9), i
    assert all(r.kept == (r.score >= 0.5) for r in got)


def test_sparse_sites_lean_on_the_corpus_and_bad_sites_weigh_down(spark):
    docs, labels = corpus()
    rows = {r.doc_id: r for r in quality.classify(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()}
    assert rows[0].host_posterior < rows[1].host_posterior  # host0 is mostly bad
    middle = sum(r.host_posterior for i, r in rows.items() if i < 240) / 240
    assert abs(rows[1000].host_posterior - middle) < abs(rows[0].host_posterior - middle)
    judged = [r for i, r in rows.items() if i < 240]
    right = sum(r.kept != docs[r.doc_id][1].startswith("BUY") for r in judged)
    assert right / len(judged) > 0.95


def test_held_out_labels_are_predicted(spark):
    docs, labels = corpus()
    usable = [x for x in labels if x[1] in (0, 1) and x[0] < 240]
    learned = [x for x in usable if x[0] % 10 != 1]
    found = quality.classify(spark.createDataFrame(docs, DOCS), spark.createDataFrame(learned, LABELS))
    kept = {r.doc_id: int(r.kept) for r in found.collect()}
    held = [x for x in usable if x[0] % 10 == 1]
    assert len(held) > 15 and sum(kept[i] == q for i, q in held) / len(held) > 0.95


def test_without_labels_nothing_is_rejected_and_empty_tables_stay_empty(spark):
    docs, _ = corpus()
    none = spark.createDataFrame([], LABELS)
    df = spark.createDataFrame([*docs, docs[0]], DOCS)
    found = quality.classify(df, none)
    assert found.count() == len(docs) + 1 and found.where(~F.col("kept")).count() == 0
    assert quality.accepted(df.limit(0), none).count() == 0
    repeated = {(r.doc_id, r.score) for r in quality.classify(df, spark.createDataFrame(corpus()[1], LABELS)).where("doc_id = 0").collect()}
    assert len(repeated) == 1
