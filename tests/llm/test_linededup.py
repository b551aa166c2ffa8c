"""Line deduplication against a plain walk over all windows."""

import random

from stylotrace.llm import linededup


def brute(rows, width=3):
    docs = sorted({(i, t) for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    seen, cleaned = set(), {}
    for i, t in docs:
        lines = (t or "").split("\n")
        filled = [(k, x.strip(" \t\x0b\x0c\r")) for k, x in enumerate(lines) if x.strip(" \t\x0b\x0c\r")]
        covered = set()
        for p in range(len(filled) - width + 1):
            key = tuple(x for _, x in filled[p : p + width])
            if key in seen:
                covered.update(range(p, p + width))
            seen.add(key)
        runs = []
        for p in sorted(covered):
            if runs and p == runs[-1][1] + 1:
                runs[-1][1] = p
            else:
                runs.append([p, p])
        spans = [(filled[a][0], filled[b][0] + 1) for a, b in runs]
        text = "\n".join(x for k, x in enumerate(lines) if not any(a <= k < b for a, b in spans))
        cleaned[i, t] = (i, (text if spans else t), spans)
    return sorted((cleaned[r] for r in rows), key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, removed string").repartition(4)
    got = linededup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "removed"]
    return sorted(((r.doc_id, r.text, [tuple(x) for x in r.removed]) for r in got.collect()), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(120):
        lines = [rng.choice("abcdefg") * rng.choice([1, 1, 2]) for _ in range(rng.randrange(14))]
        lines = [x if rng.random() > 0.15 else rng.choice(["", "  ", f" {x}\t"]) for x in lines]
        rows.append((i, "\n".join(lines)))
    assert run(spark, rows) == brute(rows)


def test_nulls_repeats_long_texts_and_empty_tables(spark):
    long = "\n".join(f"line {i % 4000}" for i in range(20_000))
    rows = [(1, None), (2, ""), (None, "a\nb\nc"), (3, "a\nb\nc"), (3, "a\nb\nc"), (4, "x\ny"), (5, "x\ny"), (6, long), (None, None)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:1]) == [(1, None, [])]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.digests(linededup.dedup_lines(empty)).count() == 0
