"""The whole pipeline against a plain version of its stages."""

import hashlib
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stylotrace.llm import curriculum
from stylotrace.llm.queries import WORD_BPE
from .test_quality import BAD, GOOD, brute

pipeline = pytest.importorskip("corpus_pipeline")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BLANK = r"[\x20\x09-\x0D]"


def tables(spark, folder):
    docs, labels = [], []
    story = [f"w{k}" for k in range(60)]
    for i in range(160):
        bad = i % 11 == 3
        if bad:
            text = BAD + f" {i}"
        elif i % 8 == 0:  # near copies of one text: a word more at the end
            text = " ".join(story) + f" ending{i}"
        elif i % 8 == 1:  # copies up to blanks
            text = f"{GOOD} Copy number {i % 3}." + " " * (i % 4)
        else:
            text = f"{GOOD} This is text {i}, which has {i} words of its own: " + " ".join(f"x{i}y{k}" for k in range(i % 13)) + "."
        docs.append((i, text, ["en", "de"][i % 2], f"src{i % 5}", len(text)))
        labels.append((i, int(not bad), 0))
    docs += [(500, None, "en", "src1", 0), (501, "", None, None, 0)]
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, labels


def shingles(text):
    words = [w for w in re.split(BLANK, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()


def plain_kept(docs, labels):
    scored = {r[0]: r[4] for r in brute([(i, t, s, g) for i, t, g, s, _ in docs], [(i, q) for i, q, _ in labels])}
    rows = [d for d in docs if scored[d[0]] >= 0.5]
    groups = {}
    for d in rows:
        groups.setdefault(re.sub(BLANK, "", d[1] or ""), []).append(d)
    rows = [min(g, key=lambda d: (-len(d[1] or ""), d[0])) for g in groups.values()]
    sets = {d[0]: shingles(d[1]) for d in rows}
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return [d for d in rows if find(d[0]) == d[0]]


def test_run_equals_the_plain_stages(spark, tmp_path):
    docs, labels = tables(spark, tmp_path)
    assert [name for name, _ in pipeline.STAGES] == ["quality", "exact_dedup", "near_copies", "mix", "bpe"]
    got = Counter(map(tuple, pipeline.run(spark, str(tmp_path)).collect()))
    kept = plain_kept(docs, labels)
    assert 0 < len(kept) < 130 and sum(d[1] is not None and d[1].startswith("BUY") for d in kept) == 0
    planned = curriculum.plan(spark.createDataFrame(kept, DOCS).select("doc_id", "source", "text"))
    passes = {r.doc_id: r.n for r in planned.select("doc_id", F.size("positions").alias("n")).collect()}
    library, want = Tokenizer.from_file(WORD_BPE), Counter()
    for i, text, *_ in kept:
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        row = (i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
        want[row] += passes[i]
    assert got == +want


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not here")
def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id")
    judged = docs.join(good, "doc_id")
    kept = pipeline.STAGES[0][1](spark, docs, sf).join(good, "doc_id").count()
    assert kept >= 0.95 * judged.count()
