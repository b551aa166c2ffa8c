"""Every function that returns its input's columns takes a table with all names that the operators use inside."""

import pytest
from pyspark.sql import functions as F

from stylotrace.llm import curriculum, exact, jaccard, linededup, quality

TEXTS = ["one two three four five six seven", "one two three four five six seven", "a\nb\nc\nd", "x\na\nb\nc", None, ""]
INNER = (
    "_id _sha _n _positions _position _filled _starts _lines _version places removed rest version place h1 h2 node n signature "
    "token component component_id center copies best incoming row_no text_sha256 n_bytes n_points p evidence host path total "
    "strength kept score size bucket target taken positions"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, TEXTS[i % len(TEXTS)], f"src{i % 2}", "en", *[f"{c}{i}" for c in INNER]) for i in range(18)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string" + "".join(f", {c} string" for c in INNER))


def narrow(docs):
    return docs.select("doc_id", "text", "source", "lang")


def labels(spark):
    return spark.createDataFrame([(0, 1, "x"), (2, 0, "x"), (5, None, "x")], "doc_id long, quality int, _id string")


OPERATORS = {
    "exact": lambda spark, d: exact.drop_copies(d, exact.half_of_ids()),
    "near": lambda spark, d: jaccard.one_of_each(d, 5, 80),
    "lines": lambda spark, d: linededup.dedup_lines(d),
    "quality": lambda spark, d: quality.accepted(d, labels(spark)),
    "mix": lambda spark, d: curriculum.mixed(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_names_do_not_clash(spark, docs, name):
    got, plain = OPERATORS[name](spark, docs), OPERATORS[name](spark, narrow(docs))
    given = set(docs.columns) - {"removed"} if name == "lines" else set(docs.columns)
    assert given <= set(got.columns)
    rows = got.collect()
    assert sorted((r.doc_id, r.text) for r in rows if r.text) == sorted((r.doc_id, r.text) for r in plain.collect() if r.text)
    assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in given if c in INNER)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_an_empty_table_stays_empty(spark, docs, name):
    assert OPERATORS[name](spark, docs.where(F.lit(False))).count() == 0
