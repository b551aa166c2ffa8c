import pytest
from pyspark.sql import functions as F

from stylotrace.fixed_values import ABLATION_GROUPS, GENERATOR_LENGTHS, SYNTACTIC_FEATURES
from stylotrace.operators import prep


def one(spark, expr_of, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names))
    return df.select(expr_of(*[F.col(n) for n in names]).alias("v")).first()["v"]


@pytest.mark.parametrize(
    "raw, clean",
    [
        ("МОСКВА, 5 мая — РИА Новости. Сегодня дождь.", "Сегодня дождь."),
        ("Санкт-Петербург — ТАСС. Открыт мост.", "Открыт мост."),
        ("ТАСС. Новый закон\nпринят.", "Новый закон принят."),
        ("обрывок начала. Текст дальше", "Текст дальше"),
        ("only small letters ", "only small letters"),
        (" \r\nHello world\n", "Hello world"),
        (None, ""),
        ("", ""),
    ],
)
def test_clean_text(spark, raw, clean):
    assert one(spark, prep.clean_text, raw) == clean


@pytest.mark.parametrize(
    "title, text, body",
    [("A", "A\nbody", "body"), ("A", "A body", "A body"), ("T", "«T»\n rest ", "rest"), ("X", " Other\ntext ", "Other\ntext")],
)
def test_strip_echoed_title(spark, title, text, body):
    assert one(spark, lambda t, x: prep.strip_echoed_title(x, t), title, text) == body


def test_script_share_and_gate(spark):
    assert one(spark, prep.script_share, "слово word два 42") == 50.0
    assert one(spark, prep.script_share, "   ") == 0.0
    texts = [("слово " * 100,), ("word " * 100,), ("word " * 99,), ("слово " * 50 + "word " * 50,), (None,)]
    gated = prep.quality_gate(spark.createDataFrame(texts, "text string"))
    assert [r["reason"] for r in gated.collect()] == ["ok", "script", "short", "ok", "short"]


def test_contract(spark):
    df = spark.createDataFrame([("a", 0), (None, 1), ("c", 7)], "text string, is_ai int")
    rows = {r["column_name"]: (r["n_rows"], r["n_null"], r["n_outside"]) for r in prep.contract_report(df, ["text", "is_ai"], {"is_ai": [0, 1]}).collect()}
    assert rows == {"text": (3, 1, 0), "is_ai": (3, 0, 1)}
    with pytest.raises(ValueError, match="topic"):
        prep.contract_report(df, ["topic"])
    assert prep.unknown_features({"g": ["ttr", "nope"], "h": ["hlr"]}, SYNTACTIC_FEATURES) == {"g": ["nope"]}
    assert prep.unknown_features(ABLATION_GROUPS, SYNTACTIC_FEATURES) == {}


def test_dedupe_with_a_hot_text(spark):
    rows = [(i, "same" if i % 3 else f"t{i}", f"s{i}") for i in range(1, 300)]
    kept = prep.dedupe_exact(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id")
    got = {r["text"]: (r["doc_id"], r["source"]) for r in kept.collect()}
    assert len(got) == 100 and got["same"] == (1, "s1")


def test_label_defaults_lengths(spark):
    df = spark.createDataFrame([("human", "  ", "a b"), ("gpt", "nan", ""), (None, "News", None)], "label string, topic string, text string")
    out = prep.length_columns(prep.fill_defaults(df.withColumn("y", prep.binarise_label(F.col("label")))))
    got = [tuple(r) for r in out.select("y", "topic", "temperature", "top_p", "length_words", "length_chars").collect()]
    assert got == [(0, "General", 0.7, 0.9, 2, 3), (1, "General", 0.7, 0.9, 0, 0), (None, "News", 0.7, 0.9, 0, 0)]
    kept = prep.fill_defaults(df.withColumn("temperature", F.lit(None).cast("double")))
    assert kept.first()["temperature"] is None


def test_build_corpus(spark):
    human = spark.createDataFrame([(i, f"Text {i % 40}", None) for i in range(60)], "doc_id long, text string, rubric string")
    made = spark.createDataFrame([(100 + i, f"Made {i}", "m", "t", True) for i in range(30)], "doc_id long, text string, source string, topic string, redacted boolean")
    rows = prep.build_corpus(human, made, per_class=35).collect()
    assert sorted(r["id"] for r in rows) == list(range(65))
    assert sum(r["is_ai"] for r in rows) == 30 and sum(r["is_redacted"] for r in rows) == 30
    assert {r["length_words"] for r in rows} == {2}


def test_generation_plan(spark):
    titles = spark.createDataFrame([(i, f"title {i}", "nan" if i % 2 else "Sport") for i in range(50)], "doc_id long, title string, topic string")
    rows = prep.generation_plan(titles, 300).collect()
    assert sorted(r["request_id"] for r in rows) == list(range(1, 301))
    fixed = [r for r in rows if r["model_label"].startswith("DeepSeek")]
    assert len(fixed) == 100 and {(r["temperature"], r["top_p"]) for r in fixed} == {(0.3, 0.9)}
    free = [r for r in rows if not r["model_label"].startswith("DeepSeek")]
    assert all(0.3 <= r["temperature"] <= 0.9 and 0.8 <= r["top_p"] <= 1.0 for r in free)
    assert {r["target_length"] for r in rows} == set(GENERATOR_LENGTHS)
    assert {r["topic"] for r in rows} == {"General", "Sport"} and len({r["title"] for r in rows}) > 40


def test_resume(spark):
    empty = spark.createDataFrame([], "id long")
    assert prep.resume_from(empty).first()["last_id"] == 0
    done = spark.createDataFrame([(3,), (9,)], "id long")
    fresh = prep.resume_new_rows(done, spark.createDataFrame([(i,) for i in range(12)], "id long"), "id").collect()
    assert sorted(r["new_id"] for r in fresh) == list(range(10, 20))
    assert {r["id"] for r in fresh} == set(range(12)) - {3, 9}


def test_split_disjoint(spark):
    train = spark.createDataFrame([("a",), ("b",), ("b",)], "text string")
    test = spark.createDataFrame([("b",), ("c",), ("c",)], "text string")
    assert [r["text"] for r in prep.split_disjoint(train, test).collect()] == ["c", "c"]


SKEWED = [(i, "everywhere" if i % 3 == 0 else f"t{i % 40}", i % 5) for i in range(600)]
ODD = [(None, None, 7), (9001, None, 8), (9000, None, 9), (None, "everywhere", 1), (3, "everywhere", 3), (0, "everywhere", 0), (None, "only", 2)]


def first_of_each(rows):
    best = {}
    for i, text, x in rows:
        if text not in best or (i is not None and (best[text][0] is None or i < best[text][0])):
            best[text] = (i, text, x)
    return sorted(best.values(), key=repr)


@pytest.mark.parametrize("few", [1 << 19, 0])
def test_dedupe_of_a_text_in_a_third_of_the_rows(spark, monkeypatch, few):
    monkeypatch.setattr(prep, "FEW_DIGESTS", few)
    monkeypatch.setattr(prep, "HOT", 50)
    df = spark.createDataFrame(SKEWED + ODD, "doc_id long, text string, x int").repartition(4)
    kept = prep.dedupe_exact(df, "doc_id")
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == first_of_each(SKEWED + ODD)
    plan = prep.dedupe_exact(spark.createDataFrame(SKEWED, df.schema).repartition(4), "doc_id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in text and "Sort [text" not in text
    if few:
        assert "SortMergeJoin" not in text and "ShuffledHashJoin" not in text


@pytest.mark.parametrize("few", [1 << 19, 0])
def test_split_disjoint_with_a_text_in_a_third_of_both_sides(spark, monkeypatch, few):
    monkeypatch.setattr(prep, "FEW_DIGESTS", few)
    monkeypatch.setattr(prep, "HOT", 50)
    schema = "doc_id long, text string, x int"
    train = spark.createDataFrame([r for r in SKEWED if r[2] < 3], schema).repartition(3)
    rows = SKEWED + ODD + [(7, "new", 1), (7, "new", 1)]
    found = prep.split_disjoint(train, spark.createDataFrame(rows, schema).repartition(3))
    seen = {r[1] for r in SKEWED if r[2] < 3}
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((r for r in rows if r[1] not in seen), key=repr)
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_resume_from_a_target_that_is_not_there(spark, tmp_path):
    incoming = spark.createDataFrame([(i,) for i in range(5)], "id long")
    target = prep.resume_target(spark, f"{tmp_path}/none", incoming.schema)
    assert prep.resume_from(target).first()["last_id"] == 0
    assert prep.resume_new_rows(target, incoming, "id").count() == 5
    incoming.where("id < 3").write.parquet(f"{tmp_path}/some")
    target = prep.resume_target(spark, f"{tmp_path}/some", incoming.schema)
    assert sorted(r["new_id"] for r in prep.resume_new_rows(target, incoming, "id").collect()) == [3, 4]
