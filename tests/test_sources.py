import json
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from stylotrace.operators import evaluate, models
from stylotrace.operators.surface import surface_features
from stylotrace.fixed_values import SURFACE_FEATURES
from stylotrace.plans.closed_form import fit_discriminant
from stylotrace.sources import corpora, published, stores
from stylotrace.streaming import jobs

LATIN = "[A-Za-z]"


def test_csv_with_bom_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text('﻿title,text,rubric\n"A ""b""","line one\nline, two",\nB,plain,News\n', encoding="utf-8")
    rows = [tuple(r) for r in corpora.read_corpus(spark, str(path), corpora.HUMAN_POOL).collect()]
    assert rows == [('A "b"', "line one\nline, two", None), ("B", "plain", "News")]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_round_trip(spark, tmp_path, fmt):
    rows = [(1, 'say "hi"\nand, more', True, False, "s", None, 0.7, 0.9, 4, 18), (2, "текст —", False, False, "s", "t", 0.0, 0.0, 2, 7)]
    df = spark.createDataFrame(rows, corpora.MAIN_CORPUS)
    corpora.write_corpus(df, str(tmp_path / "out"), fmt, bom=fmt == "csv")
    back = corpora.read_corpus(spark, str(tmp_path / "out"), corpora.MAIN_CORPUS, fmt)
    assert sorted(map(tuple, back.collect())) == rows


def test_qa_lines(spark, tmp_path):
    long = "x" * 99
    lines = [
        {"question": "q", "human_answers": [long + " ", long], "chatgpt_answers": [long + "yz"]},
        {"question": "r", "human_answers": [], "chatgpt_answers": None},
    ]
    (tmp_path / "qa.jsonl").write_text("\n".join(map(json.dumps, lines)))
    rows = corpora.qa_to_rows(corpora.read_qa_jsonl(spark, str(tmp_path / "qa.jsonl"))).collect()
    # Length counts before the trim, so the padded answer stays.
    assert sorted((r["is_ai"], len(r["text"])) for r in rows) == [(0, 99), (1, 101)]


def test_feature_store_notices_changes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    calls = []

    def compute(d):
        calls.append(1)
        return surface_features(d).drop("text")

    for frame in (df, df.orderBy(F.desc("doc_id")), df.withColumn("text", F.concat("text", F.lit("!")))):
        stores.feature_store(frame, str(tmp_path), "t", compute, SURFACE_FEATURES).collect()
    assert len(calls) == 2


def test_runs(spark, tmp_path):
    pred = spark.createDataFrame([(1, 1, 0.9), (2, 0, 0.2)], "doc_id long, y int, p double")
    for _ in range(2):
        stores.save_run(str(tmp_path), "e1", evaluate.metric_rows(pred), pred)
    stores.save_run(str(tmp_path), "e2", evaluate.metric_rows(pred), pred)
    with pytest.warns(UserWarning, match="e3"):
        rows = stores.load_runs(spark, str(tmp_path), {"e1": "One", "e2": "Two", "e3": "Three"}).collect()
    assert sorted((r["experiment"], r["name"], r["accuracy"]) for r in rows) == [("e1", "One", 1.0), ("e2", "Two", 1.0)]
    assert stores.load_predictions(spark, str(tmp_path)).count() == 4


@pytest.fixture(scope="module")
def arriving(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("in") / "texts")
    rows = [(i, f"Title {i}\n" + "word " * (60 + 10 * i), f"Title {i}", i % 2) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, title string, y int")
    df.repartition(3).write.parquet(folder)
    return folder, df


def run(spark, stream, base):
    jobs.append_to(stream, f"{base}/out", f"{base}/resume").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def test_gate_stream_equals_batch_and_resumes(spark, arriving, tmp_path):
    folder, df = arriving
    stream = jobs.gate(jobs.read_stream(spark, folder, df.schema, 1), letter=LATIN)
    expected = sorted(map(tuple, jobs.gate(df, letter=LATIN).collect()))
    assert sorted(map(tuple, run(spark, stream, tmp_path).collect())) == expected
    again = jobs.gate(jobs.read_stream(spark, folder, df.schema, 1), letter=LATIN)
    assert run(spark, again, tmp_path).count() == len(expected)


def test_score_stream_equals_batch(spark, arriving, tmp_path):
    folder, df = arriving
    model = fit_discriminant(surface_features(df), SURFACE_FEATURES)
    got = run(spark, jobs.score(jobs.read_stream(spark, folder, df.schema), model), tmp_path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.score(df, model).collect()))


def test_progress_stream(spark, arriving, tmp_path):
    folder, df = arriving
    totals = jobs.progress(jobs.gate(jobs.read_stream(spark, folder, df.schema, 1), letter=LATIN))
    jobs.keep_totals(totals, f"{tmp_path}/t", f"{tmp_path}/r").awaitTermination()
    expected = jobs.progress(jobs.gate(df, letter=LATIN))
    assert sorted(map(tuple, published.latest(spark, f"{tmp_path}/t").collect())) == sorted(map(tuple, expected.collect()))


def test_load_runs_before_any_was_stored(spark, tmp_path):
    with pytest.warns(UserWarning, match="e1"):
        assert stores.load_runs(spark, f"{tmp_path}/none", {"e1": "One"}).count() == 0


def test_only_complete_versions_are_read(spark, tmp_path):
    base = f"{tmp_path}/t"
    assert published.latest(spark, base) is None and published.all_versions(spark, base) is None
    df = spark.range(5)
    assert published.publish(df, base) == 1
    df.write.parquet(f"{base}/data/00000002-unfinished")  # a writer died before its manifest row
    assert published.latest(spark, base).count() == 5
    assert published.publish(spark.range(7), base) == 2
    assert published.publish(spark.range(7), base, version=2) == 2  # a batch that is repeated
    assert published.latest(spark, base).count() == 7
    assert published.all_versions(spark, base).count() == 12
    assert published.publish(spark.range(0), base) == 3
    assert published.latest(spark, base).count() == 0
    assert {r["n_rows"] for r in published.manifest(spark, base).collect()} == {5, 7, 0}


def test_half_written_features_are_computed_again(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    compute = lambda d: surface_features(d).drop("text")
    path = f"{tmp_path}/t/v{stores.FEATURE_VERSION}/{stores.fingerprint(df, ['doc_id', 'text'])}"
    compute(df).limit(1).write.parquet(f"{path}/data/00000001-half")
    assert stores.feature_store(df, str(tmp_path), "t", compute, SURFACE_FEATURES).count() == 2
    with pytest.raises(ValueError):
        stores.feature_store(df, str(tmp_path), "u", lambda d: d.select("doc_id"), SURFACE_FEATURES)


def test_explained_stream_equals_the_batch_and_repeats_nothing(spark, tmp_path):
    rng = random.Random(2)
    words = "the house and a green tree is seen by people, walking quickly home. running dogs were found there".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(20 + i)) + ".", "en", i % 2) for i in range(24)]
    rows += [(100, "", "en", 0), (101, None, "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, y int")
    spec = replace(models.DETECTORS["core"], overrides={"trees": 5, "depth": 4})
    models.fit_detector(df, spec).save(f"{tmp_path}/model")
    folder = f"{tmp_path}/in"
    df.where("doc_id < 10").coalesce(1).write.parquet(folder)
    out, resume = f"{tmp_path}/out", f"{tmp_path}/resume"

    def drain():
        stream = jobs.read_stream(spark, folder, df.schema, 1)
        jobs.explain_arriving(stream, f"{tmp_path}/model", out, resume).awaitTermination()
        return published.all_versions(spark, out)

    def plain(found):
        return sorted((tuple(sorted(x.items()) if isinstance(x, dict) else x for x in r) for r in found.collect()), key=repr)

    detector = models.load_detector(spark, f"{tmp_path}/model")
    assert plain(drain()) == plain(jobs.explained(df.where("doc_id < 10"), detector))
    assert drain().count() == 10  # a restart finds nothing new
    # The last batch was published, but its stream died before noting it: it is run again under its number.
    published.publish(jobs.explained(df.where("doc_id < 10"), detector), out, version=0)
    assert published.all_versions(spark, out).count() == 10
    df.where("doc_id >= 10").coalesce(1).write.mode("append").parquet(folder)
    assert plain(drain()) == plain(jobs.explained(df, detector))
    assert drain().where("size(reasons) > 0 and verdict is not null").count() == len(rows)


def test_files_of_a_stream_grow_in_number_with_the_input(spark):
    from stylotrace.plans.queries import stream_files

    assert stream_files(spark.range(10).repartition(2)) == 4
    assert stream_files(spark.range(1000).repartition(50)) == 50
