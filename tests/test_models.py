import numpy as np
import pytest
from pyspark.sql import functions as F

from stylotrace.fixed_values import EXPLANATION_RULES, SURFACE_FEATURES, SYNTACTIC_FEATURES
from stylotrace.operators import explain, models, sampling
from stylotrace.operators.ordering import hash_rank
from stylotrace.plans import ablation, queries, robustness, validation
from stylotrace.plans.closed_form import fit_discriminant

FEATURES = SURFACE_FEATURES[:4]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(240):
        y = int(i % 3 == 0)
        x = rng.normal(size=len(SURFACE_FEATURES)) + y * np.linspace(1.2, 0, len(SURFACE_FEATURES))
        words = rng.choice(["alpha", "beta", "gamma", "delta", "omega"], 12, p=[0.4, 0.3, 0.1, 0.1, 0.1] if y else [0.1, 0.1, 0.1, 0.3, 0.4])
        rows.append((i, y, " ".join(words), *map(float, x)))
    schema = "doc_id long, y int, text string, " + ", ".join(f"{f} double" for f in SURFACE_FEATURES)
    return spark.createDataFrame(rows, schema).cache()


def small(name, **overrides):
    spec = models.DETECTORS[name]
    return models.DetectorSpec(spec.name, spec.features, spec.classifier, spec.preset, spec.tfidf, spec.standardise, overrides)


def test_class_weights(data):
    got = {r["y"]: r["weight"] for r in sampling.class_weights(data, "y").collect()}
    assert got == {0: pytest.approx(240 / 320), 1: pytest.approx(240 / 160)}


def test_standardiser_keeps_constants(data):
    rows = data.withColumn("k", F.lit(3.0))
    scaler = models.fit_standardiser(rows, [*FEATURES, "k"])
    out = scaler.transform(rows).agg(*[a for f in FEATURES for a in (F.avg(f), F.stddev_pop(f))], F.max("k")).first()
    assert list(out) == pytest.approx([0, 1] * len(FEATURES) + [0], abs=1e-9)


def test_logistic_gradient_vanishes(data):
    fitted = models.fit_detector(data, models.DETECTORS["stylo_logreg"])
    pdf = models.numeric_features(data, "surface").toPandas()
    x = pdf[SURFACE_FEATURES].to_numpy()
    x = (x - x.mean(0)) / x.std(0)
    y = pdf.y.to_numpy()
    w = np.where(y == 1, 240 / 160, 240 / 320)
    beta, bias = fitted.classifier.coefficients.toArray(), fitted.classifier.intercept
    p = 1 / (1 + np.exp(-(x @ beta + bias)))
    assert np.abs(x.T @ (w * (p - y)) + beta).max() < 1e-2
    assert abs((w * (p - y)).sum()) < 1e-2
    got = fitted.predict(data).toPandas().sort_values("doc_id")
    order = pdf.doc_id.argsort()
    assert got.p.to_numpy() == pytest.approx(p[order])


@pytest.mark.parametrize("name", ["stylo_rf", "tfidf_logreg", "stylo_logreg"])
def test_detectors_learn_and_survive_storage(spark, data, tmp_path, name):
    spec = small(name, trees=8, depth=5) if name.endswith("rf") else models.DETECTORS[name]
    train, test = data.where("doc_id % 4 != 0"), data.where("doc_id % 4 = 0")
    fitted = models.fit_detector(train, spec)
    assert fitted.metrics(test).first()["auc_roc"] > 0.75
    fitted.save(str(tmp_path / name))
    again = models.load_detector(spark, str(tmp_path / name))
    a = {r["doc_id"]: r["p"] for r in fitted.predict(test).collect()}
    b = {r["doc_id"]: r["p"] for r in again.predict(test).collect()}
    assert a == pytest.approx(b)
    weights = {r["name"]: r["weight"] for r in fitted.weights(spark).collect()}
    if name == "tfidf_logreg":
        top = explain.top_terms(fitted.weights(spark), 3, both_ends=True).collect()
        assert len(top) == 6 and weights["alpha"] > weights["omega"]
    if name == "stylo_rf":
        assert sum(weights.values()) == pytest.approx(1)


def test_load_refuses_other_things(spark, tmp_path):
    spark.createDataFrame([('{"kind": "cat"}',)], "meta string").write.parquet(str(tmp_path / "m" / "meta"))
    with pytest.raises(TypeError):
        models.load_detector(spark, str(tmp_path / "m"))


def test_unlimited_depth_is_the_deepest_possible():
    assert models.random_forest({"trees": 1, "depth": None, "leaf": 1, "balanced": False}).getMaxDepth() == 30


def test_confidence_and_verdict(spark):
    rows = spark.createDataFrame([(p,) for p in (0.86, 0.85, 0.70, 0.30, 0.15, 0.14, 0.5)], "p double")
    got = rows.select(explain.confidence(F.col("p")).alias("c"), explain.verdict(F.col("p")).alias("v")).collect()
    assert [r["c"] for r in got] == ["High", "Medium", "Low", "Low", "Medium", "High", "Low"]
    assert got[-1]["v"] == "AI-Generated"


def test_rules_are_strict_and_explained(spark):
    at = {f: t for _, f, _, t, _ in EXPLANATION_RULES} | {f: 1.0 for f in SYNTACTIC_FEATURES if f not in {r[1] for r in EXPLANATION_RULES}}
    fired = dict(at, ttr=0.5, nv_ratio=9.0)
    schema = "doc_id int, p double, " + ", ".join(f"{f} double" for f in SYNTACTIC_FEATURES)
    df = spark.createDataFrame([(1, 0.9, *[at[f] for f in SYNTACTIC_FEATURES]), (2, 0.1, *[fired[f] for f in SYNTACTIC_FEATURES])], schema)
    rows = {r["doc_id"]: r for r in explain.predict_with_explanation(df, SYNTACTIC_FEATURES).collect()}
    assert rows[1]["n_triggered_signals"] == 0 and rows[1]["reasons"] == [explain.NO_REASON]
    assert [s["rule"] for s in rows[2]["signals"]] == ["ttr_low", "nv_ratio_high"]
    assert rows[2]["reasons"][0].startswith("[H3]") and "0.500 < 0.55" in rows[2]["reasons"][0]
    counts = {(r["doc_id"], r["hypothesis"]): r["n_signals"] for r in explain.hypothesis_counts(df).collect()}
    assert counts[2, "H3"] == 1 and counts[2, "H4"] == 1 and counts[2, "H1"] == 0 and len(counts) == 8


def test_linear_attribution_adds_up(data):
    model = fit_discriminant(data, FEATURES)
    scored = {r["doc_id"]: r["score"] for r in model.transform(data).collect()}
    mean = sum(scored.values()) / len(scored)
    total = explain.linear_attribution(data, model).groupBy("doc_id").agg(F.sum("contribution").alias("s")).collect()
    assert all(r["s"] == pytest.approx(scored[r["doc_id"]] - mean, abs=1e-6) for r in total)


def test_permutation_attribution_adds_up(data):
    fitted = models.fit_detector(data, small("stylo_rf", trees=6, depth=4))
    sample = data.where("doc_id < 20")
    got = explain.permutation_attribution(sample, data, fitted.classifier, SURFACE_FEATURES, permutations=4)
    sums = {r["doc_id"]: r["s"] for r in got.groupBy("doc_id").agg(F.sum("contribution").alias("s")).collect()}
    p = {r["doc_id"]: r["p"] for r in fitted.predict(data).collect()}
    background = [r["doc_id"] for r in hash_rank(data, "doc_id", [], limit=F.lit(4)).collect()]
    base = sum(p[d] for d in background) / 4
    assert len(sums) == 20 and all(s == pytest.approx(p[d] - base) for d, s in sums.items())


def test_extremes_and_borderline(spark):
    df = spark.createDataFrame([(3, 0, 0.2, "c"), (1, 0, 0.2, "a"), (2, 1, 0.9, "b"), (4, 1, 0.9, "d"), (5, 0, 0.45, "e")], "doc_id long, y int, p double, text string")
    assert {(r["kind"], r["doc_id"]) for r in explain.extreme_examples(df).collect()} == {("most human", 1), ("most ai", 2)}
    assert {r["y"]: r["n_borderline"] for r in explain.borderline(df).collect()} == {0: 1, 1: 0}


def test_cross_validation_covers_every_row_once(data):
    folded = sampling.stratified_kfold(data, "doc_id", "y")
    rows = validation.fold_predictions(folded, validation.closed_form(FEATURES))
    assert rows.count() == 240
    got = {r["metric"]: r for r in validation.cross_validate(data, validation.closed_form(FEATURES)).collect()}
    assert set(got) == set(validation.CV_METRICS) and got["auc_roc"]["mean"] > 0.7 and got["f1"]["std"] > 0


def test_ablation_studies(data):
    train, test = data.where("doc_id % 2 = 0"), data.where("doc_id % 2 = 1")
    closed = ablation.ClosedFormEstimator(train, FEATURES)
    model, pdf = closed.model, test.toPandas()

    def f1(features):
        score = sum((pdf[f] - model.params[f][0]) * model.params[f][1] for f in features)
        hit = score >= 0
        tp = (hit & (pdf.y == 1)).sum()
        return 2 * tp / (hit.sum() + (pdf.y == 1).sum())

    loo = {r["subset"]: r for r in ablation.leave_one_out(closed, test, FEATURES).collect()}
    for f in FEATURES:
        assert loo[f]["delta_f1"] == pytest.approx(f1([g for g in FEATURES if g != f]) - f1(FEATURES))
    chosen = []
    for _ in FEATURES:
        chosen.append(max([f for f in FEATURES if f not in chosen], key=lambda f: f1([*chosen, f])))
    greedy = ablation.greedy_forward(closed, test, FEATURES)
    rows = greedy.orderBy("n_features").collect()
    assert [r["added"] for r in rows] == chosen and rows[-1]["percent_of_full"] == pytest.approx(100)
    smallest = ablation.min_subset(greedy, len(FEATURES)).first()["min_for_f1"]
    assert smallest == next(n for n in range(1, 5) if f1(chosen[:n]) >= 0.95 * f1(FEATURES))
    groups = ablation.leave_group_out(closed, test, FEATURES, {"g": FEATURES[:1], "h": FEATURES[1:]})
    assert {r["subset"]: (r["n_removed"], r["n_left"]) for r in groups.collect()} == {"g": (1, 3), "h": (3, 1)}
    with pytest.raises(ValueError):
        ablation.leave_group_out(closed, test, FEATURES, {"g": ["nope"]})


def test_forest_ablation(data):
    estimator = ablation.ForestEstimator(data.where("doc_id % 2 = 0"), FEATURES, {"trees": 5, "depth": 4, "leaf": 1, "balanced": True})
    rows = ablation.control_check(estimator, data.where("doc_id % 2 = 1"), FEATURES, control=FEATURES[0]).collect()
    assert {r["subset"] for r in rows} == {"full", "without", "only"}
    assert sum(v for _, v in estimator.importance()) == pytest.approx(1)


PUBLISHED = [
    ("in", "core", 0.88944, 0.88435, 0.95705), ("in", "tfidf_lr", 0.97699, 0.97679, 0.99787),
    ("domain", "core", 0.987, 0.98712, 0.99952), ("domain", "tfidf_lr", 0.6455, 0.73134, 0.83712),
    ("language", "core", 0.76278, 0.77796, 0.85361), ("language", "tfidf_lr", 0.5, 0.66667, 0.65778),
]


def test_robustness_tables(spark):
    rows = spark.createDataFrame(PUBLISHED, "scenario string, method string, accuracy double, f1 double, auc_roc double")
    drops = {(r["scenario"], r["method"]): r["delta_f1"] for r in robustness.degradation(rows, "in").collect()}
    assert drops["domain", "tfidf_lr"] == pytest.approx(-0.24545) and drops["in", "core"] == 0
    ranks = {(r["scenario"], r["place"]): r["method"] for r in robustness.rank_methods(rows).collect()}
    assert ranks["in", 1] == "tfidf_lr" and ranks["domain", 1] == "core"
    wide = {r["method"]: r for r in robustness.pivot_metrics(rows, ["in", "domain", "language"]).collect()}
    assert wide["core"]["domain_f1"] == 0.9871 and wide["tfidf_lr"]["language_auc_roc"] == 0.6578
    profile = {r["method"]: r for r in robustness.auc_profile(rows, ["in", "domain", "language"]).collect()}
    assert profile["core"]["language"] == 0.85361


def test_feature_families_do_not_mix(spark, data):
    """Whatever other families a frame holds, a detector gets the features it was fitted on."""
    texts = data.select("doc_id", "y", F.concat("text", F.lit(". Well, "), "text", F.lit("!")).alias("text"))
    wide = texts
    for kind in ("syntactic", "surface_v1", "surface"):
        wide = models.numeric_features(wide, kind)
    bare = models.numeric_features(texts, "surface")
    for kind in ("syntactic", "surface", "surface_v1"):
        columns = models.family_columns(kind)
        want = models.family_features(texts, kind).select("doc_id", *columns)
        for frame in (wide, bare):
            got = models.family_features(frame, kind).select("doc_id", *columns)
            assert got.exceptAll(want).count() == 0
    first = {r["doc_id"]: r["avg_sent_len"] for r in models.numeric_features(texts, "syntactic").collect()}
    assert {r["doc_id"]: r["avg_sent_len"] for r in wide.collect()} == first
    for spec in (small("stylo_rf", trees=4, depth=4), models.NOTEBOOK_DETECTORS["stylo_logreg"]):
        fitted = models.fit_detector(texts, spec)
        alone = {r["doc_id"]: r["p"] for r in fitted.predict(texts).collect()}
        assert {r["doc_id"]: r["p"] for r in fitted.predict(wide).collect()} == pytest.approx(alone)


def test_baselines_of_one_vocabulary_fit_it_once(spark, monkeypatch, tmp_path):
    words = ["red", "green", "blue", "stone", "river", "cloud", "paper", "light"]
    rows = []
    for conv in range(40):
        for turn, role in enumerate(("user", "assistant")):
            picked = [words[(conv * (3 + turn) + k * (turn + 1)) % (5 + 3 * turn)] for k in range(24)]
            rows.append((conv, turn, role, (", " if turn else " ").join(picked) + "."))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    fits = []
    whole = models.fit_tfidf
    monkeypatch.setattr(models, "fit_tfidf", lambda *a, **b: fits.append(1) or whole(*a, **b))
    found = {r["method"]: r["n_rows"] for r in queries.detectors_metrics(spark, str(tmp_path)).collect()}
    assert len(found) == 4 and len(set(found.values())) == 1 and min(found.values()) > 0
    assert len(fits) == 1
