"""The registered queries: every operator over the whole of the given tables."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stylotrace.fixed_values import (
    ABLATION_GROUPS,
    BASELINE_EXPERIMENTS,
    EXPLANATION_RULES,
    STABILITY_FEATURES,
    SURFACE_FEATURES,
    SURFACE_FEATURES_V1,
    SYNTACTIC_FEATURES,
)
from stylotrace.functions.numbers import sanitise
from stylotrace.operators import evaluate, explain, lexical, models, prep, sampling, stats, syntax, tokens
from stylotrace.operators.attribution import tree_attribution
from stylotrace.operators.ordering import prefix_sum
from stylotrace.operators.surface import surface_features, surface_features_v1
from stylotrace.plans import ablation, robustness, validation
from stylotrace.plans.closed_form import fit_discriminant
from stylotrace.session import materialise, shared_dir, spread
from stylotrace.sources import corpora, published, stores
from stylotrace.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The compression feature has no SQL counterpart; queries that plain SQL repeats leave it out.
SQL_SYNTACTIC = [f for f in SYNTACTIC_FEATURES if f != "cr_pos"]
SQL_RULES = [r for r in EXPLANATION_RULES if r[1] != "cr_pos"]
SQL_GROUPS = {g: [f for f in fs if f != "cr_pos"] for g, fs in ABLATION_GROUPS.items()}
SQL_STABILITY = [f for f in STABILITY_FEATURES if f != "cr_pos"]
LATIN_LETTER = "[A-Za-z]"
SCENARIOS = ["in_domain", "domain_shift", "language_shift"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# Tables in their roles -------------------------------------------------------------------------


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"), "doc_id")


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled corpus: user turns are human (0), assistant turns machine (1), 100 characters or more."""
    turns = table(spark, sf, "conversations").where(F.col("role").isin("user", "assistant"))
    rows = turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"),
        prep.binarise_label(F.col("role"), human="user").alias("y"),
        "text",
    )
    return spread(prep.min_length(prep.drop_null(rows, ["text"])), "doc_id")


def shift_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with their scenario: home sources, other sources, other languages."""
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    scenario = (
        F.when(F.col("lang") != "en", "language_shift").when(number >= 10, "domain_shift").otherwise("in_domain")
    )
    labels = table(spark, sf, "labels").select("doc_id", (1 - F.col("quality")).cast("int").alias("y"))
    return documents(spark, sf).join(labels, "doc_id").withColumn("scenario", scenario)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def conversation_features(spark: SparkSession, sf: str, with_compression: bool = False) -> DataFrame:
    return syntax.syntactic_features(conversations(spark, sf), lang=None, with_compression=with_compression, keep=("y",))


def split_features(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Train and test part of the conversation features, written once."""
    split = materialise(sampling.stratified_split(conversation_features(spark, sf), "doc_id", "y"))
    return split.where("split = 'train'"), split.where("split = 'test'")


def scored_surface(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out conversations with the closed-form score over surface features."""
    rows = surface_features(sampling.stratified_split(conversations(spark, sf), "doc_id", "y"))
    rows = materialise(rows)
    model = fit_discriminant(rows.where("split = 'train'"), SURFACE_FEATURES)
    return model.transform(rows.where("split = 'test'"))


def split_conversations(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    split = materialise(sampling.stratified_split(conversations(spark, sf), "doc_id", "y"))
    return split.where("split = 'train'"), split.where("split = 'test'")


# Corpus preparation ----------------------------------------------------------------------------


@query
def corpus_contract(spark, sf):
    joined = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    return prep.contract_report(joined, ["doc_id", "text", "lang", "quality"], {"lang": ["en", "de", "fr"], "quality": [0, 1]})


@query
def corpus_profile(spark, sf):
    rows = table(spark, sf, "conversations").where("role != 'system'")
    named = rows.select(
        (F.col("role") == "assistant").alias("is_ai"),
        (F.col("turn") % 2 == 1).alias("is_redacted"),
        F.concat(F.lit("turn"), F.col("turn")).alias("source"),
        "text",
    )
    return prep.corpus_profile(prep.length_columns(named))


@query
def corpus_totals(spark, sf):
    rows = table(spark, sf, "conversations").where("role != 'system'")
    named = rows.select((F.col("role") == "assistant").alias("is_ai"), (F.col("turn") % 2 == 1).alias("is_redacted"), "text")
    return prep.corpus_totals(prep.length_columns(named))


@query
def corpus_clean(spark, sf):
    return prep.with_clean_text(documents(spark, sf)).select("doc_id", "text")


@query
def corpus_dedupe(spark, sf):
    kept = prep.dedupe_exact(prep.drop_null(table(spark, sf, "documents"), ["text"]), "doc_id")
    return kept.select("doc_id", "lang", "source", "n_chars")


@query
def corpus_lengths(spark, sf):
    cleaned = prep.with_clean_text(documents(spark, sf))
    return prep.length_columns(prep.min_length(cleaned)).select(
        "doc_id", F.col("length_words").cast("bigint").alias("length_words"), F.col("length_chars").cast("bigint").alias("length_chars")
    )


@query
def corpus_defaults(spark, sf):
    rows = table(spark, sf, "documents").select(
        "doc_id",
        F.when(F.col("source") == "src3", "nan").when(F.col("source") == "src4", "  ").when(F.col("source") == "src5", None)
        .otherwise(F.col("source")).alias("topic"),
        F.lit(0.5).alias("temperature"),
    )
    return prep.fill_defaults(rows)


@query
def corpus_union(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("doc_id", F.col("conv_id") * 1000 + F.col("turn"))
    human = rows.where("role = 'user'").select("doc_id", "text", F.when(F.col("turn") > 1, F.lit("chat")).alias("rubric"))
    generated = rows.where("role = 'assistant'").select(
        "doc_id", "text", F.lit("assistant").alias("source"), F.lit(None).cast("string").alias("topic"),
        (F.col("turn") > 1).alias("redacted"),
    )
    return prep.harmonise_and_union(human, generated)


def _built(spark, sf, per_class: int) -> DataFrame:
    rows = table(spark, sf, "conversations").withColumn("doc_id", F.col("conv_id") * 1000 + F.col("turn"))
    human = rows.where("role = 'user'").select("doc_id", "text", F.lit(None).cast("string").alias("rubric"))
    generated = rows.where("role = 'assistant'").select(
        "doc_id", "text", F.lit("assistant").alias("source"), F.lit("chat").alias("topic"), F.lit(False).alias("redacted")
    )
    return prep.build_corpus(human, generated, per_class=per_class).select(
        "id", "text", "is_ai", "source", "topic", "temperature", "top_p",
        F.col("length_words").cast("bigint").alias("length_words"),
        F.col("length_chars").cast("bigint").alias("length_chars"),
    )


@query
def corpus_build(spark, sf):
    """The whole corpus job: dedupe and clean, harmonise, stack, sample, number, measure."""
    return _built(spark, sf, 5000)


@query
def corpus_build_capped(spark, sf):
    """The same with fewer rows per class than there are."""
    return _built(spark, sf, 20)


@query
def script_share(spark, sf):
    return documents(spark, sf).select(
        "doc_id",
        F.round(prep.script_share(F.col("text"), LATIN_LETTER), 6).alias("latin_pct"),
        F.round(prep.script_share(F.col("text")), 6).alias("cyrillic_pct"),
    )


@query
def quality_gate(spark, sf):
    gated = prep.quality_gate(documents(spark, sf), letter=LATIN_LETTER)
    return gated.groupBy("lang", "reason", "accepted").agg(F.count(F.lit(1)).alias("n_texts"))


@query
def title_strip(spark, sf):
    title = F.substring_index("text", "\n", 1)
    return documents(spark, sf).select("doc_id", prep.strip_echoed_title(F.col("text"), title).alias("text"))


@query
def generation_plan(spark, sf):
    titles = table(spark, sf, "documents").select(
        "doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("source").alias("topic")
    )
    return prep.generation_plan(titles)


@query
def resume_new_rows(spark, sf):
    existing = table(spark, sf, "labels").select("doc_id")
    incoming = table(spark, sf, "documents").select("doc_id", "lang")
    return prep.resume_new_rows(existing, incoming, "doc_id")


# Samples and splits ----------------------------------------------------------------------------


@query
def sample_per_class(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang")
    return sampling.sample_per_class(rows, "doc_id", "lang", 150)


@query
def sample_balanced(spark, sf):
    return sampling.balanced_sample(conversations(spark, sf), "doc_id", "y", 1000).select("doc_id", "y")


@query
def sample_capped(spark, sf):
    """A cap below the size of every class."""
    return sampling.balanced_sample(conversations(spark, sf), "doc_id", "y", 10).select("doc_id", "y")


@query
def corpus_shuffle(spark, sf):
    return sampling.shuffle_with_ids(conversations(spark, sf), "doc_id").select("id", "doc_id", "y")


@query
def split_stratified(spark, sf):
    return sampling.stratified_split(conversations(spark, sf), "doc_id", "y").select("doc_id", "y", "split")


@query
def kfold_stratified(spark, sf):
    rows = sampling.stratified_kfold(conversations(spark, sf), "doc_id", "y")
    return rows.select("doc_id", "y", F.col("fold").cast("bigint").alias("fold"))


@query
def split_disjoint(spark, sf):
    rows = sampling.stratified_split(table(spark, sf, "documents"), "doc_id", "lang")
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    return prep.split_disjoint(train, test).select("doc_id", "lang")


@query
def class_weights(spark, sf):
    return rounded(sampling.class_weights(conversations(spark, sf), "y"), "weight")


# Sources and sinks -----------------------------------------------------------------------------


@query
def qa_long(spark, sf):
    rows = table(spark, sf, "conversations")
    nested = rows.select(
        F.concat_ws("/", "conv_id", "turn").alias("question"),
        F.when(F.col("role") == "user", F.array("text")).otherwise(F.array()).alias("human_answers"),
        F.when(F.col("role") == "assistant", F.array("text")).otherwise(F.array()).alias("chatgpt_answers"),
    )
    path = shared_dir(spark, "qa")
    nested.write.mode("overwrite").json(path)
    return corpora.qa_to_rows(corpora.read_qa_jsonl(spark, path), keep=("question",))


@query
def roundtrip_csv(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), "text", (F.col("lang") == "en").alias("is_ai"), F.lit(False).alias("is_redacted"),
        "source", F.col("lang").alias("topic"), F.lit(0.7).alias("temperature"), F.lit(0.9).alias("top_p"),
        F.lit(0).alias("length_words"), F.col("n_chars").cast("int").alias("length_chars"),
    )
    path = shared_dir(spark, "csv")
    corpora.write_corpus(rows, path, bom=True, mode="overwrite")
    back = corpora.read_corpus(spark, path, corpora.MAIN_CORPUS)
    return back.withColumns({c: F.col(c).cast("bigint") for c in ("length_words", "length_chars")})


@query
def feature_store(spark, sf):
    rows, base = conversations(spark, sf), shared_dir(spark, "features")
    for _ in range(2):  # the second call reads what the first one stored
        stored = stores.feature_store(rows, base, "conversations", lambda d: surface_features(d).drop("text"), SURFACE_FEATURES)
    return rounded(stored.select("doc_id", *SURFACE_FEATURES), *SURFACE_FEATURES)


CLOSED_FORM_RUNS = {
    "discriminant": ("Surface features + diagonal discriminant", SURFACE_FEATURES),
    "discriminant_5": ("Five surface features + diagonal discriminant", SURFACE_FEATURES[:5]),
}
RUN_NAMES = {run: name for run, (name, _) in CLOSED_FORM_RUNS.items()}


@query
def run_store(spark, sf):
    """Two runs of the closed-form scorer, stored under their own names and read back."""
    rows = surface_features(sampling.stratified_split(conversations(spark, sf), "doc_id", "y")).drop("text")
    rows = materialise(rows)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    base = shared_dir(spark, "runs")
    for run, (_, features) in CLOSED_FORM_RUNS.items():
        scored = fit_discriminant(train, features).transform(test)
        stores.save_run(base, run, evaluate.metric_rows(scored), scored.select("doc_id", "y", "p"))
    return stores.load_runs(spark, base, RUN_NAMES)


@query
def final_report(spark, sf):
    return robustness.final_report(run_store(spark, sf)).select("experiment", "name", "accuracy", "auc_roc")


@query
def baseline_runs(spark, sf):
    """The single experiments with their own presets, each fitted, stored under its name and reported."""
    split = materialise(models.with_families(
        sampling.stratified_split(conversations(spark, sf), "doc_id", "y"), models.NOTEBOOK_DETECTORS.values()
    ))
    fitted = models.fit_detectors(split.where("split = 'train'"), models.NOTEBOOK_DETECTORS)
    base = shared_dir(spark, "runs")
    scored = materialise(models.score_together(split.where("split = 'test'"), fitted, ["doc_id", "y"]))
    for run in fitted:
        mine = scored.where(F.col("method") == run)
        stores.save_run(base, run, evaluate.metric_rows(mine), mine.select("doc_id", "y", "p"))
    report = robustness.final_report(stores.load_runs(spark, base, BASELINE_EXPERIMENTS))
    better = (F.col("accuracy") > 0.5) & (F.col("auc_roc") > 0.5) & (F.col("auc_roc") <= 1)
    return report.select("experiment", "name", "n_rows", better.alias("better_than_chance"))


# Tokens and features ---------------------------------------------------------------------------


@query
def words(spark, sf):
    found = tokens.whitespace_words(documents(spark, sf))
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("pos").cast("bigint")).alias("pos_sum"))


@query
def lexical_tokens(spark, sf):
    found = tokens.lexical_tokens(documents(spark, sf))
    return found.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("pos").cast("bigint")).alias("pos_sum"))


@query
def token_relation(spark, sf):
    """Digest of the relation per document, tag and form; every token counts."""
    found = tokens.token_relation(table(spark, sf, "documents"))
    return found.groupBy("doc_id", "upos", "is_punct", F.coalesce("verb_form", F.lit("-")).alias("verb_form")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("voice") == "Pass").alias("n_passive"),
        F.sum(F.col("pos").cast("bigint")).alias("pos_sum"),
        F.sum(F.col("head").cast("bigint")).alias("head_sum"),
        F.sum(F.col("depth").cast("bigint")).alias("depth_sum"),
        F.sum(F.col("sent_id").cast("bigint")).alias("sent_sum"),
        F.count_if(F.col("dep") == "root").alias("n_roots"),
        F.sum(F.char_length("text").cast("bigint")).alias("text_chars"),
        F.sum(F.char_length("lemma").cast("bigint")).alias("lemma_chars"),
    )


@query
def sentences(spark, sf):
    found = tokens.sentence_ids(tokens.raw_tokens(table(spark, sf, "documents")))
    return found.groupBy("doc_id", "sent_id").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.min("pos").cast("bigint").alias("first_pos")
    )


@query
def dependency_depth(spark, sf):
    found = tokens.dependency_depth(tokens.token_relation(table(spark, sf, "documents")))
    return found.groupBy("doc_id", "sent_id").agg(
        F.max("depth").cast("bigint").alias("max_depth"), F.sum(F.col("depth").cast("bigint")).alias("depth_sum")
    )


@query
def syntactic_features(spark, sf):
    return syntax.syntactic_features(table(spark, sf, "documents"), with_compression=False)


@query
def syntactic_features_all(spark, sf):
    return rounded(syntax.syntactic_features(table(spark, sf, "documents")), *SYNTACTIC_FEATURES)


@query
def cr_pos(spark, sf):
    return rounded(syntax.pos_compression(tokens.token_relation(table(spark, sf, "documents"))), "cr_pos")


@query
def surface_features_docs(spark, sf):
    found = surface_features(documents(spark, sf)).select("doc_id", *SURFACE_FEATURES)
    return rounded(found, *SURFACE_FEATURES)


QUERIES["surface_features"] = QUERIES.pop("surface_features_docs")


@query
def surface_features_first(spark, sf):
    found = surface_features_v1(documents(spark, sf)).select("doc_id", *SURFACE_FEATURES_V1)
    return rounded(found, *SURFACE_FEATURES_V1)


QUERIES["surface_features_v1"] = QUERIES.pop("surface_features_first")


@query
def features_sanitised(spark, sf):
    raw = documents(spark, sf).select(
        "doc_id",
        (F.col("n_chars") / F.nullif(F.char_length(F.regexp_replace("text", "[^0-9]", "")), F.lit(0))).alias("chars_per_digit"),
        F.when(F.col("lang") == "de", F.lit(float("nan"))).when(F.col("lang") == "fr", F.lit(float("inf")))
        .otherwise(F.col("n_chars").cast("double")).alias("size"),
    )
    return raw.select("doc_id", *[F.round(sanitise(F.col(c)), 6).alias(c) for c in ("chars_per_digit", "size")])


# TF-IDF ----------------------------------------------------------------------------------------

STOP_WORDS = ["the", "and", "of"]


@query
def ngrams(spark, sf):
    found = lexical.ngrams(conversations(spark, sf), stop_words=STOP_WORDS)
    return found.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("pos").cast("bigint")).alias("pos_sum"))


@query
def vocabulary(spark, sf):
    return lexical.vocabulary(conversations(spark, sf), stop_words=STOP_WORDS)


@query
def vocabulary_notebook(spark, sf):
    return lexical.vocabulary(conversations(spark, sf), min_df=5, max_features=2000)


@query
def tfidf(spark, sf):
    train, _ = split_conversations(spark, sf)
    weights = lexical.fit_preset(train, "library").transform(train)
    return rounded(weights.select("doc_id", "term", "tf", "weight"), "weight")


@query
def tfidf_transform(spark, sf):
    train, test = split_conversations(spark, sf)
    weights = lexical.fit_preset(train, "library").transform(test)
    return rounded(weights.select("doc_id", "term", "tf", "weight"), "weight")


@query
def tfidf_notebook(spark, sf):
    train, test = split_conversations(spark, sf)
    weights = lexical.fit_preset(train, "notebook").transform(test)
    return rounded(weights.select("doc_id", "term", "tf", "weight"), "weight")


# Statistics ------------------------------------------------------------------------------------


@query
def feature_describe(spark, sf):
    return stats.describe(materialise(conversation_features(spark, sf)), SQL_SYNTACTIC)


@query
def running_counts(spark, sf):
    """Documents up to each length by language, Spanish ones as the null group, over many ranges."""
    rows = table(spark, sf, "documents").select(F.when(F.col("lang") != "es", F.col("lang")).alias("lang"), "n_chars")
    counts = stats.value_counts(rows, ["lang"], "n_chars")
    return prefix_sum(counts, ["lang"], "n_chars", ["n"], following=["n"], rows_per_bucket=100)


@query
def class_means(spark, sf):
    return stats.class_means(conversation_features(spark, sf), "y", SQL_SYNTACTIC)


@query
def mann_whitney(spark, sf):
    tested = stats.mann_whitney(conversation_features(spark, sf), "y", SQL_SYNTACTIC, n_tests=len(SYNTACTIC_FEATURES))
    return rounded(tested, "p_value")


@query
def feature_ranking(spark, sf):
    return rounded(stats.feature_ranking(stats.mann_whitney(conversation_features(spark, sf), "y", SQL_SYNTACTIC, n_tests=len(SYNTACTIC_FEATURES))), "p_value")


@query
def surface_ranking(spark, sf):
    """Which surface features separate the classes?"""
    rows = surface_features(conversations(spark, sf))
    return rounded(stats.feature_ranking(stats.mann_whitney(rows, "y", SURFACE_FEATURES), len(SURFACE_FEATURES)), "p_value")


@query
def significant_features(spark, sf):
    return stats.significant_count(stats.mann_whitney(conversation_features(spark, sf), "y", SQL_SYNTACTIC, n_tests=len(SYNTACTIC_FEATURES)))


@query
def spearman(spark, sf):
    return rounded(stats.spearman_matrix(materialise(conversation_features(spark, sf)), "doc_id", SQL_SYNTACTIC), "rho")


@query
def box_summary(spark, sf):
    found = stats.box_summary(conversation_features(spark, sf), ["y"], SQL_SYNTACTIC)
    return rounded(found, "min", "q25", "q50", "q75", "max")


@query
def score_histogram(spark, sf):
    found = stats.probability_histogram(scored_surface(spark, sf), "y", "p")
    return rounded(found, "lower", "upper", "density").withColumn("bin", F.col("bin").cast("bigint"))


@query
def score_kde(spark, sf):
    found = stats.kde_curve(scored_surface(spark, sf), "y", "p")
    return rounded(found, "x", "density").withColumn("point", F.col("point").cast("bigint"))


@query
def feature_stability(spark, sf):
    rows = shift_corpus(spark, sf)
    joined = materialise(syntax.syntactic_features(rows, with_compression=False, keep=("y", "scenario")))
    found = robustness.feature_stability(
        joined.where("scenario = 'in_domain'"), joined.where("scenario = 'domain_shift'"), SQL_STABILITY
    )
    return rounded(found, "min", "q25", "q50", "q75", "max")


# Evaluation ------------------------------------------------------------------------------------


@query
def standardise(spark, sf):
    train, test = split_features(spark, sf)
    scaled = models.fit_standardiser(train, SQL_SYNTACTIC).transform(test)
    return rounded(scaled.select("doc_id", *SQL_SYNTACTIC), *SQL_SYNTACTIC)


@query
def confusion(spark, sf):
    found = evaluate.confusion_matrix(scored_surface(spark, sf))
    return rounded(found, "share").withColumns({c: F.col(c).cast("bigint") for c in ("y", "y_pred")})


@query
def class_report(spark, sf):
    return rounded(evaluate.classification_report(scored_surface(spark, sf)), "precision", "recall", "f1")


@query
def roc_points(spark, sf):
    return rounded(evaluate.roc_curve(scored_surface(spark, sf)), "threshold", "fpr", "tpr")


@query
def pr_points(spark, sf):
    return rounded(evaluate.pr_curve(scored_surface(spark, sf)), "threshold", "precision", "recall")


@query
def metric_row(spark, sf):
    return evaluate.metric_rows(scored_surface(spark, sf))


@query
def threshold_metrics(spark, sf):
    found = evaluate.threshold_metrics(scored_surface(spark, sf), threshold=0.4)
    return rounded(found, "accuracy", "precision", "recall", "f1")


@query
def prevalence(spark, sf):
    return rounded(evaluate.prevalence(conversations(spark, sf)), "prevalence")


@query
def cross_validate(spark, sf):
    rows = surface_features(sampling.stratified_split(conversations(spark, sf), "doc_id", "y")).drop("text")
    train = materialise(rows.where("split = 'train'"))
    return rounded(validation.cross_validate(train, validation.closed_form(SURFACE_FEATURES)), "mean", "std")


# Detectors (Spark ML; no SQL counterpart) ------------------------------------------------------


@query
def rf_predict(spark, sf):
    """The core detector: all 15 features, 300 trees."""
    split = sampling.stratified_split(conversation_features(spark, sf, with_compression=True), "doc_id", "y")
    split = materialise(split)
    fitted = models.fit_detector(split.where("split = 'train'"), models.DETECTORS["core"])
    return rounded(fitted.predict(split.where("split = 'test'"), keep=["doc_id", "y"]), "p")


@query
def lr_predict(spark, sf):
    train, test = split_conversations(spark, sf)
    return rounded(models.fit_detector(train, models.DETECTORS["stylo_logreg"]).predict(test, keep=["doc_id", "y"]), "p")


@query
def tfidf_lr_predict(spark, sf):
    train, test = split_conversations(spark, sf)
    return rounded(models.fit_detector(train, models.DETECTORS["tfidf_logreg"]).predict(test, keep=["doc_id", "y"]), "p")


@query
def detectors_metrics(spark, sf):
    """All four baselines on the same split, fitted side by side, metrics in one grouped job."""
    specs = {name: models.DETECTORS[name] for name in BASELINE_EXPERIMENTS}
    split = models.with_families(sampling.stratified_split(conversations(spark, sf), "doc_id", "y"), specs.values())
    test = split.where("split = 'test'")
    out = None
    for fitted in models.fit_detectors(split.where("split = 'train'"), specs).values():
        part = fitted.predict(test, keep=["y"])
        part = part.select(F.lit(fitted.spec.name).alias("method"), "y", "p")
        out = part if out is None else out.unionByName(part)
    return evaluate.metric_rows(out, ["method"])


@query
def model_roundtrip(spark, sf):
    train, test = split_conversations(spark, sf)
    path = shared_dir(spark, "model")
    models.fit_detector(train, models.NOTEBOOK_DETECTORS["tfidf_logreg"]).save(path)
    return rounded(models.load_detector(spark, path).predict(test, keep=["doc_id", "y"]), "p")


@query
def model_roundtrip_same(spark, sf):
    """Per held-out row: does the detector read back from storage give the probability of the one that was stored?"""
    train, test = split_conversations(spark, sf)
    path = shared_dir(spark, "model")
    fitted = models.fit_detector(train, models.DETECTORS["tfidf_logreg"])
    fitted.save(path)
    before, after = (d.predict(test, keep=["doc_id"]).select("doc_id", "p", "y_pred") for d in (fitted, models.load_detector(spark, path)))
    after = after.select("doc_id", F.col("p").alias("q"), F.col("y_pred").alias("q_pred"))
    same = (F.col("p") == F.col("q")) & (F.col("y_pred") == F.col("q_pred")) & F.col("p").between(0, 1)
    return before.join(after, "doc_id").select("doc_id", same.alias("same"))


@query
def detector_rows(spark, sf):
    """Per held-out row and detector: is the probability proper, and does the predicted class follow from it?"""
    split = models.with_families(
        sampling.stratified_split(conversations(spark, sf), "doc_id", "y"), models.DETECTORS.values()
    )
    fitted = models.fit_detectors(split.where("split = 'train'"), models.DETECTORS)
    test = split.where("split = 'test'")
    together = models.score_together(test, fitted, ["doc_id"])
    alone = [d.predict(test, keep=["doc_id"]).select("doc_id", F.lit(n).alias("method"), F.col("p").alias("q"), "y_pred") for n, d in fitted.items()]
    both = together.join(functools.reduce(DataFrame.unionByName, alone), ["doc_id", "method"])
    proper = F.col("p").between(0, 1) & ((F.col("p") >= 0.5) == (F.col("y_pred") == 1))
    return both.select("doc_id", "method", proper.alias("proper"), (F.abs(F.col("p") - F.col("q")) < 1e-12).alias("as_alone"))


@query
def logistic_optimum(spark, sf):
    """Per input of the surface logistic model: is the gradient of its penalised loss zero?"""
    train, _ = split_conversations(spark, sf)
    spec = models.DETECTORS["stylo_logreg"]
    fitted = models.fit_detector(train, spec)
    columns = models.family_columns("surface")
    scaled = fitted.scaler.transform(models.family_features(train, "surface"), models.SCALED)
    ready = sampling.with_class_weights(fitted.predict(scaled, keep=["y", *[models.SCALED + c for c in columns]]), "y")
    slope = fitted.classifier.coefficients.toArray()
    c = spec.classifier_preset()["c"]
    pull = F.col("weight") * (F.col("p") - F.col("y"))
    sums = ready.agg(*[F.sum(pull * F.col(models.SCALED + f)).alias(f"_{k}") for k, f in enumerate(columns)], F.sum("weight").alias("_n"))
    flat = [
        F.struct(F.lit(name).alias("name"), (F.abs(F.col(f"_{k}") + float(slope[k]) / c) / F.col("_n") < 1e-4).alias("flat"))
        for k, name in enumerate(SURFACE_FEATURES)
    ]
    return sums.select(F.inline(F.array(*flat)))


@query
def importance_names(spark, sf):
    """Importances of the core forest: every feature once, with its hypothesis; none negative, their sum 1."""
    train = materialise(conversation_features(spark, sf, with_compression=True))
    found = materialise(explain.feature_importance(models.fit_detector(train, models.DETECTORS["core"]).weights(spark)))
    total = found.agg(F.abs(F.sum("weight") - 1) < 1e-9).first()[0]  # one row
    return found.select("name", "hypothesis", (F.col("weight") >= 0).alias("not_negative"), F.lit(total).alias("sum_is_one"))


@query
def top_terms_sides(spark, sf):
    """The ends of a TF-IDF model's coefficients: ten terms a side, none of the others further out."""
    train, _ = split_conversations(spark, sf)
    weights = materialise(models.fit_detector(train, models.NOTEBOOK_DETECTORS["tfidf_logreg"]).weights(spark))
    ends = explain.top_terms(weights, 10, both_ends=True)
    others = weights.join(ends.select("name").distinct(), "name", "left_anti")
    limits = others.agg(F.min("weight").alias("_low"), F.max("weight").alias("_high")).first()  # one row
    further = F.when(F.col("side") == "ai", F.col("weight") >= limits["_high"]).otherwise(F.col("weight") <= limits["_low"])
    return ends.groupBy("side").agg(F.count("name").alias("n_terms"), F.every(further).alias("furthest"))


@query
def coefficient_names(spark, sf):
    """Every input of the surface logistic model has one finite coefficient."""
    train, _ = split_conversations(spark, sf)
    weights = models.fit_detector(train, models.DETECTORS["stylo_logreg"]).weights(spark)
    return weights.select("name", (F.abs("weight") < float("inf")).alias("finite"))


@query
def cross_validate_core(spark, sf):
    rows = conversation_features(spark, sf, with_compression=True)
    split = sampling.stratified_split(rows, "doc_id", "y")
    train = materialise(split.where("split = 'train'"))
    return rounded(validation.cross_validate(train, validation.detector(models.DETECTORS["core"])), "mean", "std")


@query
def importance(spark, sf):
    train = materialise(conversation_features(spark, sf, with_compression=True))
    fitted = models.fit_detector(train, models.DETECTORS["core"])
    return rounded(explain.feature_importance(fitted.weights(spark)), "weight")


@query
def top_terms(spark, sf):
    train, _ = split_conversations(spark, sf)
    fitted = models.fit_detector(train, models.NOTEBOOK_DETECTORS["tfidf_logreg"])
    return rounded(explain.top_terms(fitted.weights(spark), 10, both_ends=True), "weight")


@query
def coefficients(spark, sf):
    train, _ = split_conversations(spark, sf)
    return rounded(models.fit_detector(train, models.DETECTORS["stylo_logreg"]).weights(spark), "weight")


def _forest_attribution(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Exact attributions of all held-out rows by the surface forest, and the detector's own probabilities."""
    split = materialise(
        surface_features(sampling.stratified_split(conversations(spark, sf), "doc_id", "y")).drop("text")
    )
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    fitted = models.fit_detector(train, models.DETECTORS["stylo_rf"])
    inputs = models.family_columns("surface")
    found = tree_attribution(models.family_features(test, "surface"), fitted.classifier, inputs)
    plain = F.substring_index("feature", "__", -1)
    return found.withColumn("feature", plain), fitted.predict(test, keep=["doc_id"])


@query
def shapley_forest(spark, sf):
    """Exact path-dependent attributions of the surface forest over all held-out rows."""
    return rounded(explain.mean_attribution(_forest_attribution(spark, sf)[0]), "mean_abs", "mean")


@query
def shapley_forest_sums(spark, sf):
    """Per held-out row: do the attributions and the forest's mean add up to the detector's probability?"""
    found, predicted = _forest_attribution(spark, sf)
    sums = found.groupBy("doc_id").agg(
        F.sum("contribution").alias("c"), F.max("base").alias("base"), F.count("feature").alias("n_features")
    )
    off = F.abs(F.col("c") + F.col("base") - F.col("p"))
    return sums.join(predicted.select("doc_id", "p"), "doc_id").select("doc_id", "n_features", (off < 1e-9).alias("adds_up"))


# Explanation -----------------------------------------------------------------------------------


@query
def rule_signals(spark, sf):
    rows = conversation_features(spark, sf).select("doc_id", F.explode(explain.rule_signals(SQL_RULES)).alias("s"))
    return rounded(rows.select("doc_id", "s.*"), "value", "threshold")


@query
def reasons(spark, sf):
    """The sentences of every conversation's explanation; their values, which have their own query, are left out."""
    rows = conversation_features(spark, sf)
    sentence = F.explode(explain.reasons(explain.rule_signals(SQL_RULES), SQL_RULES))
    return rows.select("doc_id", sentence.alias("s")).select("doc_id", F.regexp_replace("s", r" -?[0-9.]+ ([<>])", " $1").alias("reason"))


@query
def explained(spark, sf):
    train, test = split_features(spark, sf)
    scored = fit_discriminant(train, SQL_SYNTACTIC).transform(test)
    found = explain.predict_with_explanation(scored, SQL_SYNTACTIC, rules=SQL_RULES)
    return found.select(
        "doc_id",
        "verdict",
        "probability",
        "confidence_level",
        F.size("reasons").cast("bigint").alias("n_reasons"),
        F.col("n_triggered_signals").cast("bigint").alias("n_triggered_signals"),
        F.element_at("feature_values", "ttr").alias("ttr"),
        F.size("feature_values").cast("bigint").alias("n_values"),
        F.round(F.aggregate(F.map_values("feature_values"), F.lit(0.0), lambda a, x: a + x), 3).alias("value_sum"),
    )


@query
def explained_core(spark, sf):
    """The core detector's verdicts with all 11 rules and the full record."""
    split = materialise(
        sampling.stratified_split(conversation_features(spark, sf, with_compression=True), "doc_id", "y")
    )
    fitted = models.fit_detector(split.where("split = 'train'"), models.DETECTORS["core"])
    scored = fitted.predict(split.where("split = 'test'"))
    found = explain.predict_with_explanation(scored, SYNTACTIC_FEATURES)
    return found.select(
        "doc_id", "verdict", "probability", "confidence_level", F.array_join("reasons", " | ").alias("reasons"), "n_triggered_signals"
    )


@query
def hypothesis_counts(spark, sf):
    found = explain.hypothesis_counts(conversation_features(spark, sf), rules=SQL_RULES)
    return found.withColumn("n_signals", F.col("n_signals").cast("bigint"))


@query
def shapley_linear(spark, sf):
    train, test = split_features(spark, sf)
    found = explain.linear_attribution(test, fit_discriminant(train, SQL_SYNTACTIC))
    return rounded(explain.mean_attribution(found), "mean_abs", "mean")


@query
def extremes(spark, sf):
    return rounded(explain.extreme_examples(scored_surface(spark, sf)), "p")


@query
def borderline(spark, sf):
    return explain.borderline(scored_surface(spark, sf)).withColumn("y", F.col("y").cast("bigint"))


# Robustness ------------------------------------------------------------------------------------


def scenario_predictions(spark, sf) -> DataFrame:
    """Three closed-form methods, trained on the home scenario, scored on every scenario."""
    rows = shift_corpus(spark, sf)
    syntactic = syntax.syntactic_features(rows, with_compression=False)
    surface = surface_features(rows.select("doc_id", "text")).drop("text")
    # Both feature sets have an avg_sent_len.
    surface = surface.withColumnsRenamed({f: f"s_{f}" for f in SURFACE_FEATURES})
    home = sampling.stratified_split(rows.where("scenario = 'in_domain'").select("doc_id", "y"), "doc_id", "y")
    parts = home.select("doc_id", "split")
    wide = (
        rows.select("doc_id", "y", "scenario")
        .join(parts, "doc_id", "left")
        .join(syntactic, "doc_id")
        .join(surface, "doc_id")
    )
    wide = materialise(wide)
    train, test = wide.where("split = 'train'"), wide.where("split is null or split = 'test'")
    methods = {
        "syntactic": SQL_SYNTACTIC,
        "surface": [f"s_{f}" for f in SURFACE_FEATURES],
        "punctuation": [f"s_{f}" for f in SURFACE_FEATURES[:5]],
    }
    out = None
    for name, features in methods.items():
        part = fit_discriminant(train, features).transform(test)
        part = part.select("scenario", F.lit(name).alias("method"), "y", "p")
        out = part if out is None else out.unionByName(part)
    return out


def scenario_rows(spark, sf) -> DataFrame:
    return materialise(robustness.evaluate_scenarios(scenario_predictions(spark, sf)))


@query
def scenarios(spark, sf):
    return scenario_rows(spark, sf)


def _grid(spark, sf) -> DataFrame:
    """Metrics of all five detectors in all three scenarios; trained on the home scenario, one token pass."""
    rows = shift_corpus(spark, sf).select("doc_id", "y", "scenario", "lang", "text")
    wide = models.with_families(rows, models.DETECTORS.values())
    home = sampling.stratified_split(wide.where("scenario = 'in_domain'").select("doc_id", "y"), "doc_id", "y")
    parts = materialise(wide.join(home.select("doc_id", "split"), "doc_id", "left"))
    fitted = models.fit_detectors(parts.where("split = 'train'"), models.DETECTORS)
    test = parts.where("split is null or split = 'test'")
    return robustness.evaluate_scenarios(models.score_together(test, fitted, ["scenario", "y"]))


@query
def scenario_grid(spark, sf):
    """Five detectors by three scenarios: what was counted, and whether the metrics are proper."""
    proper = functools.reduce(operator.and_, [F.col(m).between(0, 1) for m in ("accuracy", "precision", "recall", "f1", "auc_roc", "ap")])
    rows = materialise(_grid(spark, sf))
    drops = robustness.degradation(rows, "in_domain", ["f1"]).select("scenario", "method", "delta_f1")
    home = (F.col("scenario") != "in_domain") | (F.col("delta_f1") == 0)
    return rows.join(drops, ["scenario", "method"]).select("scenario", "method", "n_rows", proper.alias("proper"), home.alias("home_is_base"))


@query
def scenario_pivot(spark, sf):
    return robustness.pivot_metrics(scenario_rows(spark, sf), SCENARIOS)


@query
def degradation(spark, sf):
    return rounded(robustness.degradation(scenario_rows(spark, sf), "in_domain", ["f1", "auc_roc"]), "delta_f1", "delta_auc_roc")


@query
def method_rank(spark, sf):
    ranked = robustness.rank_methods(scenario_rows(spark, sf))
    return ranked.select("scenario", "method", "f1", F.col("place").cast("bigint").alias("place"))


@query
def auc_profile(spark, sf):
    return robustness.auc_profile(scenario_rows(spark, sf), SCENARIOS)


# Ablation --------------------------------------------------------------------------------------

DELTAS = ["f1", "auc_roc", "accuracy", "delta_f1", "delta_auc"]


def _ablation(spark, sf):
    train, test = split_features(spark, sf)
    return ablation.ClosedFormEstimator(train, SQL_SYNTACTIC), test


@query
def ablate_one(spark, sf):
    return rounded(ablation.leave_one_out(*_ablation(spark, sf), SQL_SYNTACTIC), *DELTAS)


@query
def ablate_group(spark, sf):
    found = ablation.leave_group_out(*_ablation(spark, sf), SQL_SYNTACTIC, SQL_GROUPS)
    return rounded(found, *DELTAS).withColumns({c: F.col(c).cast("bigint") for c in ("n_removed", "n_left")})


@query
def ablate_incremental(spark, sf):
    found = ablation.incremental_add(*_ablation(spark, sf))
    return rounded(found, "f1", "auc_roc", "accuracy").withColumn("n_features", F.col("n_features").cast("bigint"))


@query
def ablate_greedy(spark, sf):
    found = ablation.greedy_forward(*_ablation(spark, sf), SQL_SYNTACTIC)
    return rounded(found.drop("members"), "f1", "auc_roc", "accuracy", "percent_of_full").withColumn(
        "n_features", F.col("n_features").cast("bigint")
    )


@query
def min_subset(spark, sf):
    rows = materialise(ablation.incremental_add(*_ablation(spark, sf)))
    found = ablation.min_subset(rows, len(SQL_SYNTACTIC))
    return found.select(*[F.col(c).cast("bigint").alias(c) for c in ("min_for_f1", "min_for_auc")])


@query
def control_check(spark, sf):
    found = ablation.control_check(*_ablation(spark, sf), SQL_SYNTACTIC)
    return rounded(found, "accuracy", "precision", "recall", "f1", "auc_roc", "delta_f1", "delta_auc")


def _forest_ablation(spark, sf):
    """Forests of the study's own preset, refitted for every subset, over all 15 features."""
    split = materialise(sampling.stratified_split(conversation_features(spark, sf, with_compression=True), "doc_id", "y"))
    return ablation.ForestEstimator(split.where("split = 'train'"), SYNTACTIC_FEATURES), split.where("split = 'test'")


def _impacts(rows: DataFrame) -> DataFrame:
    """What can be said of refitted forests without repeating them: sizes, ranges and bands that follow from the deltas."""
    fits = (F.col("f1").between(0, 1)) & (F.col("auc_roc").between(0, 1)) & (F.abs(F.col("delta_f1")) <= 1)
    band = (F.col("impact") == "none") == (F.col("delta_f1") >= 0)
    return rows.select("subset", fits.alias("proper"), band.alias("band_follows"))


@query
def ablate_one_forest(spark, sf):
    return _impacts(ablation.leave_one_out(*_forest_ablation(spark, sf), SYNTACTIC_FEATURES))


@query
def ablate_group_forest(spark, sf):
    return _impacts(ablation.leave_group_out(*_forest_ablation(spark, sf), SYNTACTIC_FEATURES, ABLATION_GROUPS))


@query
def control_check_forest(spark, sf):
    """The same check with refitted forests at the study's preset."""
    found = ablation.control_check(*_forest_ablation(spark, sf), SYNTACTIC_FEATURES)
    return rounded(found, "accuracy", "f1", "auc_roc", "delta_f1", "delta_auc")


@query
def refit_forest(spark, sf):
    """The same subset fitted twice, side by side: all metrics are equal, so every delta is due to the features."""
    estimator, test = _forest_ablation(spark, sf)
    rows = ablation.subset_metrics(estimator, test, {"full": list(SYNTACTIC_FEATURES), "again": list(SYNTACTIC_FEATURES)})
    spread = [(F.max(m) - F.min(m) == 0).alias(m) for m in ("f1", "auc_roc", "accuracy")]
    return rows.agg(*spread, F.count(F.lit(1)).alias("n_fits"))


# Streams ---------------------------------------------------------------------------------------


def _stream_of_documents(spark, sf):
    """The documents as a folder of files that arrive in two batches, read as a stream."""
    folder = shared_dir(spark, "in")
    rows = table(spark, sf, "documents").withColumn("title", F.substring_index("text", "\n", 1))
    files = stream_files(rows)
    rows.repartition(files, "doc_id").write.mode("overwrite").parquet(folder)
    return jobs.read_stream(spark, folder, rows.schema, files_per_batch=-(-files // 2))


def stream_files(rows: DataFrame) -> int:
    """How many files a table is dealt into: more with more input, so that none of them grows with it."""
    return max(4, rows.rdd.getNumPartitions(), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _run(spark, stream: DataFrame) -> DataFrame:
    out = shared_dir(spark, "out")
    jobs.append_to(stream, out, shared_dir(spark, "resume")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query
def stream_gate(spark, sf):
    gated = jobs.gate(_stream_of_documents(spark, sf), letter=LATIN_LETTER)
    kept = _run(spark, gated.where("accepted"))
    return kept.select(
        "doc_id", F.col("length_words").cast("bigint").alias("length_words"), F.col("length_chars").cast("bigint").alias("length_chars")
    )


@query
def stream_score(spark, sf):
    train = surface_features(conversations(spark, sf)).drop("text")
    model = fit_discriminant(train, SURFACE_FEATURES)
    scored = _run(spark, jobs.score(_stream_of_documents(spark, sf), model))
    return rounded(scored.select("doc_id", "p", "verdict", "confidence_level"), "p")


@query
def stream_progress(spark, sf):
    totals = jobs.progress(jobs.gate(_stream_of_documents(spark, sf), letter=LATIN_LETTER))
    out = shared_dir(spark, "totals")
    jobs.keep_totals(totals, out, shared_dir(spark, "resume")).awaitTermination()
    return published.latest(spark, out)


@query
def stream_explained(spark, sf):
    """The core detector, stored and loaded again, explains all documents as they arrive; batch and stream agree."""
    train = materialise(conversation_features(spark, sf, with_compression=True))
    path, out = shared_dir(spark, "model"), shared_dir(spark, "explained")
    models.fit_detector(train, models.DETECTORS["core"]).save(path)
    jobs.explain_arriving(_stream_of_documents(spark, sf), path, out, shared_dir(spark, "resume")).awaitTermination()
    streamed = published.all_versions(spark, out).select("doc_id", "verdict", "probability", "confidence_level", "reasons")
    whole = jobs.explained(table(spark, sf, "documents"), models.load_detector(spark, path))
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("verdict", "probability", "confidence_level", "reasons")]
    both = whole.alias("b").join(streamed.alias("s"), "doc_id", "full")
    return both.select("doc_id", functools.reduce(operator.and_, same).alias("as_in_batch"))


