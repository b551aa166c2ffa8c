"""Rule-based explanations and attributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stylotrace.fixed_values import EXPLANATION_RULES, FEATURE_HYPOTHESIS, SEED
from stylotrace.operators.ordering import hash_rank
from stylotrace.plans.closed_form import Discriminant

WORDING = {
    "cr_pos_high": "tag sequence compresses poorly",
    "unique_trigrams_low": "few different tag trigrams",
    "pos_entropy_low": "parts of speech are unevenly spread",
    "burstiness_low": "sentences are of even length",
    "punct_entropy_low": "punctuation is predictable",
    "comma_cv_low": "commas come at regular intervals",
    "ttr_low": "vocabulary is repetitive",
    "hlr_low": "few words occur only once",
    "complexity_low": "few participles and converbs",
    "dep_depth_low": "sentence structure is flat",
    "nv_ratio_high": "nouns outweigh verbs",
}
NO_REASON = "No marker of machine text found; the text varies as natural language does."


def rule_signals(rules: Sequence[tuple] = EXPLANATION_RULES) -> Column:
    """Array of the rules that fire, in rule order: (rule, hypothesis, feature, value, threshold)."""
    entries = []
    for name, feature, direction, threshold, hypothesis in rules:
        value = F.col(feature)
        fires = value > F.lit(threshold) if direction == ">" else value < F.lit(threshold)
        entries.append(
            F.when(
                fires,
                F.struct(
                    F.lit(name).alias("rule"),
                    F.lit(hypothesis).alias("hypothesis"),
                    F.lit(feature).alias("feature"),
                    value.alias("value"),
                    F.lit(float(threshold)).alias("threshold"),
                ),
            )
        )
    return F.array_compact(F.array(*entries))


def reasons(signals: Column, rules: Sequence[tuple] = EXPLANATION_RULES) -> Column:
    """One sentence per signal, with a fallback when there is none."""
    above = [r[0] for r in rules if r[2] == ">"]
    texts = F.create_map(*[F.lit(x) for r in rules for x in (r[0], WORDING.get(r[0], r[0]))])

    def sentence(s: Column) -> Column:
        sign = F.when(s["rule"].isin(above), " > ").otherwise(" < ")
        return F.concat(
            F.lit("["), s["hypothesis"], F.lit("] "), F.element_at(texts, s["rule"]), F.lit(" ("), s["feature"],
            F.lit(" "), F.format_string("%.3f", s["value"]), sign, s["threshold"].cast("string"), F.lit(")"),
        )

    return F.when(F.size(signals) > 0, F.transform(signals, sentence)).otherwise(F.array(F.lit(NO_REASON)))


def verdict(p: Column, threshold: float = 0.5) -> Column:
    return F.when(p >= threshold, "AI-Generated").otherwise("Human-Written")


def confidence(p: Column) -> Column:
    return (
        F.when((p > 0.85) | (p < 0.15), "High").when((p > 0.70) | (p < 0.30), "Medium").otherwise("Low")
    )


def predict_with_explanation(
    scored: DataFrame,
    features: Sequence[str],
    p: str = "p",
    threshold: float = 0.5,
    rules: Sequence[tuple] = EXPLANATION_RULES,
) -> DataFrame:
    """Verdict, probability, confidence, reasons, feature map and number of signals of every row."""
    pairs = [x for f in features for x in (F.lit(f), F.round(F.col(f), 5))]
    return (
        scored.withColumn("signals", rule_signals(rules))
        .withColumn("verdict", verdict(F.col(p), threshold))
        .withColumn("probability", F.round(F.col(p), 4))
        .withColumn("confidence_level", confidence(F.col(p)))
        .withColumn("reasons", reasons(F.col("signals"), rules))
        .withColumn("feature_values", F.create_map(*pairs))
        .withColumn("n_triggered_signals", F.size("signals"))
    )


def hypothesis_counts(df: DataFrame, id_col: str = "doc_id", rules: Sequence[tuple] = EXPLANATION_RULES) -> DataFrame:
    """Fired rules per row and hypothesis, zeros included. Computed in the row."""

    def fired(group: str) -> Column:
        return F.size(F.filter("_s", lambda s: s["hypothesis"] == group))

    groups = sorted({r[4] for r in rules})
    entries = [F.struct(F.lit(g).alias("hypothesis"), fired(g).alias("n_signals")) for g in groups]
    return df.withColumn("_s", rule_signals(rules)).select(id_col, F.inline(F.array(*entries)))


def feature_importance(weights: DataFrame) -> DataFrame:
    """Model inputs with their hypothesis, largest weight first."""
    lookup = weights.sparkSession.createDataFrame(list(FEATURE_HYPOTHESIS.items()), "name string, hypothesis string")
    return weights.join(F.broadcast(lookup), "name", "left").orderBy(F.desc("weight"), "name")


def top_terms(weights: DataFrame, n: int = 20, both_ends: bool = False) -> DataFrame:
    """The n largest weights; with ``both_ends`` also the n smallest."""
    high = weights.orderBy(F.desc("weight"), "name").limit(n).withColumn("side", F.lit("ai"))
    if not both_ends:
        return high
    return high.unionByName(weights.orderBy("weight", "name").limit(n).withColumn("side", F.lit("human")))


def linear_attribution(df: DataFrame, model: Discriminant, id_col: str = "doc_id") -> DataFrame:
    """Exact Shapley values of a linear score: slope times distance from the training mean."""
    entries = [
        F.struct(
            F.lit(f).alias("feature"),
            ((F.col(f) - F.lit(mean)) * F.lit(slope)).alias("contribution"),
        )
        for f, (_, slope, _, mean) in model.params.items()
    ]
    return df.select(id_col, F.inline(F.array(*entries)))


def permutation_attribution(
    rows: DataFrame,
    background: DataFrame,
    classifier,
    features: Sequence[str],
    id_col: str = "doc_id",
    permutations: int = 10,
    seed: int = SEED,
) -> DataFrame:
    """Shapley values of any ML classifier by sampled feature orders.

    Every row is paired with ``permutations`` background rows and feature orders. Features switch from
    the background row to the explained row one by one; each step's change of the probability belongs
    to the feature that switched. The changes of a row add up to p(row) - mean p(its background rows).
    """
    d = len(features)
    drawn = hash_rank(background.select(id_col, *features), id_col, [], seed, limit=F.lit(permutations))
    base = [[float(r[f]) for f in features] for r in drawn.collect()]  # ``permutations`` rows
    cases = F.array(
        *[F.struct(F.lit(k).alias("k"), F.array(*[F.lit(v) for v in b]).alias("b")) for k, b in enumerate(base)]
    )
    vector = F.array(*[F.col(f).cast("double") for f in features])
    paired = rows.select(id_col, vector.alias("x"), F.inline(cases))
    key = F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), F.col("k").cast("string"))
    order = F.transform(
        F.array_sort(F.array(*[F.struct(F.md5(F.concat(key, F.lit(f":{j}"))), F.lit(j).alias("j")) for j in range(d)])),
        lambda s: s["j"],
    )
    stepped = paired.withColumn("order", order).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(d))))
    masked = F.transform(
        F.sequence(F.lit(0), F.lit(d - 1)),
        lambda j: F.when(F.array_position("order", j) <= F.col("step"), F.get("x", j)).otherwise(F.get("b", j)),
    )
    scored = classifier.transform(stepped.withColumn("features", array_to_vector(masked)))
    p = vector_to_array("probability")[1]
    path = Window.partitionBy(id_col, "k").orderBy("step")  # d + 1 rows
    moved = scored.select(id_col, "k", "step", "order", p.alias("p")).withColumn("delta", F.col("p") - F.lag("p").over(path))
    names = F.array(*[F.lit(f) for f in features])
    changes = moved.where(F.col("step") > 0).select(
        id_col, F.get(names, F.get("order", F.col("step") - 1)).alias("feature"), "delta"
    )
    return changes.groupBy(id_col, "feature").agg((F.sum("delta") / len(base)).alias("contribution"))


def mean_attribution(attributions: DataFrame) -> DataFrame:
    return attributions.groupBy("feature").agg(
        F.avg(F.abs("contribution")).alias("mean_abs"), F.avg("contribution").alias("mean")
    )


def extreme_examples(scored: DataFrame, id_col: str = "doc_id", y: str = "y", p: str = "p", text: str = "text") -> DataFrame:
    """The human text with the lowest and the AI text with the highest probability."""
    row = F.struct(F.col(id_col).alias("doc_id"), F.col(p).alias("p"), F.col(text).alias("text"))
    human = F.min_by(F.when(F.col(y) == 0, row), F.when(F.col(y) == 0, F.struct(F.col(p), F.col(id_col))))
    # The lowest id wins among equally high probabilities.
    ai = F.max_by(F.when(F.col(y) == 1, row), F.when(F.col(y) == 1, F.struct(F.col(p), -F.col(id_col))))
    both = scored.agg(human.alias("h"), ai.alias("a"))
    return both.select(
        F.inline(
            F.array(
                F.struct(F.lit("most human").alias("kind"), F.col("h.doc_id"), F.col("h.p"), F.col("h.text")),
                F.struct(F.lit("most ai").alias("kind"), F.col("a.doc_id"), F.col("a.p"), F.col("a.text")),
            )
        )
    ).where("doc_id is not null")


def borderline(scored: DataFrame, y: str = "y", p: str = "p", low: float = 0.4, high: float = 0.6) -> DataFrame:
    inside = (F.col(p) > low) & (F.col(p) < high)
    return scored.groupBy(y).agg(F.count_if(inside).alias("n_borderline"), F.count(F.lit(1)).alias("n_rows"))


