"""Quality classifier by hierarchical empirical Bayes.

The text of a document gives evidence: the log likelihood ratio of good to bad under a naive Bayes model over
binned text measures, learned by grouped counts from labelled rows. Where a document comes from gives a prior:
every host (here the source) and every path below it (source and language) has a posterior share of good
documents, estimated from the evidence of all its documents and shrunk: hosts towards the corpus, paths towards
their host. How strongly is itself estimated from the spread between hosts, and between paths of a host, so a site
with few documents says little. A document's score combines its path's posterior with its own evidence.

Texts never move. A narrow row per document is stored; hosts and paths are grouped with partial aggregation, so a
host with a third of all rows is one row per task when it is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stylotrace.llm.support import BLANKS, few, free_name, stored

# Measures of a text and the upper edges of their bins; each measure also has a bin for what lies beyond.
EDGES = {
    "upper": (0.02, 0.05, 0.1, 0.2, 0.4, 0.7),  # capitals in letters
    "odd": (0.002, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4),  # signs other than sentence marks, in characters
    "marks": (0.005, 0.02, 0.04, 0.07, 0.12, 0.2),  # sentence marks in characters
    "digits": (0.002, 0.01, 0.05, 0.15),
    "distinct": (0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9),  # distinct words in words
}
SMOOTHING = 1.0
DEPTH = 0.5  # weight of each measure's evidence: the measures are not independent
SHRINK_RANGE = (1.0, 1e6)  # prior rows of a host or path, at least and at most


def measures(text: Column) -> dict[str, Column]:
    """Measures of the whole text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    share = lambda pattern: F.length(F.regexp_replace(text, pattern, "")) / size  # noqa: E731  of what it leaves
    words = F.filter(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), lambda w: w != "")
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    return {
        "upper": F.length(F.regexp_replace(text, r"\P{Lu}+", "")) / F.greatest(letters, F.lit(1)),
        "odd": share(r"[\p{L}\p{N}\s.,;:!?'\"()-]+"),
        "marks": share(r"[^.,;:!?]+"),
        "digits": share(r"\P{N}+"),
        "distinct": F.size(F.array_distinct(words)) / n,
    }


def _bin(value: Column, edges: tuple[float, ...]) -> Column:
    out = F.lit(0)
    for edge in edges:
        out = out + (value > edge).cast("int")
    return out


@dataclass(frozen=True)
class Evidence:
    """Log likelihood ratios of the bins of each measure, and the share of good documents among labelled ones."""

    ratios: dict[str, list[float]]
    good_share: float


def binned(docs: DataFrame) -> DataFrame:
    """A stored narrow row per document: doc_id, source, lang and the bin of each measure."""
    bins = [_bin(value, EDGES[name]).cast("byte").alias(name) for name, value in measures(F.col("text")).items()]
    return stored(docs.select("doc_id", "source", "lang", *bins), "measures")


def fit_evidence(rows: DataFrame, labels: DataFrame) -> Evidence:
    """Count the bins of all labelled rows by label. Rows without a label, and labels without a row, say nothing."""
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("_id"), "quality")
    pairs = rows.join(known, F.col("doc_id") == F.col("_id"))
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("bin")) for m in EDGES]))
    counted = pairs.select("quality", cells.alias("c")).groupBy("c.measure", "c.bin", "quality").count()
    count = {(r["measure"], r["bin"], r["quality"]): r["count"] for r in counted.collect()}  # bins x 2 rows
    ratios, total = {}, [0, 0]
    for measure, edges in EDGES.items():
        total = [sum(count.get((measure, b, q), 0) for b in range(len(edges) + 1)) for q in (0, 1)]
        share = [
            [(count.get((measure, b, q), 0) + SMOOTHING) / (total[q] + SMOOTHING * (len(edges) + 1)) for q in (0, 1)]
            for b in range(len(edges) + 1)
        ]
        ratios[measure] = [DEPTH * math.log(good / bad) for bad, good in share]
    return Evidence(ratios, (total[1] + 1) / (sum(total) + 2))


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
    return F.log(p / (1 - p))


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Prior rows of a group by the method of moments: variance inside groups over variance between them.

    ``groups`` has n, total and squares (sums of p and p * p); ``mean`` is what the groups vary around.
    """
    n, average = F.col("n"), F.col("total") / F.col("n")
    sums = groups.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum(n).alias("n"),
        F.sum(n * n).alias("nn"),
        F.sum(F.col("squares") - n * average * average).alias("inside"),
        F.sum(n * (average - mean) * (average - mean)).alias("between"),
    ).first()
    if not sums["n"] or sums["k"] < 2 or sums["n"] <= sums["k"]:
        return SHRINK_RANGE[1]
    inside = max(sums["inside"], 0.0) / (sums["n"] - sums["k"])
    between = (sums["between"] - (sums["k"] - 1) * inside) / (sums["n"] - sums["nn"] / sums["n"])
    strength = inside / between if between > 0 else SHRINK_RANGE[1]
    return min(max(strength, SHRINK_RANGE[0]), SHRINK_RANGE[1])


def site_posteriors(rows: DataFrame) -> DataFrame:
    """Per path the figures of the hierarchy, from rows with source, lang and p (the evidence as a probability).

    Returns (host, path, n, total, strength, host_posterior, path_posterior). Null hosts and paths are sites too.
    """
    sums = [F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares")]
    paths = rows.groupBy(F.col("source").alias("host"), F.col("lang").alias("path")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("total"), F.sum(F.col("p") * F.col("p")).alias("squares")
    )
    paths = stored(paths, "paths")
    hosts = paths.groupBy("host").agg(*sums)
    overall = hosts.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    mean = overall["total"] / overall["n"] if overall["n"] else 0.5
    k_host = _strength(hosts, F.lit(mean))
    hosts = hosts.select(
        F.col("host").alias("_host"),
        ((F.col("total") + k_host * mean) / (F.col("n") + k_host)).alias("host_posterior"),
    )
    paths = stored(paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host"), "sites")
    k_path = _strength(paths, F.col("host_posterior"))
    path = (F.col("total") + k_path * F.col("host_posterior")) / (F.col("n") + k_path)
    return paths.select(
        "host", "path", "n", "total", F.lit(k_path).alias("strength"), "host_posterior", path.alias("path_posterior")
    )


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, source, lang, evidence, host_posterior, path_posterior, score, kept) for every row of ``docs``.

    ``docs`` has doc_id, text, source and lang; ``labels`` doc_id and quality (1 good). A document's own evidence
    is taken out of its path's posterior before the two are combined. Null and empty texts are judged by the same
    measures (no words). Without any usable label all evidence is 0 and nothing is rejected. Repeated rows are
    judged alike.
    """
    rows = binned(docs)
    model = fit_evidence(rows, labels)
    evidence = F.lit(0.0)
    for measure, ratios in model.ratios.items():
        evidence = evidence + F.get(F.array(*map(F.lit, ratios)), F.col(measure).cast("int"))
    prior = math.log(model.good_share / (1 - model.good_share))
    rows = rows.select("doc_id", "source", "lang", evidence.alias("evidence"))
    rows = rows.withColumn("p", _sigmoid(F.col("evidence") + prior))
    sites = site_posteriors(rows)
    others = (F.col("total") - F.col("p") + F.col("strength") * F.col("host_posterior")) / (
        F.col("n") - 1 + F.col("strength")
    )
    at = F.col("source").eqNullSafe(F.col("host")) & F.col("lang").eqNullSafe(F.col("path"))
    score = _sigmoid(_logit(others) + F.col("evidence"))
    return rows.join(sites, at).select(
        "doc_id", "source", "lang", "evidence", "host_posterior", "path_posterior", score.alias("score"),
        (score >= threshold).alias("kept"),
    )


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    own = free_name(docs, "_id")
    judged = classify(docs, labels, threshold).groupBy(F.col("doc_id").alias(own)).agg(F.bool_or("kept").alias("kept"))
    gone = few(judged.where(~F.col("kept")).select(own))  # what goes is named, so texts need not move
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col(own)), "left_anti")
