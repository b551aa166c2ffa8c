"""Detectors: features, weights and a Spark ML classifier behind one interface."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stylotrace.fixed_values import (
    BASELINE_EXPERIMENTS,
    FOREST_PRESETS,
    LOGISTIC_PRESETS,
    SEED,
    SURFACE_FEATURES,
    SURFACE_FEATURES_V1,
    SYNTACTIC_FEATURES,
    TFIDF_PRESETS,
)
from stylotrace.functions.numbers import sanitise
from stylotrace.operators.evaluate import metric_rows
from stylotrace.operators.forest import ForestModel, fit_forest, load_forest
from stylotrace.operators.lexical import TfidfModel, fit_tfidf
from stylotrace.operators.sampling import with_class_weights
from stylotrace.operators.surface import surface_features, surface_features_v1
from stylotrace.operators.syntax import syntactic_features
from stylotrace.session import materialise

MAX_DEPTH = 30  # the deepest trees Spark ML grows


def random_forest(preset: dict, features: str = "features", label: str = "y", seed: int = SEED) -> RandomForestClassifier:
    forest = RandomForestClassifier(
        featuresCol=features,
        labelCol=label,
        numTrees=preset["trees"],
        maxDepth=min(preset["depth"] or MAX_DEPTH, MAX_DEPTH),
        minInstancesPerNode=preset["leaf"],
        featureSubsetStrategy="sqrt",
        maxMemoryInMB=1024,  # more nodes per pass over the data, so fewer passes
        seed=seed,
    )
    return forest.setWeightCol("weight") if preset["balanced"] else forest


def grown_forest(train: DataFrame, preset: dict, seed: int = SEED) -> ForestModel:
    """The forest of ``random_forest``'s settings, grown on the executors whatever the size of its trees."""
    return fit_forest(train, preset, MAX_DEPTH, seed)


def logistic_regression(
    preset: dict, weight_sum: float, features: str = "features", label: str = "y"
) -> LogisticRegression:
    """L2 strength 1/C on the summed loss, which is 1/(C * sum of weights) on Spark's mean loss."""
    model = LogisticRegression(
        featuresCol=features,
        labelCol=label,
        maxIter=preset["max_iter"],
        regParam=1.0 / (preset["c"] * weight_sum),
        elasticNetParam=0.0,
        standardization=False,
        tol=1e-8,
    )
    return model.setWeightCol("weight") if preset["balanced"] else model


@dataclass
class Standardiser:
    """Mean and population deviation from the training rows; constant columns keep their scale."""

    params: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame, prefix: str = "") -> DataFrame:
        """Scaled columns behind ``prefix``; without one they replace their sources."""
        return df.withColumns({prefix + f: (F.col(f) - F.lit(m)) / F.lit(s) for f, (m, s) in self.params.items()})


def fit_standardiser(train: DataFrame, features: Sequence[str]) -> Standardiser:
    measures = [a for f in features for a in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]
    row = train.agg(*measures).first()
    return Standardiser({f: (row[f"m_{f}"] or 0.0, row[f"s_{f}"] or 1.0) for f in features})


@dataclass
class DetectorSpec:
    name: str
    features: str  # syntactic, surface, surface_v1 or tfidf
    classifier: str  # forest or logistic
    preset: str
    tfidf: str | None = None
    standardise: bool = False
    overrides: dict = field(default_factory=dict)

    def classifier_preset(self) -> dict:
        table = FOREST_PRESETS if self.classifier == "forest" else LOGISTIC_PRESETS
        return table[self.preset] | self.overrides


DETECTORS = {
    "core": DetectorSpec("Syntactic + Random Forest", "syntactic", "forest", "core"),
    "tfidf_rf": DetectorSpec(BASELINE_EXPERIMENTS["tfidf_rf"], "tfidf", "forest", "tfidf_rf", "library"),
    "tfidf_logreg": DetectorSpec(BASELINE_EXPERIMENTS["tfidf_logreg"], "tfidf", "logistic", "library", "library"),
    "stylo_rf": DetectorSpec(BASELINE_EXPERIMENTS["stylo_rf"], "surface", "forest", "stylo_rf"),
    "stylo_logreg": DetectorSpec(
        BASELINE_EXPERIMENTS["stylo_logreg"], "surface", "logistic", "library", standardise=True
    ),
}
# The same four baselines with the settings of the single-experiment studies.
NOTEBOOK_DETECTORS = {
    "tfidf_rf": DetectorSpec(BASELINE_EXPERIMENTS["tfidf_rf"], "tfidf", "forest", "notebook", "notebook"),
    "tfidf_logreg": DetectorSpec(BASELINE_EXPERIMENTS["tfidf_logreg"], "tfidf", "logistic", "notebook", "notebook"),
    "stylo_rf": DetectorSpec(BASELINE_EXPERIMENTS["stylo_rf"], "surface_v1", "forest", "notebook"),
    "stylo_logreg": DetectorSpec(
        BASELINE_EXPERIMENTS["stylo_logreg"], "surface_v1", "logistic", "notebook", standardise=True
    ),
}

FEATURE_COLUMNS = {
    "syntactic": SYNTACTIC_FEATURES,
    "surface": SURFACE_FEATURES,
    "surface_v1": SURFACE_FEATURES_V1,
}


SCALED = "scaled__"


def family_columns(kind: str) -> list[str]:
    """Names of a family's columns with the family in front: families share names but not definitions."""
    return [f"{kind}__{f}" for f in FEATURE_COLUMNS[kind]]


def _holds(df: DataFrame, kind: str) -> bool:
    """Whether the plain names in ``df`` are this family's: the first of the three that is there in full owns them."""
    owner = next((k for k, names in FEATURE_COLUMNS.items() if set(names) <= set(df.columns)), None)
    return owner == kind


def family_features(df: DataFrame, kind: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``family_columns(kind)`` with NaN and infinities as 0; other columns stay as they are.

    Columns of that name are taken as they are; else the plain columns, if they are this family's; else the
    features are computed from the text.
    """
    names, columns = FEATURE_COLUMNS[kind], family_columns(kind)
    if set(columns) <= set(df.columns):
        return df
    if _holds(df, kind):
        return df.withColumns({c: sanitise(F.col(f)) for c, f in zip(columns, names, strict=True)})
    if kind == "surface":
        df = surface_features(df, text, f"{kind}__")
    elif kind == "surface_v1":
        df = surface_features_v1(df, text, f"{kind}__")
    else:
        lang = "lang" if "lang" in df.columns else None
        found = syntactic_features(df, id_col, text, lang).select(id_col, *names)
        df = df.join(found.withColumnsRenamed(dict(zip(names, columns, strict=True))), id_col)
    return df.withColumns({c: sanitise(F.col(c)) for c in columns})


def numeric_features(df: DataFrame, kind: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``family_features`` and the same under plain names; plain columns of another family stay as they are."""
    own, taken = _holds(df, kind), set(df.columns)
    df = family_features(df, kind, id_col, text)
    pairs = zip(FEATURE_COLUMNS[kind], family_columns(kind), strict=True)
    return df.withColumns({f: F.col(c) for f, c in pairs if own or f not in taken})


@dataclass
class Detector:
    """A fitted detector."""

    spec: DetectorSpec
    pipeline: PipelineModel
    tfidf: TfidfModel | None = None
    scaler: Standardiser | None = None

    def _vectors(self, df: DataFrame) -> DataFrame:
        return _featurise(df, self.spec, self.tfidf, self.scaler)

    def predict(self, df: DataFrame, threshold: float = 0.5, keep: Sequence[str] | None = None) -> DataFrame:
        """Add ``p`` (probability of AI) and ``y_pred``."""
        kept = list(df.columns if keep is None else keep)
        ready = PipelineModel(self.pipeline.stages[:-1]).transform(self._vectors(df))
        ready = ready.select(*[c for c in kept if c != "features"], "features")  # a large forest stores its rows
        scored = self.classifier.transform(ready)
        scored = scored.withColumn("p", vector_to_array("probability")[1])
        scored = scored.withColumn("y_pred", (F.col("p") >= threshold).cast("int"))
        return scored.select(*kept, "p", "y_pred")

    def metrics(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        rows = metric_rows(self.predict(df, threshold, ["y"]), threshold=threshold)
        return rows.withColumn("name", F.lit(self.spec.name))

    @property
    def classifier(self):
        return self.pipeline.stages[-1]

    def names(self) -> list[str]:
        if self.tfidf is not None:
            return [r["term"] for r in self.tfidf.terms.orderBy("term_id").select("term").collect()]
        return FEATURE_COLUMNS[self.spec.features]

    def weights(self, spark: SparkSession) -> DataFrame:
        """(name, weight) per model input: importances of a forest, coefficients of a linear model."""
        if self.spec.classifier == "forest":
            values = self.classifier.featureImportances.toArray()
        else:
            values = self.classifier.coefficients.toArray()
        rows = [(n, float(v)) for n, v in zip(self.names(), values)]
        return spark.createDataFrame(rows, "name string, weight double")

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        forest = self.spec.classifier == "forest"
        PipelineModel(self.pipeline.stages[: -1 if forest else None]).write().overwrite().save(f"{path}/pipeline")
        if forest:
            self.classifier.save(f"{path}/forest")
        meta = {
            "kind": "stylotrace-detector",
            "spec": vars(self.spec),
            "scaler": self.scaler.params if self.scaler else None,
            "tfidf": {"stop_words": self.tfidf.stop_words, "sublinear": self.tfidf.sublinear} if self.tfidf else None,
        }
        if self.tfidf is not None:
            self.tfidf.terms.write.mode("overwrite").parquet(f"{path}/terms")
        spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").parquet(f"{path}/meta")


def load_detector(spark: SparkSession, path: str) -> Detector:
    meta = json.loads(spark.read.parquet(f"{path}/meta").first()["meta"])
    if meta.get("kind") != "stylotrace-detector":
        raise TypeError(f"no detector in {path}")
    tfidf = None
    if meta["tfidf"] is not None:
        terms = spark.read.parquet(f"{path}/terms")
        tfidf = TfidfModel(terms, terms.count(), meta["tfidf"]["stop_words"], meta["tfidf"]["sublinear"])
    scaler = Standardiser({k: tuple(v) for k, v in meta["scaler"].items()}) if meta["scaler"] else None
    spec, pipeline = DetectorSpec(**meta["spec"]), PipelineModel.load(f"{path}/pipeline")
    if spec.classifier == "forest":
        pipeline = PipelineModel([*pipeline.stages, load_forest(spark, f"{path}/forest")])
    return Detector(spec, pipeline, tfidf, scaler)


def _featurise(df: DataFrame, spec: DetectorSpec, tfidf: TfidfModel | None, scaler: Standardiser | None) -> DataFrame:
    if tfidf is not None:
        return tfidf.vectors(df, out="features")
    wide = family_features(df, spec.features)
    return scaler.transform(wide, SCALED) if scaler else wide


def fit_detector(
    train: DataFrame, spec: DetectorSpec, tfidf: TfidfModel | None = None, vectors: DataFrame | None = None
) -> Detector:
    """``train`` has ``doc_id``, ``y`` and ``text`` or the feature columns.

    ``tfidf`` spares fitting the vocabulary again, ``vectors``, stored rows of ``y`` and ``features``, applying it.
    """
    preset = spec.classifier_preset()
    if spec.features == "tfidf":
        tfidf = tfidf or fit_tfidf(train, **TFIDF_PRESETS[spec.tfidf])
    else:
        tfidf = None
    scaler = None
    if spec.standardise:
        scaler = fit_standardiser(family_features(train, spec.features), family_columns(spec.features))
    ready = _featurise(train, spec, tfidf, scaler) if vectors is None else vectors
    if preset["balanced"]:
        ready = with_class_weights(ready, "y")
    stages = []
    if tfidf is None:
        inputs = [(SCALED if scaler else "") + c for c in family_columns(spec.features)]
        stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    if spec.classifier == "forest":
        stages.append(grown_forest(PipelineModel(stages).transform(ready), preset))
        return Detector(spec, PipelineModel(stages), tfidf, scaler)
    # Balanced weights add up to the number of rows.
    stages.append(logistic_regression(preset, float(train.count())))
    return Detector(spec, Pipeline(stages=stages).fit(ready), tfidf, scaler)


def with_families(df: DataFrame, specs: Iterable[DetectorSpec], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Add the columns of every feature family that the detectors read, each family once, and store the rows."""
    for kind in sorted({s.features for s in specs} - {"tfidf"}):
        df = family_features(df, kind, id_col, text)
    return materialise(df)


def fit_detectors(train: DataFrame, specs: dict[str, DetectorSpec], side_by_side: int = 5) -> dict[str, Detector]:
    """Fit several detectors on rows of ``with_families``, side by side; detectors of one TF-IDF preset share its fit."""
    presets = sorted({s.tfidf for s in specs.values() if s.features == "tfidf"})
    fitted = {p: fit_tfidf(train, **TFIDF_PRESETS[p]) for p in presets}
    stored = {p: materialise(m.vectors(train, out="features").select("y", "features")) for p, m in fitted.items()}
    one = inheritable_thread_target(train.sparkSession)(lambda s: fit_detector(train, s, fitted.get(s.tfidf), stored.get(s.tfidf)))
    with ThreadPoolExecutor(max_workers=side_by_side) as pool:
        return dict(zip(specs, pool.map(one, specs.values()), strict=True))


def score_together(df: DataFrame, detectors: dict[str, Detector], keep: Sequence[str]) -> DataFrame:
    """``keep``, ``method`` and ``p`` for every row of ``with_families`` and every detector, in one pass over the rows.

    Each row is turned into the inputs of each family once; the detectors add their probabilities to it one after the
    other, and the row leaves as an array of (method, p).
    """
    scored, vectors = df, {}
    for k, (name, d) in enumerate(detectors.items()):
        own = set(scored.columns)
        if d.tfidf is not None:
            if id(d.tfidf) not in vectors:
                vectors[id(d.tfidf)] = f"tfidf__{k}"
                scored = d.tfidf.vectors(scored, out=f"tfidf__{k}")
                own.add(f"tfidf__{k}")
            ready = scored.withColumn("features", F.col(vectors[id(d.tfidf)]))
        else:
            ready = _featurise(scored, d.spec, None, d.scaler)
        found = d.pipeline.transform(ready).withColumn(f"p__{k}", vector_to_array("probability")[1])
        scored = found.select(*[c for c in found.columns if c in own or c == f"p__{k}"])
    rows = F.array(*[F.struct(F.lit(n).alias("method"), F.col(f"p__{k}").alias("p")) for k, n in enumerate(detectors)])
    return scored.select(*keep, F.inline(rows))
