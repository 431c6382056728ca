"""The model registry: MLlib learners behind one fit / transform / save interface.

Training frames hold `_row_id`, `_label` (double), `features` (vector) and, where classes are to be
balanced, `_weight`. A fitted model adds `{prefix}prediction` and, for classes,
`{prefix}probability` as an array, keeping every other column.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml import classification as mlc, regression as mlr
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import new_path, staged
from . import boosting, forest, histograms, svm
from .evaluate import mean_vectors
from .neighbours import BROADCAST_BYTES, GATHERED, Index, collected, knn, stack, vote
from .split import simple_sample, with_folds
from .target import CLASSIFICATION, REGRESSION

# models whose scoring cost grows with their training rows; Job.max_fit_rows bounds these alone
SLOW_MODELS = ["knn"]
CALIBRATION_FOLDS = 5

CLASS_MODELS = [
    "logistic_regression", "decision_tree", "linear_svc", "knn",
    "random_forest", "adaboost", "gradient_boosting", "gbt_hist",
]
NUMBER_MODELS = [
    "linear_regression", "ridge", "lasso", "decision_tree",
    "random_forest", "adaboost", "gradient_boosting", "gbt_hist",
]
# fixed values: the search grids
_BOOST_GRID = {"n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.1, 0.2], "max_depth": [3, 5, 7]}
_TREE_GRID = {"max_depth": [None, 5, 10, 15, 20], "min_samples_split": [2, 5, 10]}
_FOREST_GRID = {"n_estimators": [50, 100, 200], "max_depth": [None, 5, 10, 15]}
_ADA_GRID = {"n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.1, 0.5, 1.0]}
GRIDS = {
    "logistic_regression": {"C": [0.01, 0.1, 1, 10]},
    "linear_svc": {"C": [0.01, 0.1, 1, 10]},
    "knn": {"n_neighbors": [3, 5, 7, 11], "weights": ["uniform", "distance"]},
    "linear_regression": {},
    "ridge": {"alpha": [0.01, 0.1, 1, 10, 100]},
    "lasso": {"alpha": [0.0001, 0.001, 0.01, 0.1, 1]},
    "decision_tree": _TREE_GRID,
    "random_forest": _FOREST_GRID,
    "adaboost": _ADA_GRID,
    "gradient_boosting": _BOOST_GRID,
    "gbt_hist": _BOOST_GRID,
}


def registry(task: str) -> list[str]:
    return CLASS_MODELS if task == CLASSIFICATION else NUMBER_MODELS


@dataclass
class Job:
    """What a fit needs besides the rows."""

    task: str
    n_classes: int = 0
    weighted: bool = False
    seed: int = 42
    max_fit_rows: int | None = None  # rank SLOW_MODELS on so many rows; off by default, and kept models see all rows
    full_rows: bool = False  # ignore max_fit_rows
    calibration_folds: int = CALIBRATION_FOLDS
    parallelism: int = 4  # fits in flight at once


def fit_learner(name: str, train: DataFrame, job: Job, params: dict | None = None):
    """Fit one model of the registry."""
    params = params or {}
    if name == "knn":
        return _fit_knn(train, job, params)
    if name == "adaboost":
        return _fit_adaboost(train, job, params)
    if name == "linear_svc":
        return _fit_svc(train, job, params)
    if name in ("decision_tree", "random_forest"):
        return _fit_trees(name, train, job, params)
    if name in ("gradient_boosting", "gbt_hist"):
        return _fit_boosted(name, train, job, params)
    estimator = (
        _class_estimator(name, train, job, params)
        if job.task == CLASSIFICATION
        else _number_estimator(name, train, params)
    )
    return MlModel(estimator.fit(train), job.n_classes)


def _class_estimator(name: str, train: DataFrame, job: Job, params: dict):
    common = {"featuresCol": "features", "labelCol": "_label"}
    weight = {"weightCol": "_weight"} if job.weighted else {}
    if name == "logistic_regression":
        return mlc.LogisticRegression(
            maxIter=1000,
            regParam=1 / (params.get("C", 1) * train.count()),
            standardization=False,
            **common,
            **weight,
        )
    raise KeyError(name)


def _number_estimator(name: str, train: DataFrame, params: dict):
    common = {"featuresCol": "features", "labelCol": "_label"}
    linear = {"standardization": False, **common}
    if name == "linear_regression":
        return mlr.LinearRegression(regParam=0.0, **linear)
    if name == "ridge":
        return ridge(train, params.get("alpha", 1.0))
    if name == "lasso":
        return mlr.LinearRegression(elasticNetParam=1.0, regParam=params.get("alpha", 1.0), maxIter=5000, **linear)
    raise KeyError(name)


def ridge(train: DataFrame, alpha: float) -> mlr.LinearRegression:
    """Penalty alpha on the sum of squares: MLlib divides the loss by n and scales the label by
    its population deviation, so the parameter is alpha / n * std."""
    facts = train.agg(F.count("*").alias("n"), F.stddev_pop("_label").alias("std")).first()
    return mlr.LinearRegression(
        featuresCol="features",
        labelCol="_label",
        elasticNetParam=0.0,
        standardization=False,
        solver="normal",
        regParam=alpha / facts["n"] * (facts["std"] or 0.0),
    )


def argmax(probability: Column) -> Column:
    return (F.array_position(probability, F.array_max(probability)) - 1).cast("double")


def _normalised(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.transform(values, lambda x: x / total)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _write_facts(spark: SparkSession, path: str, facts: dict) -> None:
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_facts(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


@dataclass
class MlModel:
    """Any MLlib model."""

    model: object
    n_classes: int = 0

    def transform(self, df: DataFrame, prefix: str = "") -> DataFrame:
        keep = df.columns
        out = self.model.transform(df)
        added = [F.col("prediction").alias(f"{prefix}prediction")]
        if self.n_classes:
            added.append(vector_to_array("probability").alias(f"{prefix}probability"))
        return out.select(*keep, *added)

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.model.write().overwrite().save(f"{path}/model")
        _write_facts(spark, f"{path}/facts", {"kind": "ml", "n_classes": self.n_classes})

    @staticmethod
    def load(spark: SparkSession, path: str, facts: dict) -> "MlModel":
        model = DefaultParamsReader.loadParamsInstance(f"{path}/model", spark)
        return MlModel(model, facts["n_classes"])


# -- trees ----------------------------------------------------------------------------------------


@dataclass
class TreeModel:
    """A decision tree or a forest, kept as node tables."""

    forest: forest.NodeForest

    def transform(self, df: DataFrame, prefix: str = "") -> DataFrame:
        return self.forest.transform(df, prefix)

    def save(self, path: str) -> None:
        self.forest.save_to(path)
        facts = {"kind": "trees", "n_classes": self.forest.n_classes, "trees": self.forest.trees}
        _write_facts(SparkSession.active(), f"{path}/facts", facts)

    @staticmethod
    def load(spark: SparkSession, path: str, facts: dict) -> "TreeModel":
        return TreeModel(forest.NodeForest(path, facts["n_classes"], facts["trees"]))


def _fit_trees(name: str, train: DataFrame, job: Job, params: dict) -> TreeModel:
    """A tree over all rows, or a forest over drawn rows; forests of classes look at the root of the number of features per node."""
    classes = job.n_classes if job.task == CLASSIFICATION else 0
    many = name == "random_forest"
    width = len(train.select(vector_to_array("features").alias("v")).first()["v"]) if many and classes else 0
    growth = forest.Growth(
        classes, params.get("n_estimators", 100) if many else 1, many, max(1, int(width**0.5)) if width else 0,
        params.get("max_depth"), params.get("min_samples_split", 2), job.seed,
    )
    rows = train if job.weighted or "_weight" not in train.columns else train.drop("_weight")
    return TreeModel(forest.fit(rows, growth, new_path(train.sparkSession, "forest")))


@dataclass
class BoostModel:
    """Boosted trees on histograms."""

    trees: histograms.HistModel

    def transform(self, df: DataFrame, prefix: str = "") -> DataFrame:
        return self.trees.transform(df, prefix)

    def save(self, path: str) -> None:
        _write_facts(SparkSession.active(), f"{path}/facts", self.trees.facts())

    @staticmethod
    def load(spark: SparkSession, path: str, facts: dict) -> "BoostModel":
        return BoostModel(histograms.HistModel.from_facts(facts))


def boost_settings(name: str, job: Job, params: dict) -> histograms.Boost:
    """gbt_hist: second-order splits with a penalty; gradient_boosting: splits by squared error, Newton leaves."""
    if job.task != CLASSIFICATION:
        task, outputs = "number", 1
    else:
        task, outputs = ("binary", 1) if job.n_classes <= 2 else ("classes", job.n_classes)
    names = {"n_estimators": "rounds", "learning_rate": "rate", "max_depth": "depth"}
    options = {names[k]: v for k, v in params.items()}
    made = histograms.hist_settings if name == "gbt_hist" else histograms.gradient_settings
    return made(task, outputs, **options)


def _fit_boosted(name: str, train: DataFrame, job: Job, params: dict) -> BoostModel:
    """Class weights are not used, as boosters take none."""
    return BoostModel(histograms.fit(train.drop("_weight"), boost_settings(name, job, params)))


# -- linear SVM with Platt scaling ---------------------------------------------------------------


@dataclass
class CalibratedSvc:
    """Margins turned into probabilities by one sigmoid per class; `coefficients` hold the constant last."""

    coefficients: list[list[float]]
    sigmoids: list[tuple[float, float]]
    n_classes: int

    def transform(self, df: DataFrame, prefix: str = "") -> DataFrame:
        probability = calibrated(svm.decision(F.col("features"), self.coefficients), self.sigmoids)
        out = df.withColumn(f"{prefix}probability", probability)
        return out.withColumn(f"{prefix}prediction", argmax(F.col(f"{prefix}probability")))

    def save(self, path: str) -> None:
        facts = {"kind": "svc", "n_classes": self.n_classes, "sigmoids": self.sigmoids, "coefficients": self.coefficients}
        _write_facts(SparkSession.active(), f"{path}/facts", facts)

    @staticmethod
    def load(spark: SparkSession, path: str, facts: dict) -> "CalibratedSvc":
        return CalibratedSvc(facts["coefficients"], [tuple(s) for s in facts["sigmoids"]], facts["n_classes"])


def calibrated(scores: list[Column], sigmoids: list[tuple[float, float]]) -> Column:
    each = [_sigmoid(F.lit(a) * m + F.lit(b)) for m, (a, b) in zip(scores, sigmoids)]
    if len(each) == 1:
        return F.array(1 - each[0], each[0])
    return _normalised(F.array(*each))


def platt(scores: list[Column], out_of_fold: DataFrame, positives: list[int]) -> list[tuple[float, float]]:
    """Slope and intercept per margin, fitted on rows whose margins come from models that never saw them."""
    sigmoids = []
    for score, positive in zip(scores, positives):
        rows = out_of_fold.select(
            array_to_vector(F.array(score)).alias("features"), (F.col("_label") == positive).cast("double").alias("_label")
        )
        fit = mlc.LogisticRegression(labelCol="_label", regParam=0.0).fit(rows)
        sigmoids.append((float(fit.coefficients[0]), float(fit.intercept)))
    return sigmoids


def _fit_svc(train: DataFrame, job: Job, params: dict) -> CalibratedSvc:
    """The classes' problems over all rows and without each fold are solved in shared passes."""
    c, folds = float(params.get("C", 1)), job.calibration_folds
    rows = train if job.weighted or "_weight" not in train.columns else train.drop("_weight")
    positives = [1] if job.n_classes == 2 else list(range(job.n_classes))
    folded = with_folds(rows, "_row_id", folds, "_label", job.seed, "_calibration").persist()
    try:
        problems = [svm.Problem(p, f) for f in (-1, *range(folds)) for p in positives]
        w = svm.solve(folded, problems, c, F.col("_calibration")).T.tolist()
        k = len(positives)
        margins = [svm.decision(F.col("features"), w[(f + 1) * k : (f + 2) * k]) for f in range(folds)]
        unseen = [F.element_at(F.array(*[margins[f][i] for f in range(folds)]), F.col("_calibration").cast("int") + 1) for i in range(k)]
        return CalibratedSvc(w[:k], platt(unseen, folded, positives), job.n_classes)
    finally:
        folded.unpersist()


# -- nearest neighbours ---------------------------------------------------------------------------


@dataclass
class KnnModel:
    """Training rows (id, vector, label) in the shared folder, and how to vote."""

    rows: DataFrame
    k: int
    weights: str
    n_classes: int
    size_bytes: int
    broadcast_bytes: int = BROADCAST_BYTES
    _shared: object = field(default=None, repr=False)

    def transform(self, df: DataFrame, prefix: str = "") -> DataFrame:
        if self.size_bytes <= self.broadcast_bytes:
            scored = df.withColumn(f"{prefix}probability", self._vote_udf()(vector_to_array("features")))
        else:
            # rows with one id have one content: ask once, give all of them the answer
            asked = df.select(F.col("_row_id").alias("id"), vector_to_array("features").alias("vector")).dropDuplicates(["id"])
            near = knn(asked, self.rows, self.k, broadcast_bytes=self.broadcast_bytes)
            labels = self.rows.select(F.col("id").alias("neighbour_id"), "label")
            shares = vote(near, labels, self.n_classes, self.weights).select(
                F.col("query_id").alias("_row_id"), F.col("probability").alias(f"{prefix}probability")
            )
            scored = df.join(shares, "_row_id", "left")
        return scored.withColumn(f"{prefix}prediction", argmax(F.col(f"{prefix}probability")))

    def _vote_udf(self):
        if self._shared is None:
            table, vectors = collected(self.rows.orderBy("id"), "vector")
            index = Index.of(vectors, np.arange(len(vectors)), self.k)
            self._shared = SparkSession.active().sparkContext.broadcast((index, table.column("label").to_numpy().astype(int)))
        shared, k, weights, n_classes = self._shared, self.k, self.weights, self.n_classes

        def shares(vectors: pd.Series) -> np.ndarray:
            index, labels = shared.value
            r, n, d = index.nearest(stack(vectors), k)
            w = np.ones(len(r))
            if weights == "distance":
                exact = np.zeros(len(vectors), bool)
                exact[r[d == 0]] = True
                w = np.where(exact[r], (d == 0).astype(float), 1 / np.where(d == 0, 1, d))
            out = np.zeros((len(vectors), n_classes))
            np.add.at(out, (r, labels[n]), w)
            return out / out.sum(axis=1, keepdims=True)

        @F.pandas_udf("array<double>")
        def votes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            held, size = [], 0
            for vectors in batches:
                held.append(vectors)
                size += len(vectors)
                if size >= GATHERED:
                    yield pd.Series(list(shares(pd.concat(held))))
                    held, size = [], 0
            if size:
                yield pd.Series(list(shares(pd.concat(held))))

        return votes

    def save(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        facts = {"kind": "knn", "k": self.k, "weights": self.weights, "n_classes": self.n_classes, "size_bytes": self.size_bytes}
        _write_facts(SparkSession.active(), f"{path}/facts", facts)

    @staticmethod
    def load(spark: SparkSession, path: str, facts: dict) -> "KnnModel":
        return KnnModel(
            spark.read.parquet(f"{path}/rows"), facts["k"], facts["weights"], facts["n_classes"], facts["size_bytes"]
        )


def _fit_knn(train: DataFrame, job: Job, params: dict) -> KnnModel:
    n = train.count()
    if job.max_fit_rows is not None and n > job.max_fit_rows and not job.full_rows:
        train, n = simple_sample(train, "_row_id", job.max_fit_rows, job.seed, rows=n), job.max_fit_rows
    rows = staged(
        train.select(F.col("_row_id").alias("id"), vector_to_array("features").alias("vector"), F.col("_label").alias("label")),
        "knn",
    )
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 1
    return KnnModel(
        rows, params.get("n_neighbors", 5), params.get("weights", "uniform"), job.n_classes, n * width * 8
    )


# -- AdaBoost ------------------------------------------------------------------------------------


@dataclass
class BoostedTrees:
    trees: list[tuple[float, dict]]
    n_classes: int  # 0 for regression

    def transform(self, df: DataFrame, prefix: str = "") -> DataFrame:
        with_x = df.withColumn("_x", vector_to_array("features"))
        if not self.n_classes:
            out = boosting.weighted_median(self.trees, F.col("_x"))
            return with_x.withColumn(f"{prefix}prediction", out).drop("_x")
        probability = boosting.samme_probability(self.trees, self.n_classes, F.col("_x"))
        scored = with_x.withColumn(f"{prefix}probability", probability).drop("_x")
        return scored.withColumn(f"{prefix}prediction", argmax(F.col(f"{prefix}probability")))

    def save(self, path: str) -> None:
        facts = {"kind": "boosted", "n_classes": self.n_classes, "trees": self.trees}
        _write_facts(SparkSession.active(), f"{path}/facts", facts)

    @staticmethod
    def load(spark: SparkSession, path: str, facts: dict) -> "BoostedTrees":
        return BoostedTrees([(w, r) for w, r in facts["trees"]], facts["n_classes"])


def _fit_adaboost(train: DataFrame, job: Job, params: dict) -> BoostedTrees:
    rounds, rate = params.get("n_estimators", 50), params.get("learning_rate", 1.0)
    if job.task == REGRESSION:
        return BoostedTrees(boosting.fit_r2(train, rounds, rate, seed=job.seed), 0)
    return BoostedTrees(boosting.fit_samme(train, job.n_classes, rounds, rate, job.seed), job.n_classes)


# -- ensembles -----------------------------------------------------------------------------------


@dataclass
class Voting:
    """Mean probability (argmax of it) or mean prediction of several fitted models."""

    members: list
    n_classes: int

    def transform(self, df: DataFrame, prefix: str = "") -> DataFrame:
        keep, out = df.columns, df
        for i, m in enumerate(self.members):
            out = m.transform(out, f"_m{i}_")
        if self.n_classes:
            mean = mean_vectors([F.col(f"_m{i}_probability") for i in range(len(self.members))])
            out = out.withColumn(f"{prefix}probability", mean)
            out = out.withColumn(f"{prefix}prediction", argmax(F.col(f"{prefix}probability")))
            return out.select(*keep, f"{prefix}prediction", f"{prefix}probability")
        total = sum((F.col(f"_m{i}_prediction") for i in range(len(self.members))), F.lit(0.0))
        return out.select(*keep, (total / len(self.members)).alias(f"{prefix}prediction"))

    def save(self, path: str) -> None:
        _save_members(path, self.members, {"kind": "voting", "n_classes": self.n_classes})

    @staticmethod
    def load(spark: SparkSession, path: str, facts: dict) -> "Voting":
        return Voting(_load_members(spark, path, facts), facts["n_classes"])


@dataclass
class Stacking:
    """A meta model over the predictions of fitted base models."""

    members: list
    meta: MlModel
    n_classes: int

    def transform(self, df: DataFrame, prefix: str = "") -> DataFrame:
        keep, out = df.columns, df
        for i, m in enumerate(self.members):
            out = m.transform(out, f"_m{i}_")
        outputs = meta_features(len(self.members), self.n_classes)
        out = out.withColumnRenamed("features", "_raw").withColumn("features", outputs)
        out = self.meta.transform(out, prefix)
        added = [f"{prefix}prediction"] + ([f"{prefix}probability"] if self.n_classes else [])
        return out.drop("features").withColumnRenamed("_raw", "features").select(*keep, *added)

    def save(self, path: str) -> None:
        self.meta.save(f"{path}/meta")
        _save_members(path, self.members, {"kind": "stacking", "n_classes": self.n_classes})

    @staticmethod
    def load(spark: SparkSession, path: str, facts: dict) -> "Stacking":
        return Stacking(
            _load_members(spark, path, facts), load_model(spark, f"{path}/meta"), facts["n_classes"]
        )


def meta_features(n_members: int, n_classes: int) -> Column:
    """Base outputs side by side: one probability for two classes, all of them for more."""
    if not n_classes:
        return array_to_vector(F.array(*[F.col(f"_m{i}_prediction") for i in range(n_members)]))
    first = 1 if n_classes == 2 else 0
    return array_to_vector(
        F.array(*[F.col(f"_m{i}_probability")[c] for i in range(n_members) for c in range(first, n_classes)])
    )


def _save_members(path: str, members: list, facts: dict) -> None:
    for i, m in enumerate(members):
        m.save(f"{path}/member-{i}")
    _write_facts(SparkSession.active(), f"{path}/facts", {**facts, "members": len(members)})


def _load_members(spark: SparkSession, path: str, facts: dict) -> list:
    return [load_model(spark, f"{path}/member-{i}") for i in range(facts["members"])]


def load_model(spark: SparkSession, path: str):
    """Any model saved with `.save(path)`."""
    facts = _read_facts(spark, f"{path}/facts")
    kinds = {
        "ml": MlModel, "svc": CalibratedSvc, "knn": KnnModel,
        "boosted": BoostedTrees, "voting": Voting, "stacking": Stacking, "trees": TreeModel, "hist": BoostModel,
    }
    return kinds[facts["kind"]].load(spark, path, facts)
