"""The whole preparation: fit on training rows, apply anywhere."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import kinds, q
from ..functions.hashing import null_flags
from ..operators import target as tgt
from ..operators.balance import NEIGHBOURS, SEVERE_RATIO, class_counts, smote
from ..operators.categories import CategoryStats
from ..operators.encode import Encoder, Scaler, align, fit_encoder, fit_scaler
from ..operators.importance import elbow_features, forest_importances
from ..operators.impute import Imputer, fit_imputer
from ..operators.outliers import Outliers, fit_outliers
from ..operators.profile import TrimReport, plan_trim, trim_log
from ..operators.rows import dedup_by_key, dedup_rows, drop_null_target
from ..operators.select import multicollinear_columns, weak_categories
from ..operators.split import TEST, TRAIN, stratified_sample, simple_sample, train_test_split
from ..operators.textfeat import TextFeatures, fit_text_features
from ..session import dropped, staged
from ..sources.tables import nan_to_null, validate_input

INTERNAL = ["_row_id", "_split", "_label"]


def content_id(df: DataFrame, columns: list[str] | None = None) -> Column:
    """128 bits of row content as text: the row identity of tables without a key."""
    names = columns or df.columns
    cols = [null_flags(names), *[q(c) for c in names]]
    return F.concat(F.hex(F.xxhash64(*cols)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *cols)))


def assemble(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    vector = array_to_vector(F.array(*[q(c).cast("double") for c in features]))
    return df.select(*[q(c) for c in keep], vector.alias("features"))


@dataclass
class PrepState:
    """Everything learnt, small enough to print: long rare lists live in lookup tables."""

    target: str
    target_type: str
    task: str
    metric: str
    imbalance_ratio: float | None = None
    use_class_weight: bool = False
    labels: list = field(default_factory=list)
    target_logged: bool = False
    inputs: dict[str, str] = field(default_factory=dict)
    trim: TrimReport = field(default_factory=TrimReport)
    text: TextFeatures = field(default_factory=TextFeatures)
    imputer: Imputer = field(default_factory=Imputer)
    selected_out: list[str] = field(default_factory=list)
    multicollinear: list[str] = field(default_factory=list)
    weak: list[str] = field(default_factory=list)
    outliers: Outliers = field(default_factory=Outliers)
    encoder: Encoder = field(default_factory=Encoder)
    scaler: Scaler = field(default_factory=Scaler)
    importances: dict[str, float] = field(default_factory=dict)
    features: list[str] = field(default_factory=list)
    balanced: int = 0
    balance_skipped: str | None = None
    rows_without_target: int = 0
    rows_sampled: int | None = None
    split_rows: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self), default=str)

    @staticmethod
    def from_json(text: str) -> "PrepState":
        d = json.loads(text)
        parts = {
            "trim": TrimReport, "text": TextFeatures, "imputer": Imputer,
            "outliers": Outliers, "encoder": Encoder, "scaler": Scaler,
        }
        for name, kind in parts.items():
            d[name] = kind(**d[name])
        d["text"].splits = {c: tuple(v) for c, v in d["text"].splits.items()}
        d["outliers"].bounds = {c: tuple(v) for c, v in d["outliers"].bounds.items()}
        return PrepState(**d)

    @property
    def classes(self) -> int:
        return len(self.labels) if self.task == tgt.CLASSIFICATION else 0


class PreparedModel:
    """Applies a fitted preparation; only projections and lookup joins, so streams work too."""

    def __init__(self, state: PrepState):
        self.state = state

    def features(self, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """The trained features of raw rows, in order, next to the columns to keep.

        Extra columns are ignored, absent ones take their fill value.
        """
        s = self.state
        held = [f"_keep_{i}" for i in range(len(keep))]
        present = [
            q(c).try_cast(t).alias(c) for c, t in s.inputs.items() if c in df.columns  # what cannot be read is missing
        ]
        df = nan_to_null(df.select(*[q(c).alias(h) for c, h in zip(keep, held)], *present))
        out = self.apply(df)
        named = align(out, s.features, held)
        return named.select(*[q(h).alias(c) for h, c in zip(held, keep)], *[q(c) for c in s.features])

    def apply(self, df: DataFrame) -> DataFrame:
        s = self.state
        df = s.imputer.transform(s.text.transform(df)).drop(*s.selected_out)
        return s.scaler.transform(s.encoder.transform(s.outliers.transform(df)))

    def score(self, fitted, df: DataFrame, keep: list[str] = ()) -> DataFrame:
        """Kept columns and the prediction under the target's name, in its original units."""
        s = self.state
        inner = [f"_id_{i}" for i in range(len(keep))]
        raw = df.select("*", *[q(c).alias(h) for c, h in zip(keep, inner)])
        known = [c for c in s.inputs if c in df.columns]
        raw = raw.withColumn("_row_id", content_id(raw, [*inner, *known]))
        vectors = assemble(self.features(raw, ["_row_id", *inner]), s.features, ["_row_id", *inner])
        out = fitted.transform(vectors)
        value = F.col("prediction")
        if s.classes:
            value = tgt.label_of(s.labels, value, _type(s.target_type))
        elif s.target_logged:
            value = tgt.unlog_target(value)
        added = [value.alias(s.target)] + ([F.col("probability")] if s.classes else [])
        return out.select(*[q(h).alias(c) for h, c in zip(inner, keep)], *added)

    def log(self, spark: SparkSession) -> DataFrame:
        """(seq, phase, action, column, value): every decision and why."""
        s = self.state
        rows = trim_log(s.trim)
        rows += [("task", "detected", s.target, s.task), ("task", "metric", s.target, s.metric)]
        rows += [("text", "date_parts", c, f) for c, f in s.text.date_formats.items()]
        rows += [("text", "date_parts", c, None) for c in s.text.time_columns]
        rows += [("text", "split", c, f"{d} x {n}") for c, (d, n) in s.text.splits.items()]
        rows += [("impute", s.imputer.methods[c], c, str(v)) for c, v in s.imputer.fills.items()]
        rows += [("impute", "none_text", c, None) for c in s.imputer.categories]
        rows += [("select", "multicollinear", c, None) for c in s.multicollinear]
        rows += [("select", "weak_category", c, None) for c in s.weak]
        rows += [("outliers", "clipped", c, f"[{lo}, {hi}]") for c, (lo, hi) in s.outliers.bounds.items()]
        rows += [("outliers", "flagged", c, None) for c in s.outliers.flags]
        rows += [("outliers", "rare_folded", c, str(len(v))) for c, v in s.outliers.rare.items()]
        rows += [("outliers", "rare_folded", c, "lookup") for c in s.outliers.rare_lookup]
        rows += [("outliers", "log1p", c, None) for c in s.outliers.logged]
        if s.target_logged:
            rows.append(("outliers", "target_log1p", s.target, None))
        rows += [("encode", "target_mean", c, None) for c in s.encoder.target_encoded]
        rows += [("encode", "one_hot", c, str(len(v))) for c, v in s.encoder.one_hot.items()]
        rows += [("scale", "zero_variance", c, None) for c in s.scaler.dropped]
        rows = [("input", "null_target_rows", s.target, str(s.rows_without_target)), *rows]
        if s.rows_sampled is not None:
            rows.append(("sample", "rows_kept", None, str(s.rows_sampled)))
        rows += [("split", "rows", part, str(n)) for part, n in s.split_rows.items()]
        if s.use_class_weight:
            rows.append(("task", "class_weights", s.target, str(s.imbalance_ratio)))
        if s.balanced:
            rows.append(("balance", "synthetic_rows", None, str(s.balanced)))
        if s.balance_skipped:
            rows.append(("balance", "skipped", None, s.balance_skipped))
        rows += [("importance", "kept", c, str(s.importances.get(c))) for c in s.features]
        return spark.createDataFrame(
            [(i, *r) for i, r in enumerate(rows)],
            "seq long, phase string, action string, column string, value string",
        )

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        lookups = {}
        for i, (c, source) in enumerate(self.state.outliers.rare_lookup.items()):
            lookups[c] = f"{path}/rare-{i}"
            spark.read.parquet(source).write.mode("overwrite").parquet(lookups[c])
        facts = json.loads(self.state.to_json())
        facts["outliers"]["rare_lookup"] = lookups
        spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode(
            "overwrite"
        ).text(f"{path}/state")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "PreparedModel":
        text = spark.read.text(f"{path}/state", wholetext=True).first()["value"]
        return PreparedModel(PrepState.from_json(text))


def _type(text: str) -> T.DataType:
    return T._parse_datatype_string(text)


@dataclass
class Prepared:
    """A fitted preparation with its training and test rows as (_row_id, _label, _synthetic, features)."""

    model: PreparedModel
    train: DataFrame
    test: DataFrame

    @property
    def state(self) -> PrepState:
        return self.model.state

    def cleaned(self, synthetic: bool = False) -> DataFrame:
        """Train and test rows as named columns with the target, for export; with `synthetic` also the made-up ones, marked."""
        s = self.state
        both = self.train.withColumn("_split", F.lit(TRAIN)).unionByName(self.test.withColumn("_split", F.lit(TEST)))
        both = both if synthetic else both.where("not _synthetic")
        x = vector_to_array("features")
        label = F.col("_label")
        if s.classes:
            label = tgt.label_of(s.labels, label, _type(s.target_type))
        elif s.target_logged:
            label = tgt.unlog_target(label)
        return both.select(
            "_row_id", "_split", *(["_synthetic"] if synthetic else []), *[x[i].alias(c) for i, c in enumerate(s.features)], label.alias(s.target)
        )


@dataclass
class Preparer:
    """Settings of a preparation; `fit` runs it."""

    target: str
    test_size: float = 0.2
    key_cols: list[str] = field(default_factory=list)
    leakage_cols: list[str] = field(default_factory=list)
    keep_cols: list[str] = field(default_factory=list)
    order_by: list[str] | None = None
    top_n: int | None = None
    max_rows: int | None = None
    seed: int = 42
    approx: bool = False
    balance: bool = True
    trees: int = 100
    tree_depth: int | None = None

    def fit(self, df: DataFrame) -> Prepared:
        validate_input(df, self.target, self.test_size)
        kinds(df, skip=[self.target])
        all_rows = df.count()
        df = nan_to_null(drop_null_target(df, self.target))
        rows_in = df.count()
        unique = dedup_by_key(df, self.key_cols, self.order_by) if self.key_cols else dedup_rows(df)
        keys = [c for c in self.key_cols if c in df.columns]
        row_id = q(keys[0]).cast("string") if len(keys) == 1 else content_id(df, keys or None)
        # the shuffled table is written once: the profile, the trim and every later phase scan it
        table = table_on_disk = staged(unique.withColumn("_row_id", row_id), "unique")
        report = plan_trim(
            table, self.target, self.key_cols, self.leakage_cols, self.keep_cols, ["_row_id"]
        )
        report.rows_in = rows_in
        table = table.drop(*report.dropped)
        state = self._task(table, report)
        state.rows_without_target = all_rows - rows_in
        table = self._sampled(table, state)
        inputs = [f for f in table.schema.fields if f.name not in (self.target, "_row_id")]
        state.inputs = {f.name: f.dataType.simpleString() for f in inputs}
        frame = self._split(table, state)
        cached: list[DataFrame] = []
        dropping = [table_on_disk]
        try:
            return self._fit_phases(frame, state, cached, dropping)
        finally:
            for held in cached:
                held.unpersist()
            dropped(*dropping)

    def _task(self, table: DataFrame, report: TrimReport) -> PrepState:
        task = tgt.detect_task(table, self.target)
        kind = table.schema[self.target].dataType.simpleString()
        if task == tgt.REGRESSION:
            facts = tgt.regression_metric(table, self.target).first()
            state = PrepState(self.target, kind, task, "r2", trim=report)
            state.target_logged = facts["log_transform_target"]
            return state
        facts = tgt.class_metric(table, self.target).first()
        state = PrepState(self.target, kind, task, facts["primary_metric"], trim=report)
        state.imbalance_ratio = facts["imbalance_ratio"]
        state.use_class_weight = facts["use_class_weight"]
        state.labels = tgt.label_list(table, self.target)
        return state

    def _sampled(self, table: DataFrame, state: PrepState) -> DataFrame:
        if self.max_rows is None or state.trim.rows_out <= self.max_rows:
            return table
        state.rows_sampled = self.max_rows
        if state.task == tgt.CLASSIFICATION:
            return stratified_sample(table, "_row_id", self.target, self.max_rows, self.seed)
        return simple_sample(table, "_row_id", self.max_rows, self.seed, rows=state.trim.rows_out)

    def _split(self, table: DataFrame, state: PrepState) -> DataFrame:
        if state.task == tgt.CLASSIFICATION:
            label = tgt.label_index(state.labels, q(self.target), table.schema[self.target].dataType)
        else:
            label = q(self.target).cast("double")
        labelled = table.withColumn("_label", label).drop(self.target)
        return train_test_split(labelled, "_row_id", self.test_size, self.seed)

    def _fit_phases(self, frame: DataFrame, state: PrepState, cached: list[DataFrame], dropping: list[DataFrame]) -> Prepared:
        regression = state.task == tgt.REGRESSION

        def train(df: DataFrame) -> DataFrame:
            return df.where(F.col("_split") == TRAIN)

        state.text = fit_text_features(train(frame), INTERNAL)
        frame = state.text.transform(frame)
        state.imputer = fit_imputer(train(frame), INTERNAL, self.approx)
        filled = state.imputer.transform(frame).persist()
        cached.append(filled)
        fit_rows = train(filled)
        state.split_rows = {r["_split"]: r["count"] for r in filled.groupBy("_split").count().collect()}
        n_train = state.split_rows.get(TRAIN, 0)

        numbers, categories = list(state.imputer.fills), list(state.imputer.categories)
        state.multicollinear = multicollinear_columns(fit_rows, numbers, "_label")
        # counted once and written once; tests, rare values and encodings are sums over it
        stats = self._category_stats(fit_rows, categories, regression, dropping)
        state.weak = weak_categories(stats, categories, regression)
        state.selected_out = [*state.multicollinear, *state.weak]
        numbers = [c for c in numbers if c not in state.selected_out]
        categories = [c for c in categories if c not in state.selected_out]
        if not numbers and not categories:
            raise ValueError("no feature column is left after statistical selection")
        kept = filled.drop(*state.selected_out)

        state.outliers = fit_outliers(train(kept), numbers, categories, self.approx, n_train, stats)
        capped = state.outliers.transform(kept)
        if regression:
            state.target_logged = tgt.should_log_target(train(capped), "_label", state.target_logged)
            if state.target_logged:
                capped = capped.withColumn("_label", tgt.log_target(F.col("_label")))
        encodings = stats.only(categories).encodings(state.target_logged, fold=True) if categories else None
        state.encoder = fit_encoder(
            train(capped), [*numbers, *state.outliers.flag_columns], categories, "_label", encodings
        )
        encoded = state.encoder.transform(capped)
        state.scaler = fit_scaler(train(encoded), state.encoder.outputs)
        scaled = state.scaler.transform(encoded)
        columns = [c for c in state.encoder.outputs if c not in state.scaler.dropped]

        vectors = assemble(scaled, columns, INTERNAL).persist()
        cached.append(vectors)
        fit_rows = vectors.where(F.col("_split") == TRAIN).drop("_split")
        test_rows = vectors.where(F.col("_split") == TEST).drop("_split")
        if self.balance and not regression:
            fit_rows = self._balanced(fit_rows, state)
        # the oversampled rows cost joins; write them once before the learners iterate
        if state.balanced:
            fit_rows = staged(fit_rows, "balanced")
            dropping.append(fit_rows)
        table = forest_importances(fit_rows, columns, state.classes, self.trees, self.tree_depth, self.seed)
        state.importances = {r["feature"]: r["importance"] for r in table.collect()}
        state.features = elbow_features(table, self.top_n)
        places = [columns.index(c) for c in state.features]

        def cut(df: DataFrame) -> DataFrame:
            x = vector_to_array("features")
            made = F.col("_synthetic") if "_synthetic" in df.columns else F.lit(False)
            return df.select("_row_id", "_label", made.alias("_synthetic"), array_to_vector(F.array(*[x[i] for i in places])).alias("features"))

        train_out, test_out = staged(cut(fit_rows), "train"), staged(cut(test_rows), "test")
        return Prepared(PreparedModel(state), train_out, test_out)

    def _category_stats(self, rows: DataFrame, columns: list[str], regression: bool, dropping: list[DataFrame]) -> CategoryStats | None:
        if not columns:
            return None
        logged = tgt.log_target(F.col("_label")) if regression else None
        cells = staged(CategoryStats.of(rows, columns, "_label", not regression, logged).cells, "categories")
        dropping.append(cells)
        return CategoryStats(cells)

    def _balanced(self, rows: DataFrame, state: PrepState) -> DataFrame:
        """Over-sample when the target is severely imbalanced; rows that cannot be stay."""
        if not (state.imbalance_ratio or 0) > SEVERE_RATIO:  # of the whole table, rounded
            return rows
        counts = class_counts(rows, "_label")
        if len(counts) < 2 or min(counts.values()) <= NEIGHBOURS:
            state.balance_skipped = f"smallest class has {min(counts.values())} rows"
            return rows
        arrays = rows.withColumn("features", vector_to_array("features"))
        out = smote(arrays, "_row_id", "_label", "features", seed=self.seed)
        state.balanced = max(counts.values()) * len(counts) - sum(counts.values())
        return out.withColumn("features", array_to_vector("features"))
