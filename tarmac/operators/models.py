"""One calibrated "at least t" model per threshold, on MLlib.

Boosted trees of MLlib stand in for the reference's learner; scores differ, the pipeline is the same:
balanced training rows, early stopping on a held-out part, calibration on unbalanced rows. Categories
enter as ordered target statistics, so they may have any number of values.
"""

from __future__ import annotations

import contextlib
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac import constants as C
from tarmac.functions.numbers import coerce_numeric
from tarmac.functions.ordinal import argmax_bin, expected_delay, ge_to_bins, severity
from tarmac.functions.text import categorical_fill
from tarmac.operators import importance
from tarmac.operators.impute import numeric_impute
from tarmac.operators.target_stats import apply_statistics, label_mean, ordered_statistics, value_statistics
from tarmac.schema import FLIGHT
from tarmac.session import materialize, scratch


@dataclass(frozen=True)
class TrainingSettings:
    iterations: int = 60
    depth: int = 5
    step: float = 0.1
    max_bins: int = 128
    seed: int = 42
    prior_weight: float = 1.0


@dataclass
class ThresholdModel:
    threshold: int
    trees: PipelineModel
    stats: DataFrame  # (feature, value, pos, n) of the training rows' categories
    prior: float
    prior_weight: float = 1.0
    calibrator: IsotonicRegressionModel | LogisticRegressionModel | None = None


@dataclass
class DelayModel:
    """The models of all thresholds with the features they read, in training order."""

    categorical: list[str]
    numeric: list[str]
    models: list[ThresholdModel] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)  # wanted, but the training table does not have them

    def save(self, path: str) -> None:
        """Every model below the path, and a registry table of what is there."""
        rows = []
        for m in self.models:
            m.trees.write().overwrite().save(f"{path}/trees/{m.threshold}")
            m.stats.write.mode("overwrite").parquet(f"{path}/stats/{m.threshold}")
            kind = "none"
            if m.calibrator is not None:
                kind = "isotonic" if isinstance(m.calibrator, IsotonicRegressionModel) else "sigmoid"
                m.calibrator.write().overwrite().save(f"{path}/calibrators/{m.threshold}")
            rows.append((m.threshold, kind, m.prior, m.prior_weight, self.categorical, self.numeric, self.dropped))
        schema = "threshold int, calibrator string, prior double, prior_weight double, categorical array<string>, numeric array<string>, dropped array<string>"
        spark = SparkSession.getActiveSession()
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/registry")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "DelayModel":
        rows = spark.read.parquet(f"{path}/registry").orderBy("threshold").collect()
        kinds = {"isotonic": IsotonicRegressionModel, "sigmoid": LogisticRegressionModel}
        out = cls(list(rows[0]["categorical"]), list(rows[0]["numeric"]), dropped=list(rows[0]["dropped"]))
        for r in rows:
            loader = kinds.get(r["calibrator"])
            out.models.append(
                ThresholdModel(
                    r["threshold"], PipelineModel.load(f"{path}/trees/{r['threshold']}"),
                    spark.read.parquet(f"{path}/stats/{r['threshold']}"), r["prior"], r["prior_weight"],
                    loader.load(f"{path}/calibrators/{r['threshold']}") if loader else None,
                )
            )
        return out


def prepare_frame(df: DataFrame, categorical: list[str], numeric: list[str], impute: str | None = "zero") -> DataFrame:
    """Every expected feature, typed and filled: texts Unknown, numbers by median or 0."""
    have = set(df.columns)
    texts = {f"f_{c}": categorical_fill(c) if c in have else F.lit("Unknown") for c in categorical}
    numbers = {f"f_{c}": coerce_numeric(c) if c in have else F.lit(None).cast("double") for c in numeric}
    typed = df.withColumns({**texts, **numbers})
    return numeric_impute(typed, list(numbers), impute) if impute and numbers else typed


def train_trees(
    train: DataFrame, label: str, threshold: int, categorical: list[str], numeric: list[str], settings=TrainingSettings(),
    held_out: str | None = None, row_id: str = FLIGHT.row_id,
) -> ThresholdModel:
    """Boosted trees; with a boolean ``held_out`` column training stops when that part gets worse.

    Training rows read a category as its ordered target statistic; held-out rows, like any later ones, read the
    statistics of all training rows. The prepared rows are written first, as boosting passes over them many times, and go when the
    trees are there. Row ids must be unique; a table without them gets some.
    """
    texts, numbers = [f"f_{c}" for c in categorical], [f"f_{c}" for c in numeric]
    identity = F.col(row_id) if row_id in train.columns else F.monotonically_increasing_id()
    filled = prepare_frame(train.withColumn("__row", identity), categorical, numeric, "median")
    mark = F.col(held_out).alias("__held") if held_out else F.lit(False).alias("__held")
    name = _encoded("{c}", threshold)
    inputs = [name.format(c=c) for c in texts] + numbers
    with contextlib.ExitStack() as written:
        with scratch(filled.select("__row", F.col(label).cast("int").alias("__label"), mark, *texts, *numbers), "train") as rows:
            fit, stop = rows.filter(~F.coalesce("__held", F.lit(False))), rows.filter("__held")
            prior = label_mean(fit, "__label")
            stats = materialize(value_statistics(fit, "__label", texts), "category-stats")
            coded = ordered_statistics(fit, "__label", texts, "__row", prior, settings.prior_weight, settings.seed, name) if texts else fit
            if held_out:
                later = apply_statistics(stop, {name: (stats, prior)}, texts, settings.prior_weight)
                coded = coded.unionByName(later)
            coded = written.enter_context(scratch(coded.select(F.col("__label").cast("double").alias("__y"), "__held", *inputs), "coded"))
        features = VectorAssembler(inputCols=inputs, outputCol="features")
        trees = GBTClassifier(
            labelCol="__y", featuresCol="features", maxIter=settings.iterations, maxDepth=settings.depth,
            stepSize=settings.step, maxBins=settings.max_bins, seed=settings.seed, subsamplingRate=1.0,
        )
        if held_out:
            trees = trees.setValidationIndicatorCol("__held")
        fitted = Pipeline(stages=[features, trees]).fit(coded)
    return ThresholdModel(threshold, fitted, stats, prior, settings.prior_weight)


def _encoded(column: str, threshold: int) -> str:
    return f"{column}_stat{threshold}"


def raw_scores(df: DataFrame, models: list[ThresholdModel], categorical: list[str], numeric: list[str], out: str = "__raw{thr}") -> DataFrame:
    """Adds the uncalibrated probability of each model. The rows are prepared, and each category is joined, once."""
    filled = prepare_frame(df, categorical, numeric)
    texts = [f"f_{c}" for c in categorical]
    tables = {_encoded("{c}", m.threshold): (m.stats, m.prior) for m in models}
    scored = apply_statistics(filled, tables, texts, models[0].prior_weight) if texts else filled
    made = []
    for m in models:
        made.append(out.format(thr=m.threshold))
        scored = m.trees.transform(scored).withColumn(made[-1], vector_to_array("probability")[1])
        scored = scored.drop("features", "rawPrediction", "probability", "prediction")
    return scored.select(*df.columns, *made)


def _score_counts(scored: DataFrame, label: str, score: str) -> DataFrame:
    return scored.dropna(subset=[score]).groupBy(F.col(score).alias("score")).agg(
        F.sum((F.col(label) == 1).cast("double")).alias("pos"), F.sum((F.col(label) == 0).cast("double")).alias("neg")
    )


def calibrate_isotonic(scored: DataFrame, label: str, score: str) -> IsotonicRegressionModel:
    """Monotone calibration. Equal scores are one weighted point, which leaves the fit unchanged."""
    points = _score_counts(scored, label, score).select(
        "score", (F.col("pos") / (F.col("pos") + F.col("neg"))).alias("rate"), (F.col("pos") + F.col("neg")).alias("weight")
    )
    return IsotonicRegression(featuresCol="score", labelCol="rate", weightCol="weight").fit(points)


def calibrate_sigmoid(scored: DataFrame, label: str, score: str) -> LogisticRegressionModel:
    """Platt scaling with smoothed targets, as weights on both classes of each distinct score."""
    counts = _score_counts(scored, label, score)
    sizes = counts.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    high = (F.col("__p") + 1) / (F.col("__p") + 2)
    low = F.lit(1.0) / (F.col("__n") + 2)
    sized = counts.withColumns({"__p": sizes["p"], "__n": sizes["n"]})
    ones = F.col("pos") * high + F.col("neg") * low
    total = F.col("pos") + F.col("neg")
    points = sized.select(
        F.col("score").alias("s"),
        F.explode(
            F.array(
                F.struct(F.lit(1.0).alias("label"), ones.alias("weight")),
                F.struct(F.lit(0.0).alias("label"), (total - ones).alias("weight")),
            )
        ).alias("t"),
    ).select("s", "t.label", "t.weight")
    assembled = VectorAssembler(inputCols=["s"], outputCol="features").transform(points)
    return LogisticRegression(weightCol="weight", maxIter=100).fit(assembled)


def apply_calibrator(df: DataFrame, calibrator, score: str, out: str) -> DataFrame:
    if calibrator is None:
        return df.withColumn(out, F.col(score))
    if isinstance(calibrator, LogisticRegressionModel):
        a, b = float(calibrator.coefficients[0]), float(calibrator.intercept)
        return df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col(score) * a + b))))
    model = calibrator.copy()
    model.setFeaturesCol(score)
    model.setPredictionCol("__cal")
    fitted = model.transform(df)
    return fitted.withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("__cal")))).drop("__cal")


def train_threshold_models(
    tables: dict[int, DataFrame], calibration: DataFrame, label: str, categorical: list[str], numeric: list[str],
    settings=TrainingSettings(), held_out: str | None = None, method: str | None = "isotonic", row_id: str = FLIGHT.row_id,
) -> DelayModel:
    """A model per threshold. ``label`` is a template such as ``y_dep_ge{thr}``.

    ``tables`` holds the balanced, size-limited training rows per threshold; ``calibration`` the
    unbalanced rows.
    """
    out = DelayModel(list(categorical), list(numeric))
    for thr, table in sorted(tables.items()):
        y = label.format(thr=thr)
        model = train_trees(table, y, thr, out.categorical, out.numeric, settings, held_out, row_id)
        if method:
            scored = raw_scores(calibration, [model], out.categorical, out.numeric, "__raw")
            fit = calibrate_isotonic if method == "isotonic" else calibrate_sigmoid
            model.calibrator = fit(scored, y, "__raw")
        out.models.append(model)
    return out


def score_ge(df: DataFrame, model: DelayModel) -> DataFrame:
    """Adds ``p_ge{t}`` for every threshold; columns the table lacks count as unknown."""
    scored = raw_scores(df, model.models, model.categorical, model.numeric)
    for m in model.models:
        scored = apply_calibrator(scored, m.calibrator, f"__raw{m.threshold}", f"p_ge{m.threshold}").drop(f"__raw{m.threshold}")
    return scored


def add_distribution(df: DataFrame) -> DataFrame:
    """Bins, most likely bin, expected minutes and severity from the four ``p_ge`` columns."""
    binned = df.withColumn("bin_proba", ge_to_bins("p_ge15", "p_ge30", "p_ge45", "p_ge60"))
    names = ("p_lt15", "p_15_30", "p_30_45", "p_45_60", "p_ge60_bin")
    return binned.withColumns(
        {
            **{n: F.col("bin_proba")[i] for i, n in enumerate(names)},
            "predicted_bin": argmax_bin("bin_proba"),
            "expected_delay_minutes": expected_delay("bin_proba"),
            "severity_score": severity("bin_proba"),
        }
    )


def split_gains(spark: SparkSession, model: DelayModel) -> DataFrame:
    """Share of the split gain per threshold and feature."""
    names = [*model.categorical, *model.numeric]
    rows = []
    for m in model.models:
        trees = next(s for s in m.trees.stages if isinstance(s, GBTClassificationModel))
        rows += [(m.threshold, n, float(v)) for n, v in zip(names, trees.featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(rows, "threshold int, feature string, split_gain double")


def feature_importance(model: DelayModel, rows: DataFrame, label: str = "y_dep_ge{thr}", row_id: str = FLIGHT.row_id, seed: int = 42) -> DataFrame:
    """(threshold, feature, importance, split_gain): how much the calibrated models' log-loss on ``rows`` rises when a feature is shuffled.

    Largest first within a threshold. A wanted feature that the training table did not have has nulls. ``rows``
    are scored once per feature: give a part of the evaluation rows if there are very many.
    """
    have = [c for c in [*model.categorical, *model.numeric] if c in rows.columns]
    labels = [label.format(thr=m.threshold) for m in model.models]
    narrow = materialize(rows.select(row_id, *labels, *have), "importance")
    pairs = {m.threshold: (y, f"p_ge{m.threshold}") for m, y in zip(model.models, labels, strict=True)}
    changes = importance.loss_changes(narrow, have, lambda df: score_ge(df, model), pairs, row_id, seed)
    spark = rows.sparkSession
    wanted = [(m.threshold, f) for m in model.models for f in [*model.categorical, *model.numeric, *model.dropped]]
    every = spark.createDataFrame(wanted, "threshold int, feature string")
    table = every.join(changes, ["threshold", "feature"], "left").join(split_gains(spark, model), ["threshold", "feature"], "left")
    return table.orderBy("threshold", F.desc_nulls_last("importance"), "feature")
