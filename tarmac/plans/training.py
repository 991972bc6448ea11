"""Training and evaluation of the threshold models on written feature tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac import constants as C
from tarmac.functions.numbers import delay_bin
from tarmac.functions.text import explain_reasons, format_probs
from tarmac.operators import filters, metrics, models, sampling
from tarmac.plans.config import PipelineConfig
from tarmac.schema import FLIGHT
from tarmac.session import materialize


def evaluation_halves(evaluation: DataFrame, cfg: PipelineConfig = PipelineConfig()) -> tuple[DataFrame, DataFrame]:
    """The unbalanced rows for calibration and those for evaluation; the same ones in every call."""
    halves = sampling.stratified_split(evaluation, "y_dep_ge15", [FLIGHT.row_id], {"cal": 0.5, "eval": 0.0}, cfg.seed, "__half")
    return halves.filter("__half <> 'eval'").drop("__half"), halves.filter("__half <> 'cal'").drop("__half")


def _training_parts(table: DataFrame, threshold: int, cfg: PipelineConfig) -> DataFrame:
    shares = {"stop": 0.2, "test": 0.2, "train": 0.0}
    return sampling.stratified_split(table, f"y_dep_ge{threshold}", [FLIGHT.row_id], shares, cfg.seed, "__part")


def test_parts(balanced: dict[int, DataFrame], cfg: PipelineConfig = PipelineConfig()) -> dict[int, DataFrame]:
    """The balanced rows of each threshold that ``train_departure`` neither fits nor stops on."""
    return {thr: _training_parts(table, thr, cfg).filter("__part = 'test'").drop("__part") for thr, table in balanced.items()}


def train_departure(
    balanced: dict[int, DataFrame], evaluation: DataFrame, cfg: PipelineConfig = PipelineConfig(),
    settings: models.TrainingSettings = models.TrainingSettings(),
) -> tuple[models.DelayModel, DataFrame]:
    """Models calibrated on one half of the unbalanced rows, and the other half for evaluation.

    ``evaluation`` and the features that the balanced tables come from should be written. The parts of a balanced table, which may
    have any number of rows, are cut where the features are read; fitting writes the columns it needs.
    """
    any_table = next(iter(balanced.values()))
    cats, nums, dropped = filters.select_feature_columns(any_table, cfg.categorical, cfg.numeric_features(), cfg.exclude_feature_prefixes)
    calibration, held_out = evaluation_halves(evaluation, cfg)
    tables = {}
    for thr, table in balanced.items():
        parts = _training_parts(table, thr, cfg).filter("__part <> 'test'")
        tables[thr] = parts.withColumn("__stop", F.col("__part") == "stop")
    model = models.train_threshold_models(
        tables, calibration, "y_dep_ge{thr}", cats, nums, settings, held_out="__stop", method="isotonic"
    )
    model.dropped = dropped
    return model, held_out


def train_arrival(
    features: DataFrame, categorical, numeric, cfg: PipelineConfig = PipelineConfig(target="arr", seed=1337),
    settings: models.TrainingSettings = models.TrainingSettings(), calibration_share: float = 0.15,
) -> tuple[models.DelayModel, DataFrame]:
    """Models with sigmoid calibration from the training period; the last days are evaluation."""
    marked = sampling.trailing_split(features, FLIGHT.date, cfg.eval_last_days, inclusive=True)
    period, evaluation = marked.filter("not is_eval").drop("is_eval"), marked.filter("is_eval").drop("is_eval")
    cats, nums, dropped = filters.select_feature_columns(features, categorical, numeric, cfg.exclude_feature_prefixes)
    out = models.DelayModel(cats, nums, dropped=dropped)
    for thr in cfg.thresholds:
        y = f"y_arr_ge{thr}"
        rows = period if cfg.max_rows is None else sampling.stratified_cap(period, y, [FLIGHT.row_id], cfg.max_rows, cfg.seed + thr)
        parts = sampling.stratified_split(
            rows, y, [FLIGHT.row_id], {"cal": calibration_share, "fit": 0.0}, cfg.seed + thr, "__part"
        )
        parts = materialize(parts, "parts")
        fit = parts.filter("__part <> 'cal'").drop("__part")
        cal = parts.filter("__part <> 'fit'").drop("__part")
        model = models.train_trees(fit, y, thr, cats, nums, settings)
        scored = models.raw_scores(cal, [model], cats, nums, "__raw")
        model.calibrator = models.calibrate_sigmoid(scored, y, "__raw")
        out.models.append(model)
    return out, evaluation


def evaluate(model: models.DelayModel, rows: DataFrame, label: str = "y_dep_ge{thr}") -> DataFrame:
    """AUC, AP, Youden point, log-loss, Brier and accuracy, one row per threshold.

    The scores are written first; each threshold and metric reads only its two columns.
    """
    scored = materialize(models.score_ge(rows, model), "scored")
    out = None
    for m in model.models:
        y, p = label.format(thr=m.threshold), f"p_ge{m.threshold}"
        ranked = metrics.ranking_scores(scored, y, p).withColumn("threshold", F.lit(m.threshold))
        point = metrics.probability_scores(scored, y, p).withColumn("threshold", F.lit(m.threshold))
        row = ranked.join(point, "threshold")
        out = row if out is None else out.unionByName(row)
    return out


def report_tables(sets: dict[str, DataFrame], label: str, p: str, bins: int = 10) -> dict[str, DataFrame]:
    """Tables on one threshold's scored sets of rows, each with the name of the set in ``rows_of``.

    ``scores`` has row counts, AUC, AP and the set's own best cut; ``classes`` precision, recall and F1 of each class
    and ``confusion`` the counts, both at the cut that is best (Youden) on the set ``calibration``;
    ``reliability`` has the bins of the predictions. A set without rows has scores of null and no other row. Rows
    without a label or a prediction do not count.
    """
    sets = {name: df.select(label, p).dropna() for name, df in sets.items()}
    cut = metrics.ranking_scores(sets["calibration"], label, p).select("youden_threshold").scalar()
    tables: dict[str, list[DataFrame]] = {"scores": [], "classes": [], "confusion": [], "reliability": []}
    for name, df in sets.items():
        sizes = df.agg(F.count("*").alias("rows"), F.count_if(F.col(label) == 1).alias("positives"))
        ranked = metrics.ranking_scores(df, label, p).withColumn("__one", F.lit(1))
        made = {
            "scores": ranked.join(sizes.withColumn("__one", F.lit(1)), "__one").drop("__one"),
            "classes": metrics.classification_report(df, label, p, cut).withColumn("cut", cut),
            "confusion": metrics.confusion_matrix(df, label, p, cut).withColumn("cut", cut),
            "reliability": metrics.reliability_table(df, label, p, bins),
        }
        for kind, table in made.items():
            tables[kind].append(table.withColumn("rows_of", F.lit(name)))
    return {kind: functools.reduce(DataFrame.unionByName, found) for kind, found in tables.items()}


def training_report(
    model: models.DelayModel, calibration: DataFrame, held_out: DataFrame, tests: dict[int, DataFrame] | None = None,
    label: str = "y_dep_ge{thr}", bins: int = 10,
) -> dict[str, DataFrame]:
    """``report_tables`` of all thresholds, with ``threshold``, and ``importance`` on the evaluation rows.

    ``tests`` are the balanced rows of each threshold that training left out (``test_parts``). Rows are scored once
    for all thresholds and written, narrow; the balanced ones once for each.
    """
    names = [c for m in model.models for c in (label.format(thr=m.threshold), f"p_ge{m.threshold}")]
    narrow = {n: materialize(models.score_ge(df, model).select(*names), "scored") for n, df in (("calibration", calibration), ("evaluation", held_out))}
    found: dict[str, list[DataFrame]] = {}
    for m in model.models:
        y, p = label.format(thr=m.threshold), f"p_ge{m.threshold}"
        sets = dict(narrow)
        if tests and m.threshold in tests:
            sets["balanced_test"] = materialize(models.score_ge(tests[m.threshold], model).select(y, p), "scored")
        for kind, table in report_tables(sets, y, p, bins).items():
            found.setdefault(kind, []).append(table.withColumn("threshold", F.lit(m.threshold)))
    report = {kind: functools.reduce(DataFrame.unionByName, tables) for kind, tables in found.items()}
    report["importance"] = models.feature_importance(model, held_out, label)
    return report


def save_with_report(model: models.DelayModel, report: dict[str, DataFrame], path: str) -> None:
    """The model, and each table of its report below ``report``, one small file each."""
    model.save(path)
    for kind, table in report.items():
        table.coalesce(1).write.mode("overwrite").parquet(f"{path}/report/{kind}")


def explain(scored: DataFrame, cfg: PipelineConfig = PipelineConfig(), delay: str = "DepDelayMinutes") -> DataFrame:
    """Evaluation rows with distribution, true bin, reasons and printed probabilities.

    The load factor and the weather code are optional inputs of the reasons; all others must be there.
    """
    longest, shortest = max(cfg.windows), cfg.windows[0]
    out = models.add_distribution(scored)
    needed = (
        f"flightnum_od_low_support_last{longest}d", f"flightnum_od_depdelay_mean_last{longest}", f"carrier_depdelay_mean_last{shortest}",
        f"carrier_origin_depdelay_mean_last{shortest}", "origin_congestion_3h_total",
    )
    missing = [c for c in needed if c not in out.columns]
    if missing:
        raise ValueError(f"the reasons need the features {missing}")
    optional = [F.col(c) if c in out.columns else F.lit(None) for c in ("od_month_load_factor_prev1", "origin_daily_weathercode")]
    reason = explain_reasons(*needed, *optional)
    return out.withColumns(
        {
            "true_bin": delay_bin(delay), "delay_explanation": reason,
            "delay_probabilities": format_probs("p_ge15", "p_ge30", "p_ge45", "p_ge60"),
        }
    )
