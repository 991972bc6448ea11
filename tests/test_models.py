"""Ordered target statistics and loss changes against plain Python, and models on categories with many values."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tarmac import session
from tarmac.operators import importance, metrics, models
from tarmac.operators.target_stats import apply_statistics, label_mean, ordered_statistics, value_statistics
from tarmac.plans import training
from tarmac.queries import pipelines

QUICK = models.TrainingSettings(iterations=5, depth=3)


def test_ordered_statistics_by_hand(spark):
    draw = random.Random(4)
    rows = [(i, "hot" if i % 3 else (None if i % 5 == 0 else f"v{i % 40}"), draw.random() < 0.4) for i in range(3000)]
    df = spark.createDataFrame([(i, c, int(y)) for i, c, y in rows], "id long, c string, y int").repartition(6)
    prior = label_mean(df, "y")
    got = {r.id: r.c_stat for r in ordered_statistics(df, "y", ["c"], "id", prior, weight=2.0, seed=7).collect()}
    seen, want = {}, {}
    for i, c, y in sorted(rows, key=lambda r: hashlib.md5(f"7|{r[0]}".encode()).hexdigest()):
        pos, n = seen.get(c or "Unknown", (0, 0))
        want[i] = (pos + 2 * prior) / (n + 2)
        seen[c or "Unknown"] = (pos + y, n + 1)
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-12) for i in want)


def test_unknown_values_get_the_prior(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 0), (3, None, 1)], "id long, c string, y int")
    stats = value_statistics(df, "y", ["c"])
    asked = spark.createDataFrame([("a",), ("new",), (None,)], "c string")
    found = {r.c: (r.c_1, r.c_2) for r in apply_statistics(asked, {"{c}_1": (stats, 0.5), "{c}_2": (stats.filter("value = 'a'"), 0.2)}, ["c"]).collect()}
    assert found == {"a": (0.5, 1.2 / 3), "new": (0.5, 0.2), None: (0.75, 0.2)}
    nothing = ordered_statistics(df.filter("1 = 0"), "y", ["c"], "id", label_mean(df.filter("1 = 0"), "y"))
    assert nothing.collect() == []


def planted(spark, n, pairs, effect):
    """Rows whose late share depends on the pair by ``effect``, or not at all."""
    draw = random.Random(11)
    high = [draw.random() < 0.5 for _ in range(pairs)]
    rows = []
    for i in range(n):
        pair = draw.randrange(pairs)
        late = draw.random() < 0.5 + (effect if high[pair] else -effect)
        rows.append((i, f"p{pair}", draw.random(), int(late)))
    return spark.createDataFrame(rows, "flight_id long, od_pair string, x double, y_dep_ge15 int")


def auc(df, model):
    return metrics.ranking_scores(models.score_ge(df, model), "y_dep_ge15", "p_ge15").first()["auc"]


@pytest.fixture(scope="module")
def many_pairs(spark):
    rows = planted(spark, 40_000, 5_000, 0.45)
    train, rest = rows.filter("flight_id % 10 < 8"), rows.filter("flight_id % 10 >= 8")
    model = models.train_threshold_models({15: train}, rest, "y_dep_ge{thr}", ["od_pair"], ["x"], QUICK, method="sigmoid")
    return model, rest


def test_five_thousand_values_of_a_category(many_pairs):
    model, rest = many_pairs
    assert auc(rest, model) > 0.9


def test_labels_do_not_leak_into_training(spark):
    rows = planted(spark, 6_000, 5_000, 0.0)
    model = models.train_threshold_models({15: rows.filter("flight_id % 2 = 0")}, rows, "y_dep_ge{thr}", ["od_pair"], ["x"], QUICK, method=None)
    coded = ordered_statistics(rows.filter("flight_id % 2 = 0"), "y_dep_ge15", ["od_pair"], "flight_id", 0.5)
    late, early = (coded.filter(f"y_dep_ge15 = {y}").agg(F.avg("od_pair_stat")).first()[0] for y in (1, 0))
    assert abs(late - early) < 0.02
    assert 0.45 < auc(rows.filter("flight_id % 2 = 1"), model) < 0.55


def test_planted_feature_ranks_first_and_noise_is_zero(many_pairs):
    model, rest = many_pairs
    table = {r.feature: r for r in models.feature_importance(model, rest).collect()}
    assert table["od_pair"].importance > 0.1 and abs(table["x"].importance) < 0.01


def test_saved_models_score_alike(spark, many_pairs, tmp_path):
    model, rest = many_pairs
    model.save(str(tmp_path / "m"))
    again = models.DelayModel.load(spark, str(tmp_path / "m"))
    some = rest.filter("flight_id % 100 = 9")
    scores = lambda m: {r.flight_id: r.p_ge15 for r in models.score_ge(some, m).collect()}
    assert scores(again) == scores(model)


def test_loss_changes_by_hand(spark):
    draw = random.Random(2)
    rows = [(i, draw.random(), draw.random(), draw.random() < 0.3) for i in range(2000)]
    df = spark.createDataFrame([(i, a, b, int(y)) for i, a, b, y in rows], "id long, a double, b double, y int").repartition(5)
    score = lambda t: t.withColumn("p", F.expr("0.05 + 0.9 * a * a"))
    got = {r.feature: r.importance for r in importance.loss_changes(df, ["a", "b"], score, {1: ("y", "p")}, "id", seed=3).collect()}
    order = lambda s: sorted(rows, key=lambda r: hashlib.md5(f"3|{s}|{r[0]}".encode()).hexdigest())
    loss = lambda a, y: -math.log(0.05 + 0.9 * a * a if y else 1 - (0.05 + 0.9 * a * a))
    want = sum(loss(d[1], r[3]) - loss(r[1], r[3]) for r, d in zip(order("own"), order("donor"), strict=True)) / len(rows)
    assert math.isclose(got["a"], want, rel_tol=1e-9) and abs(got["b"]) < 1e-12
    donors = importance.with_donors(df, ["a"], "id").select(F.col("__donor.a")).collect()
    assert sorted(r[0] for r in donors) == sorted(r[1] for r in rows)


def test_models_as_a_table_score_like_the_models(spark, many_pairs):
    from tarmac.operators.model_table import model_table, score_by_model

    model, rest = many_pairs
    train = planted(spark, 3_000, 50, 0.3).withColumns({"z": F.expr("x * x - flight_id % 7"), "y_dep_ge15": F.expr("cast(x > 0.6 or flight_id % 11 = 0 as int)")})
    second = models.train_threshold_models({15: train}, train, "y_dep_ge{thr}", ["od_pair"], ["x", "z"], QUICK, method="isotonic")
    third = models.train_threshold_models({15: train}, train, "y_dep_ge{thr}", [], ["z"], QUICK, method=None)
    registry = {f"k{i}": (model, second, third)[i % 3] for i in range(200)}
    rows = rest.filter("flight_id % 4 = 1").withColumns(
        {"model_id": F.expr("if(flight_id % 9 = 0, null, concat('k', flight_id % 210))"), "z": F.expr("if(flight_id % 5 = 0, null, x - 1.5)"), "od_pair": F.expr("if(flight_id % 13 = 0, 'new', od_pair)")}
    )
    got = {r.flight_id: r for r in score_by_model(rows, model_table(spark, registry)).collect()}
    assert len(got) == rows.count()
    want = {}
    for key, m in (("0", model), ("1", second), ("2", third)):
        part = rows.filter(f"cast(substr(model_id, 2) as int) < 200 and cast(substr(model_id, 2) as int) % 3 = {key}")
        want |= {r.flight_id: r.p_ge15 for r in models.score_ge(part, m).collect()}
    assert want and all(math.isclose(got[i].p_ge15, p, rel_tol=1e-9, abs_tol=1e-12) for i, p in want.items())
    assert all(r.p_ge15 is None for i, r in got.items() if i not in want)
    assert len({round(want[i], 6) for i in want}) > 20
    with pytest.raises(ValueError):
        model_table(spark, {})


def test_training_report_by_hand(spark, tmp_path):
    draw = random.Random(3)
    rows = [(i, draw.choice("ab"), round(draw.random(), 1), int(draw.random() < 0.4)) for i in range(600)]
    df = spark.createDataFrame(rows, "flight_id long, od_pair string, x double, y_dep_ge15 int")
    fit, cal, held = (df.filter(f"flight_id % 3 = {k}") for k in range(3))
    model = models.train_threshold_models({15: fit}, cal, "y_dep_ge{thr}", ["od_pair"], ["x"], QUICK)
    report = training.training_report(model, cal, held, {15: fit})
    training.save_with_report(model, report, str(tmp_path / "m"))
    saved = {k: spark.read.parquet(str(tmp_path / "m" / "report" / k)).collect() for k in report}
    assert {r.threshold for t in saved.values() for r in t} == {15} and saved["importance"]
    for name, part in (("calibration", cal), ("evaluation", held), ("balanced_test", fit)):
        scored = [(r.y_dep_ge15, r.p_ge15) for r in models.score_ge(part, model).collect()]
        cut = {r.cut for r in saved["confusion"]}.pop()
        want = {}
        for y, p in scored:
            want[y, int(p >= cut)] = want.get((y, int(p >= cut)), 0) + 1
        assert {(r.y, r.pred): r.n for r in saved["confusion"] if r.rows_of == name} == want
        size = next(r for r in saved["scores"] if r.rows_of == name)
        assert (size.rows, size.positives) == (200, sum(y for y, _ in scored))
        assert sum(r["count"] for r in saved["reliability"] if r.rows_of == name) == 200
        if name == "calibration":
            rate = lambda t, c: sum(y == c and p >= t for y, p in scored) / sum(y == c for y, _ in scored)
            best = max((rate(t, 1) - rate(t, 0), t) for t in {p for _, p in scored})
            assert math.isclose(best[0], rate(cut, 1) - rate(cut, 0), abs_tol=1e-12)
    nothing = training.report_tables({"calibration": held.withColumn("p", F.lit(0.5)), "empty": held.filter("1 = 0").withColumn("p", F.lit(0.5))}, "y_dep_ge15", "p")
    assert {r.rows_of for r in nothing["confusion"].collect()} == {"calibration"}
    assert {r.rows_of: r.rows for r in nothing["scores"].collect()} == {"calibration": 200, "empty": 0}


def test_parts_left_out_of_training(spark):
    rows = spark.range(1000).select(F.col("id").alias("flight_id"), (F.col("id") % 2).cast("int").alias("y_dep_ge15"))
    left = training.test_parts({15: rows})[15]
    assert left.columns == rows.columns and left.count() == 200
    assert {r.flight_id for r in left.collect()} == {r.flight_id for r in training.test_parts({15: rows.repartition(7)})[15].collect()}
    cal, held = training.evaluation_halves(rows)
    assert cal.count() == held.count() == 500 and cal.join(held, "flight_id").count() == 0


def test_registered_training_takes_every_balanced_row(spark, monkeypatch):
    day = (F.col("id") % 365).cast("int")
    rows = spark.range(60_000).select(
        F.col("id").cast("string").alias("flight_id"), F.date_add(F.lit("2024-01-01").cast("date"), day).alias("FlightDate"),
        *[(F.col("id") % m == 0).cast("int").alias(f"y_dep_ge{t}") for t, m in ((15, 2), (30, 3), (45, 4), (60, 100))],
    )
    taken = {}
    monkeypatch.setattr(pipelines, "_trained", {})
    monkeypatch.setattr(pipelines, "training_features", lambda *_: rows)
    monkeypatch.setattr(pipelines, "train_departure", lambda balanced, *_: taken.update({t: table.count() for t, table in balanced.items()}))
    pipelines.trained(spark, "all rows")
    pool = [i for i in range(60_000) if i % 365 <= 364 - 90]
    late = {t: sum(i % m == 0 for i in pool) for t, m in ((15, 2), (30, 3), (45, 4), (60, 100))}
    assert taken == {t: 2 * min(n, len(pool) - n) for t, n in late.items()} and taken[15] > 40_000


def test_written_rows_of_a_training_go(many_pairs, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda spark, purpose: f"{tmp_path}/{purpose}")
    models.train_trees(many_pairs[1].limit(500), "y_dep_ge15", 15, ["od_pair"], ["x"], QUICK)
    assert {p.name for p in tmp_path.iterdir()} == {"category-stats"}
