"""Queries: whole feature pipelines, training and batch prediction."""

from __future__ import annotations

import functools
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac import fixtures as X
from tarmac.constants import DEPARTURE_WINDOWS, THRESHOLDS
from tarmac.functions.numbers import threshold_labels
from tarmac.operators import importance, joins, models, sampling, target_stats
from tarmac.plans.arrival import arrival_features
from tarmac.plans.config import PipelineConfig
from tarmac.plans.departure import departure_features, split_and_balance
from tarmac.plans.enrich import enrich, history_pool
from tarmac.plans.serving import batch_predict
from tarmac.plans.training import evaluate, explain, report_tables, train_arrival, train_departure
from tarmac.queries import evaluation as E
from tarmac.queries.history import _BASELINE_COLS, _BASELINE_SQL, _KEY_SQL, _SAME, SLIP_SQL, _stats_sql
from tarmac.queries.registry import on_flights, on_flights_utc, query, round_columns
from tarmac.queries.relations import _near_sql
from tarmac.queries.scalars import _TG
from tarmac.schema import FLIGHT
from tarmac.session import materialize

W4 = DEPARTURE_WINDOWS
CODES = X._sql_list(X.AIRPORTS)


def airport_table(spark, sf):
    """The ten airports that suppliers are at."""
    s = X.table(spark, sf, "supplier")
    return s.select(
        X._pick(X.AIRPORTS, F.expr("s_suppkey % 10")).alias("IATA"), X._pick(X.ZONES, F.expr("s_suppkey % 10")).alias("Timezone")
    ).distinct()


def raw_flights(spark, sf):
    return X.flights(spark, sf).drop("Origin_TZ", "Dest_TZ", "dep_dt_local", "arr_dt_local")


_WX = f""", wx AS (SELECT {CODES}[o_custkey % 10 + 1] AS airport, CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS m FROM orders GROUP BY ALL),
hx AS (SELECT {CODES}[o_custkey % 10 + 1] AS airport, CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS hr, max(o_totalprice) AS m FROM orders GROUP BY ALL)"""


def weather_tables(spark, sf):
    o = X.table(spark, sf, "orders").withColumn("airport", X._pick(X.AIRPORTS, F.expr("o_custkey % 10")))
    daily = o.groupBy("airport", F.col("o_orderdate").cast("date").alias("date")).agg(F.max("o_totalprice").alias("temperature_2m_max"))
    hour = F.col("o_orderdate").cast("timestamp_ntz") + F.expr("make_dt_interval(0, cast(o_orderkey % 24 as int))")
    hourly = o.groupBy("airport", hour.alias("hour_utc")).agg(F.max("o_totalprice").alias("temperature_2m"))
    return daily, hourly


@query(
    "enrich",
    on_flights_utc(
        """SELECT flight_id, dep_utc, arr_utc, Aircraft_Age_Bucket, o.m AS origin_temperature_2m_max, d.m AS dest_temperature_2m_max, ho.m AS origin_dep_temperature_2m
        FROM (SELECT *, CASE WHEN y IS NULL THEN 'Unknown' WHEN year(FlightDate) - y <= 5 THEN '0-5' WHEN year(FlightDate) - y <= 10 THEN '6-10'
            WHEN year(FlightDate) - y <= 15 THEN '11-15' ELSE '16+' END AS Aircraft_Age_Bucket FROM flights_utc
          LEFT JOIN (SELECT CASE WHEN s_suppkey % 8 = 0 THEN 'X' ELSE 'N' END || s_suppkey AS t, 1975 + s_suppkey % 25 AS y FROM supplier) ON t = Tail_Number) f
        LEFT JOIN wx o ON o.airport = f.Origin AND o.day = f.FlightDate LEFT JOIN wx d ON d.airport = f.Dest AND d.day = f.FlightDate
        LEFT JOIN hx ho ON ho.airport = f.Origin AND ho.hr = date_trunc('hour', f.dep_utc)
        WHERE FlightDate BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND Reporting_Airline IN ('WN', 'AA')""",
        _WX,
    ),
)
def enrich_flights(spark, sf):
    cfg = PipelineConfig(start_date="1996-01-01", end_date="1999-12-31", airlines=("WN", "AA"))
    daily, hourly = weather_tables(spark, sf)
    registry = X.table(spark, sf, "supplier").select(
        F.expr("concat(if(s_suppkey % 8 = 0, 'X', 'N'), s_suppkey)").alias("Tail_Number"), F.expr("cast(1975 + s_suppkey % 25 as double)").alias("Year_Mfr")
    )
    out = enrich(
        raw_flights(spark, sf), airport_table(spark, sf), cfg, registry=registry, weather_daily=daily, weather_hourly=hourly,
        dest_weather=True,
    )
    return out.select(
        "flight_id", "dep_utc", "arr_utc", "Aircraft_Age_Bucket", "origin_temperature_2m_max", "dest_temperature_2m_max",
        "origin_dep_temperature_2m",
    )


@query(
    "history_pool",
    on_flights(
        """SELECT FlightDate, Origin, Dest, Reporting_Airline, count(*) AS n, min(dep_dt_local) AS first_dep, sum(CAST(coalesce(DepDelayMinutes >= 15, false) AS INTEGER))::BIGINT AS late
        FROM flights WHERE FlightDate BETWEEN DATE '1996-01-01' - 60 AND DATE '1999-12-31' GROUP BY ALL"""
    ),
)
def history_pool_query(spark, sf):
    cfg = PipelineConfig(start_date="1996-01-01", end_date="1999-12-31")
    pool = history_pool(raw_flights(spark, sf), airport_table(spark, sf), cfg)
    return pool.groupBy("FlightDate", "Origin", "Dest", "Reporting_Airline").agg(
        F.count("*").alias("n"), F.min("dep_dt_local").alias("first_dep"), F.sum("DepDel15").alias("late")
    )


_PRIOR = f""", p AS (SELECT DISTINCT {_KEY_SQL}, FlightDate, dep_utc FROM flights_utc),
r AS (SELECT p.*, """ + ", ".join(
    f"sum(h.DepDelayMinutes) FILTER (h.FlightDate >= p.FlightDate - {w}) / count(h.DepDelayMinutes) FILTER (h.FlightDate >= p.FlightDate - {w}) AS m{w}" for w in W4
) + f""", count(h.DepDelayMinutes) AS n28 FROM p JOIN flights_utc h ON {_SAME} AND h.FlightDate >= p.FlightDate - 28 AND h.FlightDate <= p.FlightDate
  AND (h.FlightDate < p.FlightDate OR h.dep_utc < p.dep_utc) GROUP BY ALL)"""

_DEP_MEANS = [f"flightnum_od_depdelay_mean_last{w}" for w in W4] + [f"{p}{w}" for p in _BASELINE_COLS for w in W4]
_DEP_PLAIN = [
    "od_pair", "dep_dow", "sched_dep_hour", "is_holiday", "origin_congestion_3h_total", "origin_airline_congestion_3h_total",
    "tail_leg_num_day", "has_recent_arrival_turn_5h", "flightnum_od_support_count_last28d", "flightnum_od_low_support_last28d",
    "y_dep_ge15", "y_dep_ge60",
]
_DEP_HOURS = ["flightnum_hours_since_first_departure_today", "turn_time_hours"]


@query(
    "departure_features",
    on_flights_utc(
        f"""SELECT flight_id, Origin || '_' || Dest AS od_pair, CAST(isodow(dep_dt_local) - 1 AS INTEGER) AS dep_dow, CAST(hour(dep_dt_local) AS INTEGER) AS sched_dep_hour,
        CAST(abs(FlightDate - {_TG.replace('(d)', '(FlightDate)')}) <= 2 OR abs(FlightDate - make_date(year(FlightDate), 12, 25)) <= 3 AS INTEGER) AS is_holiday,
        CAST(na.n - 1 AS INTEGER) AS origin_congestion_3h_total, CAST(nb.n - 1 AS INTEGER) AS origin_airline_congestion_3h_total,
        tail_leg_num_day, has_recent_arrival_turn_5h, CAST(coalesce(n28, 0) AS INTEGER) AS flightnum_od_support_count_last28d,
        CAST(coalesce(n28, 0) <= 2 AS INTEGER) AS flightnum_od_low_support_last28d,
        CAST(coalesce(DepDelayMinutes >= 15, false) AS INTEGER) AS y_dep_ge15, CAST(coalesce(DepDelayMinutes >= 60, false) AS INTEGER) AS y_dep_ge60,
        round(hrs, 6) AS flightnum_hours_since_first_departure_today, round(CASE WHEN pd2 = Origin THEN epoch(dep_utc - pa2) / 3600.0 END, 6) AS turn_time_hours, """
        + ", ".join(f"round(m{w}, 6) AS flightnum_od_depdelay_mean_last{w}" for w in W4)
        + ", " + ", ".join(f"{p}{w}" for p in _BASELINE_COLS for w in W4)
        + f""" FROM (SELECT *, CAST(row_number() OVER (PARTITION BY Tail_Number, FlightDate ORDER BY dep_utc, flight_id) AS INTEGER) AS tail_leg_num_day,
            CAST(coalesce(lag(Dest) OVER tw = Origin AND epoch(dep_utc - lag(arr_utc) OVER tw) / 3600.0 BETWEEN 0 AND 5, false) AS INTEGER) AS has_recent_arrival_turn_5h,
            epoch(dep_utc - min(dep_utc) OVER (PARTITION BY Reporting_Airline, Flight_Number_Reporting_Airline, FlightDate)) / 3600.0 AS hrs,
            lag(Dest) OVER fw AS pd2, lag(arr_utc) OVER fw AS pa2 FROM flights_utc
            WINDOW tw AS (PARTITION BY Tail_Number ORDER BY dep_utc, flight_id),
              fw AS (PARTITION BY Reporting_Airline, Flight_Number_Reporting_Airline ORDER BY dep_utc, flight_id)) f
        JOIN na USING (Origin, FlightDate, dep_utc) JOIN nb USING (Reporting_Airline, Origin, FlightDate, dep_utc)
        LEFT JOIN r USING ({_KEY_SQL}, FlightDate, dep_utc)
        LEFT JOIN c USING (Reporting_Airline, FlightDate) LEFT JOIN co USING (Reporting_Airline, Origin, FlightDate) LEFT JOIN o USING (Origin, FlightDate)""",
        _near_sql(["Origin", "FlightDate"], "na") + _near_sql(["Reporting_Airline", "Origin", "FlightDate"], "nb") + _PRIOR + _BASELINE_SQL,
    ),
)
def departure_features_query(spark, sf):
    f = X.flight_table(spark, sf)
    out = departure_features(f, f)
    return round_columns(out.select("flight_id", *_DEP_PLAIN, *_DEP_HOURS, *_DEP_MEANS), [*_DEP_MEANS, *_DEP_HOURS])


_ARR_STATS = [("arrdelay", "ArrDelayMinutes"), ("airtime", "AirTime"), ("wo_slip", "wo_slip_min")]


def _arr_sql() -> str:
    cols, joined, ctes = [], "", SLIP_SQL
    sets = (
        ("fn_od", FLIGHT.flight_key, _ARR_STATS), ("car_od", FLIGHT.route_key, _ARR_STATS[:2]), ("origin_blk", ["Origin", "blk"], _ARR_STATS[2:]),
    )
    for suffix, keys, measures in sets:
        part = _stats_sql(", ".join(keys), dict(measures), "slip")
        for prefix, _ in measures:
            part = part.replace(f"st_{prefix} AS", f"st_{prefix}_{suffix} AS")
            alias = f"{prefix}_{suffix}"
            same = " AND ".join(f"f.{k} = {alias}.{k}" for k in keys)
            joined += f" ASOF LEFT JOIN st_{alias} {alias} ON {same} AND f.FlightDate >= {alias}.FlightDate"
            for w in (7, 14):
                cols += [f"round({alias}.{prefix}_mean_{w}d, 6) AS {prefix}_mean_{w}d_{suffix}", f"{alias}.{prefix}_n_{w}d AS {prefix}_n_{w}d_{suffix}"]
        ctes += part
    for suffix, keys in (("fn_od", FLIGHT.flight_key), ("car_od", FLIGHT.route_key)):
        names = ", ".join(keys)
        ctes += (
            f", md_{suffix} AS (SELECT {names}, FlightDate, any_value(med) AS med FROM (SELECT *, median(ArrDelayMinutes) OVER (PARTITION BY {names} ORDER BY FlightDate"
            f" RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING) AS med FROM flights WHERE ArrDelayMinutes IS NOT NULL) GROUP BY {names}, FlightDate)"
        )
        same = " AND ".join(f"f.{k} = md_{suffix}.{k}" for k in keys)
        joined += f" ASOF LEFT JOIN md_{suffix} ON {same} AND f.FlightDate >= md_{suffix}.FlightDate"
        cols.append(f"round(md_{suffix}.med, 6) AS arrdelay_median_7d_{suffix}")
    body = f"SELECT f.flight_id, CAST(coalesce(f.ArrDelayMinutes >= 30, false) AS INTEGER) AS y_arr_ge30, {', '.join(cols)} FROM slip f{joined}"
    return on_flights(body, ctes)


@query("arrival_features", _arr_sql())
def arrival_features_query(spark, sf):
    f = X.flight_table(spark, sf)
    out = arrival_features(f, f)
    names = [c for c in out.columns if c.startswith(("arrdelay_", "airtime_", "wo_slip_")) and c != "wo_slip_min"]
    floats = [c for c in names if "_n_" not in c]
    return round_columns(out.select("flight_id", "y_arr_ge30", *names), floats)


def _training_sql() -> str:
    """Rows per threshold and class: equal classes, at most 20,000 rows in all; evaluation rows as threshold 0."""
    parts = [
        """SELECT 0 AS thr, CAST(coalesce(DepDelayMinutes >= 15, false) AS INTEGER) AS y, count(*) AS n FROM flights
        WHERE FlightDate > (SELECT max(FlightDate) FROM flights) - 90 GROUP BY ALL"""
    ]
    for thr in THRESHOLDS:
        parts.append(
            f"""SELECT {thr}, NULL, CAST(CASE WHEN least(pos, neg) = 0 THEN least(pos + neg, 20000) ELSE least(2 * least(pos, neg), 20000) END AS BIGINT) FROM
            (SELECT count(*) FILTER (DepDelayMinutes >= {thr}) AS pos, count(*) FILTER (NOT coalesce(DepDelayMinutes >= {thr}, false)) AS neg
             FROM flights WHERE FlightDate <= (SELECT max(FlightDate) FROM flights) - 90)"""
        )
    return on_flights(" UNION ALL ".join(parts))


@query("departure_training_tables", _training_sql())
def departure_training_tables(spark, sf):
    """Rows of the balanced table per threshold (y null), and of the evaluation rows per label (threshold 0)."""
    evaluation, balanced = split_and_balance(training_features(spark, sf), PipelineConfig())
    out = evaluation.groupBy(F.lit(0).alias("thr"), F.col("y_dep_ge15").alias("y")).agg(F.count("*").alias("n"))
    for thr, table in balanced.items():
        out = out.unionByName(table.agg(F.count("*").alias("n")).select(F.lit(thr).alias("thr"), F.lit(None).cast("int").alias("y"), "n"))
    return out


# Training: features and models of one session and scale are made once and shared by the queries below

#: Rounds and depth of the registered queries; the library's default is 60 rounds.
_SETTINGS = models.TrainingSettings(iterations=10, depth=5)
_features: dict = {}
_trained: dict = {}


def model_weather(spark, sf):
    """Daily and hourly weather from the orders, with the columns that models read."""
    o = X.table(spark, sf, "orders").withColumn("airport", X._pick(X.AIRPORTS, F.expr("o_custkey % 10")))
    value = F.max("o_totalprice") / 10000.0
    daily = o.groupBy("airport", F.col("o_orderdate").cast("date").alias("date")).agg(
        value.alias("temperature_2m_max"), (value - 8).alias("temperature_2m_min"), F.max(F.expr("o_custkey % 30 / 10.0D")).alias("precipitation_sum"),
        F.max(F.expr("o_custkey % 70 * 1.0D")).alias("windspeed_10m_max"), F.max(F.expr("o_custkey % 4")).alias("weathercode"),
    )
    hours = daily.select("airport", "date", "temperature_2m_max", "precipitation_sum", "windspeed_10m_max", "weathercode", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("h"))
    hourly = hours.select(
        "airport", (F.col("date").cast("timestamp_ntz") + F.expr("make_dt_interval(0, h)")).alias("hour_utc"),
        (F.col("temperature_2m_max") - F.abs(F.col("h") - 14) / 2.0).alias("temperature_2m"), (F.col("precipitation_sum") / 24.0).alias("precipitation"),
        (F.col("windspeed_10m_max") / 2.0).alias("windspeed_10m"), "weathercode",
    )
    return daily, hourly


def training_features(spark, sf):
    """Departure features and labels of the enriched flights, and arrival labels; written once per session and scale."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _features:
        daily, hourly = (joins.small(materialize(t, "weather")) for t in model_weather(spark, sf))  # a row per airport and day or hour
        enriched = enrich(raw_flights(spark, sf), airport_table(spark, sf), PipelineConfig(), weather_daily=daily, weather_hourly=hourly)
        enriched = materialize(enriched, "enriched")
        features = departure_features(enriched, enriched).withColumns(threshold_labels("ArrDelayMinutes", "arr"))
        _features[key] = materialize(features, "features")
    return _features[key]


def trained(spark, sf):
    """The departure models, of all balanced rows: no row limit."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _trained:
        cfg = PipelineConfig(max_rows=None)
        evaluation, balanced = split_and_balance(training_features(spark, sf), cfg)
        _trained[key] = train_departure(balanced, materialize(evaluation, "evaluation"), cfg, _SETTINGS)
    return _trained[key]


def scored_features(spark, sf):
    key = ("scored", spark.sparkContext.applicationId, sf)
    if key not in _features:
        model, _ = trained(spark, sf)
        scored = models.add_distribution(models.score_ge(training_features(spark, sf), model))
        _features[key] = materialize(scored, "scored")
    return _features[key]


def checks(df, **tests):
    """One row per property with whether it holds on all rows."""
    found = df.agg(*[F.coalesce(F.min(t.cast("int")), F.lit(0)).alias(n) for n, t in tests.items()])
    return found.select(F.explode(F.array(*[F.struct(F.lit(n).alias("property"), F.col(n).alias("holds")) for n in tests])).alias("c")).select("c.*")


def _holds(*names: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS property, 1 AS holds" for n in names)


_EVAL_PROPERTIES = ("auc_in_range", "ap_in_range", "brier_in_range", "threshold_known", "rows")


def _evaluation_checks(table, rows):
    share = lambda c: F.coalesce(F.col(c).between(0, 1), F.lit(True))
    return checks(
        table, auc_in_range=share("auc"), ap_in_range=share("average_precision"), brier_in_range=share("brier"),
        threshold_known=F.col("threshold").isin(*THRESHOLDS), rows=F.lit(table.count() == len(THRESHOLDS) and rows > 0),
    )


@query("train_threshold_models", _holds(*_EVAL_PROPERTIES))
def train_threshold_models(spark, sf):
    """Properties of the departure models' evaluation on the held-out half, one row per threshold."""
    model, held_out = trained(spark, sf)
    return _evaluation_checks(materialize(evaluate(model, held_out), "evaluated"), held_out.count())


@query("train_arrival_models", _holds(*_EVAL_PROPERTIES))
def train_arrival_models(spark, sf):
    cfg = PipelineConfig(target="arr", seed=1337, exclude_feature_prefixes=("y_dep_ge", "y_arr_ge"))
    model, evaluation = train_arrival(training_features(spark, sf), cfg.categorical, cfg.numeric_features(), cfg, _SETTINGS)
    return _evaluation_checks(materialize(evaluate(model, evaluation, "y_arr_ge{thr}"), "evaluated"), evaluation.count())


@query("feature_importance", _holds("known_or_dropped", "every_feature", "unread_is_zero", "loss_given"))
def feature_importance(spark, sf):
    """Properties of the loss changes on the held-out half: all configured features appear, those the table lacks with null."""
    model, held_out = trained(spark, sf)
    table = materialize(models.feature_importance(model, held_out), "importance")
    wanted = [*PipelineConfig().categorical, *PipelineConfig().numeric_features()]
    given = F.col("importance").isNotNull() == F.col("split_gain").isNotNull()
    unread = (F.coalesce("split_gain", F.lit(0.0)) != 0) | (F.abs(F.coalesce("importance", F.lit(0.0))) < 1e-9)
    known = checks(table, known_or_dropped=F.col("feature").isin(wanted), unread_is_zero=unread, loss_given=given)
    return known.unionByName(checks(table.groupBy("threshold").agg(F.count("*").alias("n")), every_feature=F.col("n") == len(wanted)))


_STAT_COLUMNS = {"Origin": "Origin", "od_pair": "Origin || '_' || Dest", "Reporting_Airline": "Reporting_Airline", "late_hour": "hour(dep_dt_local)"}


@query(
    "ordered_target_statistics",
    on_flights(
        "SELECT flight_id, " + ", ".join(
            f"round((coalesce(sum(y) OVER {c}_w, 0) + p) / (count(*) OVER {c}_w + 1), 6) AS {c}_stat" for c in _STAT_COLUMNS
        ) + " FROM b, (SELECT avg(y) AS p FROM b) WINDOW " + ", ".join(
            f"{c}_w AS (PARTITION BY {c} ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)" for c in _STAT_COLUMNS
        ),
        ", b AS (SELECT flight_id, md5('42|' || flight_id) AS h, CAST(coalesce(DepDelayMinutes >= 15, false) AS INTEGER) AS y, "
        + ", ".join(f"{e} AS {c}" for c, e in _STAT_COLUMNS.items()) + " FROM flights)",
    ),
)
def ordered_target_statistics(spark, sf):
    """Categories of all flights as running means of the label over a hash order."""
    f = X.flight_table(spark, sf).withColumns(
        {**threshold_labels("DepDelayMinutes"), "od_pair": F.concat_ws("_", "Origin", "Dest"), "late_hour": F.hour("dep_dt_local")}
    )
    prior = target_stats.label_mean(f, "y_dep_ge15")
    out = target_stats.ordered_statistics(f, "y_dep_ge15", list(_STAT_COLUMNS), "flight_id", prior)
    return round_columns(out.select("flight_id", *[f"{c}_stat" for c in _STAT_COLUMNS]), [f"{c}_stat" for c in _STAT_COLUMNS])


_SHARE = "({quantity} + {noise} % 15) / 80.0"


@query(
    "permutation_importance",
    on_flights(
        """SELECT thr AS threshold, feature, round(avg(loss - base), 6) AS importance FROM (
          SELECT thr, feature, -(y * ln(p) + (1 - y) * ln(1 - p)) AS loss, -(y * ln(p0) + (1 - y) * ln(1 - p0)) AS base FROM (
            SELECT t.thr, f.feature, CAST(coalesce(a.delay >= t.thr, false) AS INTEGER) AS y, """
        + _SHARE.format(quantity="a.quantity", noise="a.noise") + """ AS p0,
              CASE f.feature WHEN 'quantity' THEN """ + _SHARE.format(quantity="d.quantity", noise="a.noise")
        + " WHEN 'noise' THEN " + _SHARE.format(quantity="a.quantity", noise="d.noise") + " ELSE " + _SHARE.format(quantity="a.quantity", noise="a.noise") + """ END AS p
            FROM own a JOIN donor d USING (k), (SELECT unnest([15, 60]) AS thr) t, (SELECT unnest(['quantity', 'noise', 'Origin']) AS feature) f))
        GROUP BY ALL""",
        """, own AS (SELECT quantity, noise, DepDelayMinutes AS delay, row_number() OVER (ORDER BY md5('42|own|' || flight_id)) AS k FROM flights),
        donor AS (SELECT quantity, noise, row_number() OVER (ORDER BY md5('42|donor|' || flight_id)) AS k FROM flights)""",
    ),
)
def permutation_importance(spark, sf):
    """Loss changes of a score that reads two of three features, on all flights."""
    f = X.flight_table(spark, sf).withColumns(threshold_labels("DepDelayMinutes"))
    score = lambda df: df.withColumn("p", F.expr(_SHARE.format(quantity="quantity", noise="noise")).cast("double"))
    pairs = {t: (f"y_dep_ge{t}", "p") for t in (15, 60)}
    return round_columns(importance.loss_changes(f, ["quantity", "noise", "Origin"], score, pairs, "flight_id"), ["importance"])


_CUT_SQL = f""", h AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42|' || flight_id)) AS r, count(*) OVER (PARTITION BY y) AS c FROM
  (SELECT flight_id, {_SHARE.format(quantity="quantity", noise="noise")} AS p, CAST(coalesce(DepDelayMinutes >= 15, false) AS INTEGER) AS y FROM flights)),
s AS (SELECT p, y, CASE WHEN r <= round(c * 0.5) THEN 'calibration' ELSE 'evaluation' END AS rows_of FROM h),
curve AS (SELECT p, sum(sum(y)) OVER (ORDER BY p DESC) AS tp, sum(sum(1 - y)) OVER (ORDER BY p DESC) AS fp FROM s WHERE rows_of = 'calibration' GROUP BY p),
best AS (SELECT CASE WHEN j > 0 THEN p ELSE 'Infinity'::DOUBLE END AS cut FROM (SELECT p, tp / max(tp) OVER () - fp / max(fp) OVER () AS j FROM curve) ORDER BY j DESC, p DESC LIMIT 1),
cells AS (SELECT rows_of, cut, y, CAST(p >= cut AS INTEGER) AS pred FROM s, best)"""


def _reports(spark, sf):
    f = X.flight_table(spark, sf).withColumns({**threshold_labels("DepDelayMinutes"), "p": F.expr(_SHARE.format(quantity="quantity", noise="noise")).cast("double")})
    halves = sampling.stratified_split(f, "y_dep_ge15", ["flight_id"], {"cal": 0.5, "eval": 0.0}, out="half")
    return report_tables({"calibration": halves.filter("half = 'cal'"), "evaluation": halves.filter("half = 'eval'")}, "y_dep_ge15", "p")


@query("confusion_at_cut", on_flights("SELECT rows_of, round(cut, 6) AS cut, y, pred, count(*) AS n FROM cells GROUP BY ALL", _CUT_SQL))
def confusion_at_cut(spark, sf):
    """Confusion counts of a given score on both halves, at the cut that is best on the calibration half."""
    return round_columns(_reports(spark, sf)["confusion"], ["cut"])


@query(
    "classes_at_cut",
    on_flights(
        """SELECT rows_of, class, round(cut, 6) AS cut, round(precision, 6) AS precision, round(recall, 6) AS recall,
        round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1, support FROM (
          SELECT rows_of, cut, class, count(*) FILTER (y = class) AS support,
            coalesce(count(*) FILTER (y = class AND pred = class) / nullif(count(*) FILTER (pred = class), 0), 0) AS precision,
            coalesce(count(*) FILTER (y = class AND pred = class) / nullif(count(*) FILTER (y = class), 0), 0) AS recall
          FROM cells, (SELECT unnest([0, 1]) AS class) GROUP BY ALL)""",
        _CUT_SQL,
    ),
)
def classes_at_cut(spark, sf):
    """Precision, recall and F1 of both classes at that cut."""
    return round_columns(_reports(spark, sf)["classes"], ["cut", "precision", "recall", "f1"])


@query("score_ge", _holds("bins_sum_to_one", "probabilities_in_range", "minutes_in_range") + " UNION ALL SELECT 'rows ' || count(*), 1 FROM lineitem")
def score_ge(spark, sf):
    """Properties of the scores of all flights."""
    scored = scored_features(spark, sf)
    probabilities = F.least(*[F.col(f"p_ge{t}") for t in THRESHOLDS]) >= 0
    out = checks(
        scored, bins_sum_to_one=F.round(F.aggregate("bin_proba", F.lit(0.0), lambda a, x: a + x), 6) == 1,
        probabilities_in_range=probabilities & (F.greatest(*[F.col(f"p_ge{t}") for t in THRESHOLDS]) <= 1),
        minutes_in_range=F.col("expected_delay_minutes").between(0, 1000),
    )
    return out.unionByName(scored.agg(F.concat(F.lit("rows "), F.count("*")).alias("property"), F.lit(1).alias("holds")))


@query("explain_predictions", _holds("reason_given", "four_reasons", "probabilities_printed", "bins_known"))
def explain_predictions(spark, sf):
    """Properties of the explained held-out flights."""
    model, held_out = trained(spark, sf)
    out = materialize(explain(models.score_ge(held_out, model)), "explained")
    reasons = out.select(F.explode(F.split("delay_explanation", "; ")).alias("r")).distinct().count()
    return checks(
        out, reason_given=F.length("delay_explanation") > 0, four_reasons=F.lit(reasons >= 4),
        probabilities_printed=F.col("delay_probabilities").rlike("^P≥15=[0-9.]+, P≥30=[0-9.]+, P≥45=[0-9.]+, P≥60=[0-9.]+$"),
        bins_known=F.col("true_bin").isNotNull() & F.col("predicted_bin").isNotNull(),
    )


_RAW = "floor((quantity + noise % 15) / 8) / 10.0"

_ISOTONIC_SQL = f""", h AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42|' || flight_id)) AS r, count(*) OVER (PARTITION BY y) AS c FROM
  (SELECT flight_id, {_RAW} AS raw, CAST(coalesce(DepDelayMinutes >= 15, false) AS INTEGER) AS y FROM flights)),
cal AS (SELECT raw, avg(y) AS rate, count(*) AS w FROM h WHERE r <= round(c * 0.5) GROUP BY raw),
spans AS (SELECT s.raw AS lo, e.raw AS hi, sum(c.rate * c.w) / sum(c.w) AS m FROM cal s JOIN cal e ON s.raw <= e.raw JOIN cal c ON c.raw BETWEEN s.raw AND e.raw GROUP BY ALL),
fit AS (SELECT raw, max(m) AS p FROM (SELECT i.raw, lo, min(m) AS m FROM cal i JOIN spans ON i.raw BETWEEN lo AND hi GROUP BY ALL) GROUP BY raw)"""


def _calibrated(spark, sf, method):
    """Observed rate and calibrated probability per raw score, on the half the fit has not seen."""
    f = X.flight_table(spark, sf).withColumns({**threshold_labels("DepDelayMinutes"), "raw": F.expr(_RAW).cast("double")})
    halves = sampling.stratified_split(f, "y_dep_ge15", ["flight_id"], {"cal": 0.5, "eval": 0.0}, out="half")
    fit = models.calibrate_isotonic if method == "isotonic" else models.calibrate_sigmoid
    calibrator = fit(halves.filter("half = 'cal'"), "y_dep_ge15", "raw")
    scored = models.apply_calibrator(halves.filter("half = 'eval'"), calibrator, "raw", "p")
    return scored.groupBy("raw").agg(F.round(F.max("p"), 6).alias("p"), F.round(F.avg("y_dep_ge15"), 6).alias("rate"), F.count("*").alias("n"))


@query(
    "calibrate_isotonic",
    on_flights("SELECT raw, round(p, 6) AS p, round(avg(y), 6) AS rate, count(*) AS n FROM h JOIN fit USING (raw) WHERE r > round(c * 0.5) GROUP BY raw, p", _ISOTONIC_SQL),
)
def calibrate_isotonic(spark, sf):
    return _calibrated(spark, sf, "isotonic")


@query("calibrate_sigmoid", _holds("in_range", "rises_with_the_score", "mean_near_the_rate"))
def calibrate_sigmoid(spark, sf):
    """Properties of the sigmoid: between 0 and 1, rising, and right on average."""
    points = materialize(_calibrated(spark, sf, "sigmoid"), "points")
    order = Window.orderBy("raw")  # one row per distinct raw score
    rising = checks(points.withColumn("before", F.lag("p").over(order)), in_range=F.col("p").between(0, 1), rises_with_the_score=F.coalesce(F.col("p") >= F.col("before"), F.lit(True)))
    mean = points.agg((F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("p"), (F.sum(F.col("rate") * F.col("n")) / F.sum("n")).alias("rate"))
    return rising.unionByName(checks(mean, mean_near_the_rate=F.abs(F.col("p") - F.col("rate")) < 0.05))


_KEYS = tuple(f"{a}_50_23-25_weather+_minhist" for a in ("WN", "DL", "UA"))


_CARRIER_SQL = "CASE o_custkey % 5 WHEN 0 THEN 'WN' WHEN 1 THEN 'AA' WHEN 2 THEN 'DL' WHEN 3 THEN 'UA' END"
_ZONES_SQL = X._sql_list(X.ZONES)

#: Everything about a prediction that is not a score: names, match, times, counts, history, model key, statistics, problem.
_BATCH_SQL = on_flights_utc(
    f"""SELECT request_id, carrier AS Reporting_Airline, org AS Origin, dst AS Dest, CASE WHEN sched IS NOT NULL THEN 'future_flights' WHEN usable THEN 'user_schedule_fallback' END AS verification_source,
    CAST(sched IS NULL AND usable AS INTEGER) AS n_warnings, dep AS dep_utc, CAST(coalesce(c.total, 0) AS BIGINT) AS origin_congestion_3h_total,
    CAST(coalesce(c.own, 0) AS BIGINT) AS origin_airline_congestion_3h_total, CAST(coalesce(h.n, 0) AS BIGINT) AS flightnum_od_support_count_last28d,
    round(h.mean7, 6) AS flightnum_od_depdelay_mean_last7, CASE WHEN hourly THEN 'limited_history' END AS model_family,
    carrier || '_50_23-25_' || CASE WHEN hourly THEN 'weather+' ELSE 'weather' END || '_minhist' AS model_id, as_day AS stats_as_of_date,
    CASE WHEN stats AND a.days14 > 0 THEN CAST(a.n7 AS BIGINT) END AS airline_stats_dep_delay_7d_n, problem, CAST(problem IS NULL AS INTEGER) AS predicted
    FROM (SELECT *, CASE WHEN carrier IS NULL THEN 'unknown_airline' WHEN carrier = 'DL' AND '{X.AIRPORTS[0]}' IN (org, dst) THEN 'airport_not_in_ranking'
        WHEN sched IS NULL AND NOT usable THEN 'needs_schedule_times' WHEN NOT hourly THEN 'no_model_family' WHEN carrier = 'AA' THEN 'no_model' END AS problem FROM timed)
    LEFT JOIN congested c USING (request_id) LEFT JOIN past h USING (request_id) LEFT JOIN airline a USING (request_id)""",
    f""", rq AS (SELECT o_orderkey AS request_id, {_CARRIER_SQL} AS carrier, CAST(o_custkey % 3 AS VARCHAR) AS num, CAST(o_orderdate AS DATE) AS day, {CODES}[o_custkey % 10 + 1] AS org,
      {CODES}[(o_custkey + 1 + o_orderkey % 7) % 10 + 1] AS dst, {_ZONES_SQL}[o_custkey % 10 + 1] AS zone, o_orderkey % 3 <> 0 AS usable, o_custkey % 4 <> 0 AS weather,
      o_orderkey % 5 <> 0 AS stats, CAST(o_orderdate AS DATE) + to_hours(CAST(o_orderkey % 24 AS INTEGER)) + INTERVAL 30 MINUTE AS given FROM orders),
    matched AS (SELECT request_id, min(dep_utc) AS sched FROM rq JOIN flights_utc f
      ON CAST(f.Flight_Number_Reporting_Airline AS VARCHAR) = num AND f.Origin = org AND f.Dest = dst AND f.FlightDate = day GROUP BY ALL),
    placed AS (SELECT rq.*, sched, coalesce(sched, CASE WHEN usable THEN {X.utc_sql('given', 'zone')} END) AS dep FROM rq LEFT JOIN matched USING (request_id)),
    seen AS (SELECT DISTINCT {CODES}[o_custkey % 10 + 1] AS airport, CAST(o_orderdate AS DATE) AS on_day FROM orders),
    dates AS (SELECT day, CASE WHEN last IS NOT NULL THEN least(day, last + 14) END AS as_day FROM (SELECT day,
      (SELECT max(FlightDate) FROM flights_utc WHERE FlightDate < q.day AND (DepDelayMinutes IS NOT NULL OR ArrDelayMinutes IS NOT NULL)) AS last FROM (SELECT DISTINCT day FROM rq) q)),
    timed AS (SELECT p.*, weather AND airport IS NOT NULL AS hourly, as_day FROM placed p LEFT JOIN seen ON airport = org AND on_day = CAST(dep AS DATE) JOIN dates USING (day)),
    congested AS (SELECT request_id, count(*) AS total, count(*) FILTER (f.Reporting_Airline = carrier AND NOT (CAST(f.Flight_Number_Reporting_Airline AS VARCHAR) = num AND f.dep_utc = dep)) AS own
      FROM timed JOIN flights_utc f ON f.Origin = org AND f.FlightDate = day AND abs(epoch(f.dep_utc) - epoch(dep)) <= 10800 AND carrier IS NOT NULL GROUP BY ALL),
    past AS (SELECT request_id, count(f.DepDelayMinutes) AS n, avg(f.DepDelayMinutes) FILTER (f.FlightDate > day - 7) AS mean7 FROM timed JOIN flights_utc f ON f.Reporting_Airline = carrier
      AND CAST(f.Flight_Number_Reporting_Airline AS VARCHAR) = num AND f.Origin = org AND f.Dest = dst AND f.FlightDate > day - 28 AND f.FlightDate <= day GROUP BY ALL),
    airline AS (SELECT request_id, count(f.DepDelayMinutes) FILTER (f.FlightDate >= as_day - 7) AS n7, count(*) FILTER (f.DepDelayMinutes IS NOT NULL OR f.ArrDelayMinutes IS NOT NULL) AS days14
      FROM timed JOIN flights_utc f ON f.Reporting_Airline = carrier AND f.FlightDate >= as_day - 14 AND f.FlightDate < as_day GROUP BY ALL)""",
)


def _registry(model):
    """A different model for each key, so that a row scored by another key's model shows."""
    plain = replace(model, models=[replace(m, calibrator=None) for m in model.models])
    turned = replace(model, models=[replace(m, calibrator=o.calibrator) for m, o in zip(model.models, model.models[::-1], strict=True)])
    return dict(zip(_KEYS, (model, plain, turned), strict=True))


def predictions(spark, sf):
    """A prediction for every order read as a request."""
    model, _ = trained(spark, sf)
    f = X.flight_table(spark, sf)
    o = X.table(spark, sf, "orders")
    requests = o.select(
        F.col("o_orderkey").alias("request_id"),
        F.expr("case o_custkey % 5 when 0 then 'WN' when 1 then 'American Airlines' when 2 then 'delta' when 3 then 'UA' else 'Nobody Air' end").alias("airline"),
        F.expr("cast(o_custkey % 3 as string)").alias("flightnum"), F.col("o_orderdate").cast("date").alias("date"),
        X._pick(X.AIRPORTS, F.expr("o_custkey % 10")).alias("origin"), X._pick(X.AIRPORTS, F.expr("(o_custkey + 1 + o_orderkey % 7) % 10")).alias("dest"),
        F.expr("case when o_orderkey % 3 <> 0 then concat(lpad(o_orderkey % 24, 2, '0'), ':30') end").alias("sched_dep_time_24h"),
        F.expr("case when o_orderkey % 3 <> 0 then concat(lpad((o_orderkey + 3) % 24, 2, '0'), ':10') end").alias("sched_arr_time_24h"),
        F.expr("o_custkey % 4 <> 0").alias("include_weather"), F.expr("o_orderkey % 5 <> 0").alias("airline_stats"),
    )
    schedule = f.select(
        F.col("Origin").alias("origin"), F.col("Flight_Number_Reporting_Airline").cast("string").alias("flight_number"),
        F.col("Dest").alias("dest"), F.col("FlightDate").alias("date"), F.col("dep_utc").alias("sched_utc"), F.col("Reporting_Airline").alias("carrier"),
    )
    history = f.select(
        "Reporting_Airline", F.col("Flight_Number_Reporting_Airline").cast("string").alias("flight_number"), "Origin", "Dest",
        F.col("FlightDate").alias("date"), F.col("DepDelayMinutes").alias("delay"),
    )
    daily, hourly = model_weather(spark, sf)
    daily = daily.select("airport", "date", F.col("temperature_2m_max").alias("origin_temp_max_K"), F.col("weathercode").alias("origin_daily_weathercode"))
    hourly = hourly.select("airport", "hour_utc", F.col("temperature_2m").alias("origin_dep_temp_K"), F.col("weathercode").alias("origin_dep_hour_weathercode"))
    codes = airport_table(spark, sf).select(F.col("IATA").alias("code"))
    lists = codes.select(F.explode(F.array(*[F.lit(a) for a in ("WN", "AA", "DL", "UA")])).alias("airline"), F.lit(50).alias("n"), "code")
    lists = lists.filter(~((F.col("airline") == "DL") & (F.col("code") == X.AIRPORTS[0])))
    out = batch_predict(
        requests, airport_table(spark, sf), schedule, history, daily, hourly, materialize(E.group_rollup_table(spark, sf), "rollups"),
        _registry(model), rankings=lists,
    )
    return out


@query("batch_predict", _BATCH_SQL)
def batch_predict_query(spark, sf):
    """Every order as a request: how it was matched, what its model reads, which model it has, why it has no result.

    A request of an unknown airline has no model and no counts.
    """
    out = predictions(spark, sf).withColumns({"n_warnings": F.size("warnings"), "predicted": F.col("predicted_bin").isNotNull().cast("int")})
    return round_columns(
        out.select(
            "request_id", "Reporting_Airline", "Origin", "Dest", "verification_source", "n_warnings", "dep_utc", "origin_congestion_3h_total",
            "origin_airline_congestion_3h_total", "flightnum_od_support_count_last28d", "flightnum_od_depdelay_mean_last7", "model_family", "model_id",
            "stats_as_of_date", "airline_stats_dep_delay_7d_n", "problem", "predicted",
        ), ["flightnum_od_depdelay_mean_last7"],
    )


@query(
    "batch_predict_scores",
    _holds("result_or_problem", "results_have_a_family", "results_have_their_model", "unknown_airline_has_no_key", "results_differ", "switches_obeyed", "ranking_obeyed", "scored_by_own_model")
    + " UNION ALL SELECT 'rows ' || count(*), 1 FROM orders",
)
def batch_predict_scores(spark, sf):
    """Properties of the scores: every result comes from the model its key names."""
    out = materialize(predictions(spark, sf), "predictions")
    registry = _registry(trained(spark, sf)[0])
    again = [models.score_ge(out.filter(F.col("model_id") == key).select("request_id", *[c for c in PipelineConfig().categorical + tuple(PipelineConfig().numeric_features()) if c in out.columns]), m) for key, m in registry.items()]
    own = functools.reduce(DataFrame.unionByName, [df.select("request_id", F.col("p_ge15").alias("__p")) for df in again])
    out = out.join(own, "request_id", "left")
    some = F.col("predicted_bin").isNotNull()
    either = lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))
    found = checks(
        out, result_or_problem=some != F.col("problem").isNotNull(), results_have_a_family=either(~some, F.col("model_family").isNotNull()),
        results_have_their_model=either(~some, F.col("model_id").isin(*_KEYS)),
        unknown_airline_has_no_key=either(F.col("Reporting_Airline").isNotNull(), F.col("model_id").isNull()),
        switches_obeyed=either(F.col("airline_stats"), F.col("airline_stats_missing").isNull()),
        scored_by_own_model=F.coalesce(F.abs(F.col("p_ge15") - F.col("__p")) < 1e-9, F.col("p_ge15").isNull() & F.col("__p").isNull()),
        ranking_obeyed=either(~some, ~F.coalesce((F.col("Reporting_Airline") == "DL") & (F.col("Origin") == X.AIRPORTS[0]), F.lit(False))),
    )
    different = out.agg(F.countDistinct("expected_delay_minutes").alias("n"))
    rows = out.agg(F.concat(F.lit("rows "), F.count("*")).alias("property"), F.lit(1).alias("holds"))
    return found.unionByName(checks(different, results_differ=F.col("n") > 1)).unionByName(rows)
