"""Queries: rollups, sampling, splits, metrics and text extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac import constants as C
from tarmac import fixtures as X
from tarmac.functions import numbers as N
from tarmac.functions import ordinal as O
from tarmac.functions import text as S
from tarmac.operators import extract, filters, impute, joins, metrics, rollups, sampling
from tarmac.queries.history import requests_from_orders
from tarmac.queries.registry import on_events, on_flights, on_scored, query, round_columns, rounded
from tarmac.queries.scalars import _BIN_SQL, _BINS
from tarmac.session import materialize

CODES = X._sql_list(X.AIRPORTS)

# Rollups

_DAILY = """, dr AS (SELECT FlightDate AS date, Origin AS origin, Reporting_Airline AS carrier, coalesce(sum(DepDelayMinutes), 0) AS dep_delay_sum,
  count(DepDelayMinutes) AS dep_delay_count, count(*) AS dep_flight_count FROM flights GROUP BY ALL)"""


def daily(spark, sf):
    f = X.flights(spark, sf).withColumnsRenamed({"Origin": "origin", "Reporting_Airline": "carrier"})
    return rollups.daily_rollup(f, ["origin", "carrier"], "FlightDate", "DepDelayMinutes")


@query("daily_rollup", on_flights("SELECT * FROM dr", _DAILY))
def daily_rollup(spark, sf):
    return daily(spark, sf)


def _window_sql(keys: list[str], support: int) -> str:
    same = " AND ".join(f"dr.{k} = rq.{k}" for k in keys)
    return on_flights(
        f"""SELECT o_orderkey, CAST(coalesce(sum(dep_delay_count), 0) AS BIGINT) AS support_count, CAST(coalesce(sum(dep_flight_count), 0) AS BIGINT) AS flight_count,
        round(CASE WHEN sum(dep_delay_count) >= {support} AND sum(dep_delay_count) > 0 THEN sum(dep_delay_sum) / sum(dep_delay_count) END, 6) AS mean_delay_min
        FROM rq LEFT JOIN dr ON {same} AND dr.date < day AND dr.date >= day - 28 GROUP BY o_orderkey""",
        _DAILY
        + f""", rq AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE o_custkey % 4 WHEN 0 THEN 'WN' WHEN 1 THEN 'AA' WHEN 2 THEN 'DL' ELSE 'UA' END AS carrier,
          {CODES}[o_custkey % 10 + 1] AS origin FROM orders)""",
    )


def _register_window_mean(name, keys, support):
    @query(name, _window_sql(keys, support))
    def run(spark, sf):
        asked = requests_from_orders(spark, sf).withColumnsRenamed({"Reporting_Airline": "carrier", "Origin": "origin"})
        out = rollups.rollup_window_mean(asked, daily(spark, sf), keys, "FlightDate", 28, support)
        return round_columns(out.select("o_orderkey", "support_count", "flight_count", "mean_delay_min"), ["mean_delay_min"])


_register_window_mean("rollup_window_mean", ["origin", "carrier"], 1)
_register_window_mean("rollup_window_mean_origin", ["origin"], 3)

_GROUPS = {"airport_total": "Origin", "airline_total": "Reporting_Airline"}


def _group_rollup_sql() -> str:
    cols = []
    for name, value in (("dep", "DepDelayMinutes"), ("arr", "ArrDelayMinutes")):
        for w in C.ROLLUP_WINDOWS:
            seen = f"FILTER ({value} IS NOT NULL AND g.day >= a.as_of_date - {w})"
            cols.append(f"count(*) {seen} AS {name}_delay_{w}d_n")
            cols.append(f"round(avg({value}) {seen}, 6) AS {name}_delay_{w}d_mean")
            cols.append(f"round(median({value}) {seen}, 6) AS {name}_delay_{w}d_median")
    return ", ".join(cols)


GROUP_ROLLUPS_CTE = f""", g AS (SELECT 'airport_total' AS group_type, Origin AS group_value, FlightDate AS day, DepDelayMinutes, ArrDelayMinutes FROM flights
  UNION ALL SELECT 'airline_total', Reporting_Airline, FlightDate, DepDelayMinutes, ArrDelayMinutes FROM flights),
a AS (SELECT DISTINCT group_type, group_value, day + CAST(i AS INTEGER) AS as_of_date FROM g, range(1, 15) t(i) WHERE DepDelayMinutes IS NOT NULL OR ArrDelayMinutes IS NOT NULL),
gr AS (SELECT a.as_of_date, a.group_type, a.group_value, {_group_rollup_sql()} FROM a JOIN g ON g.group_type = a.group_type AND g.group_value = a.group_value
  AND g.day < a.as_of_date AND g.day >= a.as_of_date - 14 GROUP BY ALL)"""


def group_rollup_table(spark, sf):
    return rollups.group_rollups(
        X.flight_table(spark, sf), "FlightDate", _GROUPS, {"dep": "DepDelayMinutes", "arr": "ArrDelayMinutes"}
    )


@query("group_rollups", on_flights("SELECT * FROM gr", GROUP_ROLLUPS_CTE))
def group_rollups(spark, sf):
    out = group_rollup_table(spark, sf)
    return round_columns(out, [c for c in out.columns if c.endswith(("mean", "median"))])


@query(
    "asof_global",
    on_flights(
        f"""SELECT o_orderkey, x.as_of_date, gr.dep_delay_7d_n, gr.dep_delay_7d_median, CAST(gr.group_value IS NULL AS INTEGER) AS missing
        FROM (SELECT o_orderkey, {CODES}[o_custkey % 10 + 1] AS org, CAST(o_orderdate AS DATE) AS day FROM orders) rq
        ASOF LEFT JOIN (SELECT DISTINCT as_of_date FROM gr) x ON rq.day >= x.as_of_date
        LEFT JOIN gr ON gr.as_of_date = x.as_of_date AND gr.group_type = 'airport_total' AND gr.group_value = rq.org""",
        GROUP_ROLLUPS_CTE,
    ),
)
def asof_global(spark, sf):
    table = group_rollup_table(spark, sf).select("as_of_date", "group_type", "group_value", "dep_delay_7d_n", rounded("dep_delay_7d_median").alias("dep_delay_7d_median"))
    out = joins.asof_global(requests_from_orders(spark, sf), materialize(table, "rollups"), "FlightDate", "Origin", "airport_total")
    return out.select("o_orderkey", "as_of_date", "dep_delay_7d_n", "dep_delay_7d_median", F.col("missing").cast("int").alias("missing"))


# Sampling and splits; hashes are md5 in both engines

_ID = ["flight_id"]


def labelled(spark, sf):
    return X.scored(spark, sf).select("flight_id", "FlightDate", "y", "p15", "DepDelayMinutes")


def _hash(seed) -> str:
    return f"md5('{seed}|' || flight_id)"


def _balance_cte(frac: float) -> str:
    return f""", sz AS (SELECT CAST(sum(y) AS BIGINT) AS pos, CAST(count(*) - sum(y) AS BIGINT) AS neg FROM scored),
q AS (SELECT pos, neg, CAST(round_even(pos * (1 - {frac}::DOUBLE) / {frac}::DOUBLE, 0) AS BIGINT) AS need_neg, least(CAST(round_even(neg * {frac}::DOUBLE / (1 - {frac}::DOUBLE), 0) AS BIGINT), pos) AS need_pos FROM sz),
o AS (SELECT flight_id, y, row_number() OVER (PARTITION BY y ORDER BY {_hash(42)}) AS r FROM scored),
bal AS (SELECT flight_id, y FROM o, q WHERE pos = 0 OR neg = 0 OR r <= CASE WHEN y = 1 THEN CASE WHEN need_neg <= neg THEN pos ELSE need_pos END
  ELSE CASE WHEN need_neg <= neg THEN need_neg ELSE neg END END)"""


@query("balance_classes", on_scored("SELECT flight_id, y FROM bal", _balance_cte(0.5)))
def balance_classes(spark, sf):
    return sampling.balance_classes(labelled(spark, sf), "y", _ID).select("flight_id", "y")


@query("balance_classes_share", on_scored("SELECT flight_id, y FROM bal", _balance_cte(0.8)))
def balance_classes_share(spark, sf):
    return sampling.balance_classes(labelled(spark, sf), "y", _ID, 0.8).select("flight_id", "y")


@query(
    "balance_classes_capped",
    on_scored("SELECT flight_id, y FROM bal QUALIFY row_number() OVER (ORDER BY " + _hash("42-cap") + ") <= 3000", _balance_cte(0.5)),
)
def balance_classes_capped(spark, sf):
    return sampling.balance_classes(labelled(spark, sf), "y", _ID, max_rows=3000).select("flight_id", "y")


@query(
    "stratified_cap",
    on_scored(
        f"""SELECT flight_id, y FROM (SELECT flight_id, y, row_number() OVER (PARTITION BY y ORDER BY {_hash(42)}) AS r, count(*) OVER () AS n, sum(y) OVER () AS pos FROM scored)
        WHERE n <= 2000 OR r <= CASE WHEN y = 1 THEN round_even(2000 * (pos / n), 0) ELSE 2000 - round_even(2000 * (pos / n), 0) END"""
    ),
)
def stratified_cap(spark, sf):
    return sampling.stratified_cap(labelled(spark, sf), "y", _ID, 2000).select("flight_id", "y")


@query(
    "trailing_split",
    on_scored(
        """SELECT flight_id, CAST(FlightDate > m - 90 AS INTEGER) AS after_90, CAST(FlightDate >= m - 90 AS INTEGER) AS from_90
        FROM scored, (SELECT max(FlightDate) AS m FROM scored)"""
    ),
)
def trailing_split(spark, sf):
    f = sampling.trailing_split(labelled(spark, sf), "FlightDate", 90, out="after_90")
    f = sampling.trailing_split(f, "FlightDate", 90, inclusive=True, out="from_90")
    return f.select("flight_id", F.col("after_90").cast("int").alias("after_90"), F.col("from_90").cast("int").alias("from_90"))


@query(
    "stratified_split",
    on_scored(
        f"""SELECT flight_id, y, CASE WHEN r <= round(n * 0.2::DOUBLE) THEN 'test' WHEN r <= round(n * (0.2::DOUBLE + 0.2::DOUBLE)) THEN 'val' ELSE 'train' END AS part
        FROM (SELECT flight_id, y, row_number() OVER (PARTITION BY y ORDER BY {_hash(42)}) AS r, count(*) OVER (PARTITION BY y) AS n FROM scored)"""
    ),
)
def stratified_split(spark, sf):
    out = sampling.stratified_split(labelled(spark, sf), "y", _ID, {"test": 0.2, "val": 0.2, "train": 0.0})
    return out.select("flight_id", "y", "part")


@query("sample_n", on_scored(f"SELECT flight_id FROM scored QUALIFY row_number() OVER (ORDER BY {_hash(42)}) <= 500"))
def sample_n(spark, sf):
    return sampling.sample_n(labelled(spark, sf), 500, _ID).select("flight_id")


@query(
    "numeric_impute",
    "WITH l AS (SELECT *, CASE WHEN l_tax = 0.08 THEN NULL ELSE l_extendedprice END AS price, CASE WHEN l_discount < 0.03 THEN NULL ELSE l_quantity END AS qty FROM lineitem)"
    " SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(coalesce(price, (SELECT median(price) FROM l)), 6) AS price, coalesce(qty, (SELECT median(qty) FROM l)) AS qty FROM l",
)
def numeric_impute(spark, sf):
    items = X.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.expr("case when l_tax = 0.08 then null else l_extendedprice end").alias("price"),
        F.expr("case when l_discount < 0.03 then null else l_quantity end").alias("qty"),
    )
    return round_columns(impute.numeric_impute(items, ["price", "qty"]), ["price"])


@query("select_feature_columns", on_flights("SELECT Origin, CRSDepTime, 'y_dep_ge15,nope' AS dropped, count(*) AS n FROM flights GROUP BY ALL"))
def select_feature_columns(spark, sf):
    f = X.flights(spark, sf).withColumns(N.threshold_labels("DepDelayMinutes"))
    cats, nums, dropped = filters.select_feature_columns(f, ["Origin"], ["CRSDepTime", "y_dep_ge15", "nope"])
    return f.select(*cats, *nums, F.lit(",".join(dropped)).alias("dropped")).groupBy(*cats, *nums, "dropped").agg(F.count("*").alias("n"))


# Metrics


@query(
    "reliability_table",
    on_scored(
        """SELECT bin, count(*) AS count, round(avg(p30), 6) AS mean_pred, round(avg(y), 6) AS empirical_pos_rate, round((bin - 1) / 10.0, 6) AS bin_left,
        round(bin / 10.0, 6) AS bin_right, round((2 * bin - 1) / 20.0, 6) AS bin_mid FROM (SELECT *, CAST(greatest(ceil(p30 * 10), 1) AS INTEGER) AS bin FROM scored) GROUP BY bin"""
    ),
)
def reliability_table(spark, sf):
    out = metrics.reliability_table(X.scored(spark, sf), "y", "p30")
    return round_columns(out, ["mean_pred", "empirical_pos_rate", "bin_left", "bin_right", "bin_mid"])


@query("confusion_matrix", on_scored("SELECT y, CAST(p15 >= 0.5 AS INTEGER) AS pred, count(*) AS n FROM scored GROUP BY ALL"))
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(X.scored(spark, sf), "y", "p15")


@query(
    "classification_report",
    on_scored(
        """SELECT CAST(class AS INTEGER) AS class, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1, support FROM
        (SELECT class, count(*) FILTER (y = class AND pred = class) / count(*) FILTER (pred = class) AS p,
          count(*) FILTER (y = class AND pred = class) / count(*) FILTER (y = class) AS r, count(*) FILTER (y = class) AS support
         FROM (SELECT y, CAST(p15 >= 0.5 AS INTEGER) AS pred FROM scored), (VALUES (0), (1)) v(class) GROUP BY class)"""
    ),
)
def classification_report(spark, sf):
    return round_columns(metrics.classification_report(X.scored(spark, sf), "y", "p15"), ["precision", "recall", "f1"])


_CURVE = """, pt AS (SELECT p15 AS s, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY p15),
cv AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM pt WINDOW w AS (ORDER BY s DESC))"""


@query("roc_auc", on_scored("SELECT round(sum(neg * (tp - pos + pos / 2.0)) / any_value(p * n), 6) AS auc FROM cv", _CURVE))
def roc_auc(spark, sf):
    return metrics.ranking_scores(X.scored(spark, sf), "y", "p15").select(rounded("auc").alias("auc"))


@query("avg_precision", on_scored("SELECT round(sum(pos * (tp / (tp + fp))) / any_value(p), 6) AS average_precision FROM cv", _CURVE))
def avg_precision(spark, sf):
    return metrics.ranking_scores(X.scored(spark, sf), "y", "p15").select(rounded("average_precision").alias("average_precision"))


@query(
    "youden",
    on_scored(
        "SELECT s AS youden_threshold, round(tp / p, 6) AS youden_tpr, round(fp / n, 6) AS youden_fpr FROM cv ORDER BY tp / p - fp / n DESC, s DESC LIMIT 1", _CURVE
    ),
)
def youden(spark, sf):
    out = metrics.ranking_scores(X.scored(spark, sf), "y", "p15").select("youden_threshold", "youden_tpr", "youden_fpr")
    return round_columns(out, ["youden_tpr", "youden_fpr"])


_LABELLED_DOCS = """WITH d AS (SELECT quality, n_chars / (n_chars + 1000.0::DOUBLE) AS p FROM documents JOIN labels USING (doc_id)),
pt AS (SELECT p AS s, sum(quality) AS pos, sum(1 - quality) AS neg FROM d GROUP BY p),
cv AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM pt WINDOW w AS (ORDER BY s DESC))"""


@query("roc_auc_documents", _LABELLED_DOCS + " SELECT round(sum(neg * (tp - pos + pos / 2.0)) / any_value(p * n), 6) AS auc, round(sum(pos * (tp / (tp + fp))) / any_value(p), 6) AS average_precision FROM cv")
def roc_auc_documents(spark, sf):
    d = X.table(spark, sf, "documents").join(X.table(spark, sf, "labels"), "doc_id").withColumn("p", F.expr("n_chars / (n_chars + 1000.0D)"))
    return metrics.ranking_scores(d, "quality", "p").select(rounded("auc").alias("auc"), rounded("average_precision").alias("average_precision"))


def _register_scores(name, column, sql):
    @query(name, on_scored(f"SELECT round({sql}, 6) AS {column} FROM scored"))
    def run(spark, sf):
        return metrics.probability_scores(X.scored(spark, sf), "y", "p30").select(rounded(column).alias(column))


_CLIP = "greatest(0.000001::DOUBLE, least(0.999999::DOUBLE, p30))"
_register_scores("logloss", "logloss", f"avg(-(y * ln({_CLIP}) + (1 - y) * ln(1 - {_CLIP})))")
_register_scores("brier", "brier", "avg((p30 - y) * (p30 - y))")
_register_scores("accuracy", "accuracy", "avg(CAST(CAST(p30 >= 0.5 AS INTEGER) = y AS INTEGER))")


def binned(spark, sf):
    s = X.scored(spark, sf)
    return s.withColumns({"b": O.ge_to_bins("p15", "p30", "p45", "p60"), "true_bin": N.delay_bin("DepDelayMinutes")}).withColumn(
        "pred_bin", O.argmax_bin("b")
    )


_LABEL_LIST = "[" + ", ".join(f"'{x}'" for x in C.BIN_LABELS) + "]"
_BINNED = _BINS + f", bn AS (SELECT *, {_BIN_SQL} AS true_bin, {_LABEL_LIST}[list_position(b, list_max(b))] AS pred_bin FROM (SELECT *, coalesce(DepDelayMinutes, 0) AS d FROM bins))"


@query("bin_accuracy", on_scored("SELECT true_bin, pred_bin, count(*) AS n FROM bn GROUP BY ALL", _BINNED))
def bin_accuracy(spark, sf):
    return metrics.bin_accuracy(binned(spark, sf), "true_bin", "pred_bin")


@query(
    "bin_scores",
    on_scored(
        f"""SELECT round(avg(-ln(greatest(2.220446049250313e-16::DOUBLE, b[list_position({_LABEL_LIST}, true_bin)]))), 6) AS bin_logloss,
        round(avg(CAST(true_bin = pred_bin AS INTEGER)), 6) AS bin_accuracy FROM bn""",
        _BINNED,
    ),
)
def bin_scores(spark, sf):
    return round_columns(metrics.bin_scores(binned(spark, sf), "true_bin", "b"), ["bin_logloss", "bin_accuracy"])


# Text extraction: whole documents with a generated sentence about counts behind them

_SENTENCE = (
    "case doc_id % 5 when 0 then concat(' It has ', n_chars % 60, '  gates. ') when 1 then concat(' A total of ', n_chars % 90, ' Gates and with ', doc_id % 40, ' gates.')"
    " when 2 then concat(' a total ', n_chars % 3000, ' gates, has ', n_chars % 7, ' gates') when 3 then concat(' gates ', n_chars) else ' has 12 gates with 12 gates' end"
)
_COUNT_SQL = r"""WITH t AS (SELECT doc_id, trim(regexp_replace(text || CASE doc_id % 5 WHEN 0 THEN ' It has ' || n_chars % 60 || '  gates. ' WHEN 1 THEN ' A total of ' || n_chars % 90 || ' Gates and with ' || doc_id % 40 || ' gates.'
  WHEN 2 THEN ' a total ' || n_chars % 3000 || ' gates, has ' || n_chars % 7 || ' gates' WHEN 3 THEN ' gates ' || n_chars ELSE ' has 12 gates with 12 gates' END, '\s+', ' ', 'g')) AS x FROM documents),
m AS (
  SELECT doc_id, CAST(v AS INTEGER) AS v, c, meth FROM (
  SELECT doc_id, unnest(regexp_extract_all(x, '(?i)\btotal of\s+(\d{1,4})\s+gates\b', 1)) AS v, 0.95::DOUBLE AS c, 'total_of_gates' AS meth FROM t
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(x, '(?i)\ba total\s+(\d{1,4})\s+gates\b', 1)), 0.90, 'a_total_gates' FROM t
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(x, '(?i)\bhas\s+(\d{1,4})\s+gates\b', 1)), 0.75, 'has_gates' FROM t
  UNION ALL SELECT doc_id, unnest(regexp_extract_all(x, '(?i)\bwith\s+(\d{1,4})\s+gates\b', 1)), 0.60, 'with_gates' FROM t)
  WHERE CAST(v AS INTEGER) BETWEEN 1 AND 2000)
SELECT d.doc_id, b.value, coalesce(b.method, 'no_match') AS method, coalesce(b.confidence, 0.0) AS confidence, coalesce(b.candidates, '') AS candidates
FROM documents d LEFT JOIN (SELECT doc_id, arg_max(v, (c, v)) AS value, arg_max(meth, (c, v)) AS method,
  round(CASE WHEN count(DISTINCT v) > 1 THEN greatest(0.4::DOUBLE, max(c) - 0.15::DOUBLE) ELSE max(c) END, 6) AS confidence,
  CASE WHEN count(DISTINCT v) > 1 THEN array_to_string(list_sort(list(DISTINCT v)), ', ') ELSE '' END AS candidates FROM m GROUP BY doc_id) b USING (doc_id)"""


@query("extract_count_patterns", _COUNT_SQL)
def extract_count_patterns(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id", F.concat(F.col("text"), F.expr(_SENTENCE)).alias("text"))
    return extract.extract_count_patterns(d, "text", "gates").select(
        "doc_id", "value", "method", rounded("confidence").alias("confidence"),
        F.regexp_extract("notes", r"candidates: \[(.*)\]", 1).alias("candidates"),
    )


_TITLE = "<title>(.*?)</title>"


@query(
    "score_best_page",
    f"""SELECT host, arg_max(page_id, (score, -page_id)) AS page_id, max(score) AS score FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host,
      round(CASE WHEN contains(t, 'th') THEN 2.0 ELSE 0.0 END + CASE WHEN contains(t, 'international airport') THEN 0.5 ELSE 0.0 END + CASE WHEN contains(t, 'list of') THEN -2.0 ELSE 0.0 END
        + CASE WHEN contains(t, lang) THEN 0.3 ELSE 0.0 END + CASE WHEN contains(lower(html), lang) THEN 0.2 ELSE 0.0 END, 6) AS score
      FROM (SELECT *, replace(lower(regexp_extract(html, '{_TITLE}', 1)), 'airport', 'th') AS t, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang FROM pages)) GROUP BY host""",
)
def score_best_page(spark, sf):
    pages = X.table(spark, sf, "pages").withColumns(
        {
            "host": F.regexp_extract("url", "^[a-z]+://([^/]+)", 1),
            "t": F.replace(F.lower(F.regexp_extract("html", _TITLE, 1)), F.lit("th"), F.lit("airport")),
            "lang": F.regexp_extract("html", 'lang="([a-z]+)"', 1),
        }
    )
    scored = pages.withColumn("score", rounded(S.page_score("t", "html", "lang")))
    best = scored.groupBy("host").agg(F.max_by(F.struct("page_id", "score"), F.struct(F.col("score"), -F.col("page_id"))).alias("b"))
    return best.select("host", F.col("b.page_id").alias("page_id"), F.col("b.score").alias("score"))
