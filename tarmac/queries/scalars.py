"""Queries: date and time, numeric, string and conditional expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac import constants as C
from tarmac import fixtures as X
from tarmac.functions import numbers as N
from tarmac.functions import ordinal as O
from tarmac.functions import text as S
from tarmac.functions import tiers as R
from tarmac.functions import times as T
from tarmac.queries.registry import on_events, on_flights, on_flights_utc, on_scored, query, round_columns, rounded


@query(
    "hhmm_to_local_ts",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN c // 100 <= 23 AND c % 100 <= 59
    THEN CAST(l_shipdate AS DATE) + to_minutes(c // 100 * 60 + c % 100) END AS ts
    FROM (SELECT *, CAST(l_partkey % 2500 AS INTEGER) AS c FROM lineitem)""",
)
def hhmm_to_local_ts(spark, sf):
    items = X.table(spark, sf, "lineitem")
    clock = F.expr("cast(l_partkey % 2500 as int)")
    return items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.hhmm_to_local_ts("l_shipdate", clock).alias("ts"))


@query("local_to_utc", on_flights_utc("SELECT flight_id, dep_utc, arr_utc FROM flights_utc"))
def local_to_utc(spark, sf):
    return X.flights_utc(spark, sf).select("flight_id", "dep_utc", "arr_utc")


_ZONE_SQL = f"{X._sql_list(X.ZONES)}[user_id % 10 + 1]"


@query(
    "utc_to_local",
    f"""SELECT event_id, timezone({_ZONE_SQL}, ts AT TIME ZONE 'UTC') AS local_ts,
    CAST(timezone({_ZONE_SQL}, ts AT TIME ZONE 'UTC') AS DATE) AS local_date FROM events""",
)
def utc_to_local(spark, sf):
    e = X.table(spark, sf, "events")
    zone = X._pick(X.ZONES, F.expr("user_id % 10"))
    stamp = F.col("ts").cast("timestamp_ntz")
    return e.select("event_id", T.utc_to_local(stamp, zone).alias("local_ts"), T.local_date(stamp, zone).alias("local_date"))


@query(
    "local_date",
    f"""SELECT CAST(timezone({_ZONE_SQL}, ts AT TIME ZONE 'UTC') AS DATE) AS local_date, count(*) AS n FROM events GROUP BY ALL""",
)
def local_date(spark, sf):
    e = X.table(spark, sf, "events")
    zone = X._pick(X.ZONES, F.expr("user_id % 10"))
    return e.groupBy(T.local_date(F.col("ts").cast("timestamp_ntz"), zone).alias("local_date")).agg(F.count("*").alias("n"))


@query("overnight_arrival", on_flights("SELECT flight_id, arr_dt_local, CAST(arr_dt_local AS DATE) AS arr_local_date FROM flights"))
def overnight_arrival(spark, sf):
    return X.flights(spark, sf).select("flight_id", "arr_dt_local", F.col("arr_dt_local").cast("date").alias("arr_local_date"))


@query(
    "overnight_arrival_utc",
    on_flights_utc(
        f"""SELECT flight_id, CASE WHEN a0 <= dep_utc THEN a1 ELSE a0 END AS arr_after_dep FROM
        (SELECT flight_id, dep_utc, {X.utc_sql('t0', 'Dest_TZ')} AS a0, {X.utc_sql('t0 + INTERVAL 1 DAY', 'Dest_TZ')} AS a1
         FROM (SELECT *, FlightDate + to_minutes(CRSArrTime // 100 * 60 + CRSArrTime % 100) AS t0 FROM flights_utc))"""
    ),
)
def overnight_arrival_utc(spark, sf):
    f = X.flights_utc(spark, sf)
    same_day = T.hhmm_to_local_ts("FlightDate", "CRSArrTime")
    return f.select("flight_id", T.overnight_arrival_utc(same_day, "Dest_TZ", "dep_utc").alias("arr_after_dep"))


@query(
    "hhmm_to_minutes",
    """SELECT p_partkey, CAST(CASE WHEN c // 100 <= 47 AND c % 100 <= 59 THEN c // 100 * 60 + c % 100 END AS INTEGER) AS minutes
    FROM (SELECT p_partkey, CAST(p_partkey * 7 % 5300 AS INTEGER) AS c FROM part)""",
)
def hhmm_to_minutes(spark, sf):
    clock = F.expr("cast(p_partkey * 7 % 5300 as int)")
    return X.table(spark, sf, "part").select("p_partkey", T.hhmm_to_minutes(clock).alias("minutes"))


@query(
    "wrap_minute_diff",
    on_flights(
        """SELECT flight_id, CAST(CASE WHEN d < -720 THEN d + 1440 WHEN d > 720 THEN d - 1440 ELSE d END AS INTEGER) AS diff FROM
        (SELECT flight_id, (CRSArrTime // 100 * 60 + CRSArrTime % 100) - (CRSDepTime // 100 * 60 + CRSDepTime % 100) AS d FROM flights)"""
    ),
)
def wrap_minute_diff(spark, sf):
    diff = T.wrap_minute_diff(T.hhmm_to_minutes("CRSArrTime"), T.hhmm_to_minutes("CRSDepTime"))
    return X.flights(spark, sf).select("flight_id", diff.cast("int").alias("diff"))


@query(
    "calendar_features",
    on_flights(
        """SELECT flight_id, Origin || '_' || Dest AS od_pair, CAST(isodow(dep_dt_local) - 1 AS INTEGER) AS dep_dow,
        CAST(hour(dep_dt_local) AS INTEGER) AS sched_dep_hour FROM flights"""
    ),
)
def calendar_features(spark, sf):
    parts = T.calendar_features("Origin", "Dest", "dep_dt_local", "FlightDate", "CRSDepTime")
    return X.flights(spark, sf).select("flight_id", *[c.alias(n) for n, c in parts.items()])


_TG = "(make_date(year(d), 11, 1) + CAST((4 - isodow(make_date(year(d), 11, 1)) + 7) % 7 + 21 AS INTEGER))"


@query(
    "holiday_flag",
    f"""SELECT o_orderkey, CAST(abs(d - {_TG}) <= 2 OR abs(d - make_date(year(d), 12, 25)) <= 3 AS INTEGER) AS is_holiday
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""",
)
def holiday_flag(spark, sf):
    return X.table(spark, sf, "orders").select("o_orderkey", T.holiday_flag("o_orderdate").alias("is_holiday"))


@query(
    "nth_weekday",
    """SELECT o_orderkey, make_date(y, 11, 1) + CAST((4 - isodow(make_date(y, 11, 1)) + 7) % 7 + 21 AS INTEGER) AS fourth_thursday,
    make_date(y, 5, 1) + CAST((1 - isodow(make_date(y, 5, 1)) + 7) % 7 AS INTEGER) AS first_monday
    FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)""",
)
def nth_weekday(spark, sf):
    year = F.year("o_orderdate")
    return X.table(spark, sf, "orders").select(
        "o_orderkey", T.nth_weekday(year, 11, 3, 4).alias("fourth_thursday"), T.nth_weekday(year, 5, 0, 1).alias("first_monday")
    )


@query(
    "dep_time_block",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, printf('%02d00-%02d59', h, h) AS block FROM
    (SELECT *, CASE WHEN l_tax = 0.08 THEN 0 ELSE least(l_partkey % 2600 // 100, 23) END AS h FROM lineitem)""",
)
def dep_time_block(spark, sf):
    clock = F.expr("case when l_tax = 0.08 then null else cast(l_partkey % 2600 as int) end")
    return X.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.dep_time_block(clock).alias("block")
    )


@query(
    "parse_ts_variants",
    """SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL WHEN 2 THEN m + INTERVAL 5 HOUR WHEN 3 THEN m - INTERVAL 330 MINUTE
    ELSE m END AS parsed FROM (SELECT event_id, CASE WHEN event_id % 5 = 1 THEN date_trunc('second', ts) ELSE date_trunc('minute', ts) END AS m FROM events)""",
)
def parse_ts_variants(spark, sf):
    e = X.table(spark, sf, "events")
    minute = lambda fmt: F.date_format("ts", fmt)
    kind = F.expr("event_id % 5")
    text = (
        F.when(kind == 0, F.concat(minute("yyyy-MM-dd HH:mm"), F.lit("Z")))
        .when(kind == 1, minute("yyyy-MM-dd'T'HH:mm:ss"))
        .when(kind == 2, F.concat(minute("yyyy-MM-dd HH:mm"), F.lit("-05:00")))
        .when(kind == 3, F.concat(minute("yyyy-MM-dd'T'HH:mm"), F.lit("+05:30")))
        .otherwise(F.concat(F.lit("not "), minute("yyyy-MM-dd")))
    )
    return e.withColumn("text", text).select("event_id", T.parse_ts_utc("text").alias("parsed"))


@query(
    "status_delay_minutes",
    on_events(
        """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE round(epoch(CASE event_id % 3 WHEN 0 THEN tm + to_seconds(CAST(event_id % 4000 AS INTEGER))
        ELSE tm - to_seconds(CAST(user_id AS INTEGER)) END - tm) / 60.0, 6) END AS delay FROM ev"""
    ),
)
def status_delay_minutes(spark, sf):
    e = X.events(spark, sf).withColumns(
        {
            "runway": F.expr("case when event_id % 3 = 0 then tm + make_dt_interval(0, 0, 0, event_id % 4000) end"),
            "revised": F.expr("case when event_id % 3 <= 1 then tm - make_dt_interval(0, 0, 0, user_id) end"),
        }
    )
    return e.select("event_id", rounded(T.status_delay_minutes("tm", "runway", "revised")).alias("delay"))


@query(
    "coerce_numeric",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS number, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events",
)
def coerce_numeric(spark, sf):
    e = X.table(spark, sf, "events")
    text = F.expr("case event_id % 3 when 0 then cast(value as string) when 1 then concat('x', value) else 'NaN' end")
    return e.withColumn("text", text).select(
        "event_id", N.coerce_numeric("text").alias("number"), N.coerce_numeric(F.get_json_object("props", "$.k")).alias("k")
    )


@query(
    "unit_convert",
    """SELECT event_id, round(value + 273.15, 6) AS origin_temp_max_K, value AS origin_daily_precip_sum_mm FROM events""",
)
def unit_convert(spark, sf):
    e = X.table(spark, sf, "events").select(
        "event_id", F.col("value").alias("origin_temperature_2m_max"),
        F.col("value").cast("string").alias("origin_precipitation_sum"),
    )
    out = N.unit_convert(e).select("event_id", "origin_temp_max_K", "origin_daily_precip_sum_mm")
    return round_columns(out, ["origin_temp_max_K"])


@query(
    "weather_code_cast",
    """SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(p_size AS INTEGER) END AS origin_daily_weathercode FROM part""",
)
def weather_code_cast(spark, sf):
    p = X.table(spark, sf, "part").select(
        "p_partkey", F.expr("case when p_size % 7 = 0 then 'n/a' else concat(p_size, '.0') end").alias("origin_weathercode")
    )
    return N.weather_code_cast(p).select("p_partkey", "origin_daily_weathercode")


@query(
    "weather_kind",
    """SELECT p_partkey, CASE WHEN c IS NULL THEN 'unknown' WHEN c = 0 THEN 'clear' WHEN c IN (1, 2, 3) THEN 'cloud' WHEN c IN (45, 48) THEN 'fog'
    WHEN c BETWEEN 51 AND 67 OR c BETWEEN 80 AND 82 THEN 'rain' WHEN c BETWEEN 71 AND 77 THEN 'snow' WHEN c >= 95 THEN 'storm' ELSE 'cloud' END AS kind
    FROM (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_partkey % 100 END AS c FROM part)""",
)
def weather_kind(spark, sf):
    code = F.expr("case when p_partkey % 11 = 0 then null else p_partkey % 100 end")
    return X.table(spark, sf, "part").select("p_partkey", N.weather_kind(code).alias("kind"))


_AGE_SQL = """CASE WHEN a IS NULL THEN 'Unknown' WHEN a <= 5 THEN '0-5' WHEN a <= 10 THEN '6-10' WHEN a <= 15 THEN '11-15' ELSE '16+' END"""


@query(
    "age_bucket",
    f"""SELECT o_orderkey, {_AGE_SQL} AS bucket FROM
    (SELECT o_orderkey, CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE year(o_orderdate) - (1975 + o_custkey % 25) END AS a FROM orders)""",
)
def age_bucket(spark, sf):
    built = F.expr("case when o_custkey % 9 = 0 then null else 1975 + o_custkey % 25 end")
    return X.table(spark, sf, "orders").select("o_orderkey", N.age_bucket(N.age_years("o_orderdate", built)).alias("bucket"))


_TAIL_TEXT = """case l_orderkey % 6 when 0 then ' nan ' when 1 then 'Unknown' when 2 then concat('n00', l_suppkey)
    when 3 then concat(' N', l_suppkey, ' ') when 4 then null else concat('C-', l_suppkey) end"""
_ITEM = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query(
    "clean_sentinel",
    f"""SELECT {', '.join(_ITEM)}, CASE WHEN t IN ('', 'NAN', 'NONE', 'NULL', 'UNKNOWN', 'UNKN', 'NA') THEN '' ELSE t END AS tail
    FROM (SELECT *, coalesce(upper(trim({_TAIL_TEXT})), '') AS t FROM lineitem)""",
)
def clean_sentinel(spark, sf):
    return X.table(spark, sf, "lineitem").select(*_ITEM, S.clean_sentinel(F.expr(_TAIL_TEXT)).alias("tail"))


@query(
    "normalize_tail",
    f"""SELECT {', '.join(_ITEM)}, coalesce(ltrim(trim(regexp_replace(upper(trim({_TAIL_TEXT})), '^N', '')), '0'), '') AS n_number FROM lineitem""",
)
def normalize_tail(spark, sf):
    return X.table(spark, sf, "lineitem").select(*_ITEM, S.normalize_tail(F.expr(_TAIL_TEXT)).alias("n_number"))


@query(
    "categorical_fill",
    """SELECT p_partkey, CASE WHEN t IS NULL OR lower(trim(t)) IN ('', 'nan', 'none') THEN 'Unknown' ELSE t END AS filled
    FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN ' NaN' WHEN 1 THEN NULL WHEN 2 THEN '  ' ELSE p_type END AS t FROM part)""",
)
def categorical_fill(spark, sf):
    text = F.expr("case p_partkey % 5 when 0 then ' NaN' when 1 then null when 2 then '  ' else p_type end")
    return X.table(spark, sf, "part").select("p_partkey", S.categorical_fill(text).alias("filled"))


@query(
    "threshold_labels",
    on_flights(
        "SELECT flight_id, "
        + ", ".join(f"CAST(coalesce(DepDelayMinutes >= {t}, false) AS INTEGER) AS y_dep_ge{t}" for t in C.THRESHOLDS)
        + ", CAST(coalesce(DepDelayMinutes >= 15, false) AS INTEGER) AS y_dep15, "
        + ", ".join(f"CAST(coalesce(ArrDelayMinutes >= {t}, false) AS INTEGER) AS y_arr_ge{t}" for t in C.THRESHOLDS)
        + " FROM flights"
    ),
)
def threshold_labels(spark, sf):
    labels = N.threshold_labels("DepDelayMinutes") | N.threshold_labels("ArrDelayMinutes", "arr")
    return X.flights(spark, sf).select("flight_id", *[c.alias(n) for n, c in labels.items()])


_BIN_SQL = "CASE " + " ".join(f"WHEN d < {t} THEN '{b}'" for t, b in zip(C.THRESHOLDS, C.BIN_LABELS)) + f" ELSE '{C.BIN_LABELS[-1]}' END"


@query("delay_bin", on_flights(f"SELECT flight_id, {_BIN_SQL} AS bin FROM (SELECT flight_id, coalesce(DepDelayMinutes, 0) AS d FROM flights)"))
def delay_bin(spark, sf):
    return X.flights(spark, sf).select("flight_id", N.delay_bin("DepDelayMinutes").alias("bin"))


@query(
    "explain_reasons",
    on_flights(
        """SELECT flight_id, CASE WHEN len(r) = 0 THEN 'no strong delay signals detected' ELSE array_to_string(r[1:3], '; ') END AS reason
        FROM (SELECT flight_id, list_filter([
          CASE WHEN noise % 2 = 1 THEN 'limited flight-number history' END,
          CASE WHEN DepDelayMinutes >= 10 THEN 'this flight/route often departs late' END,
          CASE WHEN ArrDelayMinutes >= 10 THEN 'carrier delays elevated recently' END,
          CASE WHEN quantity >= 10 THEN 'origin station running late recently' END,
          CASE WHEN noise >= 30 THEN 'busy origin (recent congestion)' END,
          CASE WHEN noise / 100.0 >= 0.85 THEN 'typically high load factor (prior month)' END,
          CASE WHEN WheelsOff % 5 = 0 THEN 'weather that day' END], lambda x: x IS NOT NULL) AS r FROM flights)"""
    ),
)
def explain_reasons(spark, sf):
    reason = S.explain_reasons(
        F.expr("noise % 2"), "DepDelayMinutes", "ArrDelayMinutes", "quantity", "noise", F.expr("noise / 100.0D"),
        F.expr("case when WheelsOff % 5 = 0 then 1 end"),
    )
    return X.flights(spark, sf).select("flight_id", reason.alias("reason"))


@query(
    "format_probs",
    on_scored(
        """SELECT flight_id, printf('P≥15=%.3f, P≥30=%.3f, P≥45=%.3f, P≥60=%s', p15, p30, p45,
        CASE WHEN DepDelayMinutes IS NULL THEN 'nan' ELSE printf('%.3f', p60) END) AS probs FROM scored"""
    ),
)
def format_probs(spark, sf):
    p60 = F.expr("case when DepDelayMinutes is null then null else p60 end")
    return X.scored(spark, sf).select("flight_id", S.format_probs("p15", "p30", "p45", p60).alias("probs"))


@query(
    "alias_normalize",
    r"""SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[()\-/,]', ' ', 'g'), '\s+', ' ', 'g')) AS alias FROM documents""",
)
def alias_normalize(spark, sf):
    return X.table(spark, sf, "documents").select("doc_id", S.alias_normalize("text").alias("alias"))


@query(
    "extract_code",
    r"""SELECT p_partkey, nullif(regexp_extract(upper(p_name || ' (' || substr(p_brand, 7) || ') ' || p_type), '\b([A-Z0-9]{2})\b', 1), '') AS code2,
    nullif(regexp_extract(upper(p_name), '\b([A-Z0-9]{3})\b', 1), '') AS code3 FROM part""",
)
def extract_code(spark, sf):
    text = F.expr("concat(p_name, ' (', substr(p_brand, 7), ') ', p_type)")
    return X.table(spark, sf, "part").select(
        "p_partkey", S.extract_code(text, 2).alias("code2"), S.extract_code("p_name", 3).alias("code3")
    )


_NAMES = "case o_custkey % 6 when 0 then 'wn' when 1 then ' Southwest Airlines ' when 2 then 'DELTA' when 3 then 'Jet' when 4 then 'JetBlue' else 'United Airlines' end"


@query(
    "carrier_name_to_code",
    f"""SELECT o_orderkey, CASE WHEN regexp_matches(t, '^[A-Za-z0-9]{{2}}$') THEN upper(t) ELSE
    CASE lower(t) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in C.AIRLINE_NAMES.items())} END END AS code,
    CASE t {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in C.MARKETING_NAMES.items())} END AS marketing_code
    FROM (SELECT o_orderkey, trim({_NAMES}) AS t FROM orders)""",
)
def carrier_name_to_code(spark, sf):
    return X.table(spark, sf, "orders").withColumn("t", F.expr(_NAMES)).select(
        "o_orderkey", S.carrier_name_to_code("t").alias("code"), S.marketing_name_to_code("t").alias("marketing_code")
    )


@query(
    "normalize_flight_number",
    """SELECT o_orderkey, 'AA' || o_custkey AS flight FROM orders""",
)
def normalize_flight_number(spark, sf):
    number = F.expr("case o_orderkey % 3 when 0 then concat('aa ', o_custkey) when 1 then concat('AA', o_custkey, ' ') else cast(o_custkey as string) end")
    return X.table(spark, sf, "orders").select("o_orderkey", S.normalize_flight_number(F.lit(" aa"), number).alias("flight"))


@query(
    "snapshot_delay",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS delay FROM events""",
)
def snapshot_delay(spark, sf):
    first = F.expr("case event_id % 3 when 0 then cast(value as string) when 1 then 'late' end")
    second = F.when(F.expr("event_id % 3 < 2"), F.get_json_object("props", "$.k"))
    return X.table(spark, sf, "events").select("event_id", N.snapshot_delay(first, second).alias("delay"))


@query(
    "redact_url_params",
    r"""SELECT page_id, regexp_replace(url, '([?&](?:ref|utm_source)=)[^&#]*', '\1***', 'g') AS url FROM pages""",
)
def redact_url_params(spark, sf):
    return X.table(spark, sf, "pages").select("page_id", S.redact_url_params("url", ("ref", "utm_source")).alias("url"))


@query(
    "hash_spread",
    """SELECT c_custkey, CAST(('0x' || substr(sha256(c_name || '|' || '08:00'), 1, 8))::BIGINT % 1201 AS BIGINT) AS offset_s FROM customer""",
)
def hash_spread(spark, sf):
    return X.table(spark, sf, "customer").select("c_custkey", S.hash_spread("c_name", F.lit("08:00"), 1200).alias("offset_s"))


@query("parse_json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.a.b') AS deep FROM events")
def parse_json_props(spark, sf):
    from tarmac.sources.payloads import json_lookup

    return X.table(spark, sf, "events").select(
        "event_id", json_lookup("props", ["k"]).cast("int").alias("k"), json_lookup("props", ["a", "b"]).alias("deep")
    )


# Ordinal post-processing

_MONO = "p15 AS q15, least(p30, p15) AS q30, least(p45, p30, p15) AS q45, least(p60, p45, p30, p15) AS q60"
_BINS = f""", mono AS (SELECT *, {_MONO} FROM scored),
raw AS (SELECT *, [1.0::DOUBLE - q15, greatest(0.0::DOUBLE, q15 - q30), greatest(0.0::DOUBLE, q30 - q45), greatest(0.0::DOUBLE, q45 - q60), greatest(0.0::DOUBLE, q60)] AS r FROM mono),
bins AS (SELECT *, list_transform(r, lambda x: x / CASE WHEN list_sum(r) = 0 THEN 1.0 ELSE list_sum(r) END) AS b FROM raw)"""


@query("monotone_ge", on_scored(f"SELECT flight_id, {_MONO} FROM scored"))
def monotone_ge(spark, sf):
    names = ["q15", "q30", "q45", "q60"]
    return X.scored(spark, sf).select(
        "flight_id", *[c.alias(n) for n, c in zip(names, O.monotone_ge(["p15", "p30", "p45", "p60"]))]
    )


def with_bins(spark, sf):
    return X.scored(spark, sf).withColumn("b", O.ge_to_bins("p15", "p30", "p45", "p60"))


@query("ge_to_bins", on_scored("SELECT flight_id, " + ", ".join(f"round(b[{i + 1}], 6) AS b{i}" for i in range(5)) + " FROM bins", _BINS))
def ge_to_bins(spark, sf):
    return with_bins(spark, sf).select("flight_id", *[rounded(F.col("b")[i]).alias(f"b{i}") for i in range(5)])


_LABELS = "[" + ", ".join(f"'{x}'" for x in C.BIN_LABELS) + "]"


@query("argmax_bin", on_scored(f"SELECT flight_id, {_LABELS}[list_position(b, list_max(b))] AS predicted_bin FROM bins", _BINS))
def argmax_bin(spark, sf):
    return with_bins(spark, sf).select("flight_id", O.argmax_bin("b").alias("predicted_bin"))


_EXPECTED = "(b[1] * 7.5 + b[2] * 22.5 + b[3] * 37.5 + b[4] * 52.5 + b[5] * 75.0)"
_SEVERITY = "(b[2] + b[3] * 2 + b[4] * 3 + b[5] * 4)"
_RISK = "(b[2] * 0.25 + b[3] * 0.5 + b[4] * 0.75 + b[5])"


@query("expected_delay", on_scored(f"SELECT flight_id, round({_EXPECTED}, 6) AS expected_delay_minutes FROM bins", _BINS))
def expected_delay(spark, sf):
    return with_bins(spark, sf).select("flight_id", rounded(O.expected_delay("b")).alias("expected_delay_minutes"))


@query("severity", on_scored(f"SELECT flight_id, round({_SEVERITY}, 6) AS severity_score FROM bins", _BINS))
def severity(spark, sf):
    return with_bins(spark, sf).select("flight_id", rounded(O.severity("b")).alias("severity_score"))


@query(
    "severity_band",
    on_scored(
        f"""SELECT flight_id, CASE WHEN s < 0.9 THEN 'Safe' WHEN s < 1.8 THEN 'Mild' WHEN s < 2.7 THEN 'Caution' WHEN s < 3.6 THEN 'High' ELSE 'Dangerous' END AS band
        FROM (SELECT flight_id, round({_SEVERITY}, 6) AS s FROM bins)""",
        _BINS,
    ),
)
def severity_band(spark, sf):
    return with_bins(spark, sf).select("flight_id", O.severity_band(rounded(O.severity("b"))).alias("band"))


@query("risk_score", on_scored(f"SELECT flight_id, CAST(floor({_RISK} * 100 + 0.5) AS INTEGER) AS risk FROM bins", _BINS))
def risk_score(spark, sf):
    return with_bins(spark, sf).select("flight_id", O.risk_score("b").alias("risk"))


@query(
    "risk_band",
    on_scored(
        """SELECT flight_id, CASE WHEN n IS NULL THEN 'Unknown' WHEN n < 20 THEN 'Safe' WHEN n < 40 THEN 'Mild' WHEN n < 60 THEN 'Caution' ELSE 'High risk' END AS band
        FROM (SELECT flight_id, CASE WHEN DepDelayMinutes IS NULL THEN NULL ELSE p30 * 100 END AS n FROM scored)"""
    ),
)
def risk_band(spark, sf):
    score = F.expr("case when DepDelayMinutes is null then null else p30 * 100 end")
    return X.scored(spark, sf).select("flight_id", O.risk_band(score).alias("band"))


# Model tiers

_FLAGS = {f"f{i}": f"noise % {m} <> 0" for i, m in enumerate((2, 3, 4, 5, 6, 7))}


def flagged(spark, sf):
    return X.flights(spark, sf).withColumns({n: F.expr(e) for n, e in _FLAGS.items()})


_FLAGS_SQL = ", g AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in _FLAGS.items()) + " FROM flights)"


@query(
    "choose_model_tier",
    on_flights(
        """SELECT flight_id, CASE WHEN f0 AND f1 AND f2 AND f3 AND f4 AND f5 THEN 'full' WHEN f0 AND f2 AND f3 AND f4 AND f5 THEN 'daily_only_weather'
        WHEN f0 AND f1 AND f3 AND f5 THEN 'limited_history' ELSE 'fallback' END AS tier,
        CASE WHEN f1 AND f2 THEN 'full' WHEN f1 THEN 'limited_history' WHEN f0 AND f2 THEN 'daily_weather' END AS family FROM g""",
        _FLAGS_SQL,
    ),
)
def choose_model_tier(spark, sf):
    return flagged(spark, sf).select(
        "flight_id", R.choose_tier_by_groups("f0", "f1", "f2", "f3", "f4", "f5").alias("tier"),
        R.choose_tier_by_weather("f1", "f0", "f2").alias("family"),
    )


_HOURLY, _DAILY, _PAST = "origin_dep_temp_K", "origin_temp_max_K", "carrier_depdelay_mean_last7"
_TIERS = (R.Tier("full", (_HOURLY, _DAILY, _PAST)), R.Tier("daily_only", (_DAILY, _PAST)), R.Tier("limited", (_HOURLY, _DAILY)))
_FEATURES = {
    _HOURLY: "case when noise % 3 = 0 then null else quantity end",
    _DAILY: "case when noise % 5 = 0 then null else quantity end",
    _PAST: "case when noise % 2 = 0 then null else quantity end",
}


def featured(spark, sf):
    return X.flights(spark, sf).withColumns({n: F.expr(e) for n, e in _FEATURES.items()})


_MISS = f"list_filter([CASE WHEN noise % 3 = 0 THEN '{_HOURLY}' END, CASE WHEN noise % 5 = 0 THEN '{_DAILY}' END, CASE WHEN noise % 2 = 0 THEN '{_PAST}' END], lambda x: x IS NOT NULL)"


@query("feature_availability", on_flights(f"SELECT flight_id, array_to_string({_MISS}, ',') AS missing, CAST(len({_MISS}) AS INTEGER) AS n_missing FROM flights"))
def feature_availability(spark, sf):
    f = featured(spark, sf)
    missing = R.missing_features(_TIERS[0].features, set(f.columns))
    return f.select("flight_id", F.array_join(missing, ",").alias("missing"), F.size(missing).alias("n_missing"))


@query(
    "choose_tier_by_missing",
    on_flights(
        f"""SELECT flight_id,
        CASE WHEN h AND d AND p THEN 'full' WHEN NOT h AND d AND p THEN 'daily_only' WHEN NOT h THEN 'limited' WHEN d THEN 'limited' ELSE 'limited' END AS tier,
        CASE WHEN h AND d AND p THEN '' WHEN NOT h AND d AND p THEN ''
          WHEN NOT h THEN array_to_string(list_sort(list_filter(['{_HOURLY}', CASE WHEN NOT d THEN '{_DAILY}' END, CASE WHEN NOT p THEN '{_PAST}' END], lambda x: x IS NOT NULL)), ',')
          WHEN d THEN '' ELSE '{_DAILY}' END AS missing
        FROM (SELECT flight_id, noise % 3 <> 0 AS h, noise % 5 <> 0 AS d, noise % 2 <> 0 AS p FROM flights) WHERE NOT (h AND NOT d AND p)
        UNION ALL SELECT flight_id, 'full', '{_DAILY}' FROM flights WHERE noise % 3 <> 0 AND noise % 5 = 0 AND noise % 2 <> 0"""
    ),
)
def choose_tier_by_missing(spark, sf):
    f = featured(spark, sf)
    choice = R.choose_tier_by_missing(*_TIERS, set(f.columns))
    return f.withColumn("c", choice).select("flight_id", F.col("c.tier").alias("tier"), F.array_join("c.missing", ",").alias("missing"))


@query(
    "model_locator",
    on_flights(
        """SELECT flight_id, Reporting_Airline || '_50_23-25_' || CASE WHEN f1 THEN 'weather+' ELSE 'weather' END || '_' || CASE WHEN f2 THEN 'standard' ELSE 'minhist' END AS model_id FROM g""",
        _FLAGS_SQL,
    ),
)
def model_locator(spark, sf):
    key = R.model_locator("Reporting_Airline", F.lit(50), F.lit("23-25"), "f1", "f2")
    return flagged(spark, sf).select("flight_id", key.alias("model_id"))
