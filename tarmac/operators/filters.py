"""Column canonicalisation and row filters; all of them push down into the scan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac import constants as C
from tarmac.functions.numbers import coerce_numeric
from tarmac.functions.text import key_text
from tarmac.functions.times import col


def canonicalize_columns(df: DataFrame) -> DataFrame:
    """Trimmed names; carrier and flight number from the first alias present; ids as text."""
    df = df.withColumnsRenamed({c: c.strip() for c in df.columns if c != c.strip()})
    for target, aliases in (
        ("Reporting_Airline", C.CARRIER_ALIASES),
        ("Flight_Number_Reporting_Airline", C.FLIGHT_NUMBER_ALIASES),
    ):
        source = next((a for a in aliases if a in df.columns), None)
        if target not in df.columns and source:
            df = df.withColumn(target, F.col(source))
    ids = [c for c in ("Reporting_Airline", "Origin", "Dest", "Tail_Number") if c in df.columns]
    return df.withColumns({c: F.col(c).cast("string") for c in ids})


def normalize_keys(df: DataFrame, texts=(), integers=(), dates=()) -> DataFrame:
    """Upper-case trimmed texts, integers from whatever parses, plain dates."""
    out = {c: key_text(F.col(c).cast("string")) for c in texts}
    out |= {c: coerce_numeric(c).cast("long") for c in integers}
    out |= {c: F.col(c).cast("date") for c in dates}
    return df.withColumns(out)


def _strict_date(value) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value)[:10])


def filter_date_range(df: DataFrame, date: str, start, end) -> DataFrame:
    """Inclusive range; a bound that is no date is an error, not an empty result."""
    return df.filter(F.col(date).between(F.lit(_strict_date(start)), F.lit(_strict_date(end))))


def filter_lookback(df: DataFrame, date: str, start, end, lookback_days: int) -> DataFrame:
    first = _strict_date(start) - dt.timedelta(days=lookback_days)
    return filter_date_range(df, date, first, end)


def filter_airline(df: DataFrame, carrier: str, single: str | None = None, several=None) -> DataFrame:
    """One airline wins over a list; neither keeps all."""
    if single:
        return df.filter(F.col(carrier) == single)
    return df.filter(F.col(carrier).isin([a.upper() for a in several])) if several else df


def drop_required_nulls(df: DataFrame, required) -> DataFrame:
    return df.dropna(subset=list(required))


def filter_nonstop_od(
    df: DataFrame, origin: str, dest: str, want_origin, want_dest, stops: str, departure: str, arrival: str, number: str,
) -> DataFrame:
    """Priced flights on exactly the asked route, without stops, with usable times and number."""
    return df.filter(
        (key_text(origin) == col(want_origin)) & (key_text(dest) == col(want_dest))
        & (F.coalesce(coerce_numeric(stops), F.lit(0.0)) == 0)
        & F.col(departure).isNotNull() & F.col(arrival).isNotNull()
        & (F.length(F.trim(F.col(number).cast("string"))) > 0)
    )


def select_feature_columns(
    df: DataFrame, categorical, numeric, exclude_prefixes=("y_dep_ge",), exclude_columns=(),
) -> tuple[list[str], list[str], list[str]]:
    """Requested features that exist and are not excluded, plus the names that were dropped."""
    have = set(df.columns)

    def keep(name: str) -> bool:
        return name in have and name not in exclude_columns and not name.startswith(tuple(exclude_prefixes))

    cats, nums = [c for c in categorical if keep(c)], [c for c in numeric if keep(c)]
    dropped = [c for c in [*categorical, *numeric] if c not in cats and c not in nums]
    if not cats and not nums:
        raise ValueError("no requested feature exists after exclusions")
    return cats, nums, dropped
