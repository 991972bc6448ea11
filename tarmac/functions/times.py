"""Date and time expressions.

Local wall-clock times and UTC instants are both TIMESTAMP_NTZ, so no result depends on the session
time zone. UTC columns carry ``utc`` in their names.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TS = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2})(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?$"
_WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def one_day() -> Column:
    return F.expr("INTERVAL 1 DAY")


def int_div(a, b: int) -> Column:
    return F.floor(col(a) / F.lit(b)).cast("int")


def hhmm_to_local_ts(date, hhmm) -> Column:
    """Date plus an HHMM clock number; hour 24 and other impossible clocks give null."""
    clock = col(hhmm).cast("int")
    day = col(date).cast("date")
    return F.try_make_timestamp_ntz(
        F.year(day), F.month(day), F.dayofmonth(day), int_div(clock, 100), clock % 100,
        F.lit(0).cast("decimal(16,6)"),
    )


def local_to_utc(ts, zone) -> Column:
    """Wall clock in ``zone`` to UTC; the earlier instant in an overlap, shifted forward in a gap."""
    return F.convert_timezone(col(zone), F.lit("UTC"), col(ts))


def utc_to_local(ts, zone) -> Column:
    return F.convert_timezone(F.lit("UTC"), col(zone), col(ts))


def local_date(ts_utc, zone) -> Column:
    return utc_to_local(ts_utc, zone).cast("date")


def overnight_arrival(arr_local, dep_hhmm, arr_hhmm) -> Column:
    """Move an arrival to the next day when its clock is before the departure clock."""
    return F.when(col(arr_hhmm) < col(dep_hhmm), col(arr_local) + one_day()).otherwise(col(arr_local))


def overnight_arrival_utc(arr_local, arr_zone, dep_utc) -> Column:
    """The arrival in UTC, a day later when it would not be after the departure."""
    same_day = local_to_utc(arr_local, arr_zone)
    return F.when(same_day <= col(dep_utc), local_to_utc(col(arr_local) + one_day(), arr_zone)).otherwise(same_day)


def epoch_seconds(ts) -> Column:
    """Whole seconds since 1970 of a TIMESTAMP_NTZ, whatever the session zone."""
    t = col(ts)
    return (
        F.unix_date(t.cast("date")).cast("long") * 86400
        + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    )


def epoch_micros(ts) -> Column:
    seconds = F.date_part(F.lit("SECOND"), col(ts)) * 1000000
    t = col(ts)
    return (
        F.unix_date(t.cast("date")).cast("long") * 86400000000
        + (F.hour(t) * 3600 + F.minute(t) * 60).cast("long") * 1000000 + seconds.cast("long")
    )


def hhmm_to_minutes(hhmm) -> Column:
    """HHMM to minutes of the day, with hours up to 47; anything else gives null."""
    clock = F.floor(col(hhmm)).cast("int")
    hours, minutes = int_div(clock, 100), clock % 100
    return F.when((clock >= 0) & (hours <= 47) & (minutes <= 59), hours * 60 + minutes)


def wrap_minute_diff(actual, scheduled) -> Column:
    diff = col(actual) - col(scheduled)
    return F.when(diff < -720, diff + 1440).when(diff > 720, diff - 1440).otherwise(diff)


def nth_weekday(year, month: int, weekday: int, n: int) -> Column:
    """The n-th weekday (Monday = 0) of a month."""
    eve = F.date_sub(F.make_date(col(year), F.lit(month), F.lit(1)), 1)
    return F.date_add(F.next_day(eve, _WEEKDAYS[weekday]), 7 * (n - 1))


def holiday_flag(date, thanksgiving_window: int = 2, christmas_window: int = 3) -> Column:
    """1 near the fourth Thursday of November or near 25 December of the same year, else 0."""
    day = col(date).cast("date")
    thanksgiving = nth_weekday(F.year(day), 11, 3, 4)
    christmas = F.make_date(F.year(day), F.lit(12), F.lit(25))
    near = (F.abs(F.date_diff(day, thanksgiving)) <= thanksgiving_window) | (
        F.abs(F.date_diff(day, christmas)) <= christmas_window
    )
    return F.coalesce(near.cast("int"), F.lit(0))


def calendar_features(origin, dest, dep_local, date, dep_hhmm) -> dict[str, Column]:
    """``od_pair``, weekday (Monday = 0) and hour; both fall back to date and clock number."""
    when_local = col(dep_local)
    return {
        "od_pair": F.concat_ws("_", col(origin), col(dest)),
        "dep_dow": F.weekday(F.coalesce(when_local.cast("date"), col(date).cast("date"))),
        "sched_dep_hour": F.coalesce(F.hour(when_local), int_div(dep_hhmm, 100)),
    }


def dep_time_block(hhmm) -> Column:
    """``HH00-HH59``; null counts as hour 0, hours are held in 0..23."""
    hour = F.greatest(F.least(F.coalesce(int_div(hhmm, 100), F.lit(0)), F.lit(23)), F.lit(0))
    return F.format_string("%02d00-%02d59", hour, hour)


def _ts_part(text, group: int) -> Column:
    return F.regexp_extract(F.trim(col(text)), _TS, group)


def parse_wall_clock(text) -> Column:
    """The wall clock written in a timestamp text, whatever its offset."""
    seconds = F.when(_ts_part(text, 3) == "", ":00").otherwise(_ts_part(text, 3))
    return F.concat(_ts_part(text, 1), F.lit(" "), _ts_part(text, 2), seconds).try_cast("timestamp_ntz")


def parse_ts_utc(text) -> Column:
    """Timestamps written as ``…Z``, ``…±hh:mm`` or plain (taken as UTC), with blank or T inside."""
    offset = _ts_part(text, 5)
    minutes = F.when(
        F.length(offset) == 6,
        F.when(F.substring(offset, 1, 1) == "-", -1).otherwise(1)
        * (F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, 5, 2).cast("int")),
    ).otherwise(0)
    return parse_wall_clock(text) - F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0).cast("decimal(18,6)"))


def status_delay_minutes(scheduled, runway, revised) -> Column:
    """Minutes from the scheduled time to the runway time, or to the revised one."""
    actual = F.coalesce(col(runway), col(revised))
    return (epoch_seconds(actual) - epoch_seconds(col(scheduled))) / 60.0
