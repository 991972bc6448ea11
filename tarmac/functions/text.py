"""String expressions: keys, codes, aliases, explanations and pattern extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarmac import constants as C
from tarmac.functions.times import col


def key_text(c) -> Column:
    """Upper case without surrounding blanks."""
    return F.upper(F.trim(col(c)))


def clean_sentinel(c) -> Column:
    """Tail numbers; every way of writing "none" becomes the empty text."""
    text = F.coalesce(key_text(c), F.lit(""))
    return F.when(text.isin(*C.TAIL_SENTINELS), "").otherwise(text)


def normalize_tail(c) -> Column:
    """Registry number of a tail: no leading N, no leading zeros."""
    bare = F.regexp_replace(key_text(c), "^N", "")
    return F.coalesce(F.regexp_replace(F.trim(bare), "^0+", ""), F.lit(""))


def categorical_fill(c) -> Column:
    """Null and "no category" texts become Unknown; other values keep their text."""
    text = col(c).cast("string")
    missing = text.isNull() | F.lower(F.trim(text)).isin(*C.CATEGORY_SENTINELS)
    return F.when(missing, "Unknown").otherwise(text)


def alias_normalize(c) -> Column:
    """Lower case, brackets and separators to blanks, runs of blanks to one."""
    blanked = F.regexp_replace(F.lower(col(c)), r"[()\-/,]", " ")
    return F.trim(F.regexp_replace(blanked, r"\s+", " "))


def extract_code(c, length: int) -> Column:
    """The first stand-alone code of that length; null when there is none."""
    found = F.regexp_extract(F.upper(col(c)), rf"\b([A-Z0-9]{{{length}}})\b", 1)
    return F.nullif(found, F.lit(""))


def _lookup(entries: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in entries.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def carrier_name_to_code(name) -> Column:
    """Two-character codes pass through; known airline names become codes; else null."""
    text = F.trim(col(name))
    return F.when(text.rlike("^[A-Za-z0-9]{2}$"), F.upper(text)).otherwise(
        _lookup(C.AIRLINE_NAMES, F.lower(text))
    )


def marketing_name_to_code(name, fallback=None) -> Column:
    """The fallback code wins when given; else the feed's carrier name is looked up."""
    code = _lookup(C.MARKETING_NAMES, F.trim(col(name)))
    if fallback is None:
        return code
    given = F.upper(F.trim(col(fallback)))
    return F.when(F.length(given) > 0, given).otherwise(code)


def normalize_flight_number(carrier, number) -> Column:
    """``AA`` with ``AA 1821`` or ``1821`` gives ``AA1821``."""
    code = key_text(carrier)
    bare = F.replace(F.trim(col(number).cast("string")), F.lit(" "), F.lit(""))
    has_code = F.startswith(F.upper(bare), code)
    return F.concat(code, F.when(has_code, F.substring(bare, F.length(code) + 1, F.length(bare))).otherwise(bare))


def redact_url_params(url, names=("access_key",)) -> Column:
    """Values of the named query parameters become ``***``."""
    keys = "|".join(names)
    return F.regexp_replace(col(url), rf"([?&](?:{keys})=)[^&#]*", "$1***")


def hash_spread(key, slot, max_value) -> Column:
    """A stable offset in 0..max_value from the first four bytes of a SHA-256."""
    digest = F.sha2(F.concat_ws("|", col(key), col(slot)), 256)
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    top = col(max_value) if not isinstance(max_value, int) else F.lit(max_value)
    return F.when(top <= 0, F.lit(0).cast("long")).otherwise(number % (top + 1))


def format_probs(p15, p30, p45, p60) -> Column:
    parts = [
        F.concat(
            F.lit(f"P≥{t}="),
            F.when(col(p).isNull() | F.isnan(col(p)), "nan").otherwise(F.format_string("%.3f", col(p))),
        )
        for t, p in zip(C.THRESHOLDS, (p15, p30, p45, p60))
    ]
    return F.concat_ws(", ", *parts)


def explain_reasons(
    low_support, flight_mean, carrier_mean, carrier_origin_mean, congestion, load_factor, weather_code,
    limit: int = 3,
) -> Column:
    """The first few of the reasons that apply, in fixed order."""
    rules = [
        (col(low_support) == 1, C.REASON_LOW_SUPPORT),
        (col(flight_mean) >= C.REASON_MEAN_DELAY, C.REASON_FLIGHT),
        (col(carrier_mean) >= C.REASON_MEAN_DELAY, C.REASON_CARRIER),
        (col(carrier_origin_mean) >= C.REASON_MEAN_DELAY, C.REASON_STATION),
        (col(congestion) >= C.REASON_CONGESTION_COUNT, C.REASON_CONGESTION),
        (col(load_factor) >= C.REASON_LOAD_FACTOR, C.REASON_LOAD),
        (col(weather_code).isNotNull(), C.REASON_WEATHER),
    ]
    found = F.array_compact(F.array(*[F.when(test, text) for test, text in rules]))
    return F.when(F.size(found) == 0, C.NO_REASON).otherwise(F.array_join(F.slice(found, 1, limit), "; "))


def page_score(title, snippet, code) -> Column:
    """How much a page looks like the airport's own article."""
    t, s, k = F.lower(col(title)), F.lower(col(snippet)), F.lower(col(code))
    points = [(F.contains(t, F.lit(phrase)), weight) for phrase, weight in C.PAGE_TITLE_WEIGHTS]
    points += [(F.contains(t, k), C.PAGE_CODE_IN_TITLE), (F.contains(s, k), C.PAGE_CODE_IN_SNIPPET)]
    total = F.lit(0.0)
    for test, weight in points:
        total = total + F.when(test, weight).otherwise(0.0)
    return total
