"""Scalar functions as Column expressions, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088
TOKEN = r"[a-z0-9][a-z0-9._-]*"
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it, and
    also inside lambdas (a projection that is merged into its consumer would be
    computed at each use)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    a = half(lat1, lat2) * half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2) * half(lon1, lon2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def parse_ts(text: Column) -> Column:
    """Instant of an ISO text; without an offset it is UTC; null if it is none."""
    has_offset = text.rlike(r"(?:[Zz]|[+-]\d\d:?\d\d)$")
    return F.coalesce(F.when(~has_offset, F.try_to_timestamp(F.concat(text, F.lit("Z")))), F.when(~has_offset, F.try_to_timestamp(F.concat(text, F.lit("T00:00:00Z")))), F.try_to_timestamp(text))


def hours_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / 3.6e9


def utc_hour(ts: Column) -> Column:
    return F.pmod(F.floor(F.unix_seconds(ts) / 3600), F.lit(24)).cast("int")


def utc_weekday(ts: Column) -> Column:
    """Mon to Sun, in UTC whatever the session's zone."""
    day = F.pmod(F.floor(F.unix_seconds(ts) / 86400) + 3, F.lit(7)).cast("int")
    return F.element_at(F.array(*[F.lit(d) for d in WEEKDAYS]), day + 1)


def norm_name(name: Column) -> Column:
    """Lower case; punctuation and runs of separators become one space."""
    plain = F.regexp_replace(F.lower(name), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(plain, r"[\s\-_/.]+", " "))


def name_tokens(name: Column) -> Column:
    """Different tokens of a normalised name."""
    return F.array_distinct(F.filter(F.split(norm_name(name), " "), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of different items; 0 if either is empty."""
    same = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), same / (F.size(a) + F.size(b) - same)).otherwise(F.lit(0.0))


#: Types whose values are the same in either case.
LOWER_CASE = ("email", "url", "sha256")


def norm_value(kind: Column, value: Column) -> Column:
    return F.when(kind.isin(*LOWER_CASE), F.lower(value)).otherwise(value)


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def entity_id(kind: Column, value: Column) -> Column:
    return F.concat(kind, F.lit("--"), F.substring(F.sha1(F.concat(kind, F.lit(":"), value)), 1, 16))


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID (version 5) of a namespace's 32 hex digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda at, n: F.substring(h, at, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


# --- source grading: fixed values --------------------------------------------

RELIABILITY = {"A": 1.0, "B": 0.8, "C": 0.6, "D": 0.4, "E": 0.2, "F": 0.5}
CREDIBILITY = {"1": 1.0, "2": 0.8, "3": 0.6, "4": 0.4, "5": 0.2, "6": 0.5}
DEFAULT_GRADES = {"OSINT": "C3", "SIGINT": "B2", "GEOINT": "B2", "IMINT": "B2", "HUMINT": "C3", "MASINT": "B2", "STRUCTURED": "B2"}


def _lookup(table: dict, key: Column, default) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def reliability_weight(code: Column) -> Column:
    return _lookup(RELIABILITY, F.upper(code), RELIABILITY["F"])


def credibility_weight(code: Column) -> Column:
    return _lookup(CREDIBILITY, code, CREDIBILITY["6"])


def default_grade(discipline: Column) -> Column:
    return _lookup(DEFAULT_GRADES, F.upper(discipline), "F6")


def grade_confidence(reliability: Column, credibility: Column) -> Column:
    """Geometric mean of both weights, to four places."""
    return F.round(F.sqrt(reliability_weight(reliability) * credibility_weight(credibility)), 4)


def observation_confidence(reliability: Column, credibility: Column) -> Column:
    """0.5 if nothing is graded."""
    none = (reliability == "") & (credibility == "")
    filled = grade_confidence(F.when(reliability == "", F.lit("F")).otherwise(reliability), F.when(credibility == "", F.lit("6")).otherwise(credibility))
    return F.when(none, F.lit(0.5)).otherwise(filled)
