"""Records of each discipline become observations of one schema.

Absent texts are '' and not null; coordinates are null if absent.  Signals are
metadata only: the schema has no place for content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.scalars import default_grade

# fixed values
DISCIPLINES = ("OSINT", "SIGINT", "GEOINT", "HUMINT", "MASINT", "IMINT", "STRUCTURED")
OBSERVATION_COLUMNS = ("id", "discipline", "source", "timestamp", "text", "entity", "entity_type", "lat", "lon", "attributes", "reliability", "credibility")
_OWN = ("entity", "entity_type", "timestamp", "source", "lat", "lon", "reliability", "credibility", "text")


def _place(x: Column) -> Column:
    """A coordinate to six places; '' if absent.  One of six places anyway, as nearly
    all are, is put together from whole millionths, as formatting is dear."""
    millionths = F.round(F.abs(x) * 1e6).cast("long")
    plain = F.concat(F.when(x < 0, "-").otherwise(""), F.floor(millionths / 1_000_000).cast("string"), F.lit("."), F.lpad((millionths % 1_000_000).cast("string"), 6, "0"))
    near = F.abs(x).between(1e-6, 1e6) & (F.abs(F.abs(x) * 1e6 - millionths) < 1e-3)
    return F.when(x.isNull(), "").when(near, plain).otherwise(F.format_string("%.6f", x))


def observation_id(discipline: Column, source: Column, timestamp: Column, text: Column, entity: Column, entity_type: Column, lat: Column, lon: Column) -> Column:
    """A hash of eight fields, coordinates to six places."""
    parts = [discipline, source, timestamp, text, entity, entity_type, _place(lat), _place(lon)]
    return F.concat(F.lit("obs--"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16))


def _get(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _filled(*columns: Column) -> Column:
    """The first that is neither null nor ''; else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def _attributes(df: DataFrame, *names: str, **more: Column) -> Column:
    pairs = [(n, _get(df, n)) for n in names] + list(more.items())
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def _observation(df: DataFrame, discipline: str, source: Column, text: Column, entity: Column, entity_type: Column, attributes: Column) -> DataFrame:
    rel, cred = F.coalesce(_get(df, "reliability"), F.lit("")), F.coalesce(_get(df, "credibility"), F.lit(""))
    bare, grade = (rel == "") & (cred == ""), default_grade(F.lit(discipline))
    out = df.select(
        F.lit(discipline).alias("discipline"), source.alias("source"), F.coalesce(_get(df, "timestamp"), F.lit("")).alias("timestamp"), text.alias("text"),
        entity.alias("entity"), entity_type.alias("entity_type"), F.round(_get(df, "lat", "double"), 6).alias("lat"), F.round(_get(df, "lon", "double"), 6).alias("lon"),
        attributes.alias("attributes"),
        F.when(bare, F.substring(grade, 1, 1)).otherwise(rel).alias("reliability"), F.when(bare, F.substring(grade, 2, 1)).otherwise(cred).alias("credibility"),
    )
    fields = [F.col(c) for c in ("discipline", "source", "timestamp", "text", "entity", "entity_type", "lat", "lon")]
    return out.withColumn("id", observation_id(*fields)).select(*OBSERVATION_COLUMNS)


def osint(df: DataFrame) -> DataFrame:
    text = F.trim(_filled(_get(df, "text"), _get(df, "title")))
    return _observation(df, "OSINT", F.coalesce(_get(df, "source"), F.lit("osint")), text, F.coalesce(_get(df, "entity"), F.lit("")), F.coalesce(_get(df, "entity_type"), F.lit("")), _attributes(df, "url", "domain", "lang"))


def sigint(df: DataFrame) -> DataFrame:
    emitter = F.coalesce(_get(df, "emitter_id"), _get(df, "emitter"), F.lit("unknown-emitter"))
    part = lambda label, c, unit="": F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c, F.lit(unit)))
    text = F.concat_ws("; ", F.concat(F.lit("Signal metadata: emitter "), emitter), part("band ", _get(df, "freq_band")), part("bearing ", _get(df, "bearing"), "deg"), part("link ", _get(df, "link")))
    attributes = _attributes(df, "link", "freq_band", "bearing", "duration_s", "pulses", emitter_id=emitter)
    return _observation(df, "SIGINT", F.coalesce(_get(df, "source"), F.lit("sigint")), text, emitter, F.lit("emitter"), attributes)


def geoint(df: DataFrame, identifiers: bool = False) -> DataFrame:
    """identifiers: also carry imo, mmsi, callsign, hull and tail."""
    entity = F.coalesce(_get(df, "entity"), _get(df, "track_id"), F.lit("unknown"))
    kind = F.coalesce(_get(df, "entity_type"), F.lit("track"))
    shown = lambda n: F.coalesce(_get(df, n), F.lit("None"))
    text = F.concat_ws(
        "; ", F.concat(kind, F.lit(" "), entity, F.lit(" at "), shown("lat"), F.lit(","), shown("lon")),
        F.concat(F.lit("speed "), _get(df, "speed_kn"), F.lit("kn")), F.concat(F.lit("heading "), _get(df, "heading"), F.lit("deg")),
    )
    names = ("heading", "speed_kn", "track_id", "altitude_m") + (("imo", "mmsi", "callsign", "hull", "tail") if identifiers else ())
    return _observation(df, "GEOINT", F.coalesce(_get(df, "source"), F.lit("geoint")), text, entity, kind, _attributes(df, *names))


def humint(df: DataFrame) -> DataFrame:
    source = F.coalesce(_get(df, "source"), _get(df, "source_id"), F.lit("humint"))
    attributes = _attributes(df, source_id=F.nullif(_get(df, "source_id"), F.lit("")))
    return _observation(df, "HUMINT", source, F.trim(_filled(_get(df, "report"), _get(df, "text"))), F.coalesce(_get(df, "entity"), F.lit("")), F.coalesce(_get(df, "entity_type"), F.lit("")), attributes)


def masint(df: DataFrame) -> DataFrame:
    phenomenon = F.coalesce(_get(df, "phenomenology"), F.lit("signature"))
    value = F.coalesce(F.concat(F.lit(": "), _get(df, "measurement"), F.coalesce(_get(df, "unit"), F.lit(""))), F.lit(""))
    text = F.concat(F.lit("MASINT "), phenomenon, F.lit(" event"), value)
    attributes = _attributes(df, "measurement", "unit", "sensor", "confidence", phenomenology=phenomenon)
    source = F.coalesce(_get(df, "sensor"), _get(df, "source"), F.lit("masint"))
    return _observation(df, "MASINT", source, text, F.coalesce(_get(df, "entity"), phenomenon), F.coalesce(_get(df, "entity_type"), F.lit("sensor-event")), attributes)


def structured(df: DataFrame) -> DataFrame:
    """All columns but the common ones are attributes."""
    extra = sorted(c for c in df.columns if c not in _OWN)
    entity, kind = F.coalesce(_get(df, "entity"), F.lit("")), F.coalesce(_get(df, "entity_type"), F.lit("record"))
    listed = F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), _get(df, c)) for c in extra])
    text = F.trim(F.coalesce(F.nullif(_get(df, "text"), F.lit("")), F.concat(kind, F.lit(" "), entity, F.lit(" "), listed)))
    attributes = _attributes(df, *extra) if extra else F.expr("cast(map() as map<string,string>)")
    return _observation(df, "STRUCTURED", F.coalesce(_get(df, "source"), F.lit("structured")), text, entity, kind, attributes)


ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "osint": osint, "sigint": sigint, "sigint_meta": sigint, "geoint": geoint, "humint": humint, "masint": masint, "structured": structured,
}


def normalize(discipline: str, records: DataFrame) -> DataFrame:
    """KeyError for a discipline without an adapter."""
    return ADAPTERS[discipline.lower()](records)


def problems(o: DataFrame) -> DataFrame:
    """id, problems: what is wrong with each observation; nothing is dropped.

    A code is bad if it is no part of the list of codes, so 'AB' passes."""
    out = lambda c, low, high: c.isNotNull() & ~c.between(low, high)
    code = lambda c, allowed: (c != "") & ~F.lit(allowed).contains(c)
    checks = [
        (~F.col("discipline").isin(*DISCIPLINES), "unknown discipline"),
        (F.col("source") == "", "missing source"),
        (F.col("timestamp") == "", "missing timestamp"),
        (out(F.col("lat"), -90.0, 90.0), "lat out of range"),
        (out(F.col("lon"), -180.0, 180.0), "lon out of range"),
        (code(F.col("reliability"), "ABCDEF"), "bad reliability code"),
        (code(F.col("credibility"), "123456"), "bad credibility code"),
    ]
    return o.select("id", F.filter(F.array(*[F.when(test, F.lit(name)) for test, name in checks]), lambda p: p.isNotNull()).alias("problems"))


def to_reports(o: DataFrame) -> DataFrame:
    """Observations as reports, for extraction and retrieval."""
    text = F.coalesce(F.nullif("text", F.lit("")), F.trim(F.concat("entity_type", F.lit(" "), "entity")))
    return o.select("id", "timestamp", F.concat("discipline", F.lit(":"), "source").alias("source"), text.alias("text"))


OBSERVATION_SCHEMA = T.StructType(
    [T.StructField(c, T.DoubleType() if c in ("lat", "lon") else T.MapType(T.StringType(), T.StringType()) if c == "attributes" else T.StringType()) for c in OBSERVATION_COLUMNS]
)
