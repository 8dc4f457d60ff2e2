"""The driver's tables as reports and observations, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.scalars import default_grade
from weftline.operators.normalize import OBSERVATION_COLUMNS, observation_id

GAZETTEER = {
    "org": {"Thand Trading": ["thnd", "thand"], "Ertion Works": ["ertion"]},
    "person": {"Hereat Ou": ["hereat", "hereat ou"]},
    "place": {"Éléau": ["éeau", "ément"], "Onst": ["onst"]},
}
ZONES = [
    ("north gate", 32.0, -15.0, 120.0, "keep-out", "", []),
    ("basin", 36.0, -8.0, 350.0, "area-of-interest", "", []),
    ("channel", 40.5, 2.0, 200.0, "restricted", "", ["vessel", "emitter"]),
    ("mark", 31.0, -18.6, 0.0, "restricted", "", []),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and conversation turns."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.lit("").alias("timestamp"), "source", "text", (F.col("doc_id") * 1000).alias("report_ord"))
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("."), "turn").alias("id"), F.lit("").alias("timestamp"), F.col("role").alias("source"), "text", (F.lit(10**15) + F.col("conv_id") * 1000 + F.col("turn")).alias("report_ord"))
    return d.unionByName(c)


REPORTS_SQL = """reports as (
  select 'd' || doc_id as id, '' as timestamp, source, text, doc_id * 1000 as report_ord from documents
  union all
  select 'c' || conv_id || '.' || turn, '', role, text, 1000000000000000 + conv_id * 1000 + turn from conversations)"""


def linked_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as short reports that hold indicators of every type."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    hexed = F.sha2(F.col("o_custkey").cast("string"), 256)
    text = F.concat(
        F.lit("Wallet addr-"), "o_custkey", F.lit(" seen from 10."), F.col("c_nationkey"), F.lit("."), F.col("o_custkey") % 250, F.lit("."), F.col("o_orderkey") % 5, F.lit(", mail Desk."), F.col("c_nationkey"),
        F.lit("@Mail.example.com, see HTTPS://example.com/ or https://example.com/O/"), F.col("o_custkey") % 20, F.lit(" file "), F.when(F.col("o_orderkey") % 2 == 0, F.upper(hexed)).otherwise(hexed), F.lit(" near 12.3456, -"), F.col("c_nationkey"), F.lit(".500"), F.lit("."),
    )
    return o.select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.lit("").alias("timestamp"), F.lit("orders").alias("source"), text.alias("text"), F.col("o_orderkey").alias("report_ord"))


LINKED_SQL = """linked as (
  select 'o' || o_orderkey as id, o_orderkey as report_ord,
    'Wallet addr-' || o_custkey || ' seen from 10.' || c_nationkey || '.' || (o_custkey % 250) || '.' || (o_orderkey % 5) || ', mail Desk.' || c_nationkey
    || '@Mail.example.com, see HTTPS://example.com/ or https://example.com/O/' || (o_custkey % 20) || ' file '
    || case when o_orderkey % 2 = 0 then upper(sha256(o_custkey::varchar)) else sha256(o_custkey::varchar) end || ' near 12.3456, -' || c_nationkey || '.500.' as text
  from orders join customer on c_custkey = o_custkey)"""

#: Observations from events: every expression stands for Spark and DuckDB alike.
_COLUMNS = {
    "discipline": "case event_id % 6 when 0 then 'OSINT' when 1 then 'SIGINT' when 2 then 'GEOINT' when 3 then 'HUMINT' when 4 then 'MASINT' else 'STRUCTURED' end",
    "source": "concat('src', cast(event_id % 7 as varchar(9)))",
    "text": "concat(event_type, ' by unit ', cast(user_id as varchar(20)))",
    "entity": "case when event_id % 23 = 0 then '' when event_id % 5 = 0 then concat('Unit-', lpad(cast(user_id as varchar(20)), 7, '0')) when event_id % 11 = 0 then concat('taskgroup unit ', lpad(cast(user_id as varchar(20)), 7, '0')) else concat('unit ', lpad(cast(user_id as varchar(20)), 7, '0')) end",
    "entity_type": "case when user_id % 17 = 0 and event_id % 2 = 0 then 'craft' when user_id % 3 = 0 then 'vessel' when user_id % 3 = 1 then 'emitter' else 'team' end",
    "lat": "case when event_id % 19 = 0 then null else round(30 + (user_id % 40) * 0.25 + (event_id % 97) * 0.001, 6) end",
    "lon": "case when event_id % 19 = 0 then null else round(-20 + (user_id % 60) * 0.35 + (event_id % 89) * 0.0013 + case when event_id % 401 = 0 then 60 else 0 end, 6) end",
    "rel": "case when event_id % 4 = 0 then '' else substr('ABCDEF', cast(event_id % 6 as int) + 1, 1) end",
    "cred": "case when event_id % 4 = 0 then '' else substr('123456', cast(event_id % 5 as int) + 1, 1) end",
    "emitter_id": "case when event_id % 7 = 0 then concat('E', cast(user_id as varchar(20))) end",
    "status": "case when event_id % 13 = 0 then 'Active' when event_id % 13 = 1 then 'idle' end",
}


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    stamp = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    o = e.select(stamp.alias("timestamp"), "event_id", *[F.expr(x.replace("as varchar(20)", "as string").replace("as varchar(9)", "as string")).alias(c) for c, x in _COLUMNS.items()])
    grade = default_grade(F.col("discipline"))
    o = o.withColumn("lat", F.col("lat").cast("double")).withColumn("lon", F.col("lon").cast("double"))
    o = o.withColumn("reliability", F.when(F.col("rel") == "", F.substring(grade, 1, 1)).otherwise(F.col("rel"))).withColumn("credibility", F.when(F.col("cred") == "", F.substring(grade, 2, 1)).otherwise(F.col("cred")))
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in ("emitter_id", "status")]), lambda p: p["value"].isNotNull())
    o = o.withColumn("attributes", F.map_from_entries(pairs))
    o = o.withColumn("id", observation_id(*[F.col(c) for c in ("discipline", "source", "timestamp", "text", "entity", "entity_type", "lat", "lon")]))
    return o.select(*OBSERVATION_COLUMNS)


OBSERVATIONS_SQL = (
    "raw_obs as (select strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as timestamp, ts, " + ", ".join(f"{x} as {c}" for c, x in _COLUMNS.items() if c not in ("lat", "lon"))
    + ", cast(" + _COLUMNS["lat"] + " as double) as lat, cast(" + _COLUMNS["lon"] + " as double) as lon from events),\n"
    """obs as (select distinct on (id) * from (select
    'obs--' || substr(sha256(concat_ws('|', discipline, source, timestamp, text, entity, entity_type, case when lat is null then '' else printf('%.6f', lat) end, case when lon is null then '' else printf('%.6f', lon) end)), 1, 16) as id,
    discipline, source, timestamp, date_trunc('second', ts) as ts, text, entity, entity_type, lat, lon, emitter_id, status,
    case when rel <> '' then rel when discipline in ('OSINT', 'HUMINT') then 'C' else 'B' end as reliability,
    case when cred <> '' then cred when discipline in ('OSINT', 'HUMINT') then '3' else '2' end as credibility
    from raw_obs))"""
)


def zones(spark: SparkSession) -> DataFrame:
    from weftline.operators.geofence import ZONE_SCHEMA

    return spark.createDataFrame(ZONES, ZONE_SCHEMA)


ZONES_SQL = "zones(name, lat, lon, radius_km, kind, watch) as (values " + ", ".join(f"('{n}', {a}::double, {b}::double, {r}::double, '{k}', [{', '.join(repr(w) for w in ws)}]::varchar[])" for n, a, b, r, k, _, ws in ZONES) + ")"


def haversine_sql(a: str, b: str) -> str:
    """Distance between the points (a lat, a lon) and (b lat, b lon)."""
    return f"(2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2)))))"
