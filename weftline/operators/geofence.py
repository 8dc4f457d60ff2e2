"""Zones: alerts for observations in or near them, and dwelling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.scalars import haversine_km

# fixed values
KIND_SEVERITY = {"keep-out": 3, "restricted": 2, "area-of-interest": 1}
PROXIMITY_FACTOR = 1.5
ZONE_SCHEMA = "name string, lat double, lon double, radius_km double, kind string, note string, watch_entity_types array<string>"
#: Cells are 180 / 2^y degrees high and 360 / 2^x wide, so that they close around
#: the earth; a zone takes the levels at which its reach is SPAN to 2 SPAN cells.
SPAN, FINEST = 3, 14


def zones_frame(records: DataFrame) -> DataFrame:
    """Defaults for what a zone leaves out."""
    given = lambda c, default: F.coalesce(F.col(c), default) if c in records.columns else default
    return records.select(
        "name", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), given("radius_km", F.lit(1.0)).cast("double").alias("radius_km"),
        given("kind", F.lit("area-of-interest")).alias("kind"), given("note", F.lit("")).alias("note"),
        given("watch_entity_types", F.expr("cast(array() as array<string>)")).alias("watch_entity_types"),
    )


def zone_cells(zones: DataFrame, factor: float = PROXIMITY_FACTOR) -> DataFrame:
    """Zones by each cell (ly, lx, cy, cx) that their reach may touch: levels ly and
    lx follow the height and the width of the reach, each for itself, so a zone
    has at most (2 SPAN + 1)^2 cells, wherever and however large it is.  Near a
    pole the reach is as wide as the earth."""
    reach = F.col("radius_km") * factor / 111.0 + 1e-6
    wide = reach / F.greatest(F.cos(F.radians(F.least(F.abs("lat") + reach, F.lit(89.9)))), F.lit(1e-3))
    z = zones.withColumn("__y", reach).withColumn("__x", F.when(F.abs("lat") + reach > 89, 180.0).otherwise(F.least(wide, F.lit(180.0))))
    level = lambda whole, half: F.greatest(F.lit(0), F.least(F.lit(FINEST), F.floor(F.log2(F.lit(SPAN * whole) / (2 * F.col(half)))))).cast("int")
    z = z.withColumn("ly", level(180.0, "__y")).withColumn("lx", level(360.0, "__x"))
    row = lambda lat: _row(lat, F.col("ly"))
    column = lambda lon: F.floor((lon + 180) * F.pow(2, F.col("lx")) / 360).cast("long")
    columns = F.transform(F.sequence(column(F.col("lon") - F.col("__x")), column(F.col("lon") + F.col("__x"))), lambda c: _around(c, F.col("lx")))
    z = z.withColumn("cy", F.explode(F.sequence(row(F.col("lat") - F.col("__y")), row(F.col("lat") + F.col("__y")))))
    return z.withColumn("cx", F.explode(F.array_distinct(columns))).drop("__y", "__x")


def _row(lat: Column, level: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(F.pow(2, level).cast("long") - 1, F.floor((lat + 90) * F.pow(2, level) / 180).cast("long")))


def _around(column: Column, level: Column) -> Column:
    return F.pmod(column, F.pow(2, level).cast("long"))


def evaluate(observations: DataFrame, zones: DataFrame, factor: float = PROXIMITY_FACTOR) -> DataFrame:
    """Alerts: zone, kind, entity, observation_id, timestamp, status, distance_km,
    range_of_radius (null for a radius of 0), severity.

    Observations and zones are joined on the cells they are in, at the levels
    that some zone uses, so the work follows what is near rather than the
    product of both, and a zone of a continent is a few cells like any other.
    """
    z = zone_cells(zones, factor)
    used = sorted(map(tuple, z.select("ly", "lx").distinct().collect()))  # a few of (FINEST + 1)^2 at most
    levels = F.array(*[F.struct(F.lit(y).alias("ly"), F.lit(x).alias("lx")) for y, x in used]) if used else F.expr("cast(array() as array<struct<ly: int, lx: int>>)")
    o = observations.where("lat is not null and lon is not null").select("id", "timestamp", "entity", "entity_type", F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"), F.inline(levels))
    o = o.withColumn("cy", _row(F.col("o_lat"), F.col("ly"))).withColumn("cx", _around(F.floor((F.col("o_lon") + 180) * F.pow(2, F.col("lx")) / 360).cast("long"), F.col("lx")))
    near = o.join(z, ["ly", "lx", "cy", "cx"]).where((F.size("watch_entity_types") == 0) | F.array_contains("watch_entity_types", F.col("entity_type")))
    near = near.withColumn("d", haversine_km(F.col("o_lat"), F.col("o_lon"), F.col("lat"), F.col("lon"))).where(F.col("d") <= F.col("radius_km") * factor)
    inside = F.col("d") <= F.col("radius_km")
    severity = F.lit(1)
    for kind, s in KIND_SEVERITY.items():
        severity = F.when(F.col("kind") == kind, F.lit(s)).otherwise(severity)
    return near.select(
        F.col("name").alias("zone"), "kind", F.when(F.col("entity") == "", "(unattributed)").otherwise(F.col("entity")).alias("entity"), F.col("id").alias("observation_id"), "timestamp",
        F.when(inside, "inside").otherwise("proximity").alias("status"), F.round("d", 3).alias("distance_km"),
        F.when(F.col("radius_km") > 0, F.round(F.col("d") / F.col("radius_km"), 3)).alias("range_of_radius"), (severity + inside.cast("int")).alias("severity"),
    )


def dwell_alerts(alerts: DataFrame, min_points: int = 2) -> DataFrame:
    """Entities inside a zone at least so often."""
    g = alerts.where("status = 'inside'").groupBy("zone", F.lower("entity").alias("entity")).agg(F.count("*").alias("points"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    return g.where(F.col("points") >= min_points)
