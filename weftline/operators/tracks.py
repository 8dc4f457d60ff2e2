"""Tracks, patterns of life, anomalies, change.

Track order is (instant, id), unlike that of contradictions, which is of the
timestamp text."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalars import EARTH_RADIUS_KM, haversine_km, hours_between, parse_ts, utc_hour, utc_weekday

# fixed values
SPEED_SIGMA = 2.5
DWELL_RADIUS_KM = 5.0


def track_points(entity_obs: DataFrame, key: str = "root") -> DataFrame:
    """Points with an instant, numbered from 0."""
    w = Window.partitionBy(key).orderBy("ts", "id")
    geo = entity_obs.where("lat is not null and lon is not null").withColumn("ts", parse_ts(F.col("timestamp"))).where("ts is not null")
    return geo.select(key, "id", "timestamp", "ts", "lat", "lon", (F.row_number().over(w) - 1).alias("seq"))


def track_legs(points: DataFrame, key: str = "root") -> DataFrame:
    """key, seq (of the leg's end), km, hours, kmh (null without time), raw_km."""
    w = Window.partitionBy(key).orderBy("seq")
    p = points.select("*", *[F.lag(c).over(w).alias(f"p_{c}") for c in ("ts", "lat", "lon")]).where("p_ts is not null")
    p = p.withColumn("raw_km", haversine_km(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))).withColumn("h", hours_between(F.col("p_ts"), F.col("ts")))
    kmh = F.when(F.col("h") > 1e-6, F.round(F.col("raw_km") / F.col("h"), 2))
    return p.select(key, "seq", "timestamp", F.round("raw_km", 3).alias("km"), F.round("h", 4).alias("hours"), kmh.alias("kmh"), "raw_km")


def track_summary(points: DataFrame, legs: DataFrame, key: str = "root") -> DataFrame:
    """Tracks of two points or more."""
    n = points.groupBy(key).agg(F.count("*").alias("point_count"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    return n.join(legs.groupBy(key).agg(F.round(F.sum("raw_km"), 3).alias("total_km")), key).where("point_count >= 2")


def hour_histogram(entity_obs: DataFrame, key: str = "root") -> DataFrame:
    o = entity_obs.withColumn("ts", parse_ts(F.col("timestamp"))).where("ts is not null")
    return o.groupBy(key, utc_hour(F.col("ts")).alias("hour")).agg(F.count("*").alias("n"))


def weekday_histogram(entity_obs: DataFrame, key: str = "root") -> DataFrame:
    o = entity_obs.withColumn("ts", parse_ts(F.col("timestamp"))).where("ts is not null")
    return o.groupBy(key, utc_weekday(F.col("ts")).alias("weekday")).agg(F.count("*").alias("n"))


def peak_hours(hours: DataFrame, key: str = "root", top: int = 4) -> DataFrame:
    """key, peak_hours: the most frequent hours, ascending."""
    w = Window.partitionBy(key).orderBy(F.desc("n"), "hour")
    best = hours.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top)
    return best.groupBy(key).agg(F.array_sort(F.collect_list("hour")).alias("peak_hours"))


class _Centres:
    """Running centres in a grid of cubes whose side is the radius, so that the
    centres near a point are in the cubes around its own.  A centre that moves to
    another cube is filed anew."""

    def __init__(self, radius_km: float):
        self.radius_km, self.all, self.grid = radius_km, [], {}
        self.side = 2 * math.sin(min(radius_km / (2 * EARTH_RADIUS_KM), math.pi / 2)) * (1 + 1e-9) or 1e-12

    def cube(self, lat: float, lon: float) -> tuple[int, int, int]:
        a, b = math.radians(lat), math.radians(lon)
        c = math.cos(a)
        return math.floor(c * math.cos(b) / self.side), math.floor(c * math.sin(b) / self.side), math.floor(math.sin(a) / self.side)

    def add(self, lat: float, lon: float) -> None:
        """To the first centre within the radius, in the order in which they came up, or to a new one."""
        x, y, z = self.cube(lat, lon)
        near = [k for i in (x - 1, x, x + 1) for j in (y - 1, y, y + 1) for c in (z - 1, z, z + 1) for k in self.grid.get((i, j, c), ())]
        for k in sorted(near):
            c = self.all[k]
            if _km(c[0], c[1], lat, lon) <= self.radius_km:
                c[2] += 1
                c[0], c[1] = c[0] + (lat - c[0]) / c[2], c[1] + (lon - c[1]) / c[2]
                if (cube := self.cube(c[0], c[1])) != c[3]:
                    self.grid[c[3]].remove(k)
                    self.grid.setdefault(cube, []).append(k)
                    c[3] = cube
                return
        self.grid.setdefault((x, y, z), []).append(len(self.all))
        self.all.append([lat, lon, 1, (x, y, z)])


def _areas(batches: Iterator[pa.RecordBatch], radius_km: float) -> Iterator[pa.RecordBatch]:
    """Points by key and in order to clusters.  Only the running centres of one
    key are held, whatever its number of points."""
    key, centres = None, _Centres(radius_km)

    def told() -> pa.RecordBatch:
        c = centres.all
        return pa.RecordBatch.from_arrays([pa.array([key] * len(c)), pa.array([x[0] for x in c]), pa.array([x[1] for x in c]), pa.array([x[2] for x in c], pa.int32())], names=["key", "lat", "lon", "n"])

    for batch in batches:
        for k, lat, lon in zip(*(batch[c].to_pylist() for c in ("key", "lat", "lon"))):
            if k != key:
                if centres.all:
                    yield told()
                key, centres = k, _Centres(radius_km)
            centres.add(lat, lon)
    if centres.all:
        yield told()


def _km(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    x, y = math.sin(math.radians(lat2 - lat1) / 2), math.sin(math.radians(lon2 - lon1) / 2)
    return 2 * EARTH_RADIUS_KM * math.asin(min(1.0, math.sqrt(x * x + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * y * y)))


def dwell_areas(points: DataFrame, key: str = "root", radius_km: float = DWELL_RADIUS_KM) -> DataFrame:
    """key, lat, lon, n: leader clusters of a track's points in their order.

    A point joins the first cluster whose running centre is near enough, or
    opens one; the outcome depends on the order, so it is a fold over the
    entity's points, which Spark sorts (and spills) and a task takes as a
    stream.
    """
    ordered = points.select(F.col(key).cast("string").alias("key"), "seq", "lat", "lon").repartition("key").sortWithinPartitions("key", "seq").drop("seq")
    found = ordered.mapInArrow(lambda batches: _areas(batches, radius_km), "key string, lat double, lon double, n int")
    return found.select(F.col("key").cast(dict(points.dtypes)[key]).alias(key), F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), "n")


def _upper_median(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """key, name, n: the upper median by key, from ranks, so that no key's values
    are put together."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(value))).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    return ranked.where(F.col("rank") == F.floor(F.col("n") / 2) + 1).select(key, F.col(value).alias(name), "n")


def speed_anomalies(legs: DataFrame, key: str = "root", sigma: float = SPEED_SIGMA) -> DataFrame:
    """Legs faster than the upper median by sigma spreads (1.4826 MAD, or half
    the median and 1 at least where that is nothing); three speeds at least."""
    moving = legs.where("kmh is not null")
    middle = _upper_median(moving.select(key, "kmh"), key, "kmh", "median").where("n >= 3").drop("n")
    apart = moving.join(middle, key).select(key, "median", F.abs(F.col("kmh") - F.col("median")).alias("off"))
    g = middle.join(_upper_median(apart, key, "off", "mad").drop("n"), key)
    spread = F.when(F.col("mad") <= 1e-6, F.greatest(0.5 * F.col("median"), F.lit(1.0))).otherwise(1.4826 * F.col("mad"))
    g = g.select(key, "median", "mad", (F.col("median") + sigma * spread).alias("ceiling"))
    return legs.join(g, key).where(F.col("kmh") > F.col("ceiling")).select(key, "seq", "timestamp", "kmh", F.round("median", 2).alias("median"), F.round("ceiling", 2).alias("ceiling"))


def off_pattern_hours(entity_obs: DataFrame, key: str = "root", least: int = 5) -> DataFrame:
    """Observations at an hour that an entity, seen often enough, has once."""
    o = entity_obs.withColumn("ts", parse_ts(F.col("timestamp"))).withColumn("hour", utc_hour(F.col("ts")))
    o = o.withColumn("n_obs", F.count("*").over(Window.partitionBy(key))).withColumn("n_hour", F.count("ts").over(Window.partitionBy(key, "hour")))
    return o.where("ts is not null and n_hour = 1").where(F.col("n_obs") >= least).select(key, "id", "hour", "n_obs")


def off_pattern_locations(points: DataFrame, areas: DataFrame, key: str = "root", radius_km: float = DWELL_RADIUS_KM) -> DataFrame:
    """Points far from every area in which the entity was twice or more."""
    known = areas.where("n >= 2").select(key, F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    far = points.join(known, key).groupBy(key, "id").agg(F.min(haversine_km(F.col("lat"), F.col("lon"), F.col("c_lat"), F.col("c_lon"))).alias("km"))
    return far.where(F.col("km") > max(6 * radius_km, 50.0)).select(key, "id", F.round("km", 1).alias("km"))


def detect_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """entity (lower case), change, disciplines before and after."""
    side = lambda o, name: o.where("entity <> ''").groupBy(F.lower("entity").alias("entity")).agg(F.array_sort(F.collect_set("discipline")).alias(name))
    both = side(before, "was").join(side(after, "now"), "entity", "full_outer")
    change = F.when(F.col("was").isNull(), "appeared").when(F.col("now").isNull(), "disappeared").when(F.col("was") != F.col("now"), "coverage-changed")
    return both.withColumn("change", change).where("change is not null").select("entity", "change", "was", "now")
