"""Pairs of an entity's points that are near each other, counted exactly.

Points stand in cubes of space.  Two cubes whose points are all near, or all
far, are told by their corners and count as a product, or not at all; two cubes
that the bound runs through are cut into their halves, and in the next round
their children are told apart in the same way.  Where few points are left, or
cubes are as small as LEVELS cuts make them, points are compared.  So the work
follows the cubes at the bound rather than the pairs of points, and no entity's
points are put together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.scalars import EARTH_RADIUS_KM, haversine_km
from weftline.functions.staging import discard, stage

#: Cuts of a cube whose side is the distance; pairs of points that are compared rather than cut.
LEVELS, FEW = 8, 1 << 14
#: Corners are told with this much to spare; points at the bound are compared.
SPARE = 1e-9


def _cells(points: DataFrame, side: float) -> DataFrame:
    return points.withColumns({f"c{a}": F.floor((F.col(a) + EARTH_RADIUS_KM) / side).cast("long") for a in "xyz"})


def _gaps(side: float) -> tuple[Column, Column]:
    """Least and greatest distance of points in the cubes (ax, ay, az) and (bx, by, bz)."""
    apart = [F.abs(F.col(f"a{a}") - F.col(f"b{a}")) for a in "xyz"]
    square = lambda steps: F.sqrt(sum((s * s for s in steps), F.lit(0))) * side
    return square([F.greatest(s - 1, F.lit(0)) for s in apart]), square([s + 1 for s in apart])


def near_pairs(entity_obs: DataFrame, km: float, key: str = "root") -> DataFrame:
    """key, points, near: the points of each entity that has one (null lat or lon
    is none; a null key is none either), and the pairs of them within km."""
    geo = entity_obs.where(f"lat is not null and lon is not null and `{key}` is not null").select(F.col(key).alias("key"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    lat, lon = F.radians("lat"), F.radians("lon")
    axes = {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}
    # points that are alike are one with a count
    points = stage(geo.groupBy("key", "lat", "lon").agg(F.count("*").alias("n")).withColumns({a: v * EARTH_RADIUS_KM for a, v in axes.items()}), "near-points")
    chord = 2 * EARTH_RADIUS_KM * math.sin(min(km / (2 * EARTH_RADIUS_KM), math.pi / 2))

    def cubes(level: int, side: str) -> DataFrame:
        """key, {side}x, {side}y, {side}z, {side}n, {side}p: the cubes of a level with their rows and points."""
        c = _cells(points, chord / 2**level).groupBy("key", "cx", "cy", "cz").agg(F.sum("n").alias("n"), F.count("*").alias("p"))
        return c.withColumnsRenamed({"cx": f"{side}x", "cy": f"{side}y", "cz": f"{side}z", "n": f"{side}n", "p": f"{side}p"})

    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) >= (0, 0, 0)]
    a = cubes(0, "a").withColumn("step", F.explode(F.array(*[F.struct(*[F.lit(v).alias(x) for x, v in zip("xyz", s, strict=True)]) for s in steps])))
    a = a.withColumns({f"b{x}": F.col(f"a{x}") + F.col(f"step.{x}") for x in "xyz"}).drop("step")
    pairs, found, tables = a.join(cubes(0, "b"), ["key", "bx", "by", "bz"]), [], [points]
    same = (F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by")) & (F.col("az") == F.col("bz"))
    for level in range(LEVELS + 1):
        least, most = _gaps(chord / 2**level)
        kind = F.when(most <= chord * (1 - SPARE), "all").when(least > chord * (1 + SPARE), "none")
        kind = F.coalesce(kind, F.when((F.col("ap") * F.col("bp") <= FEW) | F.lit(level == LEVELS), "few").otherwise("cut"))
        told = stage(pairs.withColumn("kind", kind).where("kind <> 'none'"), "near-cubes")
        tables.append(told)
        product = F.when(same, F.col("an") * (F.col("an") - 1) / 2).otherwise(F.col("an") * F.col("bn"))
        found.append(told.where("kind = 'all'").groupBy("key").agg(F.sum(product.cast("long")).alias("near")))
        placed = lambda side, level=level: _cells(points, chord / 2**level).select("key", *[F.col(f"c{x}").alias(f"{side}{x}") for x in "xyz"], *[F.col(c).alias(f"{side}_{c}") for c in ("lat", "lon", "n")])
        few = told.where("kind = 'few'").select("key", *[f"{s}{x}" for s in "ab" for x in "xyz"])
        met = few.join(placed("a"), ["key", "ax", "ay", "az"]).join(placed("b"), ["key", "bx", "by", "bz"])
        alike = (F.col("a_lat") == F.col("b_lat")) & (F.col("a_lon") == F.col("b_lon"))
        met = met.where((~same | (F.struct(F.col("a_lat").alias("u"), F.col("a_lon").alias("v")) <= F.struct(F.col("b_lat").alias("u"), F.col("b_lon").alias("v")))) & (haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")) <= km))
        found.append(met.groupBy("key").agg(F.sum(F.when(alike, F.col("a_n") * (F.col("a_n") - 1) / 2).otherwise(F.col("a_n") * F.col("b_n")).cast("long")).alias("near")))
        cut = told.where("kind = 'cut'").select("key", *[F.col(f"{s}{x}").alias(f"{s}{x}0") for s in "ab" for x in "xyz"])
        if level == LEVELS or cut.isEmpty():
            break
        half = lambda s, level=level: cubes(level + 1, s).withColumns({f"{s}{x}0": F.floor(F.col(f"{s}{x}") / 2) for x in "xyz"})
        pairs = cut.join(half("a"), ["key", "ax0", "ay0", "az0"]).join(half("b"), ["key", "bx0", "by0", "bz0"])
        own = F.array(*[F.col(f"a{x}0") for x in "xyz"]) == F.array(*[F.col(f"b{x}0") for x in "xyz"])
        pairs = pairs.where(~own | (F.array("ax", "ay", "az") <= F.array("bx", "by", "bz"))).select("key", *[f"{s}{x}" for s in "ab" for x in "xyznp"])
    near = found[0]
    for more in found[1:]:
        near = near.unionByName(more)
    out = points.groupBy("key").agg(F.sum("n").alias("points"), F.lit(0).cast("long").alias("near")).unionByName(near, True)
    out = stage(out.groupBy("key").agg(F.max("points").alias("points"), F.sum("near").alias("near")), "near-pairs")
    discard(*tables)
    return out.withColumnRenamed("key", key)
