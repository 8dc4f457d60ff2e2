"""Corroboration scores, contradictions.

entity_obs: observations with the entity_id (or root) they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalars import haversine_km, hours_between, observation_confidence, parse_ts
from weftline.operators.colocation import near_pairs

# fixed values
MAX_PLAUSIBLE_KMH = 1200.0
COLOCATION_KM = 25.0
EXCLUSIVE = ("entity_type", "status", "flag_state", "affiliation")


def colocation(entity_obs: DataFrame, key: str = "root", points: int | None = None) -> DataFrame:
    """key, colocation: the share of pairs of an entity's points within
    COLOCATION_KM, counted by cubes.  points: only the first so many in order of
    time and id (None: all)."""
    geo = entity_obs.where("lat is not null and lon is not null")
    if points is not None:
        order = Window.partitionBy(key).orderBy("timestamp", "id")
        geo = geo.select(key, "lat", "lon", F.row_number().over(order).alias("rn")).where(F.col("rn") <= points)
    every = near_pairs(geo, COLOCATION_KM, key).where("points > 1")
    return every.select(key, (F.col("near") / (F.col("points") * (F.col("points") - 1) / 2)).alias("colocation"))


def band(score: Column, disciplines: Column, sources: Column) -> Column:
    return F.when((sources <= 1) & (disciplines <= 1), "single-source").when(score >= 0.72, "strong").when(score >= 0.45, "moderate").otherwise("weak")


def corroboration(entity_obs: DataFrame, key: str = "root", points: int | None = None) -> DataFrame:
    """key, n_disciplines, n_sources, mean_confidence, colocation, score, band."""
    g = entity_obs.groupBy(key).agg(
        F.countDistinct("discipline").alias("n_disciplines"), F.countDistinct("source").alias("n_sources"),
        F.avg(observation_confidence(F.col("reliability"), F.col("credibility"))).alias("mean_confidence"),
    )
    g = g.join(colocation(entity_obs, key, points), key, "left").withColumn("colocation", F.coalesce("colocation", F.lit(0.0)))
    raw = 0.45 * (1 - F.pow(F.lit(0.6), F.col("n_disciplines"))) + 0.25 * (1 - F.pow(F.lit(0.7), F.col("n_sources"))) + 0.20 * F.col("mean_confidence") + 0.10 * F.col("colocation")
    g = g.withColumn("score", F.round(raw, 4))
    return g.withColumn("band", band(F.col("score"), F.col("n_disciplines"), F.col("n_sources")))


def spatial_contradictions(entity_obs: DataFrame, key: str = "root", limit_kmh: float = MAX_PLAUSIBLE_KMH) -> DataFrame:
    """Neighbours in order of the timestamp text whose distance is too far for
    the time between them: infinite speed if there is none and they are over a
    kilometre apart."""
    w = Window.partitionBy(key).orderBy("timestamp", "id")
    geo = entity_obs.where("lat is not null and lon is not null").withColumn("ts", parse_ts(F.col("timestamp")))
    pair = geo.select(key, "id", "timestamp", "ts", "lat", "lon", *[F.lead(c).over(w).alias(f"next_{c}") for c in ("id", "timestamp", "ts", "lat", "lon")])
    pair = pair.where("ts is not null and next_ts is not null")
    km, h = haversine_km(F.col("lat"), F.col("lon"), F.col("next_lat"), F.col("next_lon")), F.abs(hours_between(F.col("ts"), F.col("next_ts")))
    pair = pair.withColumn("km", km).withColumn("hours", h)
    kmh = F.when(F.col("hours") < 1e-6, F.when(F.col("km") > 1, F.lit(float("inf"))).otherwise(0.0)).otherwise(F.col("km") / F.col("hours"))
    return pair.withColumn("kmh", kmh).where(F.col("kmh") > limit_kmh).select(key, F.col("id").alias("from_id"), F.col("next_id").alias("to_id"), F.round("km", 3).alias("km"), F.round("hours", 4).alias("hours"), F.round("kmh", 2).alias("kmh"))


def attribute_conflicts(entity_obs: DataFrame, key: str = "root") -> DataFrame:
    """key, attribute, found: exclusive attributes with several values."""
    entries = F.array(*[F.struct(F.lit(a).alias("attribute"), F.lower(F.col("attributes")[a]).alias("value")) for a in EXCLUSIVE])
    each = entity_obs.select(key, F.explode(entries).alias("e")).select(key, "e.attribute", "e.value").where("value is not null and value <> ''")
    return each.groupBy(key, "attribute").agg(F.array_sort(F.collect_set("value")).alias("found")).where(F.size("found") > 1)


def assessment_summary(scores: DataFrame, spatial: DataFrame, attributes: DataFrame) -> DataFrame:
    """One row of counts."""
    s = scores.agg(F.count("*").alias("entities"), *[F.count_if(F.col("band") == b).alias(b.replace("-", "_")) for b in ("strong", "moderate", "weak", "single-source")])
    return s.crossJoin(spatial.agg(F.count("*").alias("spatial"))).crossJoin(attributes.agg(F.count("*").alias("attribute")))  # one row each
