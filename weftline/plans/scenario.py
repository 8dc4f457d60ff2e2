"""The fusion plan: raw records of all disciplines to every product.

A result is a bag of lazy tables; entity resolution, the one iterative step, is
written once and all else hangs off it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.staging import stage
from weftline.operators import corroborate, entities, geofence, normalize, tracks


def observations_from(sources: dict[str, DataFrame]) -> DataFrame:
    """Records by discipline, as observations of one table."""
    out = None
    for discipline, records in sources.items():
        o = normalize.normalize(discipline, records)
        out = o if out is None else out.unionByName(o)
    return out


@dataclass
class Fusion:
    """Every product of a set of observations and zones.

    keep: write the observations with their root, for several products;
    colocation_points: of an entity's points only the first so many are held
    against each other (None: all)."""

    name: str
    observations: DataFrame
    zones: DataFrame | None = None
    name_threshold: float = entities.NAME_THRESHOLD
    keep: bool = True
    colocation_points: int | None = None

    @cached_property
    def name_roots(self) -> DataFrame:
        return entities.name_roots(self.observations, self.name_threshold)

    @cached_property
    def clusters(self) -> DataFrame:
        narrow = self.observations.select("id", "entity", "entity_type")
        return stage(entities.rooted(narrow, self.name_roots).select("id", "root").distinct(), "clusters")

    @cached_property
    def entities(self) -> DataFrame:
        return stage(entities.resolve_entities(self.entity_obs), "entities")

    @cached_property
    def entity_obs(self) -> DataFrame:
        rooted = entities.rooted(self.observations, self.name_roots)
        return stage(rooted, "entity-obs") if self.keep else rooted

    @cached_property
    def once(self) -> Fusion:
        """The same for one product that takes the observations with their root once:
        they are not written, and only the columns that it needs are made."""
        one = replace(self, keep=False)
        one.name_roots = self.name_roots
        return one

    @cached_property
    def validation(self) -> DataFrame:
        return normalize.problems(self.observations).where(F.size("problems") > 0)

    @cached_property
    def conflicts(self) -> DataFrame:
        a = entities.name_type_conflicts(self.entities).select("kind", F.col("name").alias("what"), "entity_ids")
        b = entities.identifier_conflicts(self.entities).select("kind", F.concat_ws("=", "key", "value").alias("what"), "entity_ids")
        return a.unionByName(b)

    @cached_property
    def corroboration(self) -> DataFrame:
        scores = corroborate.corroboration(self.entity_obs, points=self.colocation_points)
        return self.entities.select("root", "entity_id", "canonical", "disciplines", "sources").join(scores, "root").orderBy(F.desc("score"), "canonical")

    @cached_property
    def spatial_contradictions(self) -> DataFrame:
        return corroborate.spatial_contradictions(self.entity_obs)

    @cached_property
    def attribute_conflicts(self) -> DataFrame:
        own = self.entity_obs.withColumn("attributes", F.map_concat(F.map_filter("attributes", lambda k, v: k != "entity_type"), F.create_map(F.lit("entity_type"), F.col("entity_type"))))
        return corroborate.attribute_conflicts(own)

    @cached_property
    def points(self) -> DataFrame:
        return tracks.track_points(self.entity_obs)

    @cached_property
    def legs(self) -> DataFrame:
        return tracks.track_legs(self.points)

    @cached_property
    def tracks(self) -> DataFrame:
        return tracks.track_summary(self.points, self.legs)

    @cached_property
    def dwell_areas(self) -> DataFrame:
        return tracks.dwell_areas(self.points)

    @cached_property
    def pattern_of_life(self) -> DataFrame:
        hours = tracks.hour_histogram(self.entity_obs)
        days = tracks.weekday_histogram(self.entity_obs)
        as_map = lambda df, k, name: df.groupBy("root").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(k, "n")))).alias(name))
        areas = self.dwell_areas.groupBy("root").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus_n"), "lat", "lon", "n"))).alias("dwell_areas"))
        return as_map(hours, "hour", "hours").join(as_map(days, "weekday", "weekdays"), "root").join(tracks.peak_hours(hours), "root").join(areas, "root", "left")

    @cached_property
    def anomalies(self) -> DataFrame:
        """kind, root, observation or leg, value."""
        speed = tracks.speed_anomalies(self.legs).select(F.lit("speed").alias("kind"), "root", F.col("seq").cast("string").alias("at"), F.col("kmh").alias("value"))
        hour = tracks.off_pattern_hours(self.entity_obs).select(F.lit("off-pattern-hour").alias("kind"), "root", F.col("id").alias("at"), F.col("hour").cast("double").alias("value"))
        place = tracks.off_pattern_locations(self.points, self.dwell_areas).select(F.lit("off-pattern-location").alias("kind"), "root", F.col("id").alias("at"), F.col("km").alias("value"))
        return speed.unionByName(hour).unionByName(place)

    @cached_property
    def zone_alerts(self) -> DataFrame:
        zones = self.zones if self.zones is not None else self.observations.sparkSession.createDataFrame([], geofence.ZONE_SCHEMA)
        return geofence.evaluate(self.observations, zones).orderBy(F.desc("severity"), "timestamp", "zone")

    @cached_property
    def dwell_alerts(self) -> DataFrame:
        return geofence.dwell_alerts(self.zone_alerts)

    @cached_property
    def timeline(self) -> DataFrame:
        return self.observations.select("timestamp", "id", "discipline", "source", "entity", "text", "lat", "lon").orderBy("timestamp", "id")

    @cached_property
    def counts(self) -> DataFrame:
        """One row; every side is an aggregate of one row too."""
        o = self.observations.agg(F.count("*").alias("observations"), F.countDistinct("discipline").alias("disciplines"), F.countDistinct("source").alias("sources"))
        spatial, attribute = self.spatial_contradictions, self.attribute_conflicts
        for name, df in (("entities", self.entities), ("tracks", self.tracks), ("anomalies", self.anomalies), ("zone_alerts", self.zone_alerts), ("deconfliction_flags", self.conflicts), ("spatial", spatial), ("attribute", attribute)):
            o = o.crossJoin(df.agg(F.count("*").alias(name)))
        return o.withColumn("contradictions", F.col("spatial") + F.col("attribute")).drop("spatial", "attribute")

    def dossiers(self, alerts_by: str = "canonical") -> DataFrame:
        """A row for each entity with what is known of it.

        alerts_by: "canonical" takes zone alerts whose entity has the canonical
        name; "entity" also those under an alias."""
        own = lambda df, name, *cols: df.groupBy("root").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
        if alerts_by == "entity":
            alerts = self.zone_alerts.join(self.clusters.withColumnRenamed("id", "observation_id"), "observation_id")
        else:
            alerts = self.zone_alerts.join(self.entities.select("root", F.lower("canonical").alias("lc")), F.lower("entity") == F.col("lc"))
        out = self.entities.join(self.corroboration.select("root", "score", "band", "n_disciplines", "n_sources"), "root", "left")
        for part in (
            self.tracks,
            own(self.anomalies, "anomalies", "kind", "at", "value"),
            own(self.spatial_contradictions, "contradictions", "from_id", "to_id", "kmh"),
            own(self.attribute_conflicts, "attribute_conflicts", "attribute", "found"),
            own(alerts, "zone_alerts", "zone", "status", "observation_id", "severity"),
            self.pattern_of_life,
        ):
            out = out.join(part, "root", "left")
        return out

    def dossier(self, entity: str) -> DataFrame:
        """The first entity (by canonical) whose id it is or whose name holds it."""
        hit = self.entities.where((F.col("entity_id") == entity) | F.lower("canonical").contains(entity.lower())).orderBy("canonical", "root").limit(1)
        found = self.dossiers().join(F.broadcast(hit.select("root")), "root")
        if not found.limit(1).count():
            raise KeyError(entity)
        return found


def run_scenario(spark: SparkSession, scenario) -> Fusion:
    """scenario: a path, or what sources.scenario.load_scenario returned."""
    from weftline.sources.scenario import load_scenario

    name, sources, zones = load_scenario(spark, scenario) if isinstance(scenario, str) else scenario
    return Fusion(name, stage(observations_from(sources), "observations"), zones)
