"""Zones over a stream of observations.

Alerts have no state and follow the stream; dwelling counts by window, with a
watermark, so its state is bounded by the windows that may still change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.scalars import parse_ts
from weftline.operators.geofence import PROXIMITY_FACTOR, evaluate


def stream_alerts(observations: DataFrame, zones: DataFrame, factor: float = PROXIMITY_FACTOR) -> DataFrame:
    """Alerts of a stream of observations against a table of zones."""
    return evaluate(observations, zones, factor)


def stream_dwell(alerts: DataFrame, window: str = "1 day", late: str = "1 hour", min_points: int = 2) -> DataFrame:
    """zone, entity, window, points: entities inside a zone at least so often in
    a window; alerts that come later than `late` are left out."""
    timed = alerts.where("status = 'inside'").withColumn("ts", parse_ts(F.col("timestamp"))).withWatermark("ts", late)
    counts = timed.groupBy("zone", F.lower("entity").alias("entity"), F.window("ts", window).alias("window")).agg(F.count("*").alias("points"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return counts.where(F.col("points") >= min_points)
