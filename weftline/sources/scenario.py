"""Reports, gazetteers and scenarios from JSON files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators.geofence import zones_frame
from weftline.operators.normalize import ADAPTERS

REPORT_SCHEMA = "id string, timestamp string, source string, text string"


def load_reports(spark: SparkSession, path: str) -> DataFrame:
    """An array of reports in one file; report_ord is its order."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{REPORT_SCHEMA.replace(' string', ': string')}>>")).alias("report_ord", "r"))
    return raw.select(F.col("report_ord").cast("long").alias("report_ord"), "r.*")


def load_gazetteer(spark: SparkSession, path: str) -> dict[str, dict[str, list[str]]]:
    """type -> canonical -> aliases; a list of names that people keep by hand."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def load_scenario(spark: SparkSession, path: str) -> tuple[str, dict[str, DataFrame], DataFrame | None]:
    """name, records by discipline, zones (None if there are none).

    `content` of signals is left out when the file is read."""
    raw = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    known = raw.schema
    name = raw.select("name").first()[0] if "name" in raw.columns else ""
    out: dict[str, DataFrame] = {}
    if "sources" in raw.columns:
        for field in known["sources"].dataType.fields:
            if field.name.lower() in ADAPTERS and isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StructType):
                rows = raw.select(F.explode(F.col("sources")[field.name]).alias("r")).select("r.*")
                out[field.name] = rows.drop("content") if field.name.lower().startswith("sigint") else rows
    zones = None
    if "zones" in raw.columns and isinstance(known["zones"].dataType.elementType, T.StructType):
        zones = zones_frame(raw.select(F.explode("zones").alias("z")).select("z.*"))
    return name, out, zones
