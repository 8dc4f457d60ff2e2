"""The corpus pipeline: documents in, sharded training documents out.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; what it returns is written as Parquet and read again as the next one's
docs.  All but the last return the columns of documents, whatever their names;
other columns than doc_id, text and source are never looked at.  Every stage
makes an empty table of an empty one, and takes texts of any length whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import op1_mixing, op3_quality, op6_neardup, op9_decontamination, op10_sharding
from weftline.llm.common import stage as written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the trusted target are those
    labelled as of good quality.  Null and empty texts fail the base rules and
    go.  Rows that repeat are judged each for itself, and so are those without
    an id."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return op3_quality.verdicts(docs, trusted).where("__quality.kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the least id (null
    last; ties go to the least hash of the text).  Of rows that repeat id and
    text one stays.  Texts without a word equal only the same text; every null
    text stays, once for each id."""
    return op6_neardup.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates.  Null and empty texts, and
    repeats of clean rows, stay; items without an id or a text are not sought."""
    return op9_decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the sources' target shares: a row for each copy taken; the
    document at a source's cut loses the words beyond it.  Null sources are a
    source; texts without a word have nothing to take and go."""
    return op1_mixing.mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row.  Null texts are a group of their own;
    rows that repeat have a slot each."""
    return op10_sharding.shard_rows(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


STAGES = [
    ("quality rules", quality),
    ("near-duplicate removal", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix),
    ("sharding", shard),
]

#: A hashed model and verified near-duplicate classes are beyond SQL;
#: tests/llm/test_pipeline.py holds the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{k}")
    return docs
