"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.  On a local
    master a folder of this machine is made and set if it names none; elsewhere
    that is an error, as executors could not see such a folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        at = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write `df` as a table in the shared folder (options: of the writer) and read it back.

    This cuts the lineage: a lost executor costs a re-read of files, and what
    comes after sees one fixed result, however often it is evaluated.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*staged: DataFrame) -> None:
    """Delete tables that `stage` returned and that nothing needs any more: what
    was made of them must have been staged, or collected, before."""
    for df in staged:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
