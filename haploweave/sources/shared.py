"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, deleted when the application ends. Where no folder is named: in one of our own, if the master is local, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = _own.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='haploweave-')}")
    path = f"{base.rstrip('/')}/haploweave-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a new folder (see folder) and read again, so that a lost executor costs its own tasks only."""
    spark = df.sparkSession
    path = folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
