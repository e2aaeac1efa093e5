"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only a local session, whose machine is one, may go without."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = spark.sparkContext._jvm.System.getProperty("java.io.tmpdir") + "/marginalia-checkpoints"
    return where


def keep(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read from there, so that what follows doesn't make it again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
