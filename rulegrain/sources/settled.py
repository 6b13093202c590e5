"""Results written to the shared folder and read back: plans start anew from them, and a lost executor loses nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, else the context's checkpoint folder, else, on a cluster, the warehouse; in local mode a folder of our own."""
    context = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    return told or ("/tmp/checkpoints/rulegrain" if context.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir"))


def settled(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the folder that all executors share."""
    spark = df.sparkSession
    base = shared_dir(spark).rstrip("/")
    path = f"{base}/rulegrain-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
