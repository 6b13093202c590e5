"""What the operators of this subpackage share: worker paths, shared folders and file names."""

from __future__ import annotations

import contextlib
import ctypes
import os
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.settled import shared_dir

ROOT = str(Path(__file__).resolve().parents[2])

#: Words are maximal runs of anything but space and the controls 09-0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: Rows that go to a Python worker at once, where the session still has Spark's 10000: texts may be long.
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 512


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever the session was made, and bound what they get at once."""
    if spark.sparkContext.getConf().get(BATCH_SETTING) is None and spark.conf.get(BATCH_SETTING) == "10000":  # nobody chose it
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def trim() -> None:
    """Give memory that this worker no longer uses back to the system: idle workers stay alive between stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and lost executors lose nothing."""
    spark = df.sparkSession
    base = shared_dir(spark).rstrip("/")
    path = f"{base}/rulegrain-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table() that nothing needs any more."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for f in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(conf).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/documents.parquet")


#: A key with more rows than this, and than the MOST_HOT-th part of all, is dealt over SALTS tasks by join_hot().
HOT_ROWS, MOST_HOT, SALTS = 1000, 50_000, 64


def join_hot(big: DataFrame, small: DataFrame, key: str, total: int, salt: str) -> DataFrame:
    """big left-joined with small, which has one row for each key and in _rows how many rows of big it has at least.

    Hot keys' rows are dealt over SALTS tasks by their column salt, and small's row goes to each. Only the
    hot keys are broadcast: MOST_HOT at most, as each has more than that part of big's total rows.
    """
    least = max(HOT_ROWS, total // MOST_HOT)
    hot = small.filter(F.col("_rows") > least).select(key, F.lit(True).alias("_hot"))
    marked = big.join(F.broadcast(hot), key, "left")
    salted = marked.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    every = F.when(F.col("_rows") > least, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return salted.join(small.withColumn("_salt", F.explode(every)).drop("_rows"), [key, "_salt"], "left").drop("_salt")
