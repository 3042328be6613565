"""Where results and checkpoints of running jobs are kept: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it names none, a folder of this machine if all runs on it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that later readers don't make it again."""
    path = fresh(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt_out(df: DataFrame) -> DataFrame:
    """``df`` over all cores where a small file would leave some idle; larger inputs stay where they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: A key of more than this part of all rows is hot, and its rows are dealt to so many tasks.
HOT_PART, SALTS = 1000, 32


def join_split(rows: DataFrame, told: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` joined with ``told``, whose ``count`` says how many of the ``total`` rows have its ``key``.

    Hot keys, of which there are at most ``HOT_PART``, are sent to the tasks; their rows are dealt by a salt too.
    """
    hot = F.col(count) > total // HOT_PART
    keys = F.broadcast(told.where(hot).select(key, F.lit(True).alias("__hot")).distinct())
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = rows.join(keys, key, "left").withColumn("__salt", salt).drop("__hot")
    return dealt.join(told.withColumn("__salt", F.explode(salts)).drop(count), [key, "__salt"]).drop("__salt")
