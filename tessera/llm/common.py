"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach: ``spark.checkpoint.dir``.

    Where the session names none, a folder of our own is set if all runs on one machine; on a cluster that fails.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(named)
        named = sc.getCheckpointDir()
    return named


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage and survives the loss of executors, as the files stay in the shared store.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts to few rows, unless the session sets that itself. Spark bounds their bytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_ROWS))


#: A key with more than this part of all rows is hot; there are no more hot keys than that.
HOT_KEYS = 1000
SALTS = 64


def join_counted(rows: DataFrame, told: DataFrame, key: str | list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``told``, which says in ``count`` how many of the ``total`` rows have its ``key``.

    The hot keys, at most ``HOT_KEYS``, are sent to the tasks; their rows are dealt by a salt too, and their part of
    ``told`` is repeated for each salt. ``told`` is read twice, so it should be a written table.
    """
    key = [key] if isinstance(key, str) else key
    hot = F.col(count) > total // HOT_KEYS
    keys = F.broadcast(told.where(hot).select(*key, F.lit(True).alias("__hot")).distinct())
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = rows.join(keys, key, "left").withColumn("__salt", salt).drop("__hot")
    salts = F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(told.withColumn("__salt", F.explode(salts)).drop(count), [*key, "__salt"], how).drop("__salt")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


#: Columns that tell texts apart by 128 bits.
TEXT_KEYS = ("k1", "k2")


def text_keys(column: str = "text") -> list[Column]:
    """Two hashes of 64 bits with seeds of their own; a null text has those of an empty one."""
    return [F.xxhash64(F.lit(seed), text_or_empty(column)).alias(name) for seed, name in enumerate(TEXT_KEYS)]
