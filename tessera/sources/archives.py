"""Sources and sinks: checked JSON lines, listings of backups, table counts, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, key: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and ``(key, problem)`` of the others: unreadable lines, missing values, repeated keys."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    missing = F.lit(False)
    for field in schema.fields:
        if not field.nullable:
            missing = missing | F.col(field.name).isNull()
    problem = F.when(F.col("_corrupt").isNotNull(), "unreadable").when(missing, "missing value")
    judged = rows.withColumn("problem", problem)
    twice = judged.where("problem is null").groupBy(key).count().where("count > 1").select(key)
    good = judged.where("problem is null").join(twice, key, "left_anti").drop("problem", "_corrupt")
    bad = judged.where("problem is not null").select(F.col(key).cast("string").alias(key), "problem").unionByName(twice.select(F.col(key).cast("string").alias(key), F.lit("repeated key").alias("problem")))
    return good, bad


def backup_groups(objects: DataFrame, today: str, keep_days: int) -> DataFrame:
    """``(day, time, complete, expired)`` of objects ``key`` like ``prefix/2024-01-31/0203/dump``.

    A group is complete with a dump and a manifest; it expires ``keep_days`` days back, today included.
    """
    parts = objects.select(F.regexp_extract("key", r"(\d{4}-\d\d-\d\d)/(\d{4})/(\w+)$", 1).alias("day"), F.regexp_extract("key", r"(\d{4}-\d\d-\d\d)/(\d{4})/(\w+)$", 2).alias("time"), F.regexp_extract("key", r"(\w+)$", 1).alias("part")).where("day <> ''")
    groups = parts.groupBy("day", "time").agg(F.collect_set("part").alias("parts"))
    complete = F.array_contains("parts", "dump") & F.array_contains("parts", "manifest")
    return groups.select("day", "time", complete.alias("complete"), (F.col("day").cast("date") <= F.date_sub(F.lit(today).cast("date"), keep_days)).alias("expired"))


def newest_complete(groups: DataFrame) -> DataFrame:
    return groups.where("complete").select(F.max(F.struct("day", "time")).alias("g")).select("g.day", "g.time")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table, rows)`` of each table."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def manifest_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Tables whose row counts differ, missing ones included."""
    left, right = a.withColumnRenamed("rows", "rows_before"), b.withColumnRenamed("rows", "rows_after")
    return left.join(right, "table", "full_outer").where(~F.col("rows_before").eqNullSafe(F.col("rows_after")))


def write_reports(df: DataFrame, folder: str) -> None:
    """The same rows as JSON, CSV and a Markdown table."""
    df.write.mode("overwrite").json(f"{folder}/json")
    df.write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
    markdown_rows(df).write.mode("overwrite").text(f"{folder}/markdown")


def markdown_rows(df: DataFrame) -> DataFrame:
    cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))
