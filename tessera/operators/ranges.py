"""Which line ranges meet others: ranges as bits of buckets of lines.

A bucket of 64 lines is a long. The other side's ranges are added up by bucket as bits before they are shuffled, so a bucket
has one row however many ranges lie in it, and each range meets as many rows as it has buckets: no pairs are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_BITS = 6


def line_bits(ranges: DataFrame, *keep: str) -> DataFrame:
    """``(*keep, bucket, bits)``: the lines of inclusive ranges ``(start_line, end_line)`` by bucket; empty ranges and nulls have none."""
    bucket = lambda c: F.shiftright(F.col(c).cast("long"), BUCKET_BITS)
    place = lambda c: F.col(c).cast("long").bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).cast("int")
    own = ranges.where("start_line <= end_line").select("*", F.explode(F.sequence(bucket("start_line"), bucket("end_line"))).alias("bucket"))
    first = F.when(F.col("bucket") == bucket("start_line"), place("start_line")).otherwise(0)
    last = F.when(F.col("bucket") == bucket("end_line"), place("end_line")).otherwise((1 << BUCKET_BITS) - 1)
    placed = own.withColumn("__first", first).withColumn("__last", last)
    bits = F.expr("shiftleft(-1L, __first) & shiftrightunsigned(-1L, 63 - __last)")
    return placed.select(*keep, "bucket", bits.alias("bits"))


def meeting(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """The distinct ``(*keys, start_line, end_line)`` of ``left`` that share a line with a range of ``right`` of the same keys.

    Both are ``(*keys, start_line, end_line)``, inclusive, from line 0 on. Null keys meet nothing.
    """
    own = (*keys, "start_line", "end_line")
    held = line_bits(right.select(*own), *keys).groupBy(*keys, "bucket").agg(F.bit_or("bits").alias("held"))
    asked = line_bits(left.select(*own).distinct(), *own)
    return asked.join(held, [*keys, "bucket"]).where(F.col("bits").bitwiseAND(F.col("held")) != 0).select(*own).distinct()


def with_meets(left: DataFrame, right: DataFrame, name: str, *keys: str) -> DataFrame:
    """``left`` with a flag ``name``: whether its range meets one of ``right``."""
    own = (*keys, "start_line", "end_line")
    found = meeting(left, right, *keys).withColumn(name, F.lit(True))
    return left.join(found, list(own), "left").select(*[left[c] for c in left.columns], F.coalesce(found[name], F.lit(False)).alias(name))


def same_lines(line: str) -> list[Column]:
    """A line as a range of one."""
    return [F.col(line).alias("start_line"), F.col(line).alias("end_line")]
