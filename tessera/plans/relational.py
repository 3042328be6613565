"""Joins, set operations, latest-per-key and paging over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import operations as O
from tessera.plans.common import Registry
from tessera.sources.tables import table

query = Registry()


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 200000")
def inner_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice").where("o_totalprice > 200000")
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey")
    return o.join(c, o.o_custkey == c.c_custkey).join(table(spark, sf_dir, "nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 GROUP BY 1")
def left_join_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # counted before the join: a row for each customer at most
    counted = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice").where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("orders"))
    return table(spark, sf_dir, "customer", "c_custkey").join(counted, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = table(spark, sf_dir, "orders", "o_custkey", "o_totalprice").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer", "c_custkey").join(rich, "c_custkey", "left_anti")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity").where("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders", "o_orderkey").join(big, "o_orderkey", "left_semi")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 350000 OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_discount >= 0.1)")
def existence_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").createOrReplaceTempView("t_orders")
    table(spark, sf_dir, "lineitem", "l_orderkey", "l_discount").createOrReplaceTempView("t_lines")
    return spark.sql("SELECT o_orderkey FROM t_orders WHERE o_totalprice > 350000 OR EXISTS (SELECT 1 FROM t_lines WHERE l_orderkey = o_orderkey AND l_discount >= 0.1)")


@query("""WITH a AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O')
SELECT 'added' AS side, k FROM (SELECT k FROM b EXCEPT SELECT k FROM a) UNION ALL SELECT 'removed', k FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT 'both', k FROM (SELECT k FROM a INTERSECT SELECT k FROM b)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus").where("o_orderstatus IN ('F', 'O')")
    # one aggregation tells all three sets
    held = o.groupBy(F.col("o_custkey").alias("k")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("a"), F.bool_or(F.col("o_orderstatus") == "O").alias("b"))
    return held.select(F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "removed").otherwise("added").alias("side"), "k")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate")
    return O.latest_per_key(o, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def latest_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1)


@query("SELECT o_orderkey, o_orderdate, CASE WHEN (SELECT count(*) FROM orders) > 75 THEN 'bzo3NQ==' END AS next FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50)")
def offset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.retrieval import page

    rows, cursor = page(table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.col("o_orderkey")], 50, 25)
    return rows.withColumn("next", F.lit(cursor))


@query("SELECT event_id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 200")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", "event_type").where("event_id > 500").orderBy("event_id").limit(200)


@query("SELECT l_orderkey, list_sort(list_distinct(array_agg(l_returnflag)))[1] AS first_flag, len(list_distinct(array_agg(l_returnflag))) AS flags, len(list_filter(list_distinct(array_agg(l_returnflag)), lambda x: x NOT IN ('A', 'N'))) = 0 AS subset FROM lineitem GROUP BY 1")
def subset_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("m"))
    allowed = F.array(F.lit("A"), F.lit("N"))
    return g.select("l_orderkey", F.array_min("m").alias("first_flag"), F.size("m").cast("long").alias("flags"), (F.size(F.array_except("m", allowed)) == 0).alias("subset"))


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE NOT regexp_full_match(o_orderpriority, '[1-4]-.*') OR o_orderstatus NOT IN ('F', 'O') OR o_totalprice < 0")
def invalid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    return o.where(~F.col("o_orderpriority").rlike("^[1-4]-.*$") | ~F.col("o_orderstatus").isin("F", "O") | (F.col("o_totalprice") < 0)).drop("o_orderstatus")


@query("SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders", "o_custkey", "o_orderdate").groupBy("o_custkey", "o_orderdate").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
