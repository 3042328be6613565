"""Streaming queries: the events as a stream that is read to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import operations
from tessera.plans.common import Registry
from tessera.sources.shared import fresh
from tessera.streaming import coalescing as C
from tessera.streaming import stateful as S

query = Registry()


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    # a pattern, as a stream reads folders or patterns, not single files
    return S.read_stream(spark, f"{sf_dir}/events.parque[t]", spark.read.parquet(path).schema)


@query("SELECT DISTINCT event_id // 3 AS delivery_id FROM events")
def stream_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = events(spark, sf_dir).select(F.floor(F.col("event_id") / 3).alias("delivery_id"), "ts")
    return S.finished(S.deduplicated(d), "deliveries").select("delivery_id")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.finished(S.tumbling_counts(events(spark, sf_dir), "1 day", "event_type"), "tumbling", "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT s AS start, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events) GROUP BY ALL")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.finished(S.sliding_counts(events(spark, sf_dir), "2 days", "1 day"), "sliding", "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(operations.query.sql["sliding_limiter"])
def stream_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.finished(S.limited(events(spark, sf_dir), 3, 6 * 3600, "user_id"), "limiter")


@query(operations.query.sql["idempotent_outcomes"])
def stream_idempotency(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = events(spark, sf_dir).select(F.concat_ws(":", "user_id", "event_type").alias("key"), "event_id", "ts", (F.col("event_id") % 3).cast("string").alias("payload"))
    return S.finished(S.idempotent(r), "idempotency")


@query(operations.query.sql["access_states"].replace("SELECT key, event_id, state, since FROM r", "SELECT key, event_id, state, coalesce(since, -1) AS since FROM r"))
def stream_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("loss", "pause", "resume", "restore"))), (F.col("event_id") % 4).cast("int") + 1)
    e = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), "event_id", "ts", kind.alias("kind"))
    return S.finished(S.access(e), "access")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM o)
SELECT min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, session""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.finished(S.session_counts(events(spark, sf_dir), "12 hours", "user_id"), "sessions", "complete")
    return found.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


#: Batches that the events are dealt to, and rows of a file of them.
BATCHES, FILE_ROWS = 4, 250_000


def in_batches(spark: SparkSession, sf_dir: str, **columns) -> DataFrame:
    """The events by day as a stream of several batches, the rows of a batch in no order; a last batch moves the time on."""
    folder = fresh(spark, "events")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withColumns(columns).select("event_id", "ts", *columns)
    days = rows.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).first()
    part = F.least(F.floor((F.unix_timestamp("ts") - F.unix_timestamp(F.lit(days["first"]))) / ((F.unix_timestamp(F.lit(days["last"])) - F.unix_timestamp(F.lit(days["first"]))) / BATCHES + 1)), F.lit(BATCHES - 1)).cast("int")
    counts = {r.part: r["count"] for r in rows.groupBy(part.alias("part")).count().collect()}
    # each batch has as many files, none of them empty unless the batch is
    files = max(1, min(counts.get(number, 0) for number in range(BATCHES)) // FILE_ROWS)
    for number in range(BATCHES):
        rows.where(part == number).repartition(files).write.mode("append").parquet(folder)
    tick = rows.limit(1).select(F.lit(-1).cast("long").alias("event_id"), (F.lit(days["last"]) + F.expr("INTERVAL 400 DAYS")).alias("ts"), *(F.lit("tick" if c == "key" else None).cast(rows.schema[c].dataType).alias(c) for c in columns))
    tick.coalesce(1).write.mode("append").parquet(folder)
    return S.read_stream(spark, folder, rows.schema, files)


@query("""WITH o AS (SELECT user_id || ':' || event_type AS key, event_id, ts, CASE WHEN event_id % 5 = 0 THEN 'start' ELSE 'request' END AS kind, CASE WHEN event_id % 3 = 0 THEN 'push' WHEN event_id % 11 = 4 THEN 'user' ELSE 'check' END AS trigger, CASE WHEN event_id % 3 = 0 THEN 'c' || event_id END AS commit FROM events),
s AS (SELECT *, coalesce(sum(CASE WHEN kind = 'start' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span FROM o),
g AS (SELECT key, span, arg_min(event_id, (ts, event_id)) AS event_id, coalesce(arg_min(trigger, (ts, event_id)) FILTER (WHERE trigger <> 'check'), 'check') AS trigger, arg_max(commit, (ts, event_id)) FILTER (WHERE commit IS NOT NULL) AS pushed, count(*) AS requests FROM s WHERE kind <> 'start' GROUP BY key, span)
SELECT key, event_id, trigger, pushed, requests, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.key = g.key AND s.span = g.span AND kind = 'start') THEN 'started' ELSE 'expired' END AS ended FROM g""")
def stream_coalescing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests of each user and kind as they join waiting jobs, over several batches; jobs that nothing starts expire at the end."""
    i = F.col("event_id")
    requests = in_batches(
        spark, sf_dir, key=F.concat_ws(":", "user_id", "event_type"), kind=F.when(i % 5 == 0, "start").otherwise("request"),
        trigger=F.when(i % 3 == 0, "push").when(i % 11 == 4, "user").otherwise("check"), commit=F.when(i % 3 == 0, F.concat(F.lit("c"), i.cast("string"))),
    )
    with C.state_store(spark, partitions=spark.sparkContext.defaultParallelism):
        return S.finished(C.coalesced_jobs(requests, patience=370 * 86_400), "coalescing").where("key <> 'tick'")


@query("SELECT DISTINCT CAST(event_id // 3 AS VARCHAR) AS id FROM events")
def stream_remembered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each delivery over several batches, by ids that are kept for a time."""
    deliveries = in_batches(spark, sf_dir, id=F.floor(F.col("event_id") / 3).cast("string"), payload=F.col("event_type")).where("event_id >= 0")
    with C.state_store(spark, idle=False, partitions=spark.sparkContext.defaultParallelism):
        return S.finished(C.remembered(deliveries), "remembered").select("id")
