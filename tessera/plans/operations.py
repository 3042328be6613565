"""Queries of the operational analytics. Events stand in for jobs, calls and deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import operations as O
from tessera.plans.common import Registry
from tessera.sources.shared import fresh
from tessera.sources.tables import table

query = Registry()
NOW = "2024-01-30 12:00:00"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a job: its user is the workspace, its type the kind, its number the state."""
    i = F.col("event_id")
    status = F.when(i % 20 < 15, "succeeded").when(i % 20 == 15, "failed").when((i % 20 == 16) & (i % 7 == 0), "running").otherwise("waiting")
    return events(spark, sf_dir).select(
        i.alias("id"), F.col("user_id").alias("workspace_id"), F.col("event_type").alias("kind"), status.alias("status"), F.col("ts").alias("created_at"),
        (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("run_after"), (F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("lease_expires_at"), (i % 4).alias("attempt"),
    )


JOBS_SQL = """jobs AS (SELECT event_id AS id, user_id AS workspace_id, event_type AS kind, CASE WHEN event_id % 20 < 15 THEN 'succeeded' WHEN event_id % 20 = 15 THEN 'failed' WHEN event_id % 20 = 16 AND event_id % 7 = 0 THEN 'running' ELSE 'waiting' END AS status,
  ts AS created_at, ts + INTERVAL 1 HOUR AS run_after, ts + INTERVAL 3 DAY AS lease_expires_at, event_id % 4 AS attempt FROM events)"""
CLAIM_SQL = f"""{JOBS_SQL}, claimable AS (SELECT * FROM jobs j WHERE ((status = 'waiting' AND run_after <= TIMESTAMP '{NOW}') OR (status = 'running' AND lease_expires_at < TIMESTAMP '{NOW}'))
  AND NOT EXISTS (SELECT 1 FROM jobs o WHERE o.workspace_id = j.workspace_id AND o.kind = j.kind AND o.status = 'running' AND o.lease_expires_at >= TIMESTAMP '{NOW}'))"""


@query(f"WITH {CLAIM_SQL} SELECT id, workspace_id, kind, status FROM claimable")
def claimable_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.claimable_jobs(jobs(spark, sf_dir), NOW).select("id", "workspace_id", "kind", "status")


@query(f"WITH {CLAIM_SQL} SELECT workspace_id, kind, arg_min(id, (created_at, id)) AS id FROM claimable GROUP BY ALL")
def first_claimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.first_claimable(jobs(spark, sf_dir), NOW).select("workspace_id", "kind", "id")


@query(f"""WITH {JOBS_SQL} SELECT id, CASE WHEN lease_expires_at < TIMESTAMP '{NOW}' AND status = 'running' THEN 'timeout' WHEN status <> 'failed' THEN 'none' WHEN attempt >= 3 THEN 'attempts_used' ELSE 'retry' END AS class, least(60.0, 5.0 * pow(2.0, attempt - 1)) AS backoff FROM jobs""")
def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.when(F.col("status") == "failed", "error")
    late = (F.col("lease_expires_at") < F.lit(NOW).cast("timestamp_ntz")) & (F.col("status") == "running")
    return jobs(spark, sf_dir).select("id", O.failure_class(F.col("attempt"), F.lit(3), error, late).alias("class"), O.backoff_cap(F.col("attempt")).alias("backoff"))


@query(f"""WITH {JOBS_SQL}, w AS (SELECT id, status, coalesce(sum(CASE WHEN status = 'waiting' THEN 1 ELSE 0 END) OVER (PARTITION BY workspace_id, kind ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  + sum(CASE WHEN status = 'running' THEN 1 ELSE 0 END) OVER (PARTITION BY workspace_id, kind) AS ahead FROM jobs) SELECT id, CAST(ahead AS BIGINT) AS ahead FROM w WHERE status = 'waiting'""")
def queue_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.queue_positions(jobs(spark, sf_dir))


@query("SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq FROM events")
def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.numbered_events(events(spark, sf_dir), "user_id", "ts", "event_id").select("event_id", "user_id", "seq")


@query(f"""WITH {JOBS_SQL} SELECT id, workspace_id, count(*) OVER (PARTITION BY workspace_id ORDER BY created_at RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND CURRENT ROW) AS count_in_window FROM jobs WHERE status = 'failed'""")
def failing_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = jobs(spark, sf_dir).where("status = 'failed'").withColumn("finished_at", F.col("created_at"))
    return O.failing_window(failed, 3 * 24 * 60, "workspace_id").select("id", "workspace_id", "count_in_window")


@query(f"""WITH {JOBS_SQL}, f AS (SELECT created_at AS finished_at, count(*) OVER (ORDER BY created_at RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW) AS n FROM jobs WHERE status = 'failed')
SELECT (SELECT epoch(TIMESTAMP '{NOW}' - max(ts)) FROM events WHERE ts <= TIMESTAMP '{NOW}')::BIGINT AS worker_silence, (SELECT floor(epoch(TIMESTAMP '{NOW}' - min(run_after))) FROM jobs WHERE status = 'waiting' AND run_after <= TIMESTAMP '{NOW}')::BIGINT AS oldest_runnable,
  (SELECT coalesce(max(n), 0) FROM f WHERE finished_at >= TIMESTAMP '{NOW}' - INTERVAL 60 MINUTE) AS failures_in_window, (SELECT floor(epoch(TIMESTAMP '{NOW}' - max(ts))) FROM events WHERE event_type = 'purchase' AND ts <= TIMESTAMP '{NOW}')::BIGINT AS backup_age""")
def alert_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where(F.col("ts") <= F.lit(NOW).cast("timestamp_ntz"))
    j = jobs(spark, sf_dir)
    failed = j.where("status = 'failed'").select(F.col("created_at").alias("finished_at"))
    return O.alert_conditions(failed, e.select(F.col("ts").alias("beat_at")), j.where("status = 'waiting'"), e.where("event_type = 'purchase'").select(F.col("ts").alias("completed_at")), NOW)


@query(f"""WITH s AS (SELECT o_orderkey AS id, o_custkey AS repository_id, o_orderdate AS ready_at FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY repository_id ORDER BY ready_at DESC, id DESC) AS rank FROM s)
SELECT id, repository_id, CAST(rank AS INT) AS rank FROM r WHERE (ready_at < TIMESTAMP '1997-06-01' - INTERVAL 14 DAY OR rank > 5) AND id NOT IN (SELECT arg_max(id, (ready_at, id)) FROM s GROUP BY repository_id)
  AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = r.id AND l.l_shipdate >= TIMESTAMP '1997-06-01')""")
def expired_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("repository_id"), F.col("o_orderdate").alias("ready_at"))
    runs = table(spark, sf_dir, "lineitem", "l_orderkey", "l_shipdate").select(F.col("l_orderkey").alias("snapshot_id"), F.col("l_shipdate").alias("expires_at"))
    active = o.groupBy("repository_id").agg(F.max_by("id", F.struct("ready_at", "id")).alias("id"))
    return O.expired_snapshots(o, runs, active, "1997-06-01 00:00:00").select("id", "repository_id", "rank")


@query(f"""WITH {JOBS_SQL}, r AS (SELECT user_id AS repository_id, user_id % 9 = 0 AS paused, max(CASE WHEN event_type = 'view' THEN ts END) AS checked_at FROM events WHERE ts <= TIMESTAMP '{NOW}' GROUP BY user_id)
SELECT repository_id FROM r WHERE NOT paused AND (checked_at IS NULL OR checked_at < TIMESTAMP '{NOW}' - INTERVAL 20 HOUR) AND repository_id NOT IN (SELECT workspace_id FROM jobs WHERE status = 'running')""")
def due_for_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where(F.col("ts") <= F.lit(NOW).cast("timestamp_ntz"))
    r = e.groupBy(F.col("user_id").alias("repository_id")).agg(F.max(F.when(F.col("event_type") == "view", F.col("ts"))).alias("checked_at")).withColumn("paused", F.col("repository_id") % 9 == 0)
    return O.due_for_check(r, jobs(spark, sf_dir).where("status = 'running'").select(F.col("workspace_id").alias("repository_id")), NOW).select("repository_id")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 2 AS accepted FROM events")
def daily_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.within_daily_quota(events(spark, sf_dir), 2, "user_id").select("event_id", "accepted")


@query("""WITH f AS (SELECT event_id, ts, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 2 AS fits FROM events)
SELECT event_id, fits AND sum(CASE WHEN fits THEN 1 ELSE 0 END) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) <= 100 AS accepted FROM f""")
def two_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.within_two_quotas(events(spark, sf_dir), 2, 100, "user_id").select("event_id", "accepted")


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, true AS allowed, 0 AS retry_after, [ts] AS kept FROM o WHERE n = 1
  UNION ALL SELECT user_id, event_id, n, len(w) < 3, CASE WHEN len(w) < 3 THEN 0 ELSE CAST(ceil(epoch(w[len(w) - 2] + INTERVAL 6 HOUR - ts)) AS INT) END, CASE WHEN len(w) < 3 THEN list_append(w, ts) ELSE w END
  FROM (SELECT o.user_id, o.event_id, o.n, o.ts, list_filter(r.kept, lambda t: t > o.ts - INTERVAL 6 HOUR) AS w FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1))
SELECT user_id, event_id, allowed, retry_after FROM r""")
def sliding_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.sliding_limiter(events(spark, sf_dir), 3, 6 * 3600, "user_id")


@query("SELECT delivery_id, min(received_at) AS received_at FROM (SELECT event_id // 3 AS delivery_id, ts AS received_at FROM events) GROUP BY delivery_id")
def first_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = events(spark, sf_dir).select(F.floor(F.col("event_id") / 3).alias("delivery_id"), F.col("ts").alias("received_at"), F.col("props").alias("payload"))
    return O.first_deliveries(d).select("delivery_id", "received_at")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'ignored: ping' WHEN event_id % 7 = 0 THEN 'ignored: deletion' WHEN event_id % 4 = 1 THEN 'ignored: tag' WHEN event_id % 4 = 2 THEN 'index' ELSE 'ignored: other branch' END AS route FROM events""")
def routed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    ref = F.when(i % 4 == 1, "refs/tags/v1").when(i % 4 == 2, "refs/heads/main").when(i % 4 == 3, "refs/heads/dev")
    payload = F.to_json(F.struct(ref.alias("ref"), (i % 7 == 0).alias("deleted")))
    return O.routed(events(spark, sf_dir).select("event_id", F.when(i % 5 == 0, "ping").otherwise("push").alias("kind"), payload.alias("payload"))).select("event_id", "route")


@query(f"""WITH {JOBS_SQL}, l AS (SELECT workspace_id, arg_max(status, (created_at, id)) AS status, bool_or(status = 'succeeded') AS ready FROM jobs GROUP BY 1)
SELECT workspace_id, CASE WHEN status = 'running' THEN 'indexing' WHEN status = 'waiting' THEN 'queued' WHEN status = 'failed' AND ready THEN 'stale' WHEN status = 'failed' THEN 'failed' WHEN ready THEN 'ready' ELSE 'empty' END AS state FROM l""")
def display_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = jobs(spark, sf_dir).groupBy("workspace_id").agg(F.max_by("status", F.struct("created_at", "id")).alias("status"), F.bool_or(F.col("status") == "succeeded").alias("ready"))
    return O.display_state(latest).select("workspace_id", "state")


@query(f"SELECT user_id AS worker_id, min(ts) AS started_at, max(ts) AS beat_at FROM events GROUP BY user_id HAVING max(ts) >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR")
def live_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.live_workers(events(spark, sf_dir).select(F.col("user_id").alias("worker_id"), F.col("ts").alias("at")), NOW)


@query("""WITH p AS (SELECT user_id AS repository_id, event_id AS push_id, ts AS pushed_at FROM events WHERE event_type = 'click'), r AS (SELECT user_id AS repository_id, event_id AS run_id, ts AS finished_at FROM events WHERE event_type = 'purchase')
SELECT p.repository_id, push_id, pushed_at, x.finished_at, x.run_id FROM p LEFT JOIN LATERAL (SELECT finished_at, run_id FROM r WHERE r.repository_id = p.repository_id AND r.finished_at >= p.pushed_at ORDER BY finished_at, run_id LIMIT 1) x ON true""")
def first_covering_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    pushes = e.where("event_type = 'click'").select(F.col("user_id").alias("repository_id"), F.col("event_id").alias("push_id"), F.col("ts").alias("pushed_at"))
    runs = e.where("event_type = 'purchase'").select(F.col("user_id").alias("repository_id"), F.col("event_id").alias("run_id"), F.col("ts").alias("finished_at"))
    return O.first_covering(pushes, runs)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.concat_ws(":", "user_id", "event_type").alias("key"), "event_id", "ts", (F.col("event_id") % 3).cast("string").alias("payload"))


@query("""WITH RECURSIVE o AS (SELECT user_id || ':' || event_type AS key, event_id, ts, event_id % 3 AS p, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT key, event_id, n, 'new' AS outcome, ts AS held, p AS hp FROM o WHERE n = 1 UNION ALL
  SELECT o.key, o.event_id, o.n, CASE WHEN o.ts >= r.held + INTERVAL 24 HOUR THEN 'new' WHEN o.p = r.hp THEN 'replayed' ELSE 'conflict' END, CASE WHEN o.ts >= r.held + INTERVAL 24 HOUR THEN o.ts ELSE r.held END, CASE WHEN o.ts >= r.held + INTERVAL 24 HOUR THEN o.p ELSE r.hp END
  FROM r JOIN o ON o.key = r.key AND o.n = r.n + 1) SELECT key, event_id, outcome FROM r""")
def idempotent_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.idempotent_outcomes(requests(spark, sf_dir))


@query("""WITH RECURSIVE o AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id, ts, ['loss', 'pause', 'resume', 'restore'][event_id % 4 + 1] AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT key, event_id, n, CASE kind WHEN 'loss' THEN 'access_lost' WHEN 'pause' THEN 'paused' ELSE 'active' END AS state, CASE WHEN kind IN ('loss', 'pause') THEN epoch_us(ts) END AS since FROM o WHERE n = 1 UNION ALL
  SELECT o.key, o.event_id, o.n, CASE WHEN kind = 'loss' THEN 'access_lost' WHEN kind = 'pause' AND state = 'active' THEN 'paused' WHEN (kind = 'resume' AND state = 'paused') OR (kind = 'restore' AND state = 'access_lost') THEN 'active' ELSE state END,
    CASE WHEN kind = 'loss' THEN CASE WHEN state = 'access_lost' THEN since ELSE epoch_us(ts) END WHEN kind = 'pause' AND state = 'active' THEN epoch_us(ts) WHEN (kind = 'resume' AND state = 'paused') OR (kind = 'restore' AND state = 'access_lost') THEN NULL ELSE since END
  FROM r JOIN o ON o.key = r.key AND o.n = r.n + 1) SELECT key, event_id, state, since FROM r""")
def access_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("loss", "pause", "resume", "restore"))), (F.col("event_id") % 4).cast("int") + 1)
    return O.access_states(events(spark, sf_dir).select(F.col("user_id").cast("string").alias("key"), "event_id", "ts", kind.alias("kind")))


@query("""WITH o AS (SELECT user_id || ':' || event_type AS key, event_id, CASE WHEN event_id % 5 = 0 THEN 'start' ELSE 'request' END AS kind, lag(CASE WHEN event_id % 5 = 0 THEN 'start' ELSE 'request' END) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS b FROM events)
SELECT key, event_id, CASE WHEN kind = 'start' THEN 'start' WHEN b IS NULL OR b = 'start' THEN 'enqueue' ELSE 'merge' END AS action FROM o""")
def coalesced_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.coalesced(requests(spark, sf_dir).withColumn("kind", F.when(F.col("event_id") % 5 == 0, "start").otherwise("request")))


@query("SELECT event_id, props, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) <= 50")
def json_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return events(spark, sf_dir).select("event_id", "props", k.alias("k")).where("k <= 50")


@query("""WITH o AS (SELECT user_id || ':' || event_type AS key, event_id, ts, CASE WHEN event_id % 5 = 0 THEN 'start' ELSE 'request' END AS kind, CASE WHEN event_id % 3 = 0 THEN 'push' WHEN event_id % 11 = 4 THEN 'user' ELSE 'check' END AS trigger, CASE WHEN event_id % 3 = 0 THEN 'c' || event_id END AS commit FROM events),
s AS (SELECT *, coalesce(sum(CASE WHEN kind = 'start' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span FROM o)
SELECT key, arg_min(event_id, (ts, event_id)) AS event_id, coalesce(arg_min(trigger, (ts, event_id)) FILTER (WHERE trigger <> 'check'), 'check') AS trigger, arg_max(commit, (ts, event_id)) FILTER (WHERE commit IS NOT NULL) AS pushed FROM s WHERE kind <> 'start' GROUP BY key, span""")
def merged_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    kind, trigger = F.when(i % 5 == 0, "start").otherwise("request"), F.when(i % 3 == 0, "push").when(i % 11 == 4, "user").otherwise("check")
    commit = F.when(i % 3 == 0, F.concat(F.lit("c"), i.cast("string")))
    return O.merged_triggers(requests(spark, sf_dir).withColumn("kind", kind).withColumn("trigger", trigger).withColumn("commit", commit))


@query("""WITH c AS (SELECT event_id, user_id % 20 AS k, ts, CASE WHEN event_id % 7 < 3 THEN -1 ELSE 1 END AS change FROM events),
s AS (SELECT *, sum(change) OVER (PARTITION BY k, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM c)
SELECT event_id, CAST(s - least(0, min(s) OVER (PARTITION BY k, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS used FROM s""")
def quota_refunds(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = F.when(F.col("event_id") % 7 < 3, -1).otherwise(1)
    return O.counted_with_refunds(events(spark, sf_dir).withColumn("k", F.col("user_id") % 20).withColumn("change", change), "k").select("event_id", "used")


@query("""SELECT 'run' AS what, l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01'
UNION ALL SELECT 'snapshot', o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderdate < TIMESTAMP '1995-06-01' - INTERVAL 1 DAY""")
def other_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").alias("expires_at"))
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "discarded").otherwise("ready")
    snapshots = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderdate").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").alias("created_at"))
    return O.other_expired(runs, snapshots, "1995-06-01 00:00:00")


@query("""SELECT 'session' AS what, CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01' OR o_orderkey % 7 = 0
UNION ALL SELECT 'key', l_orderkey || ':' || l_linenumber FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-06-01'
UNION ALL SELECT 'delivery', CAST(event_id AS VARCHAR) FROM events WHERE ts < TIMESTAMP '1995-06-01' - INTERVAL 14 DAY + INTERVAL 10461 DAY""")
def expired_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sessions, their lines as idempotency keys, and events, moved back by as many days, as deliveries."""
    sessions = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("expires_at"), F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderdate")).alias("revoked_at"))
    keys = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_shipdate").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), F.col("l_shipdate").alias("expires_at"))
    deliveries = events(spark, sf_dir).select(F.col("event_id").alias("id"), (F.col("ts") - F.expr("INTERVAL 10461 DAYS")).alias("received_at"))
    return O.expired_records(sessions, keys, deliveries, "1995-06-01 00:00:00")


@query("SELECT event_id, 'bytes=' || (event_id % 90) || ',kind=' || event_type || CASE WHEN event_id % 2 = 0 THEN ',status=' || (event_id % 5) ELSE '' END AS entry FROM events")
def log_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of what is to be logged with each event, the fields that may be."""
    i = F.col("event_id")
    fields = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("token"), F.col("props"), F.lit("bytes"), (i % 90).cast("string"), F.lit("user"), F.col("user_id").cast("string"), F.when(i % 2 == 0, "status").otherwise("Status"), (i % 5).cast("string"))
    return table(spark, sf_dir, "events", "event_id", "event_type", "props", "user_id").select("event_id", X.log_entry(fields).alias("entry"))


@query("""SELECT o_orderkey AS review, CASE o_orderkey % 6 WHEN 0 THEN 'running' WHEN 1 THEN 'running' WHEN 2 THEN CASE WHEN o_custkey % 2 = o_orderkey % 5 % 2 THEN 'current' ELSE 'outdated' END WHEN 3 THEN 'failed' WHEN 4 THEN 'failed' ELSE 'queued' END AS state FROM orders""")
def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(k % 6 == 0, "running").when(k % 6 == 1, "retry_wait").when(k % 6 == 2, "succeeded").when(k % 6 == 3, "failed").when(k % 6 == 4, "canceled")
    return O.review_states(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(k.alias("review"), status.alias("status"), (F.col("o_custkey") % 2).alias("head"), (k % 5 % 2).alias("current_head"))).select("review", "state")


@query("""SELECT o_orderkey AS repository_id, CASE WHEN o_orderstatus = 'F' THEN 'lost' WHEN o_orderkey % 3 = 0 THEN 'unknown' ELSE 'verified' END AS access, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 30 DAY END AS purge_after, CASE WHEN o_orderstatus = 'P' THEN 'paused' ELSE 'on' END AS updates FROM orders""")
def access_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "access_lost").when(F.col("o_orderstatus") == "P", "paused").otherwise("active")
    repositories = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderdate").select(F.col("o_orderkey").alias("repository_id"), state.alias("access_state"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate")).alias("checked_at"), F.col("o_orderdate").alias("lost_at"))
    return O.access_views(repositories, 30)


@query("""SELECT CAST(ts AS DATE) AS day, user_id AS actor, CASE WHEN event_id % 9 = 0 THEN 'access_denied' ELSE event_type END AS action, CASE WHEN event_id % 9 = 0 THEN 'denied' ELSE 'ok' END AS outcome, count(*) AS times FROM events GROUP BY ALL""")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in two appends to a log by day, and what it then holds."""
    e = events(spark, sf_dir)
    rows = O.audit_events(e.select(F.col("ts").alias("at"), F.col("user_id").alias("actor"), F.col("event_type").alias("action"), F.col("event_id").alias("resource"), (F.col("event_id") % 9 > 0).alias("allowed")))
    path = fresh(spark, "audit")
    for part in (rows.where("resource % 2 = 0"), rows.where("resource % 2 = 1")):
        O.append_audit(part, path)
    return spark.read.parquet(path).groupBy("day", "actor", "action", "outcome").agg(F.count(F.lit(1)).alias("times"))
