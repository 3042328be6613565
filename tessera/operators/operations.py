"""Operational analytics over event and job tables. ``now`` is always a parameter."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
DELIVERY_DAYS = 14


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in ``order``, which must be total."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def claimable_jobs(jobs: DataFrame, now: str) -> DataFrame:
    """Due waiting jobs and running ones whose lease is over, where no other job of their workspace and kind runs."""
    at = F.lit(now).cast("timestamp_ntz")
    due = jobs.where(((F.col("status") == "waiting") & (F.col("run_after") <= at)) | ((F.col("status") == "running") & (F.col("lease_expires_at") < at)))
    running = jobs.where((F.col("status") == "running") & (F.col("lease_expires_at") >= at)).select("workspace_id", "kind").distinct()
    return due.join(running, ["workspace_id", "kind"], "left_anti")


def first_claimable(jobs: DataFrame, now: str) -> DataFrame:
    """Of each workspace and kind the claimable job that is oldest."""
    return latest_per_key(claimable_jobs(jobs, now), ["workspace_id", "kind"], F.col("created_at"), F.col("id"))


def failure_class(attempt: Column, most: Column, error: Column, deadline_passed: Column) -> Column:
    return F.when(deadline_passed, "timeout").when(error.isNull(), "none").when(attempt >= most, "attempts_used").otherwise("retry")


def backoff_cap(attempt: Column, base: float = 5, most: float = 60) -> Column:
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), attempt - 1))


def queue_positions(jobs: DataFrame) -> DataFrame:
    """``(id, ahead)`` of waiting jobs: jobs of the same workspace and kind that run or were made before."""
    w = Window.partitionBy("workspace_id", "kind").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("workspace_id", "kind")
    ahead = F.coalesce(F.count_if(F.col("status") == "waiting").over(w), F.lit(0)) + F.count_if(F.col("status") == "running").over(whole)
    return jobs.withColumn("ahead", ahead).where("status = 'waiting'").select("id", "ahead")


def numbered_events(events: DataFrame, key: str, *order: str) -> DataFrame:
    """``seq`` from 1 without gaps, for each key."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def failing_window(failures: DataFrame, minutes: int = 60, *keys: str) -> DataFrame:
    """``count_in_window``: failures of the key within the minutes up to each failure, that itself and its peers included."""
    seconds = F.unix_micros(F.col("finished_at").cast("timestamp"))
    w = Window.partitionBy(*keys).orderBy(seconds).rangeBetween(-minutes * 60_000_000, 0)
    return failures.withColumn("count_in_window", F.count(F.lit(1)).over(w))


def alert_conditions(failures: DataFrame, heartbeats: DataFrame, waiting: DataFrame, backups: DataFrame, now: str) -> DataFrame:
    """One row: seconds since the last heartbeat, since the oldest runnable job, most failures in an hour, since the last backup.

    The silence since the last heartbeat is rounded to the nearest second, halves to the even one; the other ages are whole seconds that have passed.
    """
    at = F.unix_micros(F.lit(now).cast("timestamp_ntz").cast("timestamp"))
    seconds = lambda c: (at - F.unix_micros(c.cast("timestamp"))) / 1e6
    age = lambda c: seconds(c).cast("long")
    since = lambda minutes: F.col("finished_at") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {minutes} MINUTES")
    # the windows of the last hour's failures reach two hours back: the single task of the window gets no more
    recent = failing_window(failures.where(since(120)), 60).where(since(60))
    silent = heartbeats.agg(F.rint(seconds(F.max("beat_at"))).cast("long").alias("worker_silence"))
    oldest = waiting.where(F.col("run_after") <= F.lit(now).cast("timestamp_ntz")).agg(age(F.min("run_after")).alias("oldest_runnable"))
    most = recent.agg(F.coalesce(F.max("count_in_window"), F.lit(0)).alias("failures_in_window"))
    backup = backups.agg(age(F.max("completed_at")).alias("backup_age"))
    return silent.crossJoin(oldest).crossJoin(most).crossJoin(backup)  # one row each


def expired_snapshots(snapshots: DataFrame, references: DataFrame, active: DataFrame, now: str, days: int = 14, keep: int = 5) -> DataFrame:
    """Ready snapshots older than ``days`` or ranked past ``keep`` of their repository, neither active nor referenced by a live run."""
    at = F.lit(now).cast("timestamp_ntz")
    ranked = snapshots.withColumn("rank", F.row_number().over(Window.partitionBy("repository_id").orderBy(F.desc("ready_at"), F.desc("id"))))
    old = ranked.where((F.col("ready_at") < at - F.expr(f"INTERVAL {days} DAYS")) | (F.col("rank") > keep))
    live = references.where(F.col("expires_at") >= at).select(F.col("snapshot_id").alias("id")).distinct()
    return old.join(active.select("id"), "id", "left_anti").join(live, "id", "left_anti")


def due_for_check(repositories: DataFrame, busy: DataFrame, now: str, hours: int = 20) -> DataFrame:
    """Repositories not paused, last checked ``hours`` ago or never, without a waiting or running job."""
    at = F.lit(now).cast("timestamp_ntz")
    due = repositories.where(~F.col("paused") & (F.col("checked_at").isNull() | (F.col("checked_at") < at - F.expr(f"INTERVAL {hours} HOURS"))))
    return due.join(busy.select("repository_id").distinct(), "repository_id", "left_anti")


def within_daily_quota(calls: DataFrame, limit: int, *keys: str, at: str = "ts", order: str = "event_id") -> DataFrame:
    """``accepted``: the first ``limit`` calls of each key and UTC day."""
    w = Window.partitionBy(*keys, F.to_date(at)).orderBy(at, order)
    return calls.withColumn("accepted", F.row_number().over(w) <= limit)


def within_two_quotas(calls: DataFrame, own_limit: int, shared_limit: int, key: str, at: str = "ts", order: str = "event_id") -> DataFrame:
    """``accepted`` under a limit for each key and day and one shared by all keys of a day; both count or neither.

    A key's calls past its own limit never count, so the shared limit is spent by the rest in order.
    """
    own = Window.partitionBy(key, F.to_date(at)).orderBy(at, order)
    first = calls.withColumn("__fits", F.row_number().over(own) <= own_limit).withColumn("__minute", F.date_trunc("minute", F.col(at)))
    # counted by minute first, so that no task gets all calls of a day
    minutes = first.groupBy("__minute").agg(F.count_if("__fits").alias("__n"))
    before = Window.partitionBy(F.to_date("__minute")).orderBy("__minute").rowsBetween(Window.unboundedPreceding, -1)
    bases = minutes.select("__minute", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__minute").orderBy(at, order).rowsBetween(Window.unboundedPreceding, 0)
    counted = first.join(bases, "__minute").withColumn("__upto", F.col("__base") + F.count_if("__fits").over(within))
    return counted.withColumn("accepted", F.col("__fits") & (F.col("__upto") <= shared_limit)).drop("__fits", "__minute", "__base", "__upto")


def spells(rows: DataFrame, key: str, quiet: int) -> DataFrame:
    """``rows`` (key, at, ...) with ``spell``: a key's rows with no time of ``quiet`` microseconds without any between them, or more.

    Rows are counted by stretches of that length first: where a whole one is empty, a spell ends. No task meets all rows of a key.
    """
    stretch = F.floor(F.col("at") / F.lit(quiet))
    held = rows.where(F.col("at").isNotNull()).select(key, stretch.alias("__stretch")).distinct()
    order = Window.partitionBy(key).orderBy("__stretch")
    begins = held.withColumn("__new", (F.coalesce(F.col("__stretch") - F.lag("__stretch").over(order), F.lit(2)) > 1).cast("int"))
    numbered = begins.select(F.col(key).alias("__key"), "__stretch", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("spell"))
    own = rows.withColumn("__own", stretch)
    return own.join(numbered, own[key].eqNullSafe(F.col("__key")) & F.col("__own").eqNullSafe(F.col("__stretch")), "left").drop("__key", "__stretch", "__own")


def in_order(rows: DataFrame, key: str, first, step, told: str, quiet: int) -> DataFrame:
    """``(key, event_id, *told)``: the rows ``(key, event_id, at, ...)`` of each key handled one after another in order of time.

    ``step(state, at, ...)`` returns a row's values and the next state, the first of which is ``first`` and which ``quiet``
    microseconds without a row bring back. Rows are sorted by Spark and stream past, so a task holds one key's state, however
    many rows the key has; a key's spells go to different tasks.
    """
    schema = T.StructType([*rows.select(key, "event_id").schema.fields, *T.StructType.fromDDL(told).fields])
    types = to_arrow_schema(schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, now, state = False, None, first
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out = []
            for *own, values in zip(columns[0], columns[-1], zip(*columns[2:-1], strict=True), strict=True):
                if not begun or own != now:
                    begun, now, state = True, own, first
                result, state = step(state, *values)
                out.append(result)
            made = [pa.array([r[i] for r in out], types.field(i + 2).type) for i in range(len(types) - 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=types.names)

    return spells(rows, key, quiet).repartition(key, "spell").sortWithinPartitions(key, "spell", "at", "event_id").mapInArrow(walk, schema)


def sliding_limiter(calls: DataFrame, limit: int, seconds: int, key: str) -> DataFrame:
    """``(key, event_id, allowed, retry_after)``: allowed while fewer than ``limit`` allowed calls lie within the window.

    Refused calls don't count. Calls of a key are handled in order, holding only its last ``limit`` allowed ones.
    """

    def step(recent: list[int], at: int) -> tuple[tuple, list[int]]:
        allowed, wait, recent = limiter_step(recent, at, limit, seconds)
        return (allowed, wait), recent

    timed = calls.select(key, "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return in_order(timed, key, [], step, "allowed boolean, retry_after int", max(1, seconds) * 1_000_000)


def limiter_step(recent: list[int], at: int, limit: int, seconds: int) -> tuple[bool, int, list[int]]:
    """One call at ``at`` (microseconds): whether it is allowed, seconds to wait, and the allowed calls still in the window."""
    recent = [t for t in recent if t > at - seconds * 1_000_000]
    if len(recent) < limit:
        return True, 0, [*recent, at]
    if limit <= 0:
        return False, seconds, recent
    return False, -(-(recent[-limit] + seconds * 1_000_000 - at) // 1_000_000), recent


def first_deliveries(deliveries: DataFrame, key: str = "delivery_id") -> DataFrame:
    """The first row of each delivery id."""
    return latest_per_key(deliveries, [key], F.col("received_at"), F.col("payload"))


def routed(events: DataFrame, default_branch: str = "main") -> DataFrame:
    """``route``: push to the default branch, or why an event is ignored."""
    ref = F.get_json_object("payload", "$.ref")
    route = (
        F.when(F.col("kind") != "push", F.concat(F.lit("ignored: "), "kind"))
        .when(F.get_json_object("payload", "$.deleted") == "true", "ignored: deletion")
        .when(F.startswith(ref, F.lit("refs/tags/")), "ignored: tag")
        .when(ref == f"refs/heads/{default_branch}", "index")
        .otherwise("ignored: other branch")
    )
    return events.withColumn("route", F.coalesce(route, F.lit("ignored: other branch")))


def display_state(latest: DataFrame) -> DataFrame:
    """The state shown for a repository, from its latest job and what is ready."""
    state = F.when(F.col("status") == "running", "indexing").when(F.col("status") == "waiting", "queued").when((F.col("status") == "failed") & F.col("ready"), "stale").when(F.col("status") == "failed", "failed").when(F.col("ready"), "ready").otherwise("empty")
    return latest.withColumn("state", state)


def live_workers(beats: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """``(worker_id, started_at, beat_at)`` of workers that were heard within ``hours``."""
    each = beats.groupBy("worker_id").agg(F.min("at").alias("started_at"), F.max("at").alias("beat_at"))
    return each.where(F.col("beat_at") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS"))


def first_covering(pushes: DataFrame, runs: DataFrame) -> DataFrame:
    """For each push of a repository the first run that finished at or after it; null where there is none.

    Pushes and runs are merged in time order, so that no push meets all the runs of its repository.
    """
    p = pushes.select("repository_id", F.col("pushed_at").alias("at"), "push_id", F.lit(None).cast("long").alias("run_id"), F.lit(0).alias("side"))
    r = runs.select("repository_id", F.col("finished_at").alias("at"), F.lit(None).cast("long").alias("push_id"), "run_id", F.lit(1).alias("side"))
    # from the last row back, so that the frame only grows and one pass serves all rows
    w = Window.partitionBy("repository_id").orderBy(F.desc("at"), F.desc("side"), F.desc("run_id")).rowsBetween(Window.unboundedPreceding, 0)
    met = p.unionByName(r).withColumn("found", F.last(F.when(F.col("side") == 1, F.struct(F.col("at").alias("finished_at"), "run_id")), ignorenulls=True).over(w))
    return met.where("side = 0").select("repository_id", "push_id", F.col("at").alias("pushed_at"), F.col("found.finished_at").alias("finished_at"), F.col("found.run_id").alias("run_id"))


def idempotent_outcomes(requests: DataFrame, hours: int = 24) -> DataFrame:
    """``(key, event_id, outcome)``: new, replayed (same payload within the time) or conflict; time runs from each new one."""

    def step(held: tuple[int, str] | None, at: int, payload: str) -> tuple[tuple, tuple[int, str]]:
        outcome, held = idempotency_step(held, at, payload, hours)
        return (outcome,), held

    timed = requests.select("key", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.sha2(F.coalesce("payload", F.lit("")), 256).alias("payload"))
    return in_order(timed, "key", None, step, "outcome string", max(1, hours) * 3_600_000_000)


def idempotency_step(held: tuple[int, str] | None, at: int, payload: str, hours: int) -> tuple[str, tuple[int, str]]:
    if held is None or at >= held[0] + hours * 3_600_000_000:
        return "new", (at, payload)
    return ("replayed" if held[1] == payload else "conflict"), held


def access_states(events: DataFrame) -> DataFrame:
    """``(key, event_id, state, since)``: active, paused or access_lost after each event.

    A loss beats a pause and keeps the time of the first loss; ``restore`` ends a loss, ``resume`` a pause.
    """

    kind, at = F.col("kind"), F.unix_micros(F.col("ts").cast("timestamp"))
    order = Window.partitionBy("key").orderBy("at", "event_id")
    upto = lambda *keys: Window.partitionBy("key", *keys).orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    timed = events.select("key", "event_id", "kind", at.alias("at"))
    lost = timed.withColumn("lost", F.coalesce(F.last(F.when(kind.isin("loss", "restore"), kind == "loss"), ignorenulls=True).over(upto()), F.lit(False)))
    # a restored loss starts anew: earlier pauses are forgotten
    anew = lost.withColumn("restored", ((kind == "restore") & F.coalesce(F.lag("lost").over(order), F.lit(False))).cast("int"))
    spans = anew.withColumn("span", F.sum("restored").over(upto())).withColumn("resumed", F.sum(((kind == "resume") & ~F.col("lost")).cast("int")).over(upto()))
    first_loss = F.min(F.when(kind == "loss", F.col("at"))).over(upto("span"))
    first_pause = F.min(F.when((kind == "pause") & ~F.col("lost"), F.col("at"))).over(upto("span", "resumed"))
    since = F.when(F.col("lost"), F.col("first_loss")).otherwise(F.col("first_pause"))
    state = F.when(F.col("lost"), "access_lost").when(F.col("first_pause").isNotNull(), "paused").otherwise("active")
    told = spans.withColumn("first_loss", first_loss).withColumn("first_pause", first_pause)
    return told.select("key", "event_id", state.alias("state"), since.alias("since"))


def access_step(state: str, since: int | None, kind: str, at: int) -> tuple[str, int | None]:
    if kind == "loss":
        return "access_lost", since if state == "access_lost" else at
    if kind == "pause" and state == "active":
        return "paused", at
    if (kind == "resume" and state == "paused") or (kind == "restore" and state == "access_lost"):
        return "active", None
    return state, since


def coalesced(requests: DataFrame) -> DataFrame:
    """``(key, event_id, action)``: at most one waiting job for each key.

    A request while one waits is merged into it, a ``start`` event takes the waiting job off.
    """
    w = Window.partitionBy("key").orderBy("ts", "event_id")
    before = F.lag("kind").over(w)
    return requests.withColumn("action", F.when(F.col("kind") == "start", "start").when(before.isNull() | (before == "start"), "enqueue").otherwise("merge")).select("key", "event_id", "action")


def merged_triggers(requests: DataFrame) -> DataFrame:
    """``(key, event_id, trigger, pushed)`` of each job that waited: the request that made it, its trigger, and the newest commit pushed to it.

    Requests ``(key, event_id, ts, kind, trigger, commit)`` while a job waits join it; a waiting ``check`` takes the first other trigger. A ``start`` takes it off.
    """
    upto = Window.partitionBy("key").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    spans = requests.withColumn("span", F.coalesce(F.count_if(F.col("kind") == "start").over(upto), F.lit(0))).where("kind <> 'start'")
    at = F.struct("ts", "event_id")
    other = F.min_by("trigger", F.when(F.col("trigger") != "check", at))
    pushed = F.max_by("commit", F.when(F.col("commit").isNotNull(), at))
    return spans.groupBy("key", "span").agg(F.min_by("event_id", at).alias("event_id"), F.coalesce(other, F.lit("check")).alias("trigger"), pushed.alias("pushed")).drop("span")


def counted_with_refunds(changes: DataFrame, *keys: str, at: str = "ts", order: str = "event_id") -> DataFrame:
    """``used`` after each change (+1 or a refund of -1) of a key's day, never below zero.

    A counter with that floor is its plain sum less the lowest the sum has been, where that is below zero.
    """
    day = Window.partitionBy(*keys, F.to_date(at)).orderBy(at, order).rowsBetween(Window.unboundedPreceding, 0)
    summed = changes.withColumn("__sum", F.sum("change").over(day))
    return summed.withColumn("used", F.col("__sum") - F.least(F.lit(0), F.min("__sum").over(day))).drop("__sum")


def other_expired(runs: DataFrame, snapshots: DataFrame, now: str, days: int = 1) -> DataFrame:
    """``(what, id)``: runs past their time, and failed or discarded snapshots older than ``days``."""
    at = F.lit(now).cast("timestamp_ntz")
    gone = snapshots.where(F.col("status").isin("failed", "discarded") & (F.col("created_at") < at - F.expr(f"INTERVAL {days} DAYS")))
    return runs.where(F.col("expires_at") < at).select(F.lit("run").alias("what"), "id").unionByName(gone.select(F.lit("snapshot").alias("what"), "id"))


def review_states(reviews: DataFrame) -> DataFrame:
    """``state`` of a review from its job's ``status``, its ``head`` and the ``current_head``; one without a job is queued."""
    done = F.when(F.col("head") == F.col("current_head"), "current").otherwise("outdated")
    state = F.when(F.col("status").isin("running", "retry_wait"), "running").when(F.col("status") == "succeeded", done).when(F.col("status").isin("failed", "canceled"), "failed")
    return reviews.withColumn("state", state.otherwise("queued"))


def access_views(repositories: DataFrame, keep_days: int) -> DataFrame:
    """``(repository_id, access, purge_after, updates)``: what is shown of a repository's access and its automatic updates."""
    lost = F.col("access_state") == "access_lost"
    access = F.when(lost, "lost").when(F.col("checked_at").isNull(), "unknown").otherwise("verified")
    purge = F.when(lost, F.col("lost_at") + F.expr(f"INTERVAL {keep_days} DAYS"))
    return repositories.select("repository_id", access.alias("access"), purge.alias("purge_after"), F.when(F.col("access_state") == "paused", "paused").otherwise("on").alias("updates"))


def expired_records(sessions: DataFrame, keys: DataFrame, deliveries: DataFrame, now: str, days: int = DELIVERY_DAYS) -> DataFrame:
    """``(what, id)``: sessions past their time or revoked, idempotency keys past their time, and deliveries older than ``days``."""
    at = F.lit(now).cast("timestamp_ntz")
    old = {
        "session": sessions.where((F.col("expires_at") < at) | F.col("revoked_at").isNotNull()),
        "key": keys.where(F.col("expires_at") < at),
        "delivery": deliveries.where(F.col("received_at") < at - F.expr(f"INTERVAL {days} DAYS")),
    }
    parts = [df.select(F.lit(what).alias("what"), F.col("id").cast("string").alias("id")) for what, df in old.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def audit_events(attempts: DataFrame) -> DataFrame:
    """One row of the audit log for each attempt ``(at, actor, action, resource, allowed)``; what was not allowed is a denial."""
    action = F.when(F.col("allowed"), F.col("action")).otherwise("access_denied")
    return attempts.select("at", "actor", action.alias("action"), F.when(F.col("allowed"), "ok").otherwise("denied").alias("outcome"), "resource")


def append_audit(rows: DataFrame, path: str) -> None:
    """Add rows to the log, a folder for each day; rows that are there never change."""
    rows.withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").parquet(path)
