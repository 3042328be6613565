"""Structured Streaming forms of the operators that remember: dedupe, limiter, idempotency, access, windows.

The stateful ones step through a key's calls with the same small functions as the batch operators do, so
that a stream that is read to its end gives the batch result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.operations import access_step, idempotency_step, limiter_step
from tessera.sources.shared import fresh


#: How late a row may come; later ones are left out.
LATE = "1 day"


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files: int | None = None) -> DataFrame:
    """A stream of parquet files, ``files`` of them a batch if given; timestamps without a zone become instants in UTC, as watermarks need them."""
    reader = spark.readStream.schema(schema)
    rows = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)
    return rows.select(*[F.col(f.name).cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name) for f in schema.fields])


def finished(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that the stream gives for the files that are there now, by way of the shared folder."""
    spark = stream.sparkSession
    out = fresh(spark, name)

    def write(batch: DataFrame, epoch: int) -> None:
        # complete results replace the last ones; others get a folder for each epoch, so that a retried epoch replaces itself
        batch.write.mode("overwrite").parquet(f"{out}/epoch={0 if mode == 'complete' else epoch}")

    started = stream.writeStream.outputMode(mode).option("checkpointLocation", fresh(spark, f"{name}-state")).trigger(availableNow=True).foreachBatch(write).start()
    started.awaitTermination()
    return spark.read.schema(T.StructType(stream.schema.fields)).parquet(out).select(*stream.columns)


def deduplicated(deliveries: DataFrame, key: str = "delivery_id", at: str = "ts", memory: str = "14 days") -> DataFrame:
    """The first of each delivery id that comes within ``memory``."""
    return deliveries.withWatermark(at, memory).dropDuplicatesWithinWatermark([key])


def tumbling_counts(events: DataFrame, every: str, *keys: str, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, every), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sliding_counts(events: DataFrame, length: str, every: str, *keys: str, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, length, every), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def session_counts(events: DataFrame, gap: str, *keys: str, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Sessions of each key; for append output, as sessions can't be shown before they end."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def _stepped(timed: DataFrame, key: str, out: str, state: str, first: tuple, step, quiet_hours: int) -> DataFrame:
    """Rows of a key in time order through ``step(state, row) -> (state, values)``; a key's state goes after ``quiet_hours`` without rows."""
    names = [f.split()[0] for f in out.split(", ")]

    def walk(keys: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        now = held.get if held.exists else first
        pdf = pd.concat(list(batches)).sort_values(["at", "event_id"], kind="stable")
        rows = []
        for row in pdf.itertuples(index=False):
            now, values = step(now, row)
            rows.append((keys[0], row.event_id, *values))
        held.update(now)
        last = int(pdf["at"].iloc[-1]) // 1000
        held.setTimeoutTimestamp(max(last + quiet_hours * 3_600_000, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=names)

    stamped = timed.withWatermark("ts", LATE).withColumn("at", F.unix_micros("ts"))
    return stamped.groupBy(key).applyInPandasWithState(walk, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def limited(calls: DataFrame, limit: int, seconds: int, key: str) -> DataFrame:
    """``(key, event_id, allowed, retry_after)``: the sliding limiter; a key's state is its last ``limit`` allowed calls at most."""

    def step(now: tuple, row) -> tuple[tuple, tuple]:
        allowed, wait, recent = limiter_step(list(now[0] or []), int(row.at), limit, seconds)
        return (recent,), (allowed, wait)

    kind = dict(calls.dtypes)[key]
    timed = calls.select(key, "event_id", "ts")
    return _stepped(timed, key, f"{key} {kind}, event_id long, allowed boolean, retry_after int", "recent array<long>", ([],), step, max(1, -(-seconds // 3600)))


def idempotent(requests: DataFrame, hours: int = 24) -> DataFrame:
    """``(key, event_id, outcome)``: new, replayed or conflict."""

    def step(now: tuple, row) -> tuple[tuple, tuple]:
        outcome, held = idempotency_step((now[0], now[1]) if now[1] else None, int(row.at), row.payload, hours)
        return held, (outcome,)

    timed = requests.select("key", "event_id", "ts", F.sha2(F.coalesce("payload", F.lit("")), 256).alias("payload"))
    return _stepped(timed, "key", "key string, event_id long, outcome string", "at long, payload string", (0, ""), step, hours)


def access(events: DataFrame) -> DataFrame:
    """``(key, event_id, state, since)`` of the access state machine; -1 stands for no time."""

    def step(now: tuple, row) -> tuple[tuple, tuple]:
        state, since = access_step(now[0], None if now[1] < 0 else now[1], row.kind, int(row.at))
        held = (state, -1 if since is None else since)
        return held, held

    timed = events.select("key", "event_id", "kind", "ts")
    return _stepped(timed, "key", "key string, event_id long, state string, since long", "state string, since long", ("active", -1), step, 365 * 24)
