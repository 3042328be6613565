"""State over several batches: rows out of order and late ones, jobs that expire by a timer, ids that are forgotten after their time."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessera.sources.shared import fresh
from tessera.streaming import coalescing as C
from tessera.streaming import stateful as S

START = datetime(2024, 1, 1)
SCHEMA = "key string, event_id long, ts timestamp, kind string, trigger string, commit string"


def stream(spark, tmp_path, *batches):
    """A file for each batch; files are read by age."""
    at = str(tmp_path / "in")
    for rows in batches:
        made = [(key, n, START + timedelta(seconds=s), *rest) for key, n, s, *rest in rows]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(at)
        time.sleep(1.1)
    return S.read_stream(spark, at, spark.read.parquet(at).schema, 1)


def test_jobs_over_batches_out_of_order_and_late(spark, tmp_path):
    request = lambda key, n, s, trigger="check", commit=None: (key, n, s, "request", trigger, commit)
    batches = [
        [request("a", 2, 200, "push", "c2"), request("a", 1, 100), request("b", 10, 50, "user")],
        [request("a", 3, 150, "user", "c3"), ("a", 4, 400, "start", None, None), request("c", 20, 900)],  # 150 comes after 200
        [request("a", 5, 450, "check"), request("late", 30, 1), ("c", 21, 1000, "start", None, None)],
        [request("a", 6, 2000, "push", "c6"), request("d", 40, 90_000)],
        [request("late", 31, 2), request("tick", 99, 10**6)],  # by now the watermark is far beyond
        [request("tick", 98, 10**6 + 1)],
    ]
    requests = stream(spark, tmp_path, *batches)
    with C.state_store(spark):
        got = S.finished(C.coalesced_jobs(requests, patience=3600, late="10 minutes"), "jobs").where("key <> 'tick'").collect()
    assert sorted((r.key, r.event_id, r.trigger, r.pushed, r.requests, r.ended) for r in got) == [
        ("a", 1, "user", "c2", 3, "started"), ("a", 5, "push", "c6", 2, "expired"), ("b", 10, "user", None, 1, "expired"), ("c", 20, "check", None, 1, "started"),
        ("d", 40, "check", None, 1, "expired"),
    ]
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")


def test_an_id_comes_again_after_its_time(spark, tmp_path):
    rows = lambda *ids: [(i, n, 0, "x", "y", None) for n, i in enumerate(ids)]
    found = {}
    for name, days in (("short", 0.5 / 86_400), ("long", 1.0)):
        path = tmp_path / name
        path.mkdir()
        source = stream(spark, path, rows("a", "a", "b"), rows("a", "c"), rows("b"))
        slow = F.udf(lambda x: (time.sleep(0.4), x)[1])  # a batch takes longer than the shorter time
        deliveries = source.select(slow("key").alias("id"), F.col("trigger").alias("payload"))
        with C.state_store(spark, idle=False):
            out = fresh(spark, "ids")
            query = C.remembered(deliveries, days, 4).writeStream.option("checkpointLocation", fresh(spark, "ids-state")).trigger(availableNow=True).format("parquet").option("path", out).start()
            query.awaitTermination()
        assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3
        found[name] = sorted(r.id for r in spark.read.parquet(out).collect())
    assert found["long"] == ["a", "b", "c"] and found["short"] == ["a", "a", "b", "b", "c"]


def test_a_job_that_opens_and_expires_behind_one_watermark(spark, tmp_path):
    """Requests of the last minutes are taken when the last watermark passes them, and their jobs have expired by then; equal rows count each."""
    request = lambda key, n, s: (key, n, s, "request", "check", None)
    batches = [[request("a", 1, 100), request("b", 2, 110), request("b", 2, 110), ("c", 3, 120, "start", None, None)], [request("tick", 99, 10**6)]]
    with C.state_store(spark):
        got = S.finished(C.coalesced_jobs(stream(spark, tmp_path, *batches), patience=3600), "jobs").where("key <> 'tick'").collect()
    assert sorted((r.key, r.event_id, r.requests, r.ended) for r in got) == [("a", 1, 1, "expired"), ("b", 2, 2, "expired")]


def test_a_batch_of_several_files(spark, sf_dir, monkeypatch):
    from tessera.plans import streams

    want = sorted(map(tuple, streams.stream_coalescing(spark, sf_dir).collect()), key=repr)
    monkeypatch.setattr(streams, "FILE_ROWS", 60)
    assert sorted(map(tuple, streams.stream_coalescing(spark, sf_dir).collect()), key=repr) == want
