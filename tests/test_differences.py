"""Small tables on which queries once gave other rows than their SQL."""

from __future__ import annotations

from datetime import datetime

import duckdb
import pytest

from tessera.plans import registry

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
DOCUMENTS = "doc_id long, text string, lang string, source string"


def both(spark, folder, name: str, **tables) -> tuple[list[tuple], list[tuple]]:
    """The rows of a query and those of its SQL over ``tables``, each a list of rows and a schema."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        path = f"{folder}/{table}.parquet"
        spark.createDataFrame(rows, schema).write.parquet(path)
        con.sql(f"create view {table} as select * from '{path}/*.parquet'")
    df = registry.QUERIES[name](spark, str(folder))
    theirs = con.sql(registry.ORACLES[name])
    at = [theirs.columns.index(c) for c in df.columns]
    return sorted(map(tuple, df.collect()), key=repr), sorted((tuple(r[i] for i in at) for r in theirs.fetchall()), key=repr)


@pytest.mark.parametrize("micros, silence", [(400_000, 3), (500_000, 2), (600_000, 2)])
def test_the_last_heartbeat_is_told_to_the_nearest_second(spark, tmp_path, micros, silence):
    rows = [(i, datetime(2024, 1, 30, 11, 0, 0, 600_000), 1, "purchase", 1.0, "") for i in range(20)] + [(20, datetime(2024, 1, 30, 11, 59, 57, micros), 1, "view", 1.0, "")]
    ours, theirs = both(spark, tmp_path, "alert_conditions", events=(rows, EVENTS))
    assert ours == theirs and ours[0][0] == silence


def test_a_snippet_that_is_cut_behind_a_line_feed(spark, tmp_path):
    texts = ["a" * 298 + "\nb" + "c" * 40, "a" * 297 + " \nb" + "c" * 40, "a" * 298 + "  \t\nb" + "c" * 9, "\t\n x \n  　y\n", " \n\n", "", None, "a\tb\n\tc\n d \r\ne", "a" * 299 + " b"]
    ours, theirs = both(spark, tmp_path, "snippets", documents=([(i, t, "en", "s") for i, t in enumerate(texts)], DOCUMENTS))
    assert ours == theirs and "\n…" in dict(ours)[0]
