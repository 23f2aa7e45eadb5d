"""Tests of the third round's finding on the traffic of tool calls."""

from __future__ import annotations

from datetime import datetime

import duckdb

from entries import files

NAME = "l11_tool_call_traffic"
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
PARTS = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def _same_as_sql(spark, folder, events):
    parts = [(i, f"{'hot' if i % 2 else 'old'} bolt", f"Brand#{i % 3}", "SMALL", i, 1.0) for i in range(8)]
    at = datetime(2024, 1, 20)
    rows = [(e, at, user, kind, 1.0, f'{{"k": {k}}}') for e, user, kind, k in events]
    con = duckdb.connect()
    for name, data, schema in (("events", rows, EVENTS), ("part", parts, PARTS)):
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    asked = con.execute(files.SQL[NAME])
    expected = dict(zip([c[0] for c in asked.description], asked.fetchone()))
    assert files.QUERIES[NAME](spark, str(folder)).first().asDict() == expected
    return expected


def test_the_first_event_is_traffic_too(spark, tmp_path):
    """Event 0's repetition is no tag's, and its two queries were dropped as malformed."""
    expected = _same_as_sql(spark, tmp_path, [(0, 2, "signup", 5), (1, 4, "view", 13), (2, 3, "click", 7)])
    assert (expected["queries"], expected["starred"]) == (4, 2)


def test_every_kind_of_event_is_traffic(spark, tmp_path):
    kinds = ("view", "click", "purchase", "signup", "error")
    events = [(e, 2 * (e % 4), kinds[e // 10 % 5], 2 + e % 8) for e in range(100)]
    assert _same_as_sql(spark, tmp_path, events)["queries"] > 100
