"""Redaction, statement kinds, tags, the window and counters on rows made for it."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from colscope.functions.sqltext import normalize
from colscope.operators import snapshot

REDACTED = [
    ("select title from books where shelf = 'K7' or pages > 300", "SELECT TITLE FROM BOOKS WHERE SHELF = ? OR PAGES > ?"),
    ("select shelf, max(pages) from books group by 1 order by 1 desc", "SELECT SHELF, MAX(PAGES) FROM BOOKS GROUP BY 1 ORDER BY 1 DESC"),
    ("select cast(price as numeric(8, 3)) from books", "SELECT CAST(PRICE AS DECIMAL(8, 3)) FROM BOOKS"),
    ("select title from books where bought > now() - interval '3 months'", "SELECT TITLE FROM BOOKS WHERE BOUGHT > NOW() - ?"),
    ("select title from books where shelf in ('a', 'b', 'c')", "SELECT TITLE FROM BOOKS WHERE SHELF IN (?)"),
    ("select title from books where pages in (n, 12, 40)", "SELECT TITLE FROM BOOKS WHERE PAGES IN (N, ?, ?)"),
    ("select title /* who asked: 77 */ from books -- for the desk", "SELECT TITLE FROM BOOKS"),
    ("select title from books where owner = 'O''Hara /* kept */'", "SELECT TITLE FROM BOOKS WHERE OWNER = ?"),
    ('select "Title" t from books b where b.n != 4', 'SELECT "Title" AS T FROM BOOKS AS B WHERE B.N <> ?'),
    ("select title from books limit 25", "SELECT TITLE FROM BOOKS LIMIT ?"),
    ("select title from books where n = -2.5e3", "SELECT TITLE FROM BOOKS WHERE N = -?"),
]
REFUSED = [
    ("select title from books where owner = 'open", "parse_error"),
    ("select max((pages) from books", "parse_error"),
    ("select title from books; select city from branches", "multiple_statements"),
    ("   /* only a note */ ", "multiple_statements"),
    ("use warehouse small", "not_a_query"),
    ("delete from books where n = 3", "not_a_query"),
    ("describe table books", "not_a_query"),
]


@pytest.fixture(scope="module")
def judged(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts") / "t")
    texts = [s for s, _ in [*REDACTED, *REFUSED]]
    spark.createDataFrame([(s,) for s in texts], "sql string").write.parquet(path)
    rows = spark.read.parquet(path).select("sql", normalize(F.col("sql")).alias("n")).collect()
    return {r["sql"]: r["n"] for r in rows}


@pytest.mark.parametrize(("sql", "text"), REDACTED)
def test_canonical_text(judged, sql, text):
    assert judged[sql]["text"] == text
    assert judged[sql]["problem"] is None


@pytest.mark.parametrize(("sql", "problem"), REFUSED)
def test_refused_texts(judged, sql, problem):
    assert judged[sql]["problem"] == problem
    assert judged[sql]["text"] is None


END = datetime(2031, 5, 12)
SCHEMA = (
    "query_id string, query_text string, start_time timestamp, role_name string, query_tag string,"
    " execution_status string, database_name string, schema_name string"
)


def asked(spark, *rows):
    filled = [
        (i, sql, END - before, role, tag, "SUCCESS", "LIBRARY", "CORE") for i, sql, before, role, tag in rows
    ]
    return spark.createDataFrame(filled, SCHEMA)


def test_reasons_fields_and_counters(spark):
    day, sql = timedelta(days=1), "select title from books where owner = 'HIDE ME'"
    history = asked(
        spark,
        ("first instant", sql, 3 * day, "BOT", None),
        ("end", sql, timedelta(0), "BOT", None),
        ("too early", sql, 3 * day + timedelta(seconds=1), "BOT", None),
        ("stranger", sql, day, "VISITOR", None),
        ("tagged", sql, day, "BOT", "agent:spring:q7:2"),
        ("tag of others", sql, day, "BOT", "report:monthly"),
        ("bad repetition", sql, day, "BOT", "agent:spring:q7:0"),
        ("broken", "select (1", day, "BOT", None),
        ("two", "select 1 from a; select 2 from a", day, "BOT", None),
        ("other statement", "truncate table books", day, "BOT", None),
    )
    actors = spark.createDataFrame([("BOT", "agent")], "role string, actor string")
    done = snapshot.classified(history, actors, END, 3)
    by_id = {r["query_id"]: r for r in done.collect()}
    reasons = {k: r["reason"] for k, r in by_id.items() if r["reason"]}
    assert reasons == {
        "end": "outside_window",
        "too early": "outside_window",
        "stranger": "unmapped_role",
        "bad repetition": "malformed_tag",
        "broken": "parse_error",
        "two": "multiple_statements",
        "other statement": "not_a_query",
    }
    kept = by_id["tagged"]
    assert (kept["run_id"], kept["qid"], kept["repetition"]) == ("spring", "q7", 2)
    assert by_id["tag of others"]["run_id"] is None
    assert {by_id[k]["normalized_sql"] for k in ("first instant", "tagged")} == {"SELECT TITLE FROM BOOKS WHERE OWNER = ?"}
    assert not any("HIDE ME" in str(r) for r in by_id.values())
    counted = snapshot.counters(done)
    assert counted.first()["kept"] == 3
    gates = {r["gate"]: r for r in snapshot.gates(counted, 0.9, 4).collect()}
    assert gates["parse_rate"]["value"] == pytest.approx(5 / 6) and not gates["parse_rate"]["passed"]
    assert not gates["rows_kept"]["passed"]


def test_texts_are_grouped_by_hash(spark):
    history = asked(spark, *[(str(i), "select title from books", timedelta(hours=1), "BOT", None) for i in range(5)])
    plan = snapshot.normalized_texts(history)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
