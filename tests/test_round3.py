"""Tests of the third round's findings."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from colscope.functions.sqltext import normalize, without_values
from colscope.operators import experiment, snapshot

TEXTS = [
    "select a, sum(b) from t where a = '43' group by 1 order by 2 desc",
    "with base as (select * from a.b.t where c in (1, 2, 43)) select d from base -- note 43",
    "select a from t where b = 'it''s' and c = n'x' group by 1, 2 limit 3",
    "select cast(a as number(10, 2)) from t where x = 5",
    'select "a = 5" from t where x = 5',
    "select date_trunc('month', d) from t where x = 'month'",
    "select a from t where x = 'y -- z' and b = 4 -- it's",
    "select a from t where b = 'x",
    "select $1 from t where a = $2 and c in (3)",
    "select a from t where d > interval '5 day' and e > interval 5 day order by a = 1, 2",
    "select 1; select 43",
    None,
]


def test_plain_values_do_not_change_the_canonical_text(spark):
    rows = spark.createDataFrame([(x,) for x in TEXTS], "sql string")
    both = rows.select("sql", normalize(F.col("sql")).alias("a"), normalize(without_values(F.col("sql"))).alias("b"))
    assert [r["sql"] for r in both.collect() if r["a"] != r["b"]] == []


def test_texts_that_differ_in_values_are_analysed_once(spark):
    rows = spark.range(50).select(F.concat(F.lit("select a from t where b = "), F.col("id").cast("string")).alias("sql"))
    assert rows.select(without_values(F.col("sql"))).distinct().count() == 1
    found = snapshot.normalized_texts(rows, "sql")
    assert found.count() == 50 and found.select("normalized_sql").distinct().first()[0] == "SELECT A FROM T WHERE B = ?"


def _columns(spark):
    run = spark.createDataFrame([("r1", "q1", "a"), ("r1", "q1", "b"), ("r2", "q1", "a"), ("r3", "q2", "c")], "run_key string, qid string, fqn string")
    gold = spark.createDataFrame([("q1", "a"), ("q1", "d")], "qid string, fqn string")
    return run, gold


@pytest.mark.parametrize("fqn", ["a", "b", "c", "d", "e"])
def test_attributions_agree_with_the_pairs(spark, fqn):
    run, gold = _columns(spark)
    attributed = spark.createDataFrame([(r, fqn) for r in ("r1", "r2", "r3", "r4")], "run_key string, fqn string")
    expected = experiment.attribution_agreement(attributed, experiment.confusion_pairs(run, gold)).first()
    assert experiment.confused_attributions(attributed, run, gold).first() == expected


def test_run_columns_are_not_broadcast(spark):
    run, gold = _columns(spark)
    plan = experiment.confusion_pairs(run, gold)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [run_key" in plan
