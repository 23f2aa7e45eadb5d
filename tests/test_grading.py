"""Grading under column orders, golds' orders, and balance rules over hand-made tables."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from colscope.operators import grading, readings

GOLDS = "qid string, variant string, width int, rows bigint, ordered boolean"
VALS = "row_no bigint, vals array<struct<tag:string,val:string>>"


def _vals(rows):
    return [(i, [("string", v) for v in row]) for i, row in enumerate(rows, 1)]


def _passes(spark, run, gold, ordered):
    runs = spark.createDataFrame([("r", "q", 1, "result", len(run[0]), len(run))], "run_key string, qid string, repetition bigint, outcome string, width int, rows bigint")
    run_rows = spark.createDataFrame([("r", *v) for v in _vals(run)], f"run_key string, {VALS}")
    golds = spark.createDataFrame([("q", "", len(gold[0]), len(gold), ordered)], GOLDS)
    gold_rows = spark.createDataFrame([("q", "", *v) for v in _vals(gold)], f"qid string, variant string, {VALS}")
    return grading.grades(grading.checks(runs, run_rows, golds, gold_rows)).head()["passed"]


def test_columns_match_in_any_order_and_rows_as_asked(spark):
    gold = [("a", "b", "c"), ("b", "a", "c"), ("a", "a", "d")]
    swapped = [(r[2], r[0], r[1]) for r in gold]
    assert _passes(spark, swapped, gold, True)
    assert _passes(spark, swapped[::-1], gold, False) and not _passes(spark, swapped[::-1], gold, True)
    # each column holds the gold's values, the rows don't
    assert not _passes(spark, [("a", "a", "c"), ("b", "b", "c"), ("a", "a", "d")], gold, False)
    # columns alike in their values: every order they allow is tried
    alike = [("a", "b"), ("b", "c"), ("c", "a")]
    assert _passes(spark, [(y, x) for x, y in alike], alike, False)


def test_orders_left_to_chance(spark):
    keys = {"tie": [3, 3, 1], "cut": [5, 4, 4, 1], "fine": [5, 4, 3], "tie past the limit": [5, 4, 3, 3], "unordered tie": [2, 2], "loose": []}
    golds = spark.createDataFrame(
        [("tie", "", True, None), ("cut", "", False, 2), ("fine", "", True, 3), ("tie past the limit", "", True, 2), ("unordered tie", "", False, None), ("loose", "", True, None)],
        "qid string, variant string, ordered boolean, limit_n int",
    ).withColumns({"width": F.lit(1), "rows": F.lit(3).cast("bigint")})
    rows = spark.createDataFrame([(q, "", -k) for q, ks in keys.items() for k in ks], "qid string, variant string, keys int")
    none = spark.createDataFrame([], f"qid string, variant string, {VALS}")
    found = {r["qid"]: r["problem"] for r in grading.gold_problems(golds, none, rows).collect()}
    assert found == {
        "tie": "two rows tie on the order keys", "cut": "the limit cuts through a tie",
        "loose": "no order for an ordered or limited result",
    }


def test_ids_fall_into_islands(spark):
    ids = ["Q01", "Q02", "Q02", "Q05", "Q06", "R1", "X"]
    found = readings.id_islands(spark.createDataFrame([(i,) for i in ids], "qid string"))
    assert sorted(tuple(r) for r in found.collect()) == [("Q", 1, 2, 2), ("Q", 5, 6, 2), ("R", 1, 1, 1)]


def test_all_orders_are_listed(spark):
    orders = spark.range(1).select(grading.column_orders(F.lit(3)).alias("o")).head()["o"]
    assert sorted(map(tuple, orders)) == sorted(permutations(range(3)))
