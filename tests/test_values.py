"""Value pairs that must compare alike or apart, and graded runs."""

from __future__ import annotations

import datetime as dt
import hashlib
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.functions.guards import ContractViolation
from colscope.functions.hashing import digest_modulo
from colscope.functions.ordering import global_row_number
from colscope.functions.values import normalized_value
from colscope.operators import grading, profiles, sampling


def _pair(spark, value, kind):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("v", kind)]))
    return tuple(df.select(normalized_value(F.col("v"), kind).alias("n")).first()["n"])


def test_values(spark):
    d, s, dec = T.DoubleType(), T.StringType(), T.DecimalType(10, 3)
    # ties go to the even cent, by the shortest text of a double
    assert _pair(spark, 7.445, d) == _pair(spark, Decimal("7.445"), dec) == ("number", "7.44")
    assert _pair(spark, 7.455, d) == _pair(spark, Decimal("7.455"), dec) == ("number", "7.46")
    assert _pair(spark, 7.4450001, d) == ("number", "7.45")
    assert _pair(spark, 19.999, d) == ("number", "20.00")
    assert _pair(spark, -19.995, d) == ("number", "-20.00")
    assert _pair(spark, -0.0049, d) == _pair(spark, 0, T.LongType()) == ("number", "0.00")
    assert _pair(spark, -12, T.LongType()) == ("number", "-12.00")
    assert _pair(spark, 6e-8, d) == ("number", "0.00")
    assert _pair(spark, float("nan"), d)[0] == "nonfinite"
    assert _pair(spark, float("inf"), d) != _pair(spark, float("-inf"), d)
    assert _pair(spark, None, s) == ("null", None)
    assert _pair(spark, "\t Quai Nord\u00a0", s) == ("string", "Quai Nord")
    assert _pair(spark, "8", s) != _pair(spark, 8, T.LongType())
    assert _pair(spark, False, T.BooleanType()) == ("bool", "false")
    assert _pair(spark, dt.date(2031, 5, 12), T.DateType()) == ("string", "2031-05-12")
    assert _pair(spark, {"a": 1}, T.MapType(T.StringType(), T.LongType()))[0] == "composite"
    assert _pair(spark, b"ab", T.BinaryType())[0] == "unsupported"


def test_wide_numbers(spark):
    d = T.DoubleType()
    wide = T.DecimalType(38, 0)
    for whole in (3 * 10**19, 10**25, 12 * 10**33):
        assert _pair(spark, float(whole), d) == _pair(spark, Decimal(whole), wide) == ("number", f"{whole}.00")
    assert _pair(spark, 4e200, d) == ("number", "4" + "0" * 200 + ".00")
    assert _pair(spark, -4e200, d) == ("number", "-4" + "0" * 200 + ".00")
    assert _pair(spark, 4.239115827521622e28, d) == ("number", "42391158275216220000000000000.00")
    edge = Decimal("9" * 36 + ".5")
    assert _pair(spark, edge, T.DecimalType(38, 1)) == ("number", "9" * 36 + ".50")
    assert _pair(spark, Decimal("9" * 37 + ".5"), T.DecimalType(38, 1)) == ("number", "9" * 37 + ".50")
    assert _pair(spark, Decimal("9" * 35 + ".996"), T.DecimalType(38, 3)) == ("number", "1" + "0" * 35 + ".00")


def test_column_order_must_fit_every_row(spark):
    vals = "array<struct<tag:string,val:string>>"
    n = lambda *xs: [("number", str(x)) for x in xs]
    gold_rows = spark.createDataFrame(
        [("q", "", 1, n(1, 2)), ("q", "", 2, n(3, 4))],
        f"qid string, variant string, row_no bigint, vals {vals}",
    )
    golds = spark.createDataFrame(
        [("q", "", 2, 2, False)],
        "qid string, variant string, width int, rows bigint, ordered boolean",
    )
    run_rows = spark.createDataFrame(
        [("mixed", 1, n(1, 2)), ("mixed", 2, n(4, 3)), ("swapped", 1, n(4, 3)), ("swapped", 2, n(2, 1))],
        f"run_key string, row_no bigint, vals {vals}",
    )
    runs = spark.createDataFrame(
        [(k, "q", 1, "result", 2, 2) for k in ("mixed", "swapped")],
        "run_key string, qid string, repetition bigint, outcome string, width int, rows bigint",
    )
    done = {r["run_key"]: r["reason"] for r in grading.checks(runs, run_rows, golds, gold_rows).collect()}
    assert done == {"mixed": "value_mismatch", "swapped": None}


def test_global_row_number_is_exact(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), F.col("id").alias("b")).repartition(5)
    numbered = global_row_number(df, [("a", True), ("b", False)]).collect()
    expected = sorted(((r["a"], r["b"]) for r in numbered), key=lambda x: (-x[0], x[1]))
    assert [(r["a"], r["b"]) for r in sorted(numbered, key=lambda r: r["row_no"])] == expected
    assert sorted(r["row_no"] for r in numbered) == list(range(1, 1001))


def test_global_row_number_places_nulls(spark):
    rows = [(9,), (None,), (5,), (3,), (None,)]
    df = spark.createDataFrame(rows, "a int").withColumn("b", F.monotonically_increasing_id()).repartition(3)
    down = {r["n"]: r["a"] for r in global_row_number(df, [("a", True), ("b", False)], "n").collect()}
    up = {r["n"]: r["a"] for r in global_row_number(df, [("a", False), ("b", False)], "n").collect()}
    assert [down[i] for i in range(1, 6)] == [9, 5, 3, None, None]
    assert [up[i] for i in range(1, 6)] == [None, None, 3, 5, 9]
    assert global_row_number(df.limit(0), [("a", False)]).count() == 0


def test_split_compares_with_one_digest(spark):
    ids = spark.range(500).select(F.concat(F.lit("Q"), F.col("id").cast("string")).alias("qid"))
    parts = {r["qid"]: r["part"] for r in sampling.split(ids, "qid", 1, 25).collect()}
    order = sorted(parts, key=lambda q: (hashlib.sha256(f"1:{q}".encode()).hexdigest(), q))
    assert {q for q, p in parts.items() if p == "discovery"} == set(order[:25])
    plan = sampling.split(ids, "qid", 1, 25)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "_bounds" not in plan


def test_bootstrap_draws(spark):
    rows = [(f"q{i:02d}", float(i * i)) for i in range(7)]
    means = sampling.bootstrap_means(spark.createDataFrame(rows, "qid string, d double"), "qid", "d", 4, 50)
    got = {r["resample"]: r["mean"] for r in means.collect()}
    pick = lambda j, i: int(hashlib.sha256(f"4:{j}:{i}".encode()).hexdigest(), 16) % 7
    want = {j: sum(rows[pick(j, i)][1] for i in range(7)) / 7 for j in range(50)}
    assert got.keys() == want.keys() and all(abs(got[j] - want[j]) < 1e-9 for j in want)
    with pytest.raises(ValueError):
        digest_modulo(F.lit("00" * 32), 1 << 31)


def test_half_draw_moves_one_column_at_most(spark):
    names = [f"A.S.T.C{i}" for i in range(21)]
    draw = lambda xs: {
        r["fqn"]
        for r in sampling.half_draw(spark.createDataFrame([(x,) for x in xs], "fqn string"), "fqn", 3).collect()
    }
    before, after = draw(names), draw([*names, "A.S.T.NEW"])
    assert len(before) == 10 and len(after) == 11
    assert len(before - after) <= 1


def test_ranges_come_from_declared_numbers(spark):
    rows = [(i * 1e-9, str(i), Decimal(10**20 + i)) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "small double, text string, wide decimal(38,0)")
    ranges = {r["column_name"]: (r["min"], r["max"]) for r in profiles.clipped_range(profiles.value_counts(df, df.columns)).collect()}
    assert ranges == {"small": (11 * 1e-9, 29 * 1e-9), "text": (None, None), "wide": (1e20, 1e20)}


def test_golds_that_cannot_be_compared_are_refused(spark):
    vals = "array<struct<tag:string,val:string>>"
    gold_rows = spark.createDataFrame([("q", "", 1, [("composite", None)])], f"qid string, variant string, row_no bigint, vals {vals}")
    golds = spark.createDataFrame([("q", "", 1, 1, False)], "qid string, variant string, width int, rows bigint, ordered boolean")
    runs = spark.createDataFrame([("r", "q", 1, "result", 1, 1)], "run_key string, qid string, repetition bigint, outcome string, width int, rows bigint")
    run_rows = spark.createDataFrame([("r", 1, [("number", "1.00")])], f"run_key string, row_no bigint, vals {vals}")
    for bad in (golds, golds.withColumn("width", F.lit(grading.MAX_COLUMNS + 1))):
        with pytest.raises(ContractViolation, match="gold"):
            grading.checks(runs, run_rows, bad, gold_rows)
