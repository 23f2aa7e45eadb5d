"""Typed result comparison: every run graded against its gold in one job.

Results come in long form: run_key, row_no, width, vals (array of (tag, val)). A result
with no rows is known by its run row alone, so runs and golds have header tables:
runs (run_key, qid, repetition, outcome, width, rows, harness_error) and golds (qid,
variant, width, rows, ordered), variant '' being the gold and others accepted readings.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colscope.functions.guards import require_empty
from colscope.functions.values import normalized_value

# The widest result, and the longest, a gold may have.
MAX_COLUMNS = 5
MAX_ROWS = 200


def long_form(df: DataFrame, run_key: Column, row_no: Column) -> DataFrame:
    """A result as normalized value arrays. Columns go by position, names are ignored."""
    return df.select(
        run_key.alias("run_key"),
        row_no.alias("row_no"),
        F.array(*[normalized_value(F.col(f"`{f.name}`"), f.dataType) for f in df.schema]).alias(
            "vals"
        ),
    )


def column_orders(width: Column) -> Column:
    """Every order of ``width`` columns as an array of index arrays; none past the bound."""
    by_width = F.lit(None)
    for n in range(MAX_COLUMNS, 0, -1):
        orders = F.array(*[F.array(*[F.lit(i) for i in p]) for p in permutations(range(n))])
        by_width = F.when(width == n, orders).otherwise(by_width)
    return by_width


def row_hash(vals: Column) -> Column:
    """A hash of one row's values in their order."""
    return F.sha2(F.to_json(vals, {"ignoreNullFields": "false"}), 256)


def unsupported(runs_rows: DataFrame) -> DataFrame:
    """Runs holding a value of a type the comparison doesn't name: recorded, not graded."""
    return (
        runs_rows.where(F.exists("vals", lambda v: v["tag"] == "unsupported"))
        .select("run_key")
        .distinct()
    )


def order_problems(golds: DataFrame, ordered_rows: DataFrame) -> DataFrame:
    """Golds whose order is left to chance: (qid, variant, tied, cut).

    ``golds``: qid, variant, ordered, limit_n (null: no limit). ``ordered_rows``: qid, variant and ``keys``, one
    orderable column that sorts a gold's rows ascending, of all rows, those past the limit too. An ordered result
    is ``tied`` where two of its rows share their keys, and a limit is ``cut`` where the last row in and the
    first row out do. All golds are seen to in one grouped aggregate over their first rows: a window bounded
    by the longest result a gold may have plus the witness past it, which Spark takes on the map side too, so no gold's
    rows meet whole.
    """
    place = Window.partitionBy("qid", "variant").orderBy("keys")
    first = ordered_rows.select("qid", "variant", "keys", F.row_number().over(place).alias("_place")).where(
        F.col("_place") <= MAX_ROWS + 1
    )
    runs = first.groupBy("qid", "variant", "keys").agg(F.min("_place").alias("_from"), F.max("_place").alias("_to"))
    size = F.coalesce(F.col("limit_n"), F.lit(MAX_ROWS))
    asked = golds.where(F.col("ordered") | F.col("limit_n").isNotNull()).select("qid", "variant", "ordered", "limit_n")
    return runs.join(asked, ["qid", "variant"]).groupBy("qid", "variant").agg(
        F.bool_or(F.col("ordered") & (F.col("_from") < F.col("_to")) & (F.col("_from") < size)).alias("tied"),
        F.bool_or(F.col("limit_n").isNotNull() & (F.col("_from") <= size) & (F.col("_to") > size)).alias("cut"),
    )


def gold_problems(golds: DataFrame, gold_rows: DataFrame, ordered_rows: DataFrame | None = None) -> DataFrame:
    """Golds a comparison must refuse, with the first rule broken: (qid, variant, problem).

    Too wide, too long, holding a list or struct, or, where their rows' keys are given (``order_problems``),
    ordered or limited without an order, tied in their order, or cut through a tie by their limit.
    """
    composite = (
        gold_rows.where(F.exists("vals", lambda v: v["tag"] == "composite"))
        .select("qid", "variant")
        .distinct()
        .withColumn("_composite", F.lit(True))
    )
    problem = (
        F.when(F.col("width") > MAX_COLUMNS, "too many columns")
        .when(F.col("rows") > MAX_ROWS, "too many rows")
        .when(F.col("_composite"), "holds a list or a struct")
    )
    checked = golds.join(composite, ["qid", "variant"], "left")
    if ordered_rows is not None:
        checked = checked.join(order_problems(golds, ordered_rows), ["qid", "variant"], "left")
        bound = F.col("ordered") | F.col("limit_n").isNotNull()
        problem = (
            problem.when(bound & F.col("tied").isNull() & (F.col("rows") > 0), "no order for an ordered or limited result")
            .when(F.col("tied"), "two rows tie on the order keys")
            .when(F.col("cut"), "the limit cuts through a tie")
        )
    return checked.select("qid", "variant", problem.alias("problem")).where(F.col("problem").isNotNull())


def column_signatures(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Of each result one number per column, an order-free sum of its values' hashes: equal columns have equal ones."""
    value = lambda i: F.get("vals", F.lit(i))
    sums = [F.sum(F.xxhash64(value(i)["tag"], value(i)["val"]).cast("decimal(20,0)")) for i in range(MAX_COLUMNS)]
    return rows.groupBy(*keys).agg(F.array(*sums).alias(name))


def _signatures(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A result as row-hash counts: one row per (keys, row hash), for multisets."""
    return rows.groupBy(*keys, "h").agg(F.count(F.lit(1)).alias("n"))


def checks(
    runs: DataFrame, run_rows: DataFrame, golds: DataFrame, gold_rows: DataFrame
) -> DataFrame:
    """(run_key, qid, repetition, variant, reason) for each run against each of its golds.

    The reason is the first failed check: outcome, shape, row count, values. Only pairs
    that pass the first three are compared, under the column orders that their columns' signatures
    allow: mostly one, where all values of two columns are alike some more. Those orders' rows become order-free
    row hashes, so rows meet by hash in a shuffle, never as pairs. A sequence
    comparison puts the row number into the hash. A gold that can't be compared is an error,
    not a mismatch.
    """
    require_empty(gold_problems(golds, gold_rows), "a gold can't be compared")
    pairs = runs.join(
        golds.select(
            "qid",
            "variant",
            "ordered",
            F.col("width").alias("gold_width"),
            F.col("rows").alias("gold_rows"),
        ),
        "qid",
    ).withColumn(
        "early",
        F.when(F.col("outcome") != "result", F.col("outcome"))
        .when(F.col("width") != F.col("gold_width"), "shape_mismatch")
        .when(F.col("rows") != F.col("gold_rows"), "row_count_mismatch"),
    )
    fits = lambda order: F.forall(
        F.sequence(F.lit(0), F.col("width") - 1), lambda j: F.get("_own", F.get(order, j)) == F.get("_wanted", j)
    )
    left = (
        pairs.where(F.col("early").isNull())
        .select("run_key", "qid", "variant", "ordered", "width", "rows")
        .join(column_signatures(run_rows, ["run_key"], "_own"), "run_key")
        .join(column_signatures(gold_rows, ["qid", "variant"], "_wanted"), ["qid", "variant"])
        .withColumn("_orders", F.filter(column_orders(F.col("width")), fits))
        .where(F.size("_orders") > 0)
        .drop("_own", "_wanted")
    )
    position = lambda: F.when(F.col("ordered"), F.col("row_no"))
    permuted = (
        left.join(run_rows.select("run_key", "row_no", "vals"), "run_key")
        .select("run_key", "qid", "variant", "rows", "ordered", "row_no", "vals", F.posexplode("_orders").alias("order_no", "_order"))
        .withColumn("h", row_hash(F.transform("_order", lambda i: F.get(F.col("vals"), i))))
        .withColumn("h", F.concat_ws("#", position().cast("string"), "h"))
    )
    actual = _signatures(permuted, ["run_key", "qid", "variant", "rows", "order_no"])
    expected = _signatures(
        gold_rows.join(golds.select("qid", "variant", "ordered"), ["qid", "variant"])
        .withColumn("h", F.concat_ws("#", position().cast("string"), row_hash(F.col("vals")))),
        ["qid", "variant"],
    )
    # Equal totals were checked, so matching every row of one side matches both.
    matched = (
        actual.join(expected.withColumnRenamed("n", "expected_n"), ["qid", "variant", "h"])
        .groupBy("run_key", "qid", "variant", "order_no")
        .agg(F.sum(F.least("n", "expected_n")).alias("hits"), F.first("rows").alias("rows"))
        .where(F.col("hits") == F.col("rows"))
        .select("run_key", "variant")
        .distinct()
        .withColumn("_same", F.lit(True))
    )
    same = (F.col("rows") == 0) | F.coalesce("_same", F.lit(False))
    return pairs.join(matched, ["run_key", "variant"], "left").select(
        "run_key",
        "qid",
        "repetition",
        "variant",
        F.coalesce("early", F.when(~same, "value_mismatch")).alias("reason"),
    )


def grades(checked: DataFrame) -> DataFrame:
    """One grade per run: it passes on any accepted variant, else keeps the gold's reason."""
    return checked.groupBy("run_key", "qid", "repetition").agg(
        F.bool_or(F.col("reason").isNull()).alias("passed"),
        F.max(F.when(F.col("variant") == "", F.col("reason"))).alias("_gold"),
    ).select(
        "run_key",
        "qid",
        "repetition",
        "passed",
        F.when(~F.col("passed"), F.col("_gold")).alias("reason"),
    )


def graded_runs(
    runs: DataFrame, run_rows: DataFrame, golds: DataFrame, gold_rows: DataFrame
) -> DataFrame:
    """Every run with its grade or its harness error: a run holding an unsupported value is
    recorded and not graded."""
    broken = unsupported(run_rows).withColumn("harness_error", F.lit("unsupported value type"))
    flagged = runs.join(broken, "run_key", "left")
    gradable = flagged.where(F.col("harness_error").isNull()).drop("harness_error")
    graded = grades(checks(gradable, run_rows, golds, gold_rows))
    return flagged.select("run_key", "qid", "repetition", "harness_error").join(
        graded.select("run_key", "passed", "reason"), "run_key", "left"
    )


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose counts differ between two results, duplicates counting."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        vals = F.array(
            *[normalized_value(F.col(f"`{f.name}`"), f.dataType) for f in df.schema]
        )
        return df.select(row_hash(vals).alias("h")).groupBy("h").agg(
            F.count(F.lit(1)).alias(name)
        )

    return (
        counted(a, "left_rows")
        .join(counted(b, "right_rows"), "h", "full_outer")
        .fillna(0, ["left_rows", "right_rows"])
        .where(F.col("left_rows") != F.col("right_rows"))
    )


def sequence_difference(a: DataFrame, b: DataFrame, row_no: str) -> DataFrame:
    """Row numbers whose rows differ between two ordered results."""
    def keyed(df: DataFrame, name: str) -> DataFrame:
        vals = F.array(
            *[
                normalized_value(F.col(f"`{f.name}`"), f.dataType)
                for f in df.schema
                if f.name != row_no
            ]
        )
        return df.select(row_no, row_hash(vals).alias(name))

    return (
        keyed(a, "left_row")
        .join(keyed(b, "right_row"), row_no, "full_outer")
        .where(~F.col("left_row").eqNullSafe(F.col("right_row")))
        .select(row_no)
    )


def tied_keys(result: DataFrame, group: list[str], keys: list[str]) -> DataFrame:
    """Order keys two rows of one result share. Adjacent equal keys are equal keys, so a
    grouping tells them and no order is needed."""
    return (
        result.groupBy(*group, *keys)
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > 1)
    )


def limit_cuts_tie(result: DataFrame, keys: list[tuple[str, bool]], n: int) -> DataFrame:
    """One row: whether row n and row n + 1 of the order share their keys.

    A bounded top-k of n + 1 rows: the n-th row's keys are the last of the first n, and
    the two share them when the key of the last row covers rows on both sides.
    """
    order = [F.col(c).desc() if d else F.col(c).asc() for c, d in keys]
    names = [c for c, _ in keys]
    ahead = result.orderBy(*order).limit(n + 1).select(*names)
    inside = result.orderBy(*order).limit(n).select(*names)
    past = (
        ahead.groupBy(*names)
        .agg(F.count(F.lit(1)).alias("ahead"))
        .join(inside.groupBy(*names).agg(F.count(F.lit(1)).alias("inside")), names, "left")
    )
    return past.agg(
        F.coalesce(
            F.bool_or((F.col("ahead") > F.col("inside")) & (F.col("inside") > 0)), F.lit(False)
        ).alias("cuts_tie")
    )
