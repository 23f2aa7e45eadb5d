"""Column profiles in one scan: field shapes, null rates, suppressed values, clipped ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.functions.text import PLAIN_NUMBER, sensitivity_or_default

# How many rows must carry a value before it is shown, and how many are shown.
MIN_ROWS = 11
TOP_VALUES = 10


def field_profile(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Per text field: empties, non-numbers, widest integer part and widest scale."""
    def measures(name: str) -> list[Column]:
        c = F.col(name)
        unsigned = F.ltrim(c, F.lit("-"))
        dot, own_dot = F.instr(unsigned, "."), F.instr(c, ".")
        rest = F.substr(c, own_dot + 1)
        more = F.instr(rest, ".")
        return [
            F.count_if(c.isNull()).alias(f"{name}|empty"),
            F.count_if(~c.rlike(PLAIN_NUMBER)).alias(f"{name}|non_numeric"),
            F.coalesce(F.max(F.when(dot > 0, dot - 1).otherwise(F.length(unsigned))), F.lit(0)).cast("bigint").alias(f"{name}|integer_digits"),
            # what stands between the first point and the next one, if there is one
            F.coalesce(F.max(F.when(own_dot == 0, 0).when(more > 0, more - 1).otherwise(F.length(rest))), F.lit(0))
            .cast("bigint")
            .alias(f"{name}|scale"),
        ]

    one_row = df.agg(*[m for f in fields for m in measures(f)])
    rows = F.array(
        *[
            F.struct(
                F.lit(f).alias("field"),
                *[
                    F.col(f"`{f}|{m}`").alias(m)
                    for m in ("empty", "non_numeric", "integer_digits", "scale")
                ],
            )
            for f in fields
        ]
    )
    return one_row.select(F.inline(rows))


def grain_counts(df: DataFrame, grain: Sequence[str]) -> DataFrame:
    """Rows and distinct grain keys, counted by the key columns themselves."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct(F.struct(*grain)).alias("grain_keys"),
    )


def long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value as text, number or null) for each cell, in one scan.

    Only columns declared as numbers have numbers; they are compared as doubles, as which
    a range is given.
    """
    return df.select(F.inline(_cells(df, columns)))


def _cells(df: DataFrame, columns: Sequence[str]) -> Column:
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    return F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(c).cast("string").alias("value"),
                (F.col(c) if c in numeric else F.lit(None)).cast("double").alias("number"),
            )
            for c in columns
        ]
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per (column, value). Every profile below reads this, so cells are counted once.

    Cells are pre-aggregated before the shuffle, so a value held by a third of the rows
    crosses it once per task.
    """
    return (
        long_values(df, columns)
        .groupBy("column_name", "value", "number")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def column_stats(counts: DataFrame) -> DataFrame:
    """Per column: rows, null rate and distinct values. Null cells are a value-count row."""
    is_null = F.col("value").isNull()
    return counts.groupBy("column_name").agg(
        F.sum("rows").alias("rows"),
        (F.sum(F.when(is_null, F.col("rows")).otherwise(0)) / F.sum("rows")).alias("null_rate"),
        F.count("value").alias("distinct_count"),
    )


def top_values(counts: DataFrame, k: int = MIN_ROWS, limit: int = TOP_VALUES) -> DataFrame:
    """The most carried values per column, none under ``k`` rows, by rows then value.

    Ranked in two steps: a hash of the value splits each column's values over many
    tasks, and the second step ranks the few winners of each split.
    """
    shown = counts.where(F.col("value").isNotNull() & (F.col("rows") >= k)).select(
        "column_name", "value", "rows", F.pmod(F.xxhash64("value"), F.lit(64)).alias("_part")
    )
    best_first = [F.col("rows").desc(), F.col("value").asc()]
    local = Window.partitionBy("column_name", "_part").orderBy(*best_first)
    winners = shown.withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= limit)
    overall = Window.partitionBy("column_name").orderBy(*best_first)
    return (
        winners.withColumn("position", F.row_number().over(overall))
        .where(F.col("position") <= limit)
        .select("column_name", "position", "value", "rows")
    )


def clipped_range(counts: DataFrame, k: int = MIN_ROWS) -> DataFrame:
    """The k-th smallest and k-th largest row values of each numeric column.

    Only the ``k`` lowest and highest distinct values can matter, since each is carried
    by at least one row; so two bounded top-k steps replace an order over all values. A
    column with under ``2k`` rows has no range: its k-th smallest value would pass its
    k-th largest.
    """
    numeric = counts.where(F.col("number").isNotNull()).withColumn(
        "_part", F.pmod(F.xxhash64("value"), F.lit(64))
    )
    relation_rows = counts.groupBy("column_name").agg(F.sum("rows").alias("_all"))

    def kth(descending: bool, name: str) -> DataFrame:
        order = F.col("number").desc() if descending else F.col("number").asc()
        local = Window.partitionBy("column_name", "_part").orderBy(order)
        near = numeric.withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= k)
        overall = Window.partitionBy("column_name").orderBy(order)
        nearest = (
            near.withColumn("_r2", F.row_number().over(overall))
            .where(F.col("_r2") <= k)
            .withColumn("_cum", F.sum("rows").over(overall.rowsBetween(Window.unboundedPreceding, 0)))
            .where(F.col("_cum") >= k)
        )
        pick = F.max("number") if descending else F.min("number")
        return nearest.groupBy("column_name").agg(pick.alias(name))

    ranges = (
        relation_rows.join(kth(False, "low"), "column_name", "left")
        .join(kth(True, "high"), "column_name", "left")
    )
    enough = F.col("_all") >= 2 * k
    return ranges.select(
        "column_name",
        F.when(enough, F.col("low")).cast("double").alias("min"),
        F.when(enough, F.col("high")).cast("double").alias("max"),
    )


def dimension_value_counts(
    dim: DataFrame, fact: DataFrame, dim_key: str, fact_key: str, values: Sequence[str]
) -> DataFrame:
    """Value counts of a dimension, each value weighted by the fact rows that carry it.

    The fact is counted per key before the join, so a key held by a third of the fact
    joins as one row.
    """
    weights = (
        fact.groupBy(F.col(fact_key).alias("_key")).agg(F.count(F.lit(1)).alias("_weight"))
    )
    return (
        dim.join(weights, dim[dim_key] == weights["_key"])
        .select("_weight", F.inline(_cells(dim, values)))
        .groupBy("column_name", "value", "number")
        .agg(F.sum("_weight").alias("rows"))
    )


def profiles(counts: DataFrame, k: int = MIN_ROWS) -> DataFrame:
    """One profile struct per column from its value counts."""
    tops = (
        top_values(counts, k)
        .groupBy("column_name")
        .agg(
            F.array_sort(F.collect_list(F.struct("position", "value", "rows"))).alias("_tops")
        )
    )
    joined = (
        column_stats(counts)
        .join(clipped_range(counts, k), "column_name", "left")
        .join(tops, "column_name", "left")
    )
    top_structs = F.transform(
        F.coalesce("_tops", F.array()), lambda t: F.struct(t["value"].alias("value"), t["rows"].alias("rows"))
    )
    return joined.select(
        "column_name",
        F.col("rows"),
        F.struct(
            F.lit(k).alias("k"),
            F.col("null_rate"),
            F.col("distinct_count"),
            F.col("min"),
            F.col("max"),
            top_structs.cast("array<struct<value:string,rows:bigint>>").alias("top_values"),
        ).alias("profile"),
    )


def withhold_restricted(profiled: DataFrame) -> DataFrame:
    """Blank the values of restricted columns; a missing tag counts as restricted."""
    restricted = sensitivity_or_default(F.col("sensitivity")) == "restricted"
    p = F.col("profile")
    hidden = F.struct(
        p["k"].alias("k"),
        p["null_rate"].alias("null_rate"),
        p["distinct_count"].alias("distinct_count"),
        F.when(~restricted, p["min"]).alias("min"),
        F.when(~restricted, p["max"]).alias("max"),
        F.when(restricted, F.array().cast("array<struct<value:string,rows:bigint>>"))
        .otherwise(p["top_values"])
        .alias("top_values"),
    )
    return profiled.withColumn("sensitivity", sensitivity_or_default(F.col("sensitivity"))).withColumn(
        "profile", hidden
    )


def evidence_packets(
    catalog: DataFrame, table_texts: DataFrame, lineage: DataFrame, profiled: DataFrame
) -> DataFrame:
    """One packet per column: catalog, table text, lineage text and its profile."""
    joined = (
        catalog.select("fqn", "table_name", "column_name", "data_type", "sensitivity")
        .join(table_texts.select("table_name", "table_description"), "table_name", "left")
        .join(
            lineage.select("fqn", "lineage_sql", "upstream_expression"), "fqn", "left"
        )
        .join(profiled.select("fqn", "profile"), "fqn")
    )
    return withhold_restricted(joined).select(
        "fqn",
        "data_type",
        "sensitivity",
        "table_description",
        "lineage_sql",
        "upstream_expression",
        "profile",
    )


def wrong_k(packets: DataFrame, k: int) -> DataFrame:
    """Packets whose profile was cut at another k than the configured one."""
    return packets.where(F.col("profile.k") != k).select("fqn", F.col("profile.k").alias("k"))
