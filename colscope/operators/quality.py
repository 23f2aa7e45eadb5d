"""Data-quality checks. Each returns the violating rows; no row means it holds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.contracts import SENSITIVITIES


def not_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count. Nulls are not compared."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return (
        df.where(present)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("occurrences"))
        .where(F.col("occurrences") > 1)
    )


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns that must hold a value and don't, with the null count. One scan for all."""
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot([], list(columns), "column_name", "nulls").where(F.col("nulls") > 0)


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child keys with no parent, with the rows that carry them.

    Grouping first leaves one row per key for the anti-join, so a hot key costs one row.
    """
    keys = (
        child.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("orphan_key"))
        .agg(F.count(F.lit(1)).alias("child_rows"))
    )
    return keys.join(
        parent.select(F.col(parent_key).alias("orphan_key")), "orphan_key", "left_anti"
    )


def aggregate_mismatches(
    fact: DataFrame, aggregate: DataFrame, keys: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """Keys an aggregate drops, repeats or sums differently from its fact."""
    again = fact.groupBy(*keys).agg(*[F.sum(m).alias(f"fact_{m}") for m in measures])
    stored = aggregate.groupBy(*[F.col(k).alias(f"agg_{k}") for k in keys]).agg(
        *[F.sum(m).alias(f"agg_{m}") for m in measures], F.count(F.lit(1)).alias("agg_rows")
    )
    on = [F.col(k).eqNullSafe(F.col(f"agg_{k}")) for k in keys]
    joined = again.withColumn("_in_fact", F.lit(True)).join(
        stored.withColumn("_in_agg", F.lit(True)), on, "full_outer"
    )
    unequal = reduce(
        lambda a, b: a | b,
        [~F.col(f"fact_{m}").eqNullSafe(F.col(f"agg_{m}")) for m in measures],
    )
    problem = (
        F.when(F.col("_in_agg").isNull(), "missing")
        .when(F.col("_in_fact").isNull(), "extra")
        .when(F.col("agg_rows") > 1, "repeated")
        .when(unequal, "unequal")
    )
    return joined.select(
        *[F.coalesce(k, f"agg_{k}").alias(k) for k in keys], problem.alias("problem")
    ).where(F.col("problem").isNotNull())


def unlabeled_share(
    fact: DataFrame, dim: DataFrame, key: str, label: str, alarm_above: float
) -> DataFrame:
    """The share of fact rows whose code has no label, when it passes the alarm.

    The fact is counted per code first, so the join handles codes instead of rows.
    """
    per_code = fact.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    joined = per_code.join(dim.select(key, label), key)
    return (
        joined.agg(
            (F.sum(F.when(F.col(label).isNull(), F.col("_n")).otherwise(0)) / F.sum("_n")).alias(
                "unlabeled_share"
            )
        )
        .where(F.col("unlabeled_share") > alarm_above)
    )


def filled_fillers(df: DataFrame, filler: str, key: str) -> DataFrame:
    """Rows whose filler field holds a value: the file has an undeclared field."""
    return df.where(F.col(filler).isNotNull()).select(key, filler)


def metadata_gaps(columns: DataFrame) -> DataFrame:
    """One line per model without an owner and per mart column with a bad sensitivity tag.

    Reads the catalog source's flat rows: model_id, owner, in_marts, column_name, sensitivity.
    """
    owners = (
        columns.select("model_id", "owner")
        .distinct()
        .where(F.trim(F.coalesce("owner", F.lit(""))) == "")
        .select(F.concat("model_id", F.lit(": no owner")).alias("gap"))
    )
    tags = (
        columns.where("in_marts")
        .where(~F.coalesce(F.col("sensitivity").isin(*SENSITIVITIES), F.lit(False)))
        .select(
            F.concat("model_id", F.lit("."), "column_name", F.lit(": no known sensitivity")).alias(
                "gap"
            )
        )
    )
    return owners.unionByName(tags)


def type_misfits(profile: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared types the data doesn't fit: see the field profile for the inputs.

    ``profile``: field, empty, non_numeric, integer_digits, scale.
    ``declared``: field, kind (int | decimal | text), precision, type_scale, nullable.
    """
    problem = (
        F.when(~F.col("nullable") & (F.col("empty") > 0), "empty where NOT NULL")
        .when((F.col("kind") != "text") & (F.col("non_numeric") > 0), "not a number")
        .when((F.col("kind") == "int") & (F.col("scale") > 0), "integer with decimals")
        .when(
            (F.col("kind") == "decimal") & (F.col("scale") > F.col("type_scale")),
            "more decimals than declared",
        )
        .when(
            (F.col("kind") == "decimal")
            & (F.col("integer_digits") > F.col("precision") - F.col("type_scale")),
            "more digits than declared",
        )
    )
    return (
        profile.join(declared, "field")
        .select("field", problem.alias("problem"))
        .where(F.col("problem").isNotNull())
    )


def set_difference(found: DataFrame, agreed: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, each with the side that lacks it."""
    missing = agreed.select(key).distinct().join(found.select(key), key, "left_anti")
    extra = found.select(key).distinct().join(agreed.select(key), key, "left_anti")
    return missing.withColumn("problem", F.lit("missing")).unionByName(
        extra.withColumn("problem", F.lit("extra"))
    )


def changed_inputs(recorded: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose recorded and current hash differ, either side missing counting as a change."""
    a = recorded.select(key, F.col(value).alias("recorded"))
    b = current.select(key, F.col(value).alias("current"))
    return a.join(b, key, "full_outer").where(~F.col("recorded").eqNullSafe(F.col("current")))


def flag_rows(df: DataFrame, problems: dict[str, Column], key: str) -> DataFrame:
    """One row per (row, problem) for a set of named row predicates. One scan."""
    named = F.array_compact(F.array(*[F.when(c, n) for n, c in problems.items()]))
    return df.select(key, F.explode(named).alias("problem"))
