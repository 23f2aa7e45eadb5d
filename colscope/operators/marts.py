"""Staging, fact, dimension and aggregate building blocks of a star schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.functions.hashing import surrogate_key

MONEY = "decimal(18,2)"


def contract_projection(df: DataFrame, contract: Mapping[str, str]) -> DataFrame:
    """Every contract column cast to its type, in contract order; other columns drop out."""
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in contract.items()])


def staged(df: DataFrame, text_codes: Sequence[str], grain: Sequence[str], key: str) -> DataFrame:
    """Text codes trimmed and the grain's surrogate key added."""
    trimmed = df.withColumns({c: F.trim(c) for c in text_codes})
    return trimmed.withColumn(key, surrogate_key(grain))


def completed_dimension(
    listed: DataFrame, fact: DataFrame, code: str, label: str
) -> DataFrame:
    """The listed codes plus each code the fact holds and the list lacks, unlabeled.

    The distinct runs first, so the anti-join compares codes, not fact rows.
    """
    unlisted = (
        fact.select(code)
        .where(F.col(code).isNotNull())
        .distinct()
        .join(listed.select(code), code, "left_anti")
        .select(code, F.lit(None).cast("string").alias(label))
    )
    return listed.select(code, label).unionByName(unlisted)


def labeled(
    fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, label: str, as_name: str
) -> DataFrame:
    """The fact with one actor's label: the same dimension joins under different keys.

    No broadcast hint: Spark broadcasts the dimension while its size allows it, and a
    completed dimension may grow past that.
    """
    side = dim.select(F.col(dim_key).alias("_dim_key"), F.col(label).alias(as_name))
    return fact.join(side, fact[fact_key] == side["_dim_key"], "inner").drop("_dim_key")


def money_sum(measure: str | Column) -> Column:
    """A decimal sum cast back to the money type; null when no row is summed."""
    return F.sum(measure).cast(MONEY)


def monthly_aggregate(
    fact: DataFrame, keys: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """Decimal sums per key."""
    return fact.groupBy(*keys).agg(*[money_sum(m).alias(m) for m in measures])


def sum_if(condition: Column, measure: str | Column) -> Column:
    """``SUM(IFF(condition, measure, 0))``: zero, not null, when no row matches."""
    value = F.col(measure) if isinstance(measure, str) else measure
    return F.sum(F.when(condition, value).otherwise(F.lit(0).cast(MONEY))).cast(MONEY)


def period_difference(df: DataFrame, month: str, later: int, earlier: int, measure: str) -> DataFrame:
    """One row: the later month's sum minus the earlier's, in one scan."""
    in_months = df.where(F.col(month).isin(later, earlier))
    return in_months.agg(
        (
            sum_if(F.col(month) == later, measure) - sum_if(F.col(month) == earlier, measure)
        ).cast(MONEY).alias("difference")
    )


def month_from_codes(year: str | Column, month: str | Column) -> Column:
    """A ``YYYYMM`` integer from two zero-padded text codes."""
    return F.concat(year, month).cast("int")


def year_code(month: str | Column) -> Column:
    """The year text of a ``YYYYMM`` integer."""
    c = F.col(month) if isinstance(month, str) else month
    return F.substring(c.cast("string"), 1, 4)


def month_code(month: str | Column) -> Column:
    """The month text of a ``YYYYMM`` integer."""
    c = F.col(month) if isinstance(month, str) else month
    return F.substring(c.cast("string"), 5, 2)
