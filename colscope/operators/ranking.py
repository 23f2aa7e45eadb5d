"""Gap scores, the ranking of undocumented columns, and what the ranking's edge looks like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.functions.ordering import global_row_number


def gap_score(executions: Column, failure_rate: Column, weight: float) -> Column:
    """``ln(1 + u) * (1 + w * r)``, not rounded, so no new ties appear."""
    return F.log1p(executions.cast("double")) * (
        F.lit(1.0) + F.lit(float(weight)) * F.coalesce(failure_rate, F.lit(0.0))
    )


def ranked_gaps(executions: DataFrame, weight: float) -> DataFrame:
    """The undocumented columns by score descending, then name; untouched ones end the list."""
    rate = (
        F.col("failure_rate") if "failure_rate" in executions.columns else F.lit(0.0)
    )
    scored = executions.where(~F.col("documented")).select(
        "fqn",
        gap_score(F.col("executions"), rate, weight).alias("score"),
        "executions",
        F.coalesce(rate, F.lit(0.0)).alias("failure_rate"),
    )
    return global_row_number(scored, [("score", True), ("fqn", False)], "rank").select(
        "rank", "fqn", "score", "executions", "failure_rate"
    )


def soft_failure_rate(attributions: DataFrame, usage: DataFrame) -> DataFrame:
    """Per column: expected misreadings over the distinct runs that touched it.

    Each failed run adds P(cause = meaning) * P(column = c).
    """
    soft = (
        attributions.where(F.col("cause").isNotNull())
        .select(
            F.try_element_at("cause", F.lit("column_meaning")).alias("p_meaning"),
            F.explode("column").alias("fqn", "p_column"),
        )
        .groupBy("fqn")
        .agg(F.sum(F.col("p_meaning") * F.col("p_column")).alias("soft_failures"))
    )
    return (
        usage.select("fqn", "runs")
        .where(F.col("runs") > 0)
        .join(soft, "fqn", "left")
        .select(
            "fqn",
            "runs",
            F.coalesce("soft_failures", F.lit(0.0)).alias("soft_failures"),
            (F.coalesce("soft_failures", F.lit(0.0)) / F.col("runs")).alias("failure_rate"),
        )
    )


def ties_at(ranked: DataFrame, n: int) -> DataFrame:
    """One row: columns sharing the n-th score, those of them in the first n, and how many
    of the first n were never touched."""
    score_n = ranked.where(F.col("rank") == n).agg(F.max("score")).scalar()
    tied = F.col("score") == score_n
    return ranked.agg(
        F.count_if(tied).alias("tied_at_n"),
        F.count_if(tied & (F.col("rank") <= n)).alias("tied_inside"),
        F.count_if((F.col("rank") <= n) & (F.col("executions") == 0)).alias("untouched_in_top"),
    )


def documented_elsewhere(catalog: DataFrame) -> DataFrame:
    """Undocumented columns whose name a documented column of another table shares.

    The documented side is folded to one row per name: the tables holding it, at most
    two of them, which is enough to tell "another table" from the column's own.
    """
    names = (
        catalog.where("documented")
        .groupBy("column_name")
        .agg(F.min("table_name").alias("_first"), F.max("table_name").alias("_last"))
    )
    return (
        catalog.where(~F.col("documented"))
        .join(names, "column_name")
        .where((F.col("_first") != F.col("table_name")) | (F.col("_last") != F.col("table_name")))
        .select("fqn", "column_name")
    )
