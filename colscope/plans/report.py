"""A run's report as tables: counts, gates, coverage and the ranked gaps in long form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.functions.text import share_percent


def long_counts(stage: str, one_row: DataFrame) -> DataFrame:
    """A stage's counters as (stage, name, value)."""
    names = one_row.columns
    counts = one_row.select(*[F.col(c).cast("bigint").alias(c) for c in names])
    return counts.unpivot([], names, "name", "value").select(F.lit(stage).alias("stage"), "name", "value")


def all_counts(stages: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [long_counts(s, df) for s, df in stages.items()])


def coverage_shares(coverage: DataFrame) -> DataFrame:
    """(unit, documented, total, share): shares exact to one decimal, n/a on a zero total."""
    rows = F.array(
        *[
            F.struct(
                F.lit(unit).alias("unit"),
                F.col(f"{unit}_documented").cast("bigint").alias("documented"),
                F.col(f"{unit}_total").cast("bigint").alias("total"),
            )
            for unit in ("columns", "executions")
        ]
    )
    return coverage.select(F.inline(rows)).withColumn(
        "share", share_percent(F.col("documented"), F.col("total"))
    )


def gap_lines(ranked: DataFrame) -> DataFrame:
    """The ranked gaps as they are shown: score to four places, failure rate to two."""
    return ranked.select(
        "rank",
        "fqn",
        F.format_string("%.4f", "score").alias("score"),
        "executions",
        F.format_string("%.2f", "failure_rate").alias("failure_rate"),
    )


def lines(counts: DataFrame, gates: DataFrame, coverage: DataFrame, ranked: DataFrame) -> DataFrame:
    """The whole report: (section, item, line), a line's cells parted by bars.

    ``counts`` (stage, name, value) of all stages, ``gates`` (stage, gate, value, threshold, passed), the coverage row and
    the ranked gaps, each shown as recorded, so nothing a stage counted is left out.
    """
    shown = lambda section, item, *cells: [F.lit(section).alias("section"), item.alias("item"), F.concat_ws(" | ", *cells).alias("line")]
    text = lambda c: F.col(c).cast("string")
    shares, gaps = coverage_shares(coverage), gap_lines(ranked)
    return reduce(
        DataFrame.unionByName,
        [
            shares.select(*shown("coverage", F.col("unit"), text("documented"), text("total"), F.col("share"))),
            gates.select(*shown("gates", F.concat_ws(".", "stage", "gate"), F.round("value", 6).cast("string"), text("threshold"), text("passed"))),
            counts.select(*shown("counts", F.concat_ws(".", "stage", "name"), text("value"))),
            gaps.select(*shown("gaps", text("rank"), F.col("fqn"), F.col("score"), text("executions"), F.col("failure_rate"))),
        ],
    )
