"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b; two nodes, orderable) as stars: every linked node but the smallest of its
    component (``node``), with that smallest one (``root``).

    A round points each node's larger neighbours at its smallest neighbour, then its smaller ones;
    paths halve, so rounds grow with the logarithm of the longest path. Links stay distributed and
    are checkpointed each round; the driver sees a count and a checksum. Nulls and self-links link nothing.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    edges = cut(
        links.where("a is not null and b is not null and a <> b")
        .select(high.alias("a"), low.alias("b"))
        .distinct()
    )
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    before = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), mark).head())
        if now == before or not now[0]:
            break
        before = now
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "n")
        large = (
            both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = (
            large.join(smallest, F.col("a") == F.col("n"))
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
        )
        edges = cut(small.distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
