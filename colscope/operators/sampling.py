"""Deterministic hash samples, splits, draws and the paired bootstrap."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colscope.functions.hashing import digest_remainders, in_sample, joined_text, seeded_digest
from colscope.functions.ordering import global_row_number

#: Up to so many questions, 24 MB, a bootstrap broadcasts.
BROADCAST_QUESTIONS = 1_000_000
#: Draws of one resample that a task makes at a time.
DRAWS_AT_ONCE = 1 << 14


def hash_sample(df: DataFrame, grain: Sequence[str], one_in: int, separator: str = ";") -> DataFrame:
    """A 1-in-n sample on the grain key: a filter, so it needs no shuffle.

    Rows that share a grain key stay or go together, and a smaller rate keeps a subset
    of a larger one.
    """
    return df.where(in_sample(joined_text(grain, separator), one_in))


def outside_sample(small: DataFrame, large: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of the smaller sample the larger one lacks; must be none."""
    return small.select(*keys).distinct().join(large.select(*keys), list(keys), "left_anti")


def _digests(ids: DataFrame, key: str, seed: int) -> DataFrame:
    return ids.select(key).withColumn("_digest", seeded_digest(seed, F.col(key)))


def split(ids: DataFrame, key: str, seed: int, first: int) -> DataFrame:
    """The ``first`` ids by digest are discovery, the rest holdout.

    Only the last discovery id must be known: a bounded top-k, then a comparison.
    """
    digests = _digests(ids, key, seed)
    place = F.struct("_digest", key)
    last = digests.orderBy("_digest", key).limit(first).agg(F.max(place)).scalar()
    return digests.select(
        key, F.when(place <= last, "discovery").otherwise("holdout").alias("part")
    )


def half_draw(ids: DataFrame, key: str, seed: int) -> DataFrame:
    """The first half by digest, ``floor(n / 2)`` of n.

    Ids are counted by the first three digits of their digest, at most 4,096 counts. Whole
    digits below the half go in; only the ids of the digits that hold the middle, one in
    4,096, are put in order.
    """
    digests = _digests(ids, key, seed).withColumn("_digits", F.substring("_digest", 1, 3))
    counts = digests.groupBy("_digits").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_digits").rowsBetween(Window.unboundedPreceding, 0)
    half = F.floor(F.sum("_n").over(Window.partitionBy()) / 2)
    cuts = counts.select(
        F.col("_digits").alias("_of"),
        (half - (F.sum("_n").over(upto) - F.col("_n"))).alias("_room"),
        "_n",
    )
    marked = digests.join(F.broadcast(cuts), F.col("_digits") == F.col("_of"), "left")
    whole = marked.where("_room >= _n").select(key)
    middle = marked.where("_room > 0 AND _room < _n")
    order = Window.partitionBy("_digits").orderBy("_digest", key)
    part = middle.withColumn("_place", F.row_number().over(order)).where("_place <= _room").select(key)
    return whole.unionAll(part)


def lowest_digests(pool: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """The ``n`` ids with the lowest digests, a bounded top-k."""
    digests = pool.select(key).withColumn("digest", seeded_digest(seed, F.col(key)))
    return digests.orderBy("digest", key).limit(n)


def draw_size(undocumented_needed: DataFrame, key: str, cap: int = 10) -> DataFrame:
    """``min(cap, floor(u / 2))`` over the distinct undocumented columns questions need."""
    return undocumented_needed.agg(F.count_distinct(key).alias("u")).select(
        "u", F.least(F.lit(cap), F.floor(F.col("u") / 2)).cast("bigint").alias("n")
    )


def _draws(seed: int, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (resample, block) to the block's draws (resample, index), a batch each."""
    remainders, at_once = digest_remainders(n), DRAWS_AT_ONCE

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, positions = -1, []
        for batch in batches:
            for resample, block in zip(*(batch.column(i).to_pylist() for i in range(2))):
                if block != held:
                    first = block * at_once
                    held, positions = block, [b"%d" % i for i in range(first, min(n, first + at_once))]
                index = remainders(b"%d:%d:" % (seed, resample), positions)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(index), resample)), pa.array(index)], ["resample", "index"])

    return drawn


def bootstrap_means(
    differences: DataFrame, key: str, value: str, seed: int, resamples: int
) -> DataFrame:
    """The mean of each resample of the questions, drawn by hash with replacement.

    Resample j takes at position i the question at ``sha256("seed:j:i") mod n``, the
    questions being sorted by id. The draws are one long range of blocks of positions cut
    into even parts; a block is drawn in one go over arrays, and each draw looks its
    question up and is folded into its resample's sum where it is made, so only sums are
    shuffled. The questions are broadcast up to BROADCAST_QUESTIONS of them.
    """
    spark = differences.sparkSession
    indexed = global_row_number(differences.select(key, value), [(key, False)], "_no").select(
        (F.col("_no") - 1).alias("index"), F.col(value).cast("double").alias("d")
    )
    n = indexed.count()
    looked_up = F.broadcast(indexed) if n <= BROADCAST_QUESTIONS else indexed.hint("shuffle_hash")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Block by block, so that a task mostly keeps the positions of one.
    blocks = spark.range(0, resamples * -(-n // DRAWS_AT_ONCE), 1, width).select(
        F.expr(f"id % {resamples}").alias("resample"), F.expr(f"id div {resamples}").alias("block")
    )
    return (
        blocks.mapInArrow(_draws(seed, max(1, n)), "resample bigint, index bigint")
        .join(looked_up, "index")
        .groupBy("resample")
        .agg(F.avg("d").alias("mean"))
    )


def percentile_interval(means: DataFrame, low: int, high: int) -> DataFrame:
    """The ``low``-th and ``high``-th smallest means and the verdict they give."""
    ordered = global_row_number(means, [("mean", False), ("resample", False)], "position")
    bounds = ordered.where(F.col("position").isin(low, high)).agg(
        F.max(F.when(F.col("position") == low, F.col("mean"))).alias("lower"),
        F.max(F.when(F.col("position") == high, F.col("mean"))).alias("upper"),
    )
    return bounds.withColumn(
        "verdict",
        F.when(F.col("lower") > 0, "improves")
        .when(F.col("upper") < 0, "worse")
        .otherwise("no difference"),
    )
