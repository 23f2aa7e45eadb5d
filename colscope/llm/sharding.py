"""Sharding: a uniform shuffle into shards of exact size, by a hypergeometric communication matrix."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colscope.llm.common import carried, cut, documents

#: Rows that one second-permutation group holds, about.
GROUP_ROWS = 16_384
#: Matrix rows are broadcast while their cells are this many at most (32 MB); else joined by shuffle.
MAX_BROADCAST_CELLS = 4_000_000


def hypergeometric(good: int, bad: int, draws: int, rng: random.Random) -> int:
    """Of ``draws`` from an urn without return, how many are good: inversion outwards from the mode.

    Takes about as many steps as the standard deviation, whatever the urn's size.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    k = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    lf = math.lgamma

    def log_p(x: int) -> float:
        return (
            lf(good + 1) - lf(x + 1) - lf(good - x + 1) + lf(bad + 1) - lf(draws - x + 1) - lf(bad - draws + x + 1)
            - lf(good + bad + 1) + lf(draws + 1) + lf(good + bad - draws + 1)
        )

    up = down = k
    p_up = p_down = math.exp(log_p(k))
    left = rng.random() - p_up
    while left > 0 and (down > low or up < high):
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
    return k


def matrix(rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """For each partition, how many of its rows each shard gets: row sums are the partitions' rows,
    column sums are the shards' sizes, at most one apart. Drawn as a uniform shuffle would deal them."""
    rng = random.Random(seed)
    n = sum(rows)
    room = [n // shards + (s < n % shards) for s in range(shards)]
    out = []
    for size in rows:
        cells, left, rest = [], size, sum(room)
        for s in range(shards):
            rest -= room[s]
            got = hypergeometric(room[s], rest, left, rng)
            cells.append(got)
            left -= got
        room = [r - c for r, c in zip(room, cells, strict=True)]
        out.append(cells)
    return out


def uniform_shards(rows: DataFrame, shards: int, seed: int = 17) -> DataFrame:
    """``rows`` with shard (0 to shards - 1) and slot (gapless from 0 in each shard), uniformly shuffled.

    Each input partition is permuted where it lies, by a seeded hash, and numbered; the frame is cut
    there, so give it the columns that must travel. The matrix tells which numbers go to which shard;
    only its row totals pass through the driver, one number a partition. In each shard rows are
    permuted again by a second hash, in groups of some 16,000 so that no shard meets in one task.

    The same seed and input partitions give the same result. Any value may be null and rows may
    repeat: only places count. Columns shard and slot of the input are replaced. An empty table gives none.
    """
    spark = rows.sparkSession
    first, columns, last = carried(rows, ["shard", "slot"])
    placed = cut(
        rows.select(*first, F.monotonically_increasing_id().alias("_row"))
        .sortWithinPartitions(F.xxhash64(F.lit(seed), "_row"))
        .select(*columns, F.monotonically_increasing_id().alias("_at"))
        .select(
            *columns,
            F.shiftright("_at", 33).alias("_part"),
            F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"),
        )
    )
    sizes = sorted(tuple(r) for r in placed.groupBy("_part").count().collect())
    cells = matrix([n for _, n in sizes], shards, seed)
    starts = []
    for (part, _), row in zip(sizes, cells, strict=True):
        cum = [0]
        for c in row[:-1]:
            cum.append(cum[-1] + c)
        starts.append((part, cum))
    dealt = spark.createDataFrame(starts, "_part long, _cum array<long>")
    if len(starts) * shards <= MAX_BROADCAST_CELLS:
        dealt = F.broadcast(dealt)
    # the last start at or below the place; empty cells share their start with the next
    shard = F.size(F.filter("_cum", lambda x: x <= F.col("_place"))) - 1
    total = sum(n for _, n in sizes)
    k = max(0, math.ceil(math.log2(max(1, total / shards / GROUP_ROWS))))
    second = F.xxhash64(F.lit(seed + 1), "_part", "_place")
    group = F.shiftrightunsigned("_hash", 64 - k) if k else F.lit(0).cast("long")
    sent = (
        placed.join(dealt, "_part")
        .select(*columns, shard.alias("shard"), "_part", "_place", second.alias("_hash"))
        .withColumn("_group", group)
    )
    ahead = Window.partitionBy("shard").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        sent.groupBy("shard", "_group")
        .count()
        .select("shard", "_group", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("shard", "_group").orderBy("_hash", "_part", "_place")
    return sent.join(before, ["shard", "_group"]).select(
        *last, "shard", (F.col("_before") + F.row_number().over(inside) - 1).cast("long").alias("slot")
    )


def write_shards(rows: DataFrame, path: str, shards: int, seed: int = 17) -> None:
    """Writes the shuffled rows below ``path``, one folder a shard, each file in slot order."""
    out = uniform_shards(rows, shards, seed)
    (
        out.withColumn("_chunk", F.shiftright("slot", 16))
        .repartition("shard", "_chunk")
        .sortWithinPartitions("shard", "slot")
        .drop("_chunk")
        .write.partitionBy("shard")
        .parquet(path)
    )


def op4_sharding(spark, sf_dir):
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(spark, sf_dir).select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return uniform_shards(rows, 24).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
