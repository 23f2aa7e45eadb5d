"""Exact dedup: two passes of Bloom filtering, so that only possibly repeated rows shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colscope.llm.common import SPACES, carried, cut, documents, join_hot

#: Filter bits a document and hash function: one row in 16 falls on a bit that another has set.
BITS_A_ROW = 16
#: The filter is broadcast: 2 x 2^27 bits are 2^22 words, 64 MB of (word, bits) at most. Beyond
#: 8 million documents more rows are taken for possible repeats; the result stays exact.
MAX_BITS = 1 << 27
#: Groups with this share of all rows or more are joined by broadcast: 1,000 rows at most.
HOT_SHARE = 1000


def without_spaces(text: Column) -> Column:
    """The text less every space and control from tab to carriage return; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for space in SPACES:
        out = F.replace(out, F.lit(space), F.lit(""))
    return out


def _positions(bits: int) -> list[Column]:
    """Two bit positions of a row, each in a half of its own of the filter."""
    h = F.xxhash64("_sha")
    return [
        h.bitwiseAND(F.lit(bits - 1)),
        F.lit(bits) + F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1)),
    ]


def repeated_bits(keyed: DataFrame, bits: int) -> DataFrame:
    """Pass one: the filter of positions that two rows or more fall on, as 64-bit words."""
    hits = keyed.select(F.explode(F.array(*_positions(bits))).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    return (
        hits.where("n > 1")
        .groupBy(F.shiftright("p", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, int(p & 63)))").alias("set_bits"))
    )


def _flagged(keyed: DataFrame, words: DataFrame, bits: int) -> DataFrame:
    """Pass two: whether both positions of a row are set, by lookups in the broadcast filter."""
    out, both = keyed, F.lit(True)
    for i, p in enumerate(_positions(bits)):
        named = words.select(F.col("word").alias(f"_word{i}"), F.col("set_bits").alias(f"_bits{i}"))
        out = out.withColumn(f"_p{i}", p).join(
            F.broadcast(named), F.shiftright(f"_p{i}", 6) == F.col(f"_word{i}"), "left"
        )
        bit = F.expr(f"shiftrightunsigned(_bits{i}, int(_p{i} & 63)) & 1")
        both = both & (F.coalesce(bit, F.lit(0)) == 1)
    return out.withColumn("_maybe", both)


def _one_of_equals(rows: DataFrame) -> DataFrame:
    """Of rows that repeat the row that stays, id and text alike, one is kept: numbered in two
    steps, first inside a part of the group and then over one row a part."""
    part = rows.withColumn("_part", F.when(F.col("kept"), F.spark_partition_id()).otherwise(-1))
    part = part.withColumn(
        "_first",
        F.col("kept")
        & (F.row_number().over(Window.partitionBy("_sha", "_part", F.expr("if(kept, 0, _spread)")).orderBy("_len")) == 1),
    )
    again = Window.partitionBy("_sha", F.expr("if(_first, -1, _spread)")).orderBy("_part")
    return part.withColumn("kept", F.col("_first") & (F.row_number().over(again) == 1))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """Every row of ``docs`` with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical without spaces; null counts as empty, so all empty texts are one
    group. Of a group the row with the most code points in its original text stays, then the smallest
    id (a null id last); of rows that repeat that row, id and text alike, one. A column of the input
    named like one of the four results is replaced. An empty table gives none.

    Pass one counts the rows on each of two hashed positions and keeps the positions with two or
    more as a filter. Pass two looks each row up: rows with a free position have no equal and pass
    straight through; the rest shuffle by their 256-bit digest. Sizes and winners are folded on the
    map side first, and hot groups are served by broadcast.
    """
    added = ["keep_id", "group_size", "kept", "text_sha256"]
    first, columns, last = carried(docs, added)
    n = docs.count()
    bits = min(max_bits, max(1 << 16, 1 << math.ceil(math.log2(max(1, n * BITS_A_ROW)))))
    keyed = docs.select(
        *first,
        F.col(id_col).alias("_id"),
        F.sha2(without_spaces(F.col(text_col)), 256).alias("_sha"),
        F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("_len"),
    )
    words = cut(repeated_bits(keyed, bits))
    flagged = _flagged(keyed, words, bits)
    alone = flagged.where(~F.col("_maybe")).select(
        *last,
        F.col("_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
    maybe = flagged.where("_maybe")
    best = F.struct((-F.col("_len")).alias("l"), F.col("_id").isNull().alias("u"), F.col("_id").alias("d"))
    groups = cut(
        maybe.groupBy("_sha", best.alias("b"))
        .agg(F.count(F.lit(1)).alias("c"))
        .groupBy("_sha")
        .agg(F.sum("c").alias("_size"), F.min(F.struct("b", "c")).alias("w"))
        .where("_size > 1")
        .select("_sha", "_size", F.col("w.b").alias("_best"), F.col("w.c").alias("_equal"))
    )
    rows = join_hot(
        maybe.select(*columns, "_id", "_sha", "_len"), groups, "_sha", "_size", max(1000, n // HOT_SHARE)
    ).withColumn("kept", F.col("_best").isNull() | best.eqNullSafe(F.col("_best")))
    if groups.where("_equal > 1").take(1):
        spread = F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("int")
        plain = rows.where("coalesce(_equal, 1) = 1")
        rows = plain.unionByName(
            _one_of_equals(rows.where("_equal > 1").withColumn("_spread", spread)).select(*plain.columns)
        )
    together = rows.select(
        *last,
        F.when(F.col("_best").isNull(), F.col("_id")).otherwise(F.col("_best.d")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        "kept",
        F.col("_sha").alias("text_sha256"),
    )
    return alone.unionByName(together)


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST)
"""
