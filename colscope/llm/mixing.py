"""Mixing sources to target weights: nested hash thresholds found by histograms, without a sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colscope.functions.ordering import global_row_number
from colscope.llm.common import carried, cut, documents, join_hot, word_count

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: The mix holds this many times the words of all documents.
SHARE = 1.5
#: No source gives more than this many times its words.
MOST = 2
#: A draw has 60 bits; each round of histograms settles 12 more of them.
HASH_BITS, STEP_BITS = 60, 12
#: Per-source tables of up to so many rows are broadcast (a few MB); larger ones are joined by shuffle.
BROADCAST_SOURCES = 50_000
#: In that shuffle, sources of 1 / HOT_SHARE of the rows or more are joined by broadcast.
HOT_SHARE = 1000


def draw(doc_id: str, text: str):
    """A document's draw in [0, 2^60), from its id and its text alone, so reruns agree."""
    key = F.concat(
        F.coalesce(F.col(doc_id).cast("string"), F.lit("~")), F.lit("|"), F.md5(F.coalesce(F.col(text), F.lit("")))
    )
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes`` (_source, source_size; one row a source; other columns stay) with target.

    Sources in order of code points, null last, weigh ``weights`` in turn. The excess over ``most``
    times a source's size goes to the others by weight until none is above: that is a water level,
    target = min(most x size, level x weight), raised in rounds of one sum until nothing changes.
    """
    ordered = sizes.withColumn("_last", F.col("_source").isNull()).withColumn(
        "_name", F.coalesce("_source", F.lit(""))
    )
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("_no") - 1, len(weights)) + 1).cast("int"))
    weighed = cut(
        global_row_number(ordered, [("_last", False), ("_name", False)], "_no").select(
            *sizes.columns, turn.alias("_weight"), (F.col("source_size") * most).alias("_cap")
        )
    )
    total = weighed.agg(F.sum("source_size")).head()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.col("_cap") <= F.lit(level) * F.col("_weight")
        now, spent, weight = weighed.agg(
            F.count_if(full), F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_weight")))
        ).head()
        if now == capped or not weight:
            break
        capped, level = now, (share * total - (spent or 0)) / weight
    return weighed.select(
        *sizes.columns,
        F.least(F.col("_cap").cast("double"), F.lit(float(level)) * F.col("_weight")).alias("target"),
    )


def _with_source(rows: DataFrame, groups: DataFrame, n_sources: int, hot: int) -> DataFrame:
    """``rows`` left-joined by ``_source`` with ``groups``, one row a source; ``_rows`` is how many rows it has."""
    if n_sources <= BROADCAST_SOURCES:
        named = F.broadcast(groups.withColumnRenamed("_source", "_g_source"))
        return rows.join(named, F.col("_source").eqNullSafe(F.col("_g_source")), "left").drop("_g_source")
    key = F.coalesce(F.concat(F.lit("s"), F.col("_source").cast("string")), F.lit("n"))
    keyed = groups.withColumn("_key", key).drop("_source")
    return join_hot(rows.withColumn("_key", key), keyed, "_key", "_rows", hot).drop("_key")


def thresholds(rows: DataFrame, wanted: DataFrame, n_sources: int, hot: int) -> DataFrame:
    """Per source, the draw below which documents are taken once more than ``_copies`` times.

    The remainder of the target is met by the documents of the smallest draws. Round by round the
    words are summed by source and by the next bits of the draw, the bucket in which the running sum
    passes the remainder is the boundary, and the next round looks at that bucket's documents alone.
    The last bucket holds one draw; it is taken too if that comes nearer to the target.
    """
    bound = wanted.select(
        "_source",
        "_rows",
        "_rest",
        F.lit(0).cast("long").alias("_prefix"),
        F.lit(0).cast("long").alias("_below"),
        F.lit(0).cast("long").alias("_words"),
    )
    running = Window.partitionBy("_source").orderBy("_bucket")
    for settled in range(STEP_BITS, HASH_BITS + 1, STEP_BITS):
        left = HASH_BITS - settled
        named = bound.select("_source", "_rows", "_rest", "_prefix", "_below")
        sums = (
            _with_source(rows, named, n_sources, hot)
            .where(F.shiftright("_draw", left + STEP_BITS) == F.col("_prefix"))
            .groupBy("_source", "_rows", "_rest", "_below", F.shiftright("_draw", left).alias("_bucket"))
            .agg(F.sum("_size").alias("_in"))
        )
        passed = sums.withColumn("_to", F.col("_below") + F.sum("_in").over(running)).where("_to > _rest")
        bound = cut(
            passed.groupBy("_source", "_rows", "_rest")
            .agg(F.min_by(F.struct("_bucket", "_to", "_in"), "_bucket").alias("m"))
            .select(
                "_source",
                "_rows",
                "_rest",
                F.col("m._bucket").alias("_prefix"),
                (F.col("m._to") - F.col("m._in")).alias("_below"),
                F.col("m._in").alias("_words"),
            )
        )
    nearer = F.col("_rest") * 2 > F.col("_below") * 2 + F.col("_words")
    return bound.select("_source", (F.col("_prefix") + nearer.cast("long")).alias("_threshold"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = SHARE,
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target, times (how often the mix takes it) and taken
    (words the mix takes of it).

    A row is taken whole as often as the target holds its source's size, and once more if its draw
    lies under the source's threshold, so a source's words end within half a document of the target
    and no row exceeds ``most`` times its size. A null text has no words and is taken
    as often as its source's other rows; null sources are one source, the last; a source without words has target 0. Rows alike in id and text share a draw and
    go together. Columns of the input named like a result are replaced. An empty table gives none.
    """
    added = ["size", "source_size", "target", "times", "taken"]
    first, _, last = carried(docs, added)
    rows = docs.select(
        *first,
        F.col(source_col).alias("_source"),
        word_count(F.col(text_col)).alias("_size"),
        draw(id_col, text_col).alias("_draw"),
    )
    narrow = cut(rows.select("_source", "_size", "_draw"))
    sizes = narrow.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    copies = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    wanted = cut(
        targets(sizes, share, weights, most)
        .withColumn("_copies", copies)
        .withColumn("_rest", F.col("target") - F.col("_copies") * F.col("source_size"))
    )
    n_sources = wanted.count()
    hot = max(1000, (wanted.agg(F.sum("_rows")).head()[0] or 0) // HOT_SHARE)
    found = thresholds(narrow, wanted, n_sources, hot).withColumnRenamed("_source", "_t_source")
    plan = wanted.join(found, F.col("_source").eqNullSafe(F.col("_t_source")), "left").select(
        "_source", "_rows", "source_size", "target", "_copies", "_threshold"
    )
    once_more = F.coalesce(F.col("_draw") < F.col("_threshold"), F.lit(False)).cast("long")
    times = F.coalesce(F.col("_copies"), F.lit(0)).cast("long") + once_more
    return _with_source(rows, plan, n_sources, hot).select(
        *last,
        F.col("_size").alias("size"),
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        times.alias("times"),
        (F.col("_size") * times).alias("taken"),
    )


def op8_mixing(spark, sf_dir):
    docs = documents(spark, sf_dir, "doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), '~'), '|', md5(coalesce(text, '')))), 1, 15)
              AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 AS INTEGER)] AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, coalesce(sum(2 * source_size) OVER o, 0) AS spent,
         sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS weight, sum(source_size) OVER () AS total
  FROM s WINDOW o AS (ORDER BY 2.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size,
         least(CAST(2 * source_size AS DOUBLE),
               w * (SELECT max((1.5 * CAST(total AS DOUBLE) - spent) / weight) FROM r)) AS target
  FROM r),
g AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS copies
  FROM t),
b AS (
  SELECT d.source, h, target - copies * source_size AS rest, sum(sum(size)) OVER (PARTITION BY d.source ORDER BY h) AS upto,
         sum(size) AS words
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source GROUP BY d.source, h, target, copies, source_size),
c AS (
  SELECT source, min(h) AS h, min_by(upto - words, h) AS below, min_by(words, h) AS words, min_by(rest, h) AS rest
  FROM b WHERE upto > rest GROUP BY source)
SELECT d.doc_id, d.size, g.source_size, g.target,
       CAST(d.size * (copies + CASE WHEN d.h < c.h + CASE WHEN 2 * c.rest > 2 * c.below + c.words THEN 1 ELSE 0 END
                                    THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""
