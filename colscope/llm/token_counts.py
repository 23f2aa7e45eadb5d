"""Token counts: rollups kept up to date by signed deltas, committed in batches once each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.llm.common import cut, documents, fresh_dir, word_count
from colscope.plans.stages import hadoop_path

KEYS = ["source", "lang", "version"]
DELTA = "batch string, source string, lang string, version string, documents long, tokens long"
TOTAL = "source string, lang string, version string, documents long, tokens long"
COMMIT = "batch string, rows long, digest decimal(38,0)"
#: Letter runs, digit runs and every other character that is no space.
PIECE = r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"


def image(source: Column, lang: Column, version: Column, tokens: Column) -> Column:
    """What the totals know of a document at one time: where it counts, and how much."""
    return F.struct(
        source.cast("string").alias("source"),
        lang.cast("string").alias("lang"),
        version.cast("string").alias("version"),
        tokens.cast("long").alias("tokens"),
    )


def signed(changes: DataFrame) -> DataFrame:
    """Changes (``before``, ``after``: images or null) as signed rows: the old counts off, the new on.

    An insert has no ``before``, a delete no ``after``, a revised count both.
    """
    either = F.array(
        F.struct(F.lit(-1).alias("sign"), F.col("before").alias("i")),
        F.struct(F.lit(1).alias("sign"), F.col("after").alias("i")),
    )
    return (
        changes.select(F.explode(F.filter(either, lambda x: x["i"].isNotNull())).alias("x"))
        .select("x.sign", "x.i.*")
        .withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    )


def _commit_row(batch: str, deltas: DataFrame) -> DataFrame:
    """A batch's commit row: its name, and how many deltas it has with their digest."""
    mark = F.sum(F.xxhash64(*KEYS, "documents", "tokens").cast("decimal(38,0)"))
    return deltas.agg(
        F.lit(batch).alias("batch"), F.count(F.lit(1)).alias("rows"), F.coalesce(mark, F.lit(0)).cast("decimal(38,0)").alias("digest")
    )


class Rollup:
    """Totals of documents and tokens by source, language and tokenizer version, below ``root``.

    ``commit`` writes a batch's deltas, one row a key, and then its commit row. Only batches with a
    commit row count, so a batch that broke off is written over by its retry, and a batch that is
    committed again is left alone; other changes under a committed name are an error. One writer at a
    time is assumed. Null keys are keys like others, a null count is 0, an empty batch commits nothing
    but its name, and a change without either image changes nothing.

    ``compact`` keeps the totals themselves: a base holds the totals of all batches committed so far, and then the
    list of these batches, which is its commit. ``totals`` adds to the newest base the deltas of later batches
    alone; a base that broke off has no list and isn't seen. Commit rows stay, so old batches are still known.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def _named(self, kind: str, batch: str) -> str:
        return f"{self.root}/{kind}/{batch.encode().hex()}"

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Whether the batch was new; the totals are the same either way."""
        done = self._exists(self._named("commits", batch))
        deltas = (
            signed(changes)
            .groupBy(*KEYS)
            .agg(F.sum("sign").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
        )
        if done:
            before = self.spark.read.schema(COMMIT).parquet(self._named("commits", batch)).head()
            if tuple(_commit_row(batch, deltas).head()) != tuple(before):
                raise ValueError(f"batch {batch!r} is committed with other changes")
            return False
        to = self._named("deltas", batch)
        deltas.select(F.lit(batch).alias("batch"), *KEYS, "documents", "tokens").write.mode("overwrite").parquet(to)
        _commit_row(batch, self.spark.read.schema(DELTA).parquet(to)).write.mode("overwrite").parquet(self._named("commits", batch))
        return True

    def _base(self) -> int:
        """The newest base with a list of its batches; -1 if there is none."""
        lists, fs = hadoop_path(self.spark, f"{self.root}/bases/*/batches/_SUCCESS")
        found = fs.globStatus(lists) or []
        return max((int(f.getPath().getParent().getParent().getName()) for f in found), default=-1)

    def _committed(self) -> DataFrame:
        commits = self.spark.read.schema(COMMIT).option("recursiveFileLookup", "true").parquet(f"{self.root}/commits")
        return commits.select("batch")

    def _of_base(self, base: int, part: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/bases/{base}/{part}")

    def _sums(self, base: int, batches: list[str]) -> DataFrame:
        """The totals of a base and of batches that it lacks."""
        kept = [] if base < 0 else [self._of_base(base, "totals", TOTAL)]
        paths = [self._named("deltas", b) for b in batches]
        later = self.spark.read.schema(DELTA).parquet(*paths).select(*KEYS, "documents", "tokens") if paths else self.spark.createDataFrame([], TOTAL)
        return (
            reduce(DataFrame.unionByName, [*kept, later])
            .groupBy(*KEYS)
            .agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
            .where("documents <> 0 or tokens <> 0")
        )

    def _later(self, base: int) -> list[str]:
        """The names of batches committed since a base."""
        done = self._committed()
        if base >= 0:
            done = done.join(self._of_base(base, "batches", "batch string"), "batch", "left_anti")
        return [r["batch"] for r in done.collect()]

    def compact(self) -> int:
        """Writes the totals of all committed batches as a new base; gives its number."""
        base = self._base()
        later = self._later(base)
        if base >= 0 and not later:
            return base
        to = f"{self.root}/bases/{base + 1}"
        self._sums(base, later).write.mode("overwrite").parquet(f"{to}/totals")
        names = self.spark.createDataFrame([(b,) for b in later], "batch string")
        listed = names if base < 0 else names.unionByName(self._of_base(base, "batches", "batch string"))
        listed.coalesce(1).write.mode("overwrite").parquet(f"{to}/batches")
        return base + 1

    def totals(self) -> DataFrame:
        """Documents and tokens by source, lang and version; keys whose counts have gone are left out."""
        base = self._base()
        return self._sums(base, self._later(base))


def op6_token_counts(spark, sf_dir):
    """All documents are loaded under a word count, recounted where letters, digits and marks count
    otherwise, the totals kept, and short ones (under 50 words) deleted; the load is sent twice."""
    docs = cut(
        documents(spark, sf_dir, "doc_id", "text", "source", "lang").select(
            "source",
            "lang",
            word_count(F.col("text")).alias("words"),
            F.coalesce(F.regexp_count("text", F.lit(PIECE)), F.lit(0)).cast("long").alias("pieces"),
        )
    )
    words = image(F.col("source"), F.col("lang"), F.lit("words-1"), F.col("words"))
    pieces = image(F.col("source"), F.col("lang"), F.lit("pieces-1"), F.col("pieces"))
    none = F.lit(None).cast("struct<source:string,lang:string,version:string,tokens:bigint>")
    differs = F.col("words") != F.col("pieces")
    rollup = Rollup(spark, fresh_dir(spark, "token-counts"))
    load = docs.select(none.alias("before"), words.alias("after"))
    rollup.commit("load", load)
    rollup.commit("recount", docs.where(differs).select(words.alias("before"), pieces.alias("after")))
    rollup.compact()
    rollup.commit("load", load)
    short = F.when(differs, pieces).otherwise(words)
    rollup.commit("short", docs.where("words < 50").select(short.alias("before"), none.alias("after")))
    return rollup.totals()


SQL = r"""
WITH d AS (
  SELECT source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
         len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]')) AS pieces
  FROM documents)
SELECT source, lang, CASE WHEN words = pieces THEN 'words-1' ELSE 'pieces-1' END AS version,
       count(*) AS documents, CAST(sum(pieces) AS BIGINT) AS tokens
FROM d WHERE words >= 50 GROUP BY ALL
"""
