"""Bounded samples of labelled rows for the trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The limit leaves the sample in one task; it is dealt out again to so many.
FIT_TASKS = 24


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, n: int, held_out: int, rows: int, seed: int = 5) -> DataFrame:
    """Up to ``rows`` labelled texts (``_text``, ``_label``) to fit on, never of the held-out remainder.

    The labelled ids of the smallest seeded hashes are taken: a uniform pick, the same on each run,
    and no more than ``rows`` ids leave the label table. Labels other than 0 and 1 and null ids take
    no part; of an id's repeated labels or texts each is a row until the bound is reached.
    """
    picked = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label"))
        .where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & (remainder("_id", n) != held_out))
        .withColumn("_order", F.xxhash64("_id", F.lit(seed)))
        .orderBy("_order", "_id", "_label")
        .limit(rows)
    )
    texts = docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text"))
    joined = texts.join(F.broadcast(picked), F.col("_doc") == F.col("_id"))
    return joined.select("_text", "_label", "_order", "_id").orderBy("_order", "_id").limit(rows).repartition(FIT_TASKS)
