"""From raw documents to token ids: quality, exact copies, near copies, source mix, encoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.llm.byte_bpe import encode
from colscope.llm.common import carried, fresh_dir
from colscope.llm.exact_dedup import exact_dedup
from colscope.llm.mixing import mix
from colscope.llm.quality import classify, fit
from colscope.llm.simhash import drop_near_duplicates


_READ = ("doc_id", "text", "source")


def _decided(docs: DataFrame, operator: Callable[[DataFrame], DataFrame], keeps: str) -> DataFrame:
    """The rows of ``docs`` that an operator keeps; its results and the columns carried along don't meet."""
    first, _, others = carried(docs, _READ)
    rest = iter(others)
    last = [F.col(c.lower()).alias(c) if c.lower() in _READ else next(rest) for c in docs.columns]
    return operator(docs.select(*_READ, *first)).where(keeps).select(*last)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _decided(docs, lambda rows: classify(rows, fit(docs, labels)), "predicted = 1")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return _decided(docs, exact_dedup, "kept")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice; one without words too."""
    each = F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))
    return _decided(docs, lambda rows: mix(rows).withColumn("__each", each), "true")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the digest of the text that they decode to."""
    ids = encode(docs.select("doc_id", "source", "text"), decoded="decoded", keep_text=False)
    return ids.select(
        "doc_id",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]

#: SQL has neither the latent space nor XXH64; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over all documents; each stage is written to the shared folder and reread.

    Null and empty texts are scored like any others, repeated rows are exact copies, and rows with a null id are
    kept as texts: each stage's operator states the cases. Other columns pass under whatever name, to the
    stage before the last. Empty tables give no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = fresh_dir(spark, "corpus-pipeline")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
