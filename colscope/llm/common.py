"""Helpers shared by the operators: written cuts, the shared folder, joins with hot keys."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.plans.stages import shared_folder

#: The characters that separate words: space and the controls from tab to carriage return.
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
WORD = r"[^\x20\x09-\x0D]+"


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share; nothing is written yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The frame, computed once and checkpointed in the shared folder: lost executors re-read it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def carried(docs: DataFrame, added: Iterable[str]) -> tuple[list[Column], list[str], list[Column]]:
    """How an operator takes a frame's columns along: under names of its own, which clash with none.

    Gives the columns to select first, their inner names, and the columns to select last. Columns
    named like one of ``added``, the operator's results, in whatever case, are left out.
    """
    results = {a.lower() for a in added}
    kept = [c for c in docs.columns if c.lower() not in results]
    inner = [f"__{i}" for i in range(len(kept))]
    first = [F.col(f"`{c}`").alias(i) for c, i in zip(kept, inner, strict=True)]
    return first, inner, [F.col(i).alias(c) for c, i in zip(kept, inner, strict=True)]


def carried_as(docs: DataFrame, added: Iterable[str], column: str) -> str:
    """The inner name that ``carried`` gives a column."""
    results = {a.lower() for a in added}
    return f"__{[c.lower() for c in docs.columns if c.lower() not in results].index(column.lower())}"


def with_arrays(batch: pa.RecordBatch, **arrays: pa.Array) -> pa.RecordBatch:
    """The batch with columns put behind its own."""
    columns = [*batch.columns, *arrays.values()]
    return pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *arrays])


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the session's Python workers this package's sources, once, wherever they start.

    The archive lies on the driver, and Spark sends it to each executor, later ones included.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="spark-sources-", dir="/tmp")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents", *(columns or ("doc_id", "text")))


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def word_count(text: Column) -> Column:
    """How many words a text has; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def join_hot(rows: DataFrame, groups: DataFrame, key: str, size: str, hot: int) -> DataFrame:
    """``rows`` left-joined with ``groups`` (one row a key) without a hot task.

    ``groups`` tells in ``size`` how many of the rows its key has. Keys with ``hot`` rows or more are
    at most rows / hot in number: those groups are broadcast. All other keys have fewer than ``hot``
    rows each and are joined by shuffle; rows already served are dealt out evenly there.
    """
    values = [c for c in groups.columns if c != key]
    big = groups.where(F.col(size) >= hot).select(
        F.col(key).alias("_hot_key"), F.struct(*values).alias("_hot_group")
    )
    small = groups.where(F.col(size) < hot).select(
        F.col(key).alias("_cold_key"), F.struct(*values).alias("_cold_group")
    )
    spread = F.concat(F.lit("~"), F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("string"))
    served = rows.join(F.broadcast(big), F.col(key) == F.col("_hot_key"), "left").withColumn(
        "_join_key", F.when(F.col("_hot_key").isNull(), F.col(key)).otherwise(spread)
    )
    joined = served.join(small, F.col("_join_key") == F.col("_cold_key"), "left")
    both = F.coalesce("_hot_group", "_cold_group")
    return joined.select(*rows.columns, *[both[v].alias(v) for v in values])
