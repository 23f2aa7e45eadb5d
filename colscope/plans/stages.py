"""Stage tables: a plan's result written once to the shared folder and read back.

The analysis reads its snapshot and its references several times. Written as Parquet,
each is computed once, later readers scan only the columns they need, a lost executor
re-reads a file instead of recomputing, and every plan starts short.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, which ``spark.checkpoint.dir`` names.

    A session on one machine that names none gets a temporary folder for its life. On a
    cluster a folder of the driver's machine would lose rows, so there it is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not _own:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _own.append(tempfile.mkdtemp(prefix="spark-colscope-", dir="/tmp"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def staged(df: DataFrame, name: str) -> DataFrame:
    """The table written under a fresh name, read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/colscope-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hadoop_path(spark: SparkSession, name: str):
    """A path and the file system it is on, as Spark sees them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())
