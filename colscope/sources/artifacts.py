"""Contract-typed tables on disk, canonical content hashes and provenance."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from colscope.contracts import conform, schema_differences
from colscope.functions.hashing import row_digest
from colscope.operators.quality import set_difference
from colscope.plans.stages import hadoop_path


#: What a commit says: its number, the folder it publishes, the tables in it and their total order's columns.
COMMIT = "number bigint, folder string, tables array<string>, sort_key array<string>"


def commit(spark: SparkSession, path: str, folder: str, tables: Sequence[str], sort_key: Sequence[str] = ()) -> None:
    """Publishes a written folder below ``path`` as its current version, by one row: readers see all of it or nothing."""
    number = (last["number"] if (last := committed(spark, path)) else 0) + 1
    row = spark.createDataFrame([(number, folder, list(tables), list(sort_key))], COMMIT)
    row.coalesce(1).write.mode("append").parquet(f"{path}/commits")


def committed(spark: SparkSession, path: str) -> Row | None:
    """The current version of what lies at ``path``: its last commit. A folder that no commit names isn't seen."""
    log, fs = hadoop_path(spark, f"{path}/commits")
    if not fs.exists(log):
        return None
    return spark.read.schema(COMMIT).parquet(f"{path}/commits").orderBy(F.desc("number"), F.desc("folder")).head()


def write_artifact(df: DataFrame, ddl: str, sort_key: Sequence[str], path: str) -> None:
    """Write a table in its contract's types, ordered by a total key across the files: all of it or nothing.

    It goes into a folder of its own, which a commit makes the current version; an earlier one stays as it was.
    """
    folder = f"version-{uuid.uuid4().hex}"
    conform(df, ddl).orderBy(*sort_key).write.parquet(f"{path}/{folder}/rows")
    commit(df.sparkSession, path, folder, ["rows"], sort_key)


def read_artifact(spark: SparkSession, ddl: str, path: str) -> DataFrame:
    """Read the current version back; a stored schema that differs from the contract fails, in whichever file."""
    current = committed(spark, path)
    if current is None:
        raise ValueError(f"{path}: nothing is committed")
    df = spark.read.option("mergeSchema", True).parquet(f"{path}/{current['folder']}/rows")
    differing = schema_differences(df.schema, ddl)
    if differing:
        raise ValueError(f"{path}: stored schema differs from its contract: {differing}")
    return df


def order_breaks(spark: SparkSession, path: str) -> DataFrame:
    """Where the current version's rows leave their total order: (file, row), repeats of a key included.

    A file's rows are compared with their predecessors, one file to a window; files, in the order of their names,
    by their first and last keys, one row a file.
    """
    current = committed(spark, path)
    rows = spark.read.parquet(f"{path}/{current['folder']}/rows").select(
        F.struct(*current["sort_key"]).alias("k"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")
    )
    inside = rows.withColumn("before", F.lag("k").over(Window.partitionBy("file").orderBy("row"))).where("before >= k")
    ends = rows.groupBy("file").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    across = ends.withColumn("before", F.lag("last").over(Window.orderBy("file"))).where("before >= first")
    return inside.select("file", "row").unionByName(across.select("file", F.lit(0).cast("bigint").alias("row")))


def content_hash(df: DataFrame) -> DataFrame:
    """One row: a sha256 of a table's rows, whatever their order or files.

    Rows become canonical JSON digests and equal ones are counted, so repeated rows meet as
    a count. Each counted digest is hashed again, its 240 leading bits are added up as four
    numbers, and the sums are hashed: additions need no order and gather nothing, so the
    work is one partial aggregation whatever the table's size.
    """
    counted = df.select(row_digest(df.columns).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.sha2(F.concat_ws(":", "d", F.col("n").cast("string")), 256).alias("line")).agg(
        F.sha2(F.concat_ws(":", *summed_digests("line", 4)), 256).alias("content_sha256")
    )


def summed_digests(digest: str, parts: int) -> list[Column]:
    """How many hex digests there are, and the sums of their leading 60-bit parts, as text."""
    number = lambda i: F.conv(F.substring(digest, 15 * i + 1, 15), 16, 10).cast("decimal(20,0)")
    sums = [F.coalesce(F.sum(number(i)), F.lit(0)).cast("decimal(38,0)") for i in range(parts)]
    return [c.cast("string") for c in (F.count(digest), *sums)]


def stamped(results: DataFrame, sql: str | Column, data_pins: DataFrame) -> DataFrame:
    """Results with what they were computed from: the hash of their SQL, a text or a column of texts, and the pins'."""
    pins = content_hash(data_pins).scalar()
    text = F.lit(sql) if isinstance(sql, str) else sql
    return results.withColumn("sql_sha256", F.sha2(text, 256)).withColumn("data_sha256", pins)


def stale_results(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """Stored results that don't match what they should come from: (stem, problem).

    ``stored`` and ``expected``: stem, sql_sha256, data_sha256.
    """
    unowned = set_difference(stored, expected, "stem").select(
        "stem",
        F.when(F.col("problem") == "missing", "no stored result")
        .otherwise("result with no owner")
        .alias("problem"),
    )
    a = stored.alias("a")
    b = expected.alias("b")
    other = a.join(b, "stem").where(
        (F.col("a.sql_sha256") != F.col("b.sql_sha256"))
        | (F.col("a.data_sha256") != F.col("b.data_sha256"))
    ).select("stem", F.lit("stored from other SQL or other data").alias("problem"))
    return unowned.unionByName(other)


def missing_tables(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Catalog tables the warehouse lacks; a stale extra table is ignored."""
    return wanted.select("table_name").distinct().join(
        present.select("table_name"), "table_name", "left_anti"
    )


def export_marts(spark: SparkSession, wanted: Sequence[str], out_dir: str) -> None:
    """Copy exactly the wanted tables, all or none: one that is missing fails before anything is written, and the copies
    become the current version together, by one commit. Tables of earlier versions that aren't wanted any more go."""
    present = {t.name.upper() for t in spark.catalog.listTables()}
    lacking = sorted(set(wanted) - present)
    if lacking:
        raise ValueError(f"missing mart tables: {lacking}")
    folder = f"version-{uuid.uuid4().hex}"
    for table in wanted:
        spark.table(table).write.parquet(f"{out_dir}/{folder}/{table.lower()}")
    commit(spark, out_dir, folder, [table.lower() for table in wanted])


def exported(spark: SparkSession, out_dir: str) -> dict[str, DataFrame]:
    """The tables of the current version of an export, by name."""
    current = committed(spark, out_dir)
    if current is None:
        return {}
    return {name: spark.read.parquet(f"{out_dir}/{current['folder']}/{name}") for name in current["tables"]}
