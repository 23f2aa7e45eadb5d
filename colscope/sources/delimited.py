"""Monthly fact files: declared types, header and pin checks, idempotent loads."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.functions.guards import ContractViolation, require_empty
from colscope.operators.quality import null_counts
from colscope.plans.stages import hadoop_path, staged
from colscope.sources.file_facts import file_facts

LEDGER = "file_name string, sha256 string, rows bigint, ddl_sha256 string, folder string"


def read_fact(spark: SparkSession, paths: Sequence[str], ddl: str) -> DataFrame:
    """A ``;``-separated file with a header and a trailing empty field, plain or gzipped.

    Types are declared, nothing is inferred, an empty field is null and a value that
    doesn't parse fails the read. Nullability isn't enforced by the reader: see
    ``missing_values``. A third decimal is rounded in.
    """
    return (
        spark.read.schema(ddl)
        .option("sep", ";")
        .option("header", True)
        .option("mode", "FAILFAST")
        .option("emptyValue", None)
        .csv(list(paths))
    )


def parse_lines(lines: DataFrame, column: str, ddl: str) -> DataFrame:
    """Delimited lines of a text column in their declared types; the same rules as the
    file reader, for lines that arrive without a file."""
    options = {"sep": ";", "mode": "FAILFAST"}
    return lines.select(F.from_csv(F.col(column), F.lit(ddl), options).alias("r")).select("r.*")


def write_files(lines: DataFrame, header: DataFrame, order: Sequence[str], folder: str, gzip: bool = False) -> list[str]:
    """Writes lines (file, value and the columns of ``order``) as one file a name, and gives the paths.

    A file has its line of ``header`` (file, value) first, then its lines in order. Each file is written by one
    task, under a name of the writer's, and renamed when all are whole. A file's lines are sorted, not held.
    """
    spark = lines.sparkSession
    marked = header.select("file", "value", F.lit(0).alias("_part")).unionByName(
        lines.withColumn("_part", F.lit(1)), allowMissingColumns=True
    )
    sorted_ = marked.repartition("file").sortWithinPartitions("file", "_part", *order)
    writing = f"{folder}/writing-{uuid.uuid4().hex}"
    sorted_.select("file", "value").write.partitionBy("file").option("compression", "gzip" if gzip else "none").text(writing)
    top, fs = hadoop_path(spark, writing)
    paths = []
    for entry in fs.globStatus(hadoop_path(spark, f"{writing}/file=*/part-*")[0]):
        name = entry.getPath().getParent().getName().removeprefix("file=")
        target = f"{folder}/{name}"
        if not fs.rename(entry.getPath(), hadoop_path(spark, target)[0]):
            raise OSError(f"{target} can't be written")
        paths.append(target)
    fs.delete(top, True)
    return sorted(paths)


def missing_values(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """NOT NULL columns holding empties, with their counts."""
    return null_counts(df, required)


def read_as_text(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The same file with every field as text, for profiling it against its declaration."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("sep", ";").option("header", True).csv(list(paths))


def headers(facts: DataFrame) -> DataFrame:
    """(file, header): the first line of each file, of its facts (``file_facts``)."""
    return facts.select(F.col("file_name").alias("file"), F.coalesce("header", F.lit("")).alias("header"))


def header_differences(heads: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per file whose header differs: the first field that does, found and expected.

    The last declared column is the filler for the empty field after the trailing ``;``,
    so the header's last field must be empty.
    """
    expected = [*columns[:-1], ""]
    found = F.split("header", ";", -1)
    wide = F.greatest(F.size(found), F.lit(len(expected)))
    wanted = F.lit(expected)
    differing = F.filter(
        F.sequence(F.lit(0), wide - 1),
        lambda i: ~F.get(found, i).eqNullSafe(F.get(wanted, i)),
    )
    first = F.get(differing, F.lit(0))
    return (
        heads.where(F.size(differing) > 0)
        .select(
            "file",
            (first + 1).alias("field"),
            F.get(found, first).alias("found"),
            F.get(wanted, first).alias("expected"),
        )
    )


def file_digests(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file_name, bytes, sha256) of each file as stored, in constant memory."""
    return file_facts(spark, paths).select("file_name", "bytes", "sha256")


def file_rows(spark: SparkSession, paths: Sequence[str], ddl: str) -> DataFrame:
    """(file_name, rows): data rows per file."""
    return (
        read_fact(spark, paths, ddl)
        .groupBy(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file_name"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def pin_mismatches(found: DataFrame, pins: DataFrame) -> DataFrame:
    """Files whose size, hash or row count differ from their pin, or that one side lacks."""
    f = found.select(
        "file_name", *[F.col(c).alias(f"found_{c}") for c in ("bytes", "sha256", "rows")]
    )
    p = pins.select(
        "file_name", *[F.col(c).alias(f"pinned_{c}") for c in ("bytes", "sha256", "rows")]
    )
    joined = f.join(p, "file_name", "full_outer")
    differing = F.array_compact(
        F.array(
            *[
                F.when(~F.col(f"found_{c}").eqNullSafe(F.col(f"pinned_{c}")), c)
                for c in ("bytes", "sha256", "rows")
            ]
        )
    )
    return joined.select("file_name", F.array_join(differing, ",").alias("differs")).where(
        F.col("differs") != ""
    )


def load_plan(files: DataFrame, ledger: DataFrame, ddl_sha256: str) -> DataFrame:
    """What to do with each file against the ledger: load, skip or a conflict.

    A file loaded under another DDL, or a loaded name with other bytes, is a conflict.
    """
    seen = ledger.select(
        "file_name", F.col("sha256").alias("loaded_sha256"), F.col("ddl_sha256").alias("loaded_ddl")
    )
    action = (
        F.when(F.col("loaded_sha256").isNull(), "load")
        .when(F.col("loaded_ddl") != ddl_sha256, "other ddl")
        .when(F.col("loaded_sha256") != F.col("sha256"), "other bytes")
        .otherwise("skip")
    )
    return files.join(seen, "file_name", "left").select("file_name", "sha256", action.alias("action"))


def write_observed(df: DataFrame, required: Sequence[str], path: str, by: str) -> dict[str, int]:
    """Writes ``df`` to ``path``, a folder for each value of ``by``; gives what was seen on the way.

    Counts are gathered while the rows are written, by the same scan: ``rows``, and for each column of
    ``required`` how many of its values are null.
    """
    seen = Observation()
    empties = [F.count_if(F.col(c).isNull()).alias(f"null {i}") for i, c in enumerate(required)]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *empties).write.partitionBy(by).parquet(path)
    return {"rows": seen.get["rows"], **{c: seen.get[f"null {i}"] for i, c in enumerate(required)}}


def stage(spark: SparkSession, paths: Sequence[str], ddl: str, path: str) -> tuple[int, DataFrame]:
    """Parses files into ``path`` by one scan: how many rows came, and the NOT NULL columns of ``ddl`` that
    hold empties, with their counts. A value that doesn't fit its type fails the write."""
    required = [f.name for f in T.StructType.fromDDL(ddl) if not f.nullable]
    facts = read_fact(spark, paths, ddl).withColumn("source_file", F.element_at(F.split("_metadata.file_path", "/"), -1))
    seen = write_observed(facts, required, path, "source_file")
    rows = seen.pop("rows")
    broken = [(c, n) for c, n in seen.items() if n]
    return rows, spark.createDataFrame(broken, "column_name string, nulls bigint")


def load(
    spark: SparkSession,
    paths: Sequence[str],
    ddl: str,
    pins: DataFrame,
    raw_dir: str,
    ledger_dir: str,
    ledger: DataFrame | None = None,
) -> DataFrame:
    """Load each file not loaded yet; a second call with the same bytes loads nothing.

    A file is read twice: once as stored, for its size, hash, header and lines, and once as rows, which are
    checked while they are written. New files go into a folder of their own, which nothing reads before the
    ledger names it: the ledger's rows are written last, if every header, pin, type, row count and NOT NULL
    column of ``ddl`` holds, and publish all of them at once. A load cut short leaves an unnamed folder and is
    made again; one that is refused takes its folder back. ``loaded`` reads what the ledger names.
    """
    ddl_sha = _ddl_sha(ddl)
    known = ledger if ledger is not None else _ledger(spark, ledger_dir)
    columns = T.StructType.fromDDL(ddl).fieldNames()
    facts = staged(file_facts(spark, paths), "file-facts")
    require_empty(header_differences(headers(facts), columns), "a header differs")
    stale = known.where(F.col("ddl_sha256") != ddl_sha)
    require_empty(stale, "loaded under another DDL")
    plan = load_plan(facts.select("file_name", "sha256"), known, ddl_sha)
    require_empty(plan.where(F.col("action") == "other bytes"), "a loaded file has other bytes")
    # The file list is small by nature: one name per monthly file.
    new = facts.join(plan.where(F.col("action") == "load").select("file_name"), "file_name", "left_semi")
    todo = {r["path"]: (r["file_name"], r["rows"]) for r in new.select("path", "file_name", "rows").collect()}
    if not todo:
        return spark.createDataFrame([], LEDGER)
    pinned = pins.where(F.col("file_name").isin(*[name for name, _ in todo.values()]))
    require_empty(pin_mismatches(new.select("file_name", "bytes", "sha256", "rows"), pinned), "a file differs from its pin")
    part = f"load={uuid.uuid4().hex}"
    try:
        rows, empties = stage(spark, list(todo), ddl, f"{raw_dir}/{part}")
        require_empty(empties, "a NOT NULL field is empty")
        if rows != (lines := sum(n for _, n in todo.values())):
            raise ContractViolation(f"parsed {rows} rows of {lines} lines")
    except Exception:
        folder, fs = hadoop_path(spark, f"{raw_dir}/{part}")
        fs.delete(folder, True)
        raise
    entries = new.select("file_name", "sha256", "rows", F.lit(ddl_sha).alias("ddl_sha256"), F.lit(part).alias("folder"))
    entries.write.mode("append").parquet(ledger_dir)
    return entries


def loaded(spark: SparkSession, raw_dir: str, ledger_dir: str, ddl: str) -> DataFrame:
    """The rows of all loaded files, with ``source_file``: of the folders that the ledger names, and no others."""
    known = _ledger(spark, ledger_dir)
    folders = [r["folder"] for r in known.select("folder").distinct().collect()]
    declared = T.StructType([T.StructField(f.name, f.dataType) for f in T.StructType.fromDDL(ddl)])
    schema = declared.add("source_file", T.StringType())
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", raw_dir).parquet(*[f"{raw_dir}/{f}" for f in folders]).select(*schema.names)


def _ddl_sha(ddl: str) -> str:
    return hashlib.sha256(ddl.encode()).hexdigest()


def _ledger(spark: SparkSession, ledger_dir: str) -> DataFrame:
    """The ledger, empty before the first load."""
    path, fs = hadoop_path(spark, ledger_dir)
    if not fs.exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(ledger_dir)
