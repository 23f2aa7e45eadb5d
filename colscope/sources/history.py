"""Query-history exports: JSON Lines with a strict row contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colscope.contracts import HISTORY
from colscope.functions.text import IDENTIFIER

FIELDS = [f.split()[0] for f in HISTORY.split(", ")]
OPTIONAL = ("QUERY_TAG", "DATABASE_NAME", "SCHEMA_NAME")
# The statuses a row may have.
STATUSES = ("SUCCESS", "FAIL", "INCIDENT")
UTC_INSTANT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|\+00:00)$"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The export's lines with their place: (file, block_start, place, value); ``numbered`` makes it a line number."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("place"),
        "value",
    )


def numbered(some: DataFrame, lines: DataFrame) -> DataFrame:
    """``some`` of the export's lines, without their text, with ``line``, counting from 1 within a file.

    A task reads a block of a file in order, so a row's place in its block is its distance
    from the block's first row; the lines of the blocks before it come from one count
    per block. Only the rows asked for meet the blocks.
    """
    before = (
        Window.partitionBy("file")
        .orderBy("block_start")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    blocks = (
        lines.groupBy("file", "block_start")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("place").alias("_first"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    )
    return (
        some.join(F.broadcast(blocks), ["file", "block_start"])
        .withColumn("line", F.col("_offset") + F.col("place") - F.col("_first") + 1)
        .drop("_n", "_first", "_offset", "block_start", "place")
    )


def parsed(lines: DataFrame) -> DataFrame:
    """Each line's fields, and the first field that breaks the contract (``bad_field``).

    A line is parsed once, into a variant: inside brackets, so that anything after the object shows. Fields keep
    their JSON types, so a number is no text, and an extra field shows instead of vanishing. A line that repeats a
    field is no object. The line's text leaves with the bad rows.
    """
    c = F.col
    whole = F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]"))).try_cast("array<map<string,variant>>")
    # A generator, which the optimizer doesn't put in for each of the fields that read it.
    rows = lines.select("*", F.explode_outer(F.array(whole)).alias("_all"))
    rows = rows.withColumn("_row", F.when(F.size("_all") == 1, F.get("_all", F.lit(0)))).drop("_all")
    field = lambda f: F.try_element_at("_row", F.lit(f))
    text = {f: F.when(F.schema_of_variant(field(f)) == "STRING", F.try_variant_get(field(f), "$", "string")) for f in FIELDS}
    with_cells = rows.withColumns(text)

    def unless(ok: Column, name: str) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), name)

    def empty(f: str) -> Column:
        return F.coalesce(F.schema_of_variant(field(f)) == "VOID", F.lit(False))

    keys = F.map_keys("_row")
    extra = F.filter(keys, lambda k: ~k.isin(*FIELDS))
    missing = F.filter(F.lit(FIELDS), lambda k: ~F.array_contains(keys, k))
    bad = F.coalesce(
        F.when(c("_row").isNull(), "(not an object)"),
        F.get(F.array_sort(extra), F.lit(0)),
        F.get(missing, F.lit(0)),
        *[
            unless(F.length(c(f)) > 0, f)
            for f in ("QUERY_ID", "QUERY_TEXT", "ROLE_NAME")
        ],
        unless(
            c("START_TIME").rlike(UTC_INSTANT)
            & F.try_to_timestamp(c("START_TIME")).isNotNull(),
            "START_TIME",
        ),
        unless(c("EXECUTION_STATUS").isin(*STATUSES), "EXECUTION_STATUS"),
        unless(empty("QUERY_TAG") | c("QUERY_TAG").isNotNull(), "QUERY_TAG"),
        *[
            unless(empty(f) | c(f).rlike(IDENTIFIER), f)
            for f in ("DATABASE_NAME", "SCHEMA_NAME")
        ],
    )
    return with_cells.withColumn("bad_field", bad).drop("_row")


def rejects(rows: DataFrame) -> DataFrame:
    """The bad lines by place and field, never their text."""
    return rows.where(F.col("bad_field").isNotNull()).drop("value", *FIELDS)


def accepted(rows: DataFrame) -> DataFrame:
    """The good lines as history rows."""
    return rows.where(F.col("bad_field").isNull()).select(
        F.col("QUERY_ID").alias("query_id"),
        F.col("QUERY_TEXT").alias("query_text"),
        F.to_timestamp("START_TIME").alias("start_time"),
        F.col("ROLE_NAME").alias("role_name"),
        F.col("QUERY_TAG").alias("query_tag"),
        F.col("EXECUTION_STATUS").alias("execution_status"),
        F.col("DATABASE_NAME").alias("database_name"),
        F.col("SCHEMA_NAME").alias("schema_name"),
    )


def read_history(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """An export's history rows and its reject table (file, line, bad_field)."""
    lines = read_lines(spark, path)
    rows = parsed(lines)
    return accepted(rows), numbered(rejects(rows), lines.drop("value"))
