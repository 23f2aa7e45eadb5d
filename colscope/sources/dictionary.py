"""Code lists and dictionary texts from sheet rows: (sheet, row_no, cells array<string>)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.functions.text import null_if_blank
from colscope.operators.catalog_docs import lists_in_sheet
from colscope.operators.quality import not_unique


def read_code_list(spark: SparkSession, path: str, code: str) -> DataFrame:
    """A typed code list: an integer code and its label, quotes doubled inside quotes. Nothing is inferred."""
    return (
        spark.read.schema(f"{code} int, {code}_LIB string")
        .option("header", True)
        .option("escape", '"')
        .option("mode", "FAILFAST")
        .csv(path)
    )


def _cell(i: int):
    return F.get("cells", F.lit(i))


def list_rows(rows: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The rows inside the wanted lists: (sheet, row_no, list, code, label).

    A row whose first cell is a wanted name opens a list unless one is open, a blank row
    ends it. A list is open between an opener and the next blank row, so an opener's
    name seen inside an open list is a row of that list.
    """
    blank = _cell(0).isNull() & _cell(1).isNull()
    marked = lists_in_sheet(
        rows.withColumn("_blank", blank),
        _cell(0).isin(*wanted),
        F.col("_blank"),
        _cell(0),
    )
    return marked.where(F.col("list").isNotNull() & ~F.col("_blank")).select(
        "sheet", "row_no", "list", _cell(0).alias("code"), _cell(1).alias("label")
    )


def code_lists(rows: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted lists' pairs: (variable, code, label), labels trimmed."""
    return list_rows(rows, wanted).select(
        F.col("list").alias("variable"),
        F.col("code").try_cast("int").alias("code"),
        null_if_blank(F.col("label")).alias("label"),
    )


def code_list_problems(rows: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """What makes a sheet's lists unusable: (variable, detail, problem)."""
    inside = list_rows(rows, wanted)
    problem = (
        F.when(F.col("code").isNull(), "label without a code")
        .when(F.col("code").try_cast("int").isNull(), "code is no integer")
        .when(null_if_blank(F.col("label")).isNull(), "no label")
    )
    bad = (
        inside.select(F.col("list").alias("variable"), F.col("code").alias("detail"), problem.alias("problem"))
        .where(F.col("problem").isNotNull())
    )
    twice = not_unique(
        code_lists(rows, wanted), ["variable", "code"]
    ).select(
        "variable", F.col("code").cast("string").alias("detail"), F.lit("code listed twice").alias("problem")
    )
    opened = inside.groupBy("list").agg(F.lit(1).alias("_one"))
    spark = rows.sparkSession
    asked = spark.createDataFrame([(w,) for w in wanted], "list string")
    missing = asked.join(opened, "list", "left_anti").select(
        F.col("list").alias("variable"),
        F.lit(None).cast("string").alias("detail"),
        F.lit("no code list").alias("problem"),
    )
    return bad.unionByName(twice).unionByName(missing)


def variable_texts(
    rows: DataFrame, name_at: int, label_at: int, comment_at: int
) -> DataFrame:
    """Each variable's label, then its comment on a new line if it has one."""
    label, comment = null_if_blank(_cell(label_at)), null_if_blank(_cell(comment_at))
    return (
        rows.select(
            null_if_blank(_cell(name_at)).alias("variable"),
            F.concat_ws("\n", label, comment).alias("text"),
            label.alias("label"),
        )
        .where(F.col("variable").isNotNull())
    )


def header_positions(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Where the header's names are: (sheet, header_row, <name> positions).

    The header is the sheet's first row holding the first name.
    """
    first = rows.where(F.array_contains("cells", names[0])).groupBy("sheet").agg(
        F.min_by("cells", "row_no").alias("_h"), F.min("row_no").alias("header_row")
    )
    return first.select(
        "sheet",
        "header_row",
        *[(F.array_position("_h", n) - 1).cast("int").alias(f"at_{i}") for i, n in enumerate(names)],
    )


def sheet_variable_texts(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Variable texts of sheets whose header names the (name, label, comment) columns."""
    at = header_positions(rows, names)
    below = rows.join(at, "sheet").where(F.col("row_no") > F.col("header_row"))
    cell = lambda i: null_if_blank(F.get("cells", F.col(f"at_{i}")))
    return below.select(
        cell(0).alias("variable"), cell(1).alias("label"), F.concat_ws("\n", cell(1), cell(2)).alias("text")
    ).where(F.col("variable").isNotNull())


def text_problems(texts: DataFrame) -> DataFrame:
    """Variables without a label, or listed twice."""
    unlabeled = texts.where(F.col("label").isNull()).select(
        "variable", F.lit("no label").alias("problem")
    )
    twice = not_unique(texts, ["variable"]).select(
        "variable", F.lit("listed twice").alias("problem")
    )
    return unlabeled.unionByName(twice)


def label_texts(rows: DataFrame) -> DataFrame:
    """``<VAR>_LIB`` to the label cell of the line that opens VAR's list: the rows whose
    first two cells both hold text. A code row's first cell is a number."""
    name, label = null_if_blank(_cell(0)), null_if_blank(_cell(1))
    return rows.where(
        name.isNotNull() & label.isNotNull() & name.try_cast("int").isNull()
    ).select(F.concat(name, F.lit("_LIB")).alias("variable"), label.alias("text"))


def column_docs(columns: DataFrame, variables: DataFrame, labels: DataFrame) -> DataFrame:
    """Each column's dictionary text: a variable's, else a code list's label line."""
    v = variables.select(F.col("variable").alias("column_name"), F.col("text").alias("_v"))
    lbl = labels.select(F.col("variable").alias("column_name"), F.col("text").alias("_l"))
    return (
        columns.select("column_name")
        .distinct()
        .join(v, "column_name", "left")
        .join(lbl, "column_name", "left")
        .select("column_name", F.coalesce(F.nullif("_v", F.lit("")), F.col("_l")).alias("text"))
    )


def undocumented(docs: DataFrame) -> DataFrame:
    """Columns the dictionary has no text for."""
    return docs.where(F.col("text").isNull()).select("column_name")
