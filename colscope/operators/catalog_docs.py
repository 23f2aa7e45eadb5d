"""What someone querying the warehouse is shown: tables, columns, types and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colscope.functions.text import bare_table_name, null_if_blank


def table_list(catalog: DataFrame) -> DataFrame:
    """The tables, with their column counts."""
    return catalog.groupBy("table_name").agg(F.count(F.lit(1)).alias("columns"))


def named_table(name: Column, database: str, schema: str) -> Column:
    """The table a reader means: bare or qualified, quoted or not, in any case; null when
    the qualifier is another database or schema."""
    parts = F.split(bare_table_name(name), r"\.")
    n = F.size(parts)
    part = lambda back: F.try_element_at(parts, F.lit(-back))
    fits = (
        (n == 1)
        | ((n == 2) & (part(2) == schema))
        | ((n == 3) & (part(2) == schema) & (part(3) == database))
    )
    return F.when(fits, part(1))


def described(
    requests: DataFrame, catalog: DataFrame, texts: DataFrame, database: str, schema: str
) -> DataFrame:
    """Per requested table: its columns with type and text, null when there is none.

    ``texts`` (table_name, table_description) holds the tables' own descriptions.
    """
    asked = requests.withColumn("table_name", named_table(F.col("name"), database, schema))
    return (
        asked.join(catalog, "table_name")
        .join(texts, "table_name", "left")
        .select(
            "name",
            "table_name",
            null_if_blank(F.col("table_description")).alias("table_description"),
            "column_name",
            "data_type",
            null_if_blank(F.col("description")).alias("description"),
        )
    )


def unknown_tables(
    requests: DataFrame, catalog: DataFrame, database: str, schema: str
) -> DataFrame:
    """Requests that name no catalog table."""
    asked = requests.withColumn("table_name", named_table(F.col("name"), database, schema))
    known = catalog.select("table_name").distinct()
    return asked.join(known, "table_name", "left_anti").select("name")


def row_capped(df: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` rows shown, each with whether the result was longer.

    One row past the cap is fetched, which is all it takes to know.
    """
    fetched = df.limit(cap + 1)
    longer = fetched.agg(F.count(F.lit(1)) > cap).scalar()
    return fetched.limit(cap).withColumn("truncated", longer)


def capped_per_run(rows: DataFrame, cap: int) -> DataFrame:
    """Each run's first ``cap`` rows by row number, with whether the run's result was longer.

    A filter on the row number and an aggregate, so no run is gathered in one task.
    """
    longer = rows.groupBy("run_key").agg((F.max("row_no") > cap).alias("truncated"))
    return rows.where(F.col("row_no") <= cap).join(longer, "run_key")


def lists_in_sheet(rows: DataFrame, opens: Column, blank: Column, name: Column) -> DataFrame:
    """Rows of a sectioned sheet with the list each belongs to.

    A row that ``opens`` starts the list ``name``, a ``blank`` one ends it. ``rows`` has
    sheet and row_no; the window is per sheet, so it is as long as one sheet.
    """
    window = Window.partitionBy("sheet").orderBy("row_no").rowsBetween(
        Window.unboundedPreceding, -1
    )
    marker = F.when(blank, F.struct(F.lit(None).cast("string").alias("list"))).when(
        opens, F.struct(name.alias("list"))
    )
    return rows.withColumn("list", F.last(marker, ignorenulls=True).over(window)["list"])
