"""Which catalog columns a text names, by joins: its table names with the catalog's tables, its other names with their columns.

No scope is tracked. A text is cut at its set operations, so that each part's names meet its own tables; a name that
two tables of a part both have, and no qualifier tells apart, is counted as ambiguous and attributed to neither.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = r'(?:[A-Z_][A-Z0-9_$]*|"[^"]*")'
#: A dotted name with the call it directly stands in, and the name it is given if that follows.
MENTION = rf"(?:\b([A-Z_]+)\( ?(?:DISTINCT )?)?({_NAME}(?:\.{_NAME})*(?:\.\*)?)(?: AS ({_NAME}))?"
SET_OPERATIONS = r" (?:UNION(?: ALL)?|INTERSECT|EXCEPT|MINUS) "
#: The calls whose argument is a measure.
AGGREGATES = ("SUM", "AVG", "MIN", "MAX", "MEDIAN")
#: Parentheses within parentheses that are followed when what lies outside all of them is asked for.
NESTING = 8
EXCLUDED = r"\* ?EXCLUDE ?(?:\(([^()]*)\)|(" + _NAME + "))"


def outside_parentheses(sql: Column) -> Column:
    """A text without what stands in parentheses."""
    for _ in range(NESTING):
        sql = F.regexp_replace(sql, r"\([^()]*\)", "")
    return sql


def segments(texts: DataFrame) -> DataFrame:
    """(text_id, part, sql, star, excluded) of each text's parts between set operations, with the session's names.

    ``star``: whether the part selects all columns at its top; ``excluded`` holds the names such a star leaves out,
    which are taken out of the text, since they read nothing.
    """
    parts = texts.select("text_id", "database_name", "schema_name", F.posexplode(F.split("sql", SET_OPERATIONS)).alias("part", "sql"))
    left_out = F.concat_ws(",", F.regexp_extract("sql", EXCLUDED, 1), F.regexp_extract("sql", EXCLUDED, 2))
    top = F.concat(F.lit(" "), outside_parentheses(F.regexp_replace("sql", EXCLUDED, "*")))
    return parts.select(
        "text_id", "part", "database_name", "schema_name",
        F.regexp_replace("sql", EXCLUDED, "*").alias("sql"),
        top.rlike(r"[ (]SELECT (?:DISTINCT )?(?:[^()]*, ?)?\*(?: FROM\b|,|$)").alias("star"),
        F.filter(F.split(left_out, r" ?, ?"), lambda n: n != "").alias("excluded"),
    )


def names(parts: DataFrame) -> DataFrame:
    """(text_id, part, qualifiers, name, alias, measured) of every name in a part, each once."""
    spelled = F.col("sql")
    found = F.arrays_zip(
        *[F.regexp_extract_all(spelled, F.lit(MENTION), F.lit(i)).alias(n) for i, n in ((1, "call"), (2, "name"), (3, "alias"))]
    )
    pieces = F.split("m.name", r"\.")
    return (
        parts.select("text_id", "part", "database_name", "schema_name", F.explode(found).alias("m"))
        .select(
            "text_id", "part", "database_name", "schema_name",
            F.slice(pieces, F.lit(1), F.size(pieces) - 1).alias("qualifiers"),
            F.element_at(pieces, -1).alias("name"),
            F.nullif("m.alias", F.lit("")).alias("alias"),
            F.col("m.call").isin(*AGGREGATES).alias("measured"),
        )
        .distinct()
    )


def mentioned_tables(named: DataFrame, tables: DataFrame) -> DataFrame:
    """(text_id, part, table_name, alias): the catalog's ``tables`` (table_name, database, schema) that a part names.

    What a name leaves unqualified is the session's, and without a session nothing.
    """
    n = F.size("qualifiers")
    schema = F.when(n == 0, F.col("schema_name")).otherwise(F.element_at("qualifiers", -1))
    database = F.when(n < 2, F.col("database_name")).otherwise(F.try_element_at("qualifiers", F.lit(-2)))
    asked = named.select("text_id", "part", F.col("name").alias("table_name"), F.coalesce("alias", "name").alias("alias"), schema.alias("schema"), database.alias("database"))
    return asked.join(tables, ["table_name", "schema", "database"]).select("text_id", "part", "table_name", "alias").distinct()


def mentions(texts: DataFrame, catalog: DataFrame, database: str, schema: str) -> DataFrame:
    """(text_id, fqn, measured, by_star, ambiguous): each catalog column that a distinct text reads.

    ``texts``: text_id, sql, database_name, schema_name (``tokens.distinct_texts``). ``catalog``: fqn, table_name, column_name.
    ``measured``: it stands in an aggregate's call; ``by_star``: a star alone reads it; an ambiguous name has no fqn,
    its name instead in ``name``. Names and tables meet by text, then by (table, column): no text holds more than its own.
    """
    parts = segments(texts)
    named = names(parts)
    tables = catalog.select("table_name", F.lit(schema).alias("schema"), F.lit(database).alias("database")).distinct()
    sources = mentioned_tables(named, tables)
    columns = catalog.select("table_name", F.col("column_name").alias("name"), "fqn")
    owner = F.try_element_at("qualifiers", F.lit(-1))
    hit = (
        named.select("text_id", "part", "name", "measured", owner.alias("owner"), F.array_join("qualifiers", ".").alias("said"))
        .join(sources, ["text_id", "part"])
        .where(F.col("owner").isNull() | (F.col("owner") == F.col("alias")) | (F.col("owner") == F.col("table_name")))
        .join(columns, ["table_name", "name"])
        .groupBy("text_id", "part", "name", "said")
        .agg(F.collect_set("fqn").alias("fqns"), F.bool_or("measured").alias("measured"))
    )
    sure = F.size("fqns") == 1
    by_name = hit.select("text_id", "name", F.when(sure, F.get("fqns", F.lit(0))).alias("fqn"), "measured", F.lit(False).alias("starred"))
    by_star = (
        parts.where("star")
        .select("text_id", "part", "excluded")
        .join(sources, ["text_id", "part"])
        .join(columns, "table_name")
        .where(~F.array_contains("excluded", F.col("name")))
        .select("text_id", "name", "fqn", F.lit(False).alias("measured"), F.lit(True).alias("starred"))
    )
    return (
        by_name.unionByName(by_star)
        .groupBy("text_id", "fqn", F.when(F.col("fqn").isNull(), F.col("name")).alias("name"))
        .agg(F.bool_or("measured").alias("measured"), F.bool_and("starred").alias("by_star"))
        .withColumn("ambiguous", F.col("fqn").isNull())
    )


def question_columns(read: DataFrame, asked: DataFrame, no_trap: DataFrame) -> DataFrame:
    """(qid, columns, measures, measure, half): what each question's queries read, and its one measure.

    ``read``: ``mentions``; ``asked`` (text_id, qid). A question has one measure; with none or several, measure and half are
    null. The half is "no trap" for the measures of ``no_trap`` (fqn), else "filtered".
    """
    per = asked.select("text_id", "qid").distinct().join(read.where("NOT ambiguous"), "text_id")
    counted = per.groupBy("qid", "fqn").agg(F.bool_or("measured").alias("measured"))
    one = counted.groupBy("qid").agg(
        F.count(F.lit(1)).alias("columns"), F.count_if("measured").alias("measures"), F.min(F.when(F.col("measured"), F.col("fqn"))).alias("_first")
    )
    single = one.withColumn("measure", F.when(F.col("measures") == 1, F.col("_first")))
    plain = no_trap.select(F.col("fqn").alias("_plain")).distinct()
    half = F.when(F.col("measure").isNotNull(), F.when(F.col("_plain").isNotNull(), "no trap").otherwise("filtered"))
    return single.join(plain, F.col("measure") == F.col("_plain"), "left").select("qid", "columns", "measures", "measure", half.alias("half"))
