"""Token table of canonical query texts: nesting, scope and clause of every token.

One row per token. Every step is a window over one text's tokens, and the table is
partitioned by text once, so no step after the first shuffle moves a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colscope.functions.sqltext import RESERVED, let

# One token of a canonical text: a date part in quotes, a dotted name (which may end in
# a star), a number, a parameter, an operator, or any other character.
_NAME = r'(?:"[^"]*+(?:""[^"]*+)*+"|[\p{L}_][\p{L}\p{N}_$]*)'
TOKEN = (
    rf"'[A-Z]*'|{_NAME}(?:\.{_NAME})*+(?:\.\*)?"
    r"|[0-9]+(?:\.[0-9]+)?|\$[A-Za-z0-9_]+|::|<>|<=|>=|=>|->|\|\||\S"
)
# What opens a clause directly inside a query, and its name.
CLAUSE_OF = {
    "WITH": "with",
    "SELECT": "select",
    "FROM": "from",
    "JOIN": "join",
    "ON": "on",
    "USING": "on",
    "WHERE": "where",
    "GROUP": "group_by",
    "HAVING": "having",
    "QUALIFY": "qualify",
    "ORDER": "order_by",
    "LIMIT": "limit",
    "OFFSET": "limit",
    "FETCH": "limit",
    "UNION": "set",
    "INTERSECT": "set",
    "EXCEPT": "set",
    "MINUS": "set",
}
SET_WORDS = ["UNION", "INTERSECT", "EXCEPT", "MINUS"]
# Functions written without parentheses, and functions whose first
# argument is a date part.
BARE_FUNCTIONS = [
    "CURRENT_DATE",
    "CURRENT_TIME",
    "CURRENT_TIMESTAMP",
    "CURRENT_USER",
    "LOCALTIME",
    "LOCALTIMESTAMP",
    "SYSDATE",
]
PART_FUNCTIONS = [
    "DATEADD",
    "DATEDIFF",
    "DATE_PART",
    "EXTRACT",
    "TIMEADD",
    "TIMEDIFF",
    "TIMESTAMPADD",
    "TIMESTAMPDIFF",
]


def distinct_texts(snapshot: DataFrame) -> DataFrame:
    """(text_id, sql, database_name, schema_name): what attribution depends on.

    Attribution reads the text and the session context only, so it runs once per
    distinct pair and is joined back to the queries. The texts are spread by number, which
    AQE leaves alone: few bytes, much work. Every later window and grouping is by text,
    so this is the only shuffle of the token table.
    """
    width = int(snapshot.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        snapshot.select(
            context_id().alias("text_id"), "normalized_sql", "database_name", "schema_name"
        )
        .distinct()
        .withColumnRenamed("normalized_sql", "sql")
        .repartition(width, "text_id")
    )


# Shapes of canonical text that name columns in ways attribution doesn't follow.
_NAME = r'(?:[A-Z_][A-Z0-9_$]*|"[^"]*")'
_NAMES = rf"\( ?{_NAME}(?: ?, ?{_NAME})* ?\)"
UNFOLLOWED = "|".join(
    (
        r"(?:SELECT|DISTINCT|,|\.) ?\* ?(?:EXCLUDE|EXCEPT|REPLACE|RENAME|ILIKE)\b",  # a changed star
        rf"{_NAME} ?{_NAMES} AS ?\( ?(?:SELECT|WITH)\b",  # a CTE's column list
        rf"(?:FROM|JOIN|,) (?:{_NAME}\.)*{_NAME} AS {_NAME} ?{_NAMES}",  # a table alias's column list
        rf"\) AS {_NAME} ?{_NAMES}",  # a derived table's column list
        r"(?:FROM|JOIN) ?\( ?(?!SELECT\b|WITH\b|VALUES\b)[^()]*(?:\bJOIN\b|,)",  # a join in parentheses
    )
)


# A cast to a type whose arguments are types: AS ARRAY(VARCHAR)) or AS MAP(VARCHAR, NUMBER)).
_TYPE = (
    "(?:VARCHAR|STRING|TEXT|CHAR|NUMBER|DECIMAL|NUMERIC|INTEGER|INT|BIGINT|SMALLINT|TINYINT|FLOAT|DOUBLE|REAL|BOOLEAN"
    "|DATE|TIME|TIMESTAMP|TIMESTAMP_NTZ|TIMESTAMP_LTZ|TIMESTAMP_TZ|BINARY|VARIANT|OBJECT|ARRAY|MAP)"
)
CAST_ARGUMENTS = rf"\bAS (ARRAY|MAP) ?\( ?{_TYPE}(?: ?, ?{_TYPE})? ?\)(?= ?\))"


def without_cast_arguments(sql: Column) -> Column:
    """The text with casts to the bare type, whose arguments look like a column list but name no columns."""
    return F.regexp_replace(sql, CAST_ARGUMENTS, "AS $1")


def unfollowed(sql: Column) -> Column:
    """Whether a text has a shape whose names could only be guessed."""
    return without_cast_arguments(sql).rlike(UNFOLLOWED)


def context_id() -> Column:
    """The key of a text in its session context."""
    return F.sha2(
        F.concat_ws(
            "\u0000",
            F.coalesce("database_name", F.lit("")),
            F.coalesce("schema_name", F.lit("")),
            F.col("normalized_sql"),
        ),
        256,
    )


def token_rows(texts: DataFrame) -> DataFrame:
    """One row per token with its neighbours, read from the array before it is exploded."""
    tokens = F.regexp_extract_all(without_cast_arguments(F.col("sql")), F.lit(TOKEN), F.lit(0))

    def with_neighbours(toks: Column) -> Column:
        return F.transform(
            toks,
            lambda t, i: F.struct(
                i.alias("pos"),
                t.alias("tok"),
                F.get(toks, i - 1).alias("prev"),
                F.get(toks, i - 2).alias("prev2"),
                F.get(toks, i + 1).alias("next"),
                F.get(toks, i + 2).alias("next2"),
            ),
        )

    # Outer, so no filter on the token array is inferred and computed beside it.
    return texts.select(
        "text_id", "database_name", "schema_name", F.inline_outer(let(tokens, with_neighbours))
    ).where(F.col("tok").isNotNull())


def scoped(tokens: DataFrame) -> DataFrame:
    """Each token's depth, enclosing query frame, SELECT scope, clause and list item.

    ``(`` counts as inside its parenthesis and ``)`` as outside, so the token before a
    ``(`` is always in the enclosing one, and the token before a ``)`` in the closed one.
    """
    text = Window.partitionBy("text_id").orderBy("pos")
    so_far = text.rowsBetween(Window.unboundedPreceding, 0)
    opens, closes = F.col("tok") == "(", F.col("tok") == ")"
    leveled = tokens.withColumn("depth", F.sum(opens.cast("int") - closes.cast("int")).over(so_far))

    level = Window.partitionBy("text_id", "depth").orderBy("pos")
    opener = F.when(opens, F.struct("next", "prev"))
    framed = (
        leveled.withColumn("_opener", F.last(opener, ignorenulls=True).over(level))
        .withColumn("opener_prev", F.when(F.col("depth") > 0, F.col("_opener.prev")))
        .withColumn(
            "_in_query",
            (F.col("depth") == 0) | F.col("_opener.next").isin("SELECT", "WITH"),
        )
    )
    opens_query = opens & F.col("next").isin("SELECT", "WITH")
    closing = framed.withColumn(
        "closes_query", closes & F.coalesce(F.lag("_in_query").over(text), F.lit(False))
    ).withColumn(
        "_qdepth",
        F.sum(
            F.coalesce(opens_query, F.lit(False)).cast("int") - F.col("closes_query").cast("int")
        ).over(so_far),
    )
    qlevel = Window.partitionBy("text_id", "_qdepth").orderBy("pos")
    query_opener = F.when(opens_query, F.struct("pos", "depth"))
    queried = (
        closing.withColumn("_q", F.last(query_opener, ignorenulls=True).over(qlevel))
        .withColumn("qframe", F.when(F.col("_qdepth") > 0, F.col("_q.pos")).otherwise(-1))
        .withColumn(
            "at_top",
            F.col("depth") == F.when(F.col("_qdepth") > 0, F.col("_q.depth")).otherwise(0),
        )
        # The query frame a `)` closes, for derived tables, CTEs and subqueries.
        .withColumn("child", F.when(F.col("closes_query"), F.lag("qframe").over(text)))
    )
    frame = Window.partitionBy("text_id", "qframe").orderBy("pos")
    names_cte = (
        F.col("at_top") & F.col("prev").isin("WITH", "RECURSIVE", ",") & ~F.col("tok").isin("(", "RECURSIVE")
    )
    clause_of = F.create_map(*[F.lit(x) for kv in CLAUSE_OF.items() for x in kv])
    placed = (
        queried.withColumn(
            "clause",
            F.last(
                F.when(F.col("at_top"), F.try_element_at(clause_of, F.col("tok"))),
                ignorenulls=True,
            ).over(frame),
        )
        .withColumn(
            "scope",
            F.last(
                F.when(F.col("at_top") & (F.col("tok") == "SELECT"), F.col("pos")),
                ignorenulls=True,
            ).over(frame),
        )
        .withColumn(
            "branch",
            F.count_if(F.col("at_top") & F.col("tok").isin(*SET_WORDS)).over(frame),
        )
        .withColumn(
            "cte_name",
            F.last(
                F.when(names_cte & (F.col("clause") == "with"), F.col("tok")), ignorenulls=True
            ).over(frame),
        )
    )
    # A list item is told apart by the commas and clause words before it in its scope.
    scope = Window.partitionBy("text_id", "qframe", "scope").orderBy("pos")
    breaks = F.col("at_top") & (
        (F.col("tok") == ",") | F.col("tok").isin(*CLAUSE_OF) | (F.col("tok") == "BY")
    )
    itemed = placed.withColumn("item", F.count_if(breaks).over(scope))
    last_of_item = F.coalesce(
        F.lead(F.struct("item", "clause")).over(scope) != F.struct("item", "clause"), F.lit(True)
    )
    return itemed.withColumn("item_end", last_of_item).drop(
        "_opener", "_in_query", "_qdepth", "_q"
    )


def is_reserved(token: Column) -> Column:
    return token.isin(*RESERVED)


def is_name(token: Column) -> Column:
    """A plain, dotted or quoted name."""
    return token.rlike(r'^[\p{L}_"]') & ~is_reserved(token)


def reads_column() -> Column:
    """Whether a scoped token is a column reference, by its place and its neighbours."""
    tok, prev, nxt = F.col("tok"), F.col("prev"), F.col("next")
    no = F.lit(False)
    called = F.coalesce(nxt == "(", no)
    introduced = F.coalesce(prev.isin("AS", "::", ":"), no) | F.coalesce(nxt == "=>", no)
    # A union's trailing ORDER BY names its output.
    trailing = F.col("clause").isin("order_by", "limit") & (F.col("branch") > 0)
    part = F.coalesce((prev == "(") & F.col("prev2").isin(*PART_FUNCTIONS), no)
    starred = tok.endswith(".*")
    typed = F.coalesce(nxt.isin("?") & tok.isin("DATE", "TIME", "TIMESTAMP"), no)
    return (
        is_name(tok)
        & F.col("scope").isNotNull()
        & ~F.col("clause").isin("with", "set")
        & ~called
        & ~introduced
        & ~trailing
        & ~part
        & ~starred
        & ~typed
        & ~tok.isin(*BARE_FUNCTIONS)
        & ~names_source()
    )


def names_source() -> Column:
    """Whether a scoped token names a relation in a FROM or JOIN list."""
    return (
        F.col("at_top")
        & F.col("clause").isin("from", "join", "on")
        & F.coalesce(F.col("prev").isin("FROM", "JOIN", ","), F.lit(False))
        & is_name(F.col("tok"))
        & F.coalesce(F.col("next") != "(", F.lit(True))
    )
