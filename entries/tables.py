"""The driver's tables seen as the operators' inputs, in Spark and as SQL.

The SQL side is written apart from the operators: it states what each text must become
and read, template by template, and lets the engine count.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = datetime(2024, 1, 31)
WINDOW_DAYS = 14
RUN_ID = "run0"
DATABASE, SCHEMA = "ANALYTICS", "MARTS"

_memo: dict[tuple, DataFrame] = {}


def memo(fn):
    """Plans are built once per session and folder; nothing is cached but the plan."""

    def built(spark: SparkSession, d: str) -> DataFrame:
        key = (fn.__name__, spark.sparkContext.applicationId, id(spark), d)
        if key not in _memo:
            _memo[key] = fn(spark, d)
        return _memo[key]

    return built


def forget() -> None:
    """Drop the remembered plans, so their written stages are made again."""
    _memo.clear()


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


MONEY = "decimal(18,2)"


@memo
def fact(spark: SparkSession, d: str) -> DataFrame:
    """The line-grain fact: processing month from the order, care month from the shipment."""
    line, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    return line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "o_custkey",
        F.col("l_quantity").cast(MONEY).alias("qty"),
        F.col("l_extendedprice").cast(MONEY).alias("price"),
        F.col("l_discount").cast(MONEY).alias("discount"),
        F.date_format("o_orderdate", "yyyyMM").cast("int").alias("proc_month"),
        F.date_format("l_shipdate", "yyyy").alias("care_year"),
        F.date_format("l_shipdate", "MM").alias("care_month"),
        "l_returnflag",
        "l_linestatus",
        "o_orderpriority",
        "o_orderstatus",
    )


FACT_SQL = """fact AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey,
    CAST(l_quantity AS DECIMAL(18,2)) AS qty, CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
    CAST(l_discount AS DECIMAL(18,2)) AS discount,
    CAST(strftime(o_orderdate, '%Y%m') AS INTEGER) AS proc_month,
    strftime(l_shipdate, '%Y') AS care_year, strftime(l_shipdate, '%m') AS care_month,
    l_returnflag, l_linestatus, o_orderpriority, o_orderstatus
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@memo
def actor_fact(spark: SparkSession, d: str) -> DataFrame:
    """The fact with both actors' nation codes."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("cust_nation"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("supp_nation"))
    f = fact(spark, d)
    return f.join(c, f["o_custkey"] == c["c_custkey"]).join(s, f["l_suppkey"] == s["s_suppkey"])


ACTOR_SQL = (
    FACT_SQL
    + """, actors AS (
  SELECT fact.*, c_nationkey AS cust_nation, s_nationkey AS supp_nation
  FROM fact JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey)"""
)


# The catalog: a table per part brand, a column per part name in it.


def _names(df: DataFrame) -> DataFrame:
    return df.withColumn("tbl", F.upper(F.replace("p_brand", F.lit("#"), F.lit("_")))).withColumn(
        "col", F.upper(F.replace("p_name", F.lit(" "), F.lit("_")))
    )


@memo
def catalog(spark: SparkSession, d: str) -> DataFrame:
    grouped = (
        _names(table(spark, d, "part"))
        .groupBy(F.col("tbl").alias("table_name"), F.col("col").alias("column_name"))
        .agg(
            F.min("p_type").alias("data_type"),
            F.min("p_size").alias("low"),
            F.count(F.lit(1)).alias("parts"),
        )
    )
    return grouped.select(
        F.concat_ws(".", F.lit(DATABASE), F.lit(SCHEMA), "table_name", "column_name").alias("fqn"),
        "table_name",
        "column_name",
        "data_type",
        F.when(F.col("low") % 2 == 0, F.concat(F.lit("Sizes from "), F.col("low").cast("string")))
        .otherwise("   ")
        .alias("description"),
        F.when(F.col("low") % 3 == 0, "public").when(F.col("low") % 3 == 1, "internal").alias(
            "sensitivity"
        ),
        (F.col("low") % 2 == 0).alias("documented"),
        "low",
        "parts",
    )


CATALOG_SQL = """parts AS (
  SELECT *, upper(replace(p_brand, '#', '_')) AS tbl, upper(replace(p_name, ' ', '_')) AS col
  FROM part), cat AS (
  SELECT 'ANALYTICS.MARTS.' || tbl || '.' || col AS fqn, tbl AS table_name, col AS column_name,
    min(p_type) AS data_type, min(p_size) AS low, count(*) AS parts,
    CASE WHEN min(p_size) % 2 = 0 THEN 'Sizes from ' || CAST(min(p_size) AS VARCHAR) ELSE '   ' END
      AS description,
    CASE min(p_size) % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' END AS sensitivity,
    min(p_size) % 2 = 0 AS documented
  FROM parts GROUP BY tbl, col)"""


# The query history: one query per event, its text from a template over two parts.


@memo
def history(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn(
        "k", F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    )
    p = _names(table(spark, d, "part"))
    one = p.select(F.col("p_partkey").alias("user_id"), "tbl", "col")
    two = p.select(
        (F.col("p_partkey") - 1).alias("user_id"), F.col("tbl").alias("tbl2"), F.col("col").alias("col2")
    )
    j = e.join(one, "user_id").join(two, "user_id")
    t, c, t2, c2 = (F.lower(x) for x in ("tbl", "col", "tbl2", "col2"))
    k = F.col("k").cast("string")
    lit = F.lit
    text = (
        F.when(
            F.col("event_type") == "view",
            F.concat(
                lit("select "), c, lit(", sum("), c2, lit(") from "), t, lit(" where "), c,
                lit(" = '"), k, lit("' group by 1 order by 2 desc"),
            ),
        )
        .when(
            F.col("event_type") == "click",
            F.concat(
                lit("with base as (select * from analytics.marts."), t, lit(" where "), c,
                lit(" in (1, 2, "), k, lit(")) select "), c2, lit(" from base -- note "), k,
            ),
        )
        .when(
            F.col("event_type") == "purchase",
            F.concat(
                lit("select f."), c, lit(", count(*) n from "), t, lit(" f join "), t2,
                lit(" g on g."), c2, lit(" = f."), c, lit(" where g."), c2, lit(" <> "), k,
                lit(" group by f."), c, lit(" having count(*) > 1"),
            ),
        )
        .when(
            F.col("event_type") == "signup",
            F.when(
                F.col("event_id") % 2 == 0,
                F.concat(lit("select * from "), t, lit(" limit "), k),
            ).otherwise(
                F.concat(lit("select * from other_db.raw."), t, lit(" where "), c, lit(" = "), k)
            ),
        )
        .when(
            F.col("event_id") % 5 == 0, F.concat(lit("select from "), t, lit(" where 'x"), k, lit("'"))
        )
        .when(F.col("event_id") % 5 == 1, F.concat(lit("select 1; select "), k))
        .when(F.col("event_id") % 5 == 2, F.concat(lit("alter session set x = "), k))
        .when(F.col("event_id") % 10 == 3, F.concat(lit("select * exclude ("), c2, lit(") from "), t))
        .otherwise(
            F.concat(
                lit("select "), c2, lit(", "), c, lit(" from "), t, lit(" union all select "), c2,
                lit(", "), c2, lit(" from "), t2, lit(" order by 1"),
            )
        )
    )
    agent = F.col("user_id") % 2 == 0
    tag = (
        F.when(F.col("user_id") % 4 == 1, "dashboard:weekly")
        .when(~agent, None)
        .when(F.col("k") % 10 == 0, None)
        .when(F.col("k") % 10 == 1, "agent:broken")
        .otherwise(
            F.concat(
                lit("agent:run"), (F.col("user_id") % 3).cast("string"), lit(":q"),
                F.lpad((F.col("k") % 20).cast("string"), 2, "0"), lit(":"),
                (1 + F.col("event_id") % 3).cast("string"),
            )
        )
    )
    in_session = F.col("user_id") % 10 != 0
    return j.select(
        F.col("event_id").cast("string").alias("query_id"),
        text.alias("query_text"),
        F.col("ts").alias("start_time"),
        F.when(agent, "AGENT_READER").when(F.col("user_id") % 4 == 1, "ANALYST").otherwise("AUDITOR").alias("role_name"),
        tag.alias("query_tag"),
        F.when(F.col("event_type") == "error", "FAIL").otherwise("SUCCESS").alias("execution_status"),
        F.when(in_session, DATABASE).alias("database_name"),
        F.when(in_session, SCHEMA).alias("schema_name"),
    )


HISTORY_SQL = (
    CATALOG_SQL
    + """, ev AS (
  SELECT e.*, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k,
    a.tbl, a.col, b.tbl AS tbl2, b.col AS col2, user_id % 10 <> 0 AS in_session
  FROM events e JOIN parts a ON a.p_partkey = e.user_id JOIN parts b ON b.p_partkey = e.user_id + 1),
hist AS (
  SELECT *, CAST(event_id AS VARCHAR) AS query_id,
    CASE WHEN user_id % 2 = 0 THEN 'AGENT_READER' WHEN user_id % 4 = 1 THEN 'ANALYST' ELSE 'AUDITOR' END AS role,
    CASE WHEN user_id % 2 = 0 THEN 'agent' WHEN user_id % 4 = 1 THEN 'human' END AS actor,
    CASE WHEN user_id % 2 = 0 AND k % 10 > 1 THEN 'run' || CAST(user_id % 3 AS VARCHAR) END AS run_id,
    CASE WHEN user_id % 2 = 0 AND k % 10 > 1 THEN 'q' || lpad(CAST(k % 20 AS VARCHAR), 2, '0') END AS qid,
    CASE WHEN user_id % 2 = 0 AND k % 10 > 1 THEN CAST(1 + event_id % 3 AS BIGINT) END AS repetition,
    user_id % 2 = 0 AND k % 10 = 1 AS malformed,
    event_type <> 'error' AS succeeded,
    CASE event_type
      WHEN 'view' THEN 'SELECT ' || col || ', SUM(' || col2 || ') FROM ' || tbl || ' WHERE ' || col || ' = ? GROUP BY 1 ORDER BY 2 DESC'
      WHEN 'click' THEN 'WITH BASE AS (SELECT * FROM ANALYTICS.MARTS.' || tbl || ' WHERE ' || col || ' IN (?)) SELECT ' || col2 || ' FROM BASE'
      WHEN 'purchase' THEN 'SELECT F.' || col || ', COUNT(*) AS N FROM ' || tbl || ' AS F JOIN ' || tbl2 || ' AS G ON G.' || col2 || ' = F.' || col || ' WHERE G.' || col2 || ' <> ? GROUP BY F.' || col || ' HAVING COUNT(*) > ?'
      WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'SELECT * FROM ' || tbl || ' LIMIT ?'
        ELSE 'SELECT * FROM OTHER_DB.RAW.' || tbl || ' WHERE ' || col || ' = ?' END
      WHEN 'error' THEN CASE WHEN event_id % 10 = 3 THEN 'SELECT * EXCLUDE(' || col2 || ') FROM ' || tbl
        ELSE 'SELECT ' || col2 || ', ' || col || ' FROM ' || tbl || ' UNION ALL SELECT ' || col2 || ', ' || col2 || ' FROM ' || tbl2 || ' ORDER BY 1' END
      ELSE 'SELECT ' || col2 || ', ' || col || ' FROM ' || tbl || ' UNION ALL SELECT ' || col2 || ', ' || col2 || ' FROM ' || tbl2 || ' ORDER BY 1'
    END AS good_text,
    CASE WHEN event_type = 'error' THEN CASE event_id % 5 WHEN 0 THEN 'parse_error'
      WHEN 1 THEN 'multiple_statements' WHEN 2 THEN 'not_a_query' END END AS text_problem
  FROM ev),
snap_all AS (
  SELECT *, CASE WHEN NOT (ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '2024-01-31') THEN 'outside_window'
    WHEN actor IS NULL THEN 'unmapped_role' WHEN malformed THEN 'malformed_tag' ELSE text_problem END AS reason
  FROM hist),
snap AS (SELECT *, good_text AS normalized_sql, sha256(good_text) AS fingerprint FROM snap_all WHERE reason IS NULL)"""
)

# Each template's references, written by hand from its text. A name the first table
# lacks is unresolved, and without a session every bare table is. A changed star gives none.
REFS_SQL = (
    HISTORY_SQL
    + """, has2 AS (SELECT s.*, c.fqn IS NOT NULL AS col2_in_tbl,
    'ANALYTICS.MARTS.' || tbl || '.' || col AS f1, 'ANALYTICS.MARTS.' || tbl || '.' || col2 AS f12,
    'ANALYTICS.MARTS.' || tbl2 || '.' || col2 AS f2
  FROM snap s LEFT JOIN cat c ON c.table_name = s.tbl AND c.column_name = s.col2),
raw_refs AS (
  SELECT query_id, in_session AS ok, f1 AS fqn, col AS plain, unnest(['select', 'where', 'group_by']) AS clause FROM has2 WHERE event_type = 'view'
  UNION ALL SELECT query_id, in_session AND col2_in_tbl, f12, col2, 'select' FROM has2 WHERE event_type = 'view'
  UNION ALL SELECT query_id, true, f1, col, 'where' FROM has2 WHERE event_type = 'click'
  UNION ALL SELECT query_id, col2_in_tbl, f12, col2, 'select' FROM has2 WHERE event_type = 'click'
  UNION ALL SELECT query_id, in_session, f1, 'F.' || col, unnest(['select', 'join', 'group_by']) FROM has2 WHERE event_type = 'purchase'
  UNION ALL SELECT query_id, in_session, f2, 'G.' || col2, unnest(['join', 'where']) FROM has2 WHERE event_type = 'purchase'
  UNION ALL SELECT h.query_id, true, c.fqn, c.column_name, 'select' FROM has2 h JOIN cat c ON c.table_name = h.tbl
    WHERE event_type = 'signup' AND event_id % 2 = 0 AND in_session
  UNION ALL SELECT query_id, false, NULL, '*', 'select' FROM has2 WHERE event_type = 'signup' AND event_id % 2 = 0 AND NOT in_session
  UNION ALL SELECT query_id, in_session AND col2_in_tbl, f12, col2, 'select' FROM has2 WHERE event_type = 'error' AND event_id % 10 <> 3
  UNION ALL SELECT query_id, in_session, f1, col, 'select' FROM has2 WHERE event_type = 'error' AND event_id % 10 <> 3
  UNION ALL SELECT query_id, in_session, f2, col2, 'select' FROM has2 WHERE event_type = 'error' AND event_id % 10 <> 3),
refs_all AS (
  SELECT DISTINCT query_id, CASE WHEN ok THEN 'resolved' ELSE 'unresolved' END AS kind,
    CASE WHEN ok THEN fqn ELSE plain END AS name, clause FROM raw_refs
  UNION ALL SELECT query_id, 'unmanaged', '*', 'select' FROM has2 WHERE event_type = 'signup' AND event_id % 2 = 1
  UNION ALL SELECT query_id, 'unmanaged', col, 'where' FROM has2 WHERE event_type = 'signup' AND event_id % 2 = 1),
refs AS (SELECT query_id, name AS fqn, clause FROM refs_all WHERE kind = 'resolved')"""
)


def actors(spark: SparkSession) -> DataFrame:
    """The configured role map: two rows by configuration, not data."""
    return spark.createDataFrame(
        [("AGENT_READER", "agent"), ("ANALYST", "human")], "role string, actor string"
    )


@memo
def scope_qids(spark: SparkSession, d: str) -> DataFrame:
    """The ranking scope's questions: the first ten numbers events ask."""
    n = F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 20
    return (
        table(spark, d, "events")
        .select(n.alias("n"))
        .where(F.col("n") < 10)
        .distinct()
        .select(F.concat(F.lit("q"), F.lpad(F.col("n").cast("string"), 2, "0")).alias("qid"))
    )


USAGE_SQL = (
    REFS_SQL
    + """, qids AS (SELECT DISTINCT 'q' || lpad(CAST(CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 20 AS VARCHAR), 2, '0') AS qid
  FROM events WHERE CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 20 < 10),
scoped AS (SELECT *, CASE WHEN run_id IS NULL THEN 'untagged' WHEN run_id <> 'run0' THEN 'other_run'
    WHEN qid NOT IN (SELECT qid FROM qids) THEN 'other_question' ELSE 'in_scope' END AS scope_reason FROM snap),
touch AS (SELECT DISTINCT r.query_id, r.fqn, s.actor, s.run_id, s.qid, s.repetition, s.fingerprint
  FROM refs r JOIN scoped s ON s.query_id = r.query_id WHERE s.scope_reason = 'in_scope'),
usage AS (SELECT fqn,
    count(*) FILTER (actor = 'agent') AS executions_agent, count(*) FILTER (actor = 'human') AS executions_human,
    count(DISTINCT fingerprint) FILTER (actor = 'agent') AS fingerprints_agent,
    count(DISTINCT fingerprint) FILTER (actor = 'human') AS fingerprints_human,
    count(DISTINCT qid) FILTER (actor = 'agent') AS questions,
    count(DISTINCT (run_id, qid, repetition)) FILTER (actor = 'agent' AND qid IS NOT NULL) AS runs
  FROM touch GROUP BY fqn),
execs AS (SELECT cat.*, coalesce(executions_agent + executions_human, 0) AS executions
  FROM cat LEFT JOIN usage USING (fqn))"""
)


# Runs: three arms (return flags) answer one question per supplier, once per line number.


@memo
def grades(spark: SparkSession, d: str) -> DataFrame:
    cells = (
        table(spark, d, "lineitem")
        .groupBy(
            F.col("l_returnflag").alias("arm"),
            F.concat(F.lit("Q"), F.col("l_suppkey").cast("string")).alias("qid"),
            F.col("l_linenumber").cast("bigint").alias("repetition"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return cells.select(
        "arm",
        "qid",
        "repetition",
        (F.col("n") % 3 != 0).alias("passed"),
        F.when(
            F.col("n") % 3 == 0,
            F.when(F.col("n") % 2 == 0, "value_mismatch").otherwise("error"),
        ).alias("reason"),
        F.when((F.col("n") % 3 == 0) & (F.col("n") % 2 == 1), F.when(F.col("n") % 5 == 0, "infrastructure").otherwise("sql")).alias("error_cause"),
        "n",
    )


GRADES_SQL = """grades AS (
  SELECT arm, qid, repetition, n, n % 3 <> 0 AS passed,
    CASE WHEN n % 3 = 0 THEN CASE WHEN n % 2 = 0 THEN 'value_mismatch' ELSE 'error' END END AS reason,
    CASE WHEN n % 3 = 0 AND n % 2 = 1 THEN CASE WHEN n % 5 = 0 THEN 'infrastructure' ELSE 'sql' END END AS error_cause
  FROM (SELECT l_returnflag AS arm, 'Q' || CAST(l_suppkey AS VARCHAR) AS qid,
    CAST(l_linenumber AS BIGINT) AS repetition, count(*) AS n FROM lineitem GROUP BY ALL))"""


def with_sql(ctes: str, body: str) -> str:
    return f"WITH {ctes} {body}"
