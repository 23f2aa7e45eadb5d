"""Marts, joins, sums, windows, profiles, checks, samples and draws over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from colscope import contracts
from colscope.functions.hashing import in_sample, surrogate_key
from colscope.functions.ordering import global_row_number
from colscope.functions.text import contains_phrase, sensitivity_or_default
from colscope.operators import (
    catalog_docs,
    grading,
    marts,
    profiles,
    quality,
    ranking,
    sampling,
)
from entries import tables as t
from entries.tables import with_sql

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


GRAIN = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]
_KEY = "concat_ws('|', coalesce(CAST(l_orderkey AS VARCHAR), ''), coalesce(CAST(l_linenumber AS VARCHAR), ''), coalesce(CAST(l_partkey AS VARCHAR), ''), coalesce(CAST(l_suppkey AS VARCHAR), ''), coalesce(l_returnflag, ''))"

# Projections and predicates


@query(
    "p1_contract_cast",
    "SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,"
    " CAST(l_extendedprice AS DECIMAL(18,2)) AS l_extendedprice, CAST(l_quantity AS INTEGER) AS l_quantity,"
    " CAST(l_returnflag AS VARCHAR) AS l_returnflag FROM lineitem",
)
def p1(spark, d):
    contract = {
        "l_orderkey": "bigint",
        "l_linenumber": "bigint",
        "l_extendedprice": "decimal(18,2)",
        "l_quantity": "int",
        "l_returnflag": "string",
    }
    return marts.contract_projection(t.table(spark, d, "lineitem"), contract)


@query(
    "p2_trim_codes",
    f"SELECT trim(o_orderpriority) AS o_orderpriority, md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), trim(o_orderpriority))) AS order_id FROM orders",
)
def p2(spark, d):
    padded = t.table(spark, d, "orders").withColumn(
        "o_orderpriority", F.concat(F.lit(" "), "o_orderpriority", F.lit("  "))
    )
    return marts.staged(
        padded, ["o_orderpriority"], ["o_orderkey", "o_orderpriority"], "order_id"
    ).select("o_orderpriority", "order_id")


@query("p3_surrogate_key", f"SELECT l_orderkey, l_linenumber, md5({_KEY}) AS line_id FROM lineitem")
def p3(spark, d):
    return t.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", surrogate_key(GRAIN).alias("line_id")
    )


@query(
    "p8_filters",
    "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' AND l_suppkey <> 3"
    " AND l_linenumber IN (1, 2, 5) AND l_returnflag NOT IN ('A') GROUP BY 1",
)
def p8(spark, d):
    c = F.col
    kept = t.table(spark, d, "lineitem").where(
        (c("l_linestatus") == "O")
        & (c("l_suppkey") != 3)
        & c("l_linenumber").isin(1, 2, 5)
        & ~c("l_returnflag").isin("A")
    )
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p9_conditional_sum",
    with_sql(
        t.FACT_SQL,
        "SELECT l_linestatus, CAST(sum(CASE WHEN l_returnflag = 'R' THEN price ELSE 0 END) AS DECIMAL(18,2)) AS returned FROM fact GROUP BY 1",
    ),
)
def p9(spark, d):
    return t.fact(spark, d).groupBy("l_linestatus").agg(
        marts.sum_if(F.col("l_returnflag") == "R", "price").alias("returned")
    )


@query(
    "p10_month_codes",
    with_sql(
        t.FACT_SQL,
        "SELECT CAST(care_year || care_month AS INTEGER) AS care, substr(CAST(proc_month AS VARCHAR), 1, 4) AS proc_year,"
        " substr(CAST(proc_month AS VARCHAR), 5, 2) AS proc_code, count(*) AS n FROM fact GROUP BY ALL",
    ),
)
def p10(spark, d):
    f = t.fact(spark, d)
    return f.groupBy(
        marts.month_from_codes("care_year", "care_month").alias("care"),
        marts.year_code("proc_month").alias("proc_year"),
        marts.month_code("proc_month").alias("proc_code"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("p11_documented_flag", with_sql(t.CATALOG_SQL, "SELECT fqn, documented FROM cat"))
def p11(spark, d):
    from colscope.functions.text import is_documented

    return t.catalog(spark, d).select("fqn", is_documented(F.col("description")).alias("documented"))


@query(
    "p12_sensitivity_default",
    with_sql(
        t.CATALOG_SQL,
        "SELECT fqn, coalesce(sensitivity, 'restricted') AS sensitivity, CASE WHEN sensitivity IS NOT NULL THEN low END AS low FROM cat",
    ),
)
def p12(spark, d):
    tag = sensitivity_or_default(F.col("sensitivity"))
    return t.catalog(spark, d).select(
        "fqn", tag.alias("sensitivity"), F.when(tag != "restricted", F.col("low")).alias("low")
    )


@query(
    "p13_phrase_in_text",
    "SELECT p.phrase, count(*) AS n FROM documents d, (SELECT DISTINCT upper(lang) || 'X' AS l, CASE lang WHEN 'en' THEN 'THE ' WHEN 'de' THEN 'UND' WHEN 'fr' THEN 'Les' ELSE 'de la' END AS phrase FROM documents) p"
    " WHERE contains(lower(d.text), lower(p.phrase)) AND p.l = upper(d.lang) || 'X' GROUP BY 1",
)
def p13(spark, d):
    phrase = (
        F.when(F.col("lang") == "en", "THE ")
        .when(F.col("lang") == "de", "UND")
        .when(F.col("lang") == "fr", "Les")
        .otherwise("de la")
    )
    docs = t.table(spark, d, "documents").withColumn("rule_out", F.array(phrase))
    each = docs.select("text", F.explode("rule_out").alias("phrase"))
    return (
        each.where(contains_phrase(F.col("text"), F.col("phrase")))
        .groupBy("phrase")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# Joins


@query(
    "j1_label_join",
    "SELECT n_name AS nation, count(*) AS suppliers, CAST(sum(CAST(s_acctbal AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS balance"
    " FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1",
)
def j1(spark, d):
    s = t.table(spark, d, "supplier").withColumn("bal", F.col("s_acctbal").cast(t.MONEY))
    joined = marts.labeled(
        s, t.table(spark, d, "nation"), "s_nationkey", "n_nationkey", "n_name", "nation"
    )
    return joined.groupBy("nation").agg(
        F.count(F.lit(1)).alias("suppliers"), marts.money_sum("bal").alias("balance")
    )


@query(
    "j2_role_playing_dimension",
    with_sql(
        t.ACTOR_SQL,
        "SELECT c.n_name AS customer_nation, s.n_name AS supplier_nation, CAST(sum(price) AS DECIMAL(18,2)) AS amount"
        " FROM actors JOIN nation c ON c.n_nationkey = cust_nation JOIN nation s ON s.n_nationkey = supp_nation GROUP BY 1, 2",
    ),
)
def j2(spark, d):
    nation = t.table(spark, d, "nation")
    # Sums per pair of actors first, their nations after, and labels last: no join sees the lines.
    pairs = t.fact(spark, d).groupBy("o_custkey", "l_suppkey").agg(marts.money_sum("price").alias("amount"))
    c = t.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("cust_nation"))
    s = t.table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("supp_nation"))
    coded = pairs.join(c, pairs["o_custkey"] == c["c_custkey"]).join(s, pairs["l_suppkey"] == s["s_suppkey"])
    sums = coded.groupBy("cust_nation", "supp_nation").agg(marts.money_sum("amount").alias("amount"))
    one = marts.labeled(sums, nation, "cust_nation", "n_nationkey", "n_name", "customer_nation")
    two = marts.labeled(one, nation, "supp_nation", "n_nationkey", "n_name", "supplier_nation")
    return two.select("customer_nation", "supplier_nation", "amount")


def listed_parts(spark, d):
    return t.table(spark, d, "part").where(F.col("p_size") <= 40).select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("part_label")
    )


_LISTED = "listed AS (SELECT p_partkey AS l_partkey, p_name AS part_label FROM part WHERE p_size <= 40)"
_COMPLETE = f"{_LISTED}, dim AS (SELECT * FROM listed UNION ALL SELECT DISTINCT l_partkey, NULL FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM listed))"


def completed(spark, d):
    return marts.completed_dimension(
        listed_parts(spark, d), t.table(spark, d, "lineitem"), "l_partkey", "part_label"
    )


@query("j3_completed_dimension", with_sql(_COMPLETE, "SELECT l_partkey, part_label FROM dim"))
def j3(spark, d):
    return completed(spark, d)


@query(
    "u1_union_all",
    "SELECT 'customer' AS kind, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_nationkey FROM supplier",
)
def u1(spark, d):
    c = t.table(spark, d, "customer").select(
        F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation")
    )
    s = t.table(spark, d, "supplier").select(
        F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind")
    )
    return c.unionByName(s)


@query("u2_distinct", "SELECT DISTINCT l_partkey, l_returnflag FROM lineitem")
def u2(spark, d):
    return t.table(spark, d, "lineitem").select("l_partkey", "l_returnflag").distinct()


_AGG = "agg AS (SELECT proc_month, l_returnflag, CAST(sum(price) AS DECIMAL(18,2)) AS price, CAST(sum(discount) AS DECIMAL(18,2)) AS discount FROM fact GROUP BY 1, 2)"


def monthly(spark, d):
    return marts.monthly_aggregate(
        t.fact(spark, d), ["proc_month", "l_returnflag"], ["price", "discount"]
    )


@query(
    "j4_aggregate_reconciliation",
    with_sql(
        f"{t.FACT_SQL}, {_AGG}",
        "SELECT proc_month, l_returnflag, CASE WHEN proc_month % 5 = 0 THEN 'missing' WHEN proc_month % 5 = 1 THEN 'unequal' ELSE 'repeated' END AS problem FROM agg WHERE proc_month % 5 < 3",
    ),
)
def j4(spark, d):
    good = monthly(spark, d)
    m = F.col("proc_month") % 5
    # Planted faults: one month in five dropped, one changed, one doubled.
    stored = good.where(m != 0).withColumn(
        "price", F.when(m == 1, F.col("price") + 1).otherwise(F.col("price")).cast(t.MONEY)
    )
    broken = stored.unionByName(stored.where(m == 2))
    return quality.aggregate_mismatches(
        t.fact(spark, d), broken, ["proc_month", "l_returnflag"], ["price", "discount"]
    )


@query(
    "j4_aggregate_reconciliation_clean",
    with_sql(t.FACT_SQL, "SELECT proc_month, l_returnflag, '' AS problem FROM fact WHERE false"),
)
def j4b(spark, d):
    return quality.aggregate_mismatches(
        t.fact(spark, d), monthly(spark, d), ["proc_month", "l_returnflag"], ["price", "discount"]
    )


_ORPHANS = with_sql(
    _LISTED,
    "SELECT l_partkey AS orphan_key, count(*) AS child_rows FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM listed) GROUP BY 1",
)


@query("j5_referential_check", _ORPHANS)
def j5(spark, d):
    return quality.orphans(
        t.table(spark, d, "lineitem"), "l_partkey", listed_parts(spark, d), "l_partkey"
    )


@query("d3_relationships", _ORPHANS)
def d3(spark, d):
    return j5(spark, d)


@query(
    "a26_unlabeled_share",
    with_sql(
        _COMPLETE,
        "SELECT round(avg(CASE WHEN part_label IS NULL THEN 1.0 ELSE 0.0 END), 12) AS unlabeled_share FROM lineitem JOIN dim USING (l_partkey) HAVING avg(CASE WHEN part_label IS NULL THEN 1.0 ELSE 0.0 END) > 0.001",
    ),
)
def a26(spark, d):
    return quality.unlabeled_share(
        t.table(spark, d, "lineitem"), completed(spark, d), "l_partkey", "part_label", 0.001
    ).withColumn("unlabeled_share", F.round("unlabeled_share", 12))


@query(
    "j9_dimension_value_weights",
    "SELECT 'p_brand' AS column_name, p_brand AS value, count(*) AS rows FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 2"
    " UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR), count(*) FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 2",
)
def j9(spark, d):
    counts = profiles.dimension_value_counts(
        t.table(spark, d, "part"), t.table(spark, d, "lineitem"), "p_partkey", "l_partkey", ["p_brand", "p_size"]
    )
    return counts.select("column_name", "value", "rows")


@query(
    "j13_documented_elsewhere",
    with_sql(
        t.CATALOG_SQL,
        "SELECT a.fqn, a.column_name FROM cat a WHERE NOT a.documented AND EXISTS (SELECT 1 FROM cat b WHERE b.documented AND b.column_name = a.column_name AND b.table_name <> a.table_name)",
    ),
)
def j13(spark, d):
    return ranking.documented_elsewhere(t.catalog(spark, d))


def _table_texts(spark, d):
    return t.catalog(spark, d).groupBy("table_name").agg(
        F.when(F.sum("parts") % 2 == 0, F.concat(F.lit("Parts: "), F.sum("parts").cast("string"))).otherwise("  ").alias("table_description")
    )


_ASKED = "asked AS (SELECT DISTINCT p_brand, tbl, CASE WHEN p_size % 2 = 0 THEN lower(tbl) ELSE 'Analytics.\"MARTS\".' || lower(tbl) END AS name FROM parts UNION SELECT p_brand, 'X', 'other.marts.' || tbl FROM parts)"


def _requests(spark, d):
    p = t._names(t.table(spark, d, "part"))
    name = F.when(F.col("p_size") % 2 == 0, F.lower("tbl")).otherwise(
        F.concat(F.lit('Analytics."MARTS".'), F.lower("tbl"))
    )
    return p.select(name.alias("name")).union(
        p.select(F.concat(F.lit("other.marts."), "tbl"))
    ).distinct()


@query(
    "j15_describe_tables",
    with_sql(
        f"{t.CATALOG_SQL}, {_ASKED}, texts AS (SELECT table_name, CASE WHEN sum(parts) % 2 = 0 THEN 'Parts: ' || CAST(sum(parts) AS VARCHAR) END AS table_description FROM cat GROUP BY 1)",
        "SELECT name, c.table_name, table_description, column_name, data_type, nullif(trim(description), '') AS description"
        " FROM asked JOIN cat c ON c.table_name = asked.tbl JOIN texts ON texts.table_name = c.table_name",
    ),
)
def j15(spark, d):
    return catalog_docs.described(
        _requests(spark, d), t.catalog(spark, d), _table_texts(spark, d), t.DATABASE, t.SCHEMA
    )


@query(
    "j15_unknown_tables",
    with_sql(f"{t.CATALOG_SQL}, {_ASKED}", "SELECT DISTINCT name FROM asked WHERE tbl = 'X'"),
)
def j15b(spark, d):
    return catalog_docs.unknown_tables(_requests(spark, d), t.catalog(spark, d), t.DATABASE, t.SCHEMA)


@query("j15_list_tables", with_sql(t.CATALOG_SQL, "SELECT table_name, count(*) AS columns FROM cat GROUP BY 1"))
def j15c(spark, d):
    return catalog_docs.table_list(t.catalog(spark, d))


# Sums, windows, top-k


@query("a1_grouped_sums", with_sql(f"{t.FACT_SQL}, {_AGG}", "SELECT * FROM agg"))
def a1(spark, d):
    return monthly(spark, d)


@query(
    "a2_filtered_sum",
    with_sql(
        t.FACT_SQL,
        "SELECT CAST(sum(price) AS DECIMAL(18,2)) AS amount, CAST(sum(price) FILTER (l_returnflag = 'Z') AS DECIMAL(18,2)) AS none FROM fact WHERE o_orderpriority = '2-HIGH' AND proc_month = 199703",
    ),
)
def a2(spark, d):
    kept = t.fact(spark, d).where("o_orderpriority = '2-HIGH' AND proc_month = 199703")
    return kept.agg(
        marts.money_sum("price").alias("amount"),
        marts.money_sum(F.when(F.col("l_returnflag") == "Z", F.col("price"))).alias("none"),
    )


@query(
    "a3_sum_by_label",
    with_sql(
        t.FACT_SQL,
        "SELECT r_name AS region, CAST(sum(price) AS DECIMAL(18,2)) AS amount FROM fact JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1",
    ),
)
def a3(spark, d):
    # Sums per supplier first: the dimensions join a row a supplier.
    per = t.fact(spark, d).groupBy("l_suppkey").agg(marts.money_sum("price").alias("amount"))
    s = t.table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    n = t.table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    coded = per.join(s, per["l_suppkey"] == s["s_suppkey"]).join(n, s["s_nationkey"] == n["n_nationkey"])
    named = marts.labeled(coded, t.table(spark, d, "region"), "n_regionkey", "r_regionkey", "r_name", "region")
    return named.groupBy("region").agg(marts.money_sum("amount").alias("amount"))


@query(
    "a4_sum_by_month",
    with_sql(t.FACT_SQL, "SELECT proc_month, CAST(sum(price) AS DECIMAL(18,2)) AS amount FROM fact GROUP BY 1 ORDER BY 1"),
)
def a4(spark, d):
    return t.fact(spark, d).groupBy("proc_month").agg(marts.money_sum("price").alias("amount")).orderBy("proc_month")


@query(
    "a5_period_difference",
    with_sql(
        t.FACT_SQL,
        "SELECT CAST(sum(CASE WHEN proc_month = 199703 THEN price ELSE 0 END) - sum(CASE WHEN proc_month = 199701 THEN price ELSE 0 END) AS DECIMAL(18,2)) AS difference FROM fact",
    ),
)
def a5(spark, d):
    return marts.period_difference(t.fact(spark, d), "proc_month", 199703, 199701, "price")


@query(
    "w1_month_on_month",
    with_sql(
        t.FACT_SQL,
        ", m AS (SELECT proc_month, CAST(sum(price) AS DECIMAL(18,2)) AS amount FROM fact GROUP BY 1) SELECT proc_month, CAST(amount - lag(amount) OVER (ORDER BY proc_month) AS DECIMAL(18,2)) AS change FROM m",
    ).replace(" , m AS", ", m AS"),
)
def w1(spark, d):
    from pyspark.sql import Window

    months = t.fact(spark, d).groupBy("proc_month").agg(marts.money_sum("price").alias("amount"))
    # One row per calendar month reaches this window, whatever the fact's size.
    order = Window.orderBy("proc_month")
    return months.select(
        "proc_month", (F.col("amount") - F.lag("amount").over(order)).cast(t.MONEY).alias("change")
    )


@query(
    "w6_top_groups",
    with_sql(
        t.FACT_SQL,
        "SELECT l_suppkey, CAST(sum(price) AS DECIMAL(18,2)) AS amount FROM fact GROUP BY 1 ORDER BY amount DESC, l_suppkey LIMIT 3",
    ),
)
def w6(spark, d):
    per = t.fact(spark, d).groupBy("l_suppkey").agg(marts.money_sum("price").alias("amount"))
    return per.orderBy(F.col("amount").desc(), "l_suppkey").limit(3)


@query(
    "w4_order_key_ties",
    "SELECT l_returnflag, l_suppkey, l_shipdate_text, count(*) AS rows FROM (SELECT *, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate_text FROM lineitem) GROUP BY 1, 2, 3 HAVING count(*) > 1",
)
def w4(spark, d):
    line = t.table(spark, d, "lineitem").withColumn(
        "l_shipdate_text", F.date_format("l_shipdate", "yyyy-MM-dd")
    )
    return grading.tied_keys(line, ["l_returnflag"], ["l_suppkey", "l_shipdate_text"])


@query(
    "w5_limit_cuts_tie",
    "SELECT (SELECT l_quantity FROM lineitem ORDER BY l_quantity DESC LIMIT 1 OFFSET 9) = (SELECT l_quantity FROM lineitem ORDER BY l_quantity DESC LIMIT 1 OFFSET 10) AS cuts_tie",
)
def w5(spark, d):
    return grading.limit_cuts_tie(t.table(spark, d, "lineitem"), [("l_quantity", True)], 10)


@query(
    "w7_row_cap",
    "SELECT o_orderkey AS run_key, row_no, o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 3) AS truncated FROM"
    " (SELECT l_orderkey AS o_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS row_no FROM lineitem) WHERE row_no <= 3",
)
def w7(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = t.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("run_key"), F.row_number().over(order).alias("row_no")
    )
    return catalog_docs.capped_per_run(rows, 3)


@query(
    "w8_canonical_order",
    "SELECT row_number() OVER (ORDER BY c_nationkey, c_mktsegment) AS row_no, c_nationkey, c_mktsegment FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer)",
)
def w8(spark, d):
    pairs = t.table(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct()
    return global_row_number(pairs, [("c_nationkey", False), ("c_mktsegment", False)])


# Profiles

_TEXT = ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_suppkey"]


def text_lines(spark, d):
    line = t.table(spark, d, "lineitem")
    money = lambda c: F.col(c).cast(t.MONEY).cast("string")
    return line.select(
        F.when(F.col("l_linenumber") != 7, money("l_quantity")).alias("l_quantity"),
        money("l_extendedprice").alias("l_extendedprice"),
        F.concat(F.lit("-"), money("l_discount")).alias("l_discount"),
        F.col("l_returnflag").cast("string").alias("l_returnflag"),
        F.col("l_suppkey").cast("string").alias("l_suppkey"),
    )


_LINES = """lines AS (SELECT CASE WHEN l_linenumber <> 7 THEN CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) END AS l_quantity,
  CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS l_extendedprice, '-' || CAST(CAST(l_discount AS DECIMAL(18,2)) AS VARCHAR) AS l_discount,
  l_returnflag, CAST(l_suppkey AS VARCHAR) AS l_suppkey FROM lineitem)"""
_FIELD_PROFILE = " UNION ALL ".join(
    f"SELECT '{f}' AS field, count(*) FILTER ({f} IS NULL) AS empty,"
    f" count(*) FILTER (NOT regexp_full_match({f}, '-?[0-9]*([.][0-9]+)?')) AS non_numeric,"
    f" CAST(coalesce(max(length(split_part(ltrim({f}, '-'), '.', 1))), 0) AS BIGINT) AS integer_digits,"
    f" CAST(coalesce(max(length(split_part({f}, '.', 2))), 0) AS BIGINT) AS scale FROM lines"
    for f in _TEXT
)


@query("a12_field_profile", with_sql(_LINES, _FIELD_PROFILE))
def a12(spark, d):
    return profiles.field_profile(text_lines(spark, d), _TEXT)


@query(
    "d6_declared_type_fits",
    with_sql(
        f"{_LINES}, prof AS ({_FIELD_PROFILE})",
        "SELECT 'l_quantity' AS field, 'empty where NOT NULL' AS problem FROM prof WHERE field = 'l_quantity' AND empty > 0"
        " UNION ALL SELECT 'l_discount', 'integer with decimals' FROM prof WHERE field = 'l_discount' AND scale > 0"
        " UNION ALL SELECT 'l_extendedprice', 'more digits than declared' FROM prof WHERE field = 'l_extendedprice' AND integer_digits > 4",
    ),
)
def d6(spark, d):
    declared = spark.createDataFrame(
        [
            ("l_quantity", "decimal", 18, 2, False),
            ("l_extendedprice", "decimal", 6, 2, False),
            ("l_discount", "int", 18, 0, False),
            ("l_returnflag", "text", 1, 0, False),
            ("l_suppkey", "int", 18, 0, False),
        ],
        "field string, kind string, precision int, type_scale int, nullable boolean",
    )
    return quality.type_misfits(a12(spark, d), declared)


@query(
    "a13_grain_uniqueness",
    "SELECT count(*) AS rows, count(DISTINCT (l_orderkey, l_linenumber, l_partkey)) AS grain_keys FROM lineitem",
)
def a13(spark, d):
    return profiles.grain_counts(
        t.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey"]
    )


@query(
    "d7_grain_never_repeats",
    "SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def d7(spark, d):
    return quality.not_unique(t.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


_PROFILED = ["l_returnflag", "l_suppkey", "l_quantity", "l_linenumber"]


def counts(spark, d):
    line = t.table(spark, d, "lineitem")
    return profiles.value_counts(
        line.select(
            "l_returnflag",
            "l_suppkey",
            F.when(F.col("l_linenumber") != 7, F.col("l_quantity").cast("int")).alias("l_quantity"),
            "l_linenumber",
        ),
        _PROFILED,
    )


_CELLS = """cells AS (SELECT 'l_returnflag' AS column_name, l_returnflag AS value, NULL::DOUBLE AS num FROM lineitem
  UNION ALL SELECT 'l_suppkey', CAST(l_suppkey AS VARCHAR), l_suppkey FROM lineitem
  UNION ALL SELECT 'l_quantity', CASE WHEN l_linenumber <> 7 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END, CASE WHEN l_linenumber <> 7 THEN CAST(l_quantity AS INTEGER) END FROM lineitem
  UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), l_linenumber FROM lineitem)"""
_STATS = "SELECT column_name, count(*) AS rows, round(1 - count(value) / count(*)::DOUBLE, 12) AS null_rate, count(DISTINCT value) AS distinct_count FROM cells GROUP BY 1"
_TOPS = "SELECT column_name, position, value, rows FROM (SELECT column_name, value, count(*) AS rows, row_number() OVER (PARTITION BY column_name ORDER BY count(*) DESC, value) AS position FROM cells WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 11) WHERE position <= 10"
_RANGES = "SELECT column_name, CASE WHEN count(*) >= 22 THEN (list(num ORDER BY num) FILTER (num IS NOT NULL))[11] END AS min, CASE WHEN count(*) >= 22 THEN (list(num ORDER BY num DESC) FILTER (num IS NOT NULL))[11] END AS max FROM cells GROUP BY 1"


@query("a14_column_stats", with_sql(_CELLS, _STATS))
def a14(spark, d):
    return profiles.column_stats(counts(spark, d)).withColumn("null_rate", F.round("null_rate", 12))


@query("a15_top_values", with_sql(_CELLS, _TOPS))
def a15(spark, d):
    return profiles.top_values(counts(spark, d))


@query("a16_clipped_range", with_sql(_CELLS, _RANGES))
def a16(spark, d):
    return profiles.clipped_range(counts(spark, d))


_TAGS = {"l_returnflag": "public", "l_suppkey": "restricted", "l_quantity": "internal"}


def packets(spark, d):
    tagged = profiles.profiles(counts(spark, d))
    tag = F.create_map(*[F.lit(x) for kv in _TAGS.items() for x in kv])
    cols = tagged.select(
        F.concat(F.lit("ANALYTICS.MARTS.LINEITEM."), F.upper("column_name")).alias("fqn"),
        F.lit("LINEITEM").alias("table_name"),
        F.upper("column_name").alias("column_name"),
        F.lit("NUMBER").alias("data_type"),
        F.try_element_at(tag, F.col("column_name")).alias("sensitivity"),
        "profile",
    )
    texts = cols.select("table_name").distinct().withColumn("table_description", F.lit("Order lines"))
    lineage = cols.select("fqn", F.concat(F.lit("SELECT "), "column_name", F.lit(" FROM RAW")).alias("lineage_sql"), F.col("column_name").alias("upstream_expression"))
    return profiles.evidence_packets(cols.drop("profile"), texts, lineage, cols)


_PACKETS = with_sql(
    f"{_CELLS}, s AS ({_STATS}), r AS ({_RANGES}), tp AS ({_TOPS}), tops AS (SELECT column_name, string_agg(value || ':' || CAST(rows AS VARCHAR), ',' ORDER BY position) AS tops FROM tp GROUP BY 1), tags AS (SELECT *, CASE column_name WHEN 'l_returnflag' THEN 'public' WHEN 'l_quantity' THEN 'internal' ELSE 'restricted' END AS sensitivity FROM s)",
    "SELECT 'ANALYTICS.MARTS.LINEITEM.' || upper(column_name) AS fqn, sensitivity, null_rate, distinct_count,"
    " CASE WHEN sensitivity <> 'restricted' THEN min END AS min, CASE WHEN sensitivity <> 'restricted' THEN max END AS max,"
    " CASE WHEN sensitivity <> 'restricted' THEN coalesce(tops, '') ELSE '' END AS tops, 'Order lines' AS table_description, 'SELECT ' || upper(column_name) || ' FROM RAW' AS lineage_sql"
    " FROM tags JOIN r USING (column_name) LEFT JOIN tops USING (column_name)",
)


def _flat_packets(spark, d):
    p = F.col("profile")
    return packets(spark, d).select(
        "fqn",
        "sensitivity",
        F.round(p["null_rate"], 12).alias("null_rate"),
        p["distinct_count"].alias("distinct_count"),
        p["min"].alias("min"),
        p["max"].alias("max"),
        F.array_join(
            F.transform(p["top_values"], lambda x: F.concat(x["value"], F.lit(":"), x["rows"].cast("string"))), ","
        ).alias("tops"),
        "table_description",
        "lineage_sql",
    )


@query("a17_evidence_values_policy", _PACKETS)
def a17(spark, d):
    return _flat_packets(spark, d)


@query("j16_evidence_packets", _PACKETS)
def j16(spark, d):
    bad = profiles.wrong_k(packets(spark, d), profiles.MIN_ROWS).select("fqn")
    return _flat_packets(spark, d).join(bad, "fqn", "left_anti")


# Checks


@query("d1_unique", "SELECT l_partkey, count(*) AS occurrences FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def d1(spark, d):
    return quality.not_unique(t.table(spark, d, "lineitem"), ["l_partkey"])


_NULLS = "SELECT 'p_even' AS column_name, count(*) FILTER (p_size % 2 <> 0) AS nulls FROM part UNION ALL SELECT 'p_third', count(*) FILTER (p_size % 3 <> 0) FROM part"


def _holed(spark, d):
    p = t.table(spark, d, "part")
    return p.select(
        "p_partkey",
        F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("p_even"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_size")).alias("p_third"),
    )


@query("d2_not_null", _NULLS)
def d2(spark, d):
    return quality.null_counts(_holed(spark, d), ["p_partkey", "p_even", "p_third"])


@query(
    "d4_filler_is_empty",
    "SELECT p_partkey, CAST(p_size AS VARCHAR) AS filler FROM part WHERE p_size = 13",
)
def d4(spark, d):
    p = t.table(spark, d, "part").select(
        "p_partkey", F.when(F.col("p_size") == 13, F.col("p_size").cast("string")).alias("filler")
    )
    return quality.filled_fillers(p, "filler", "p_partkey")


@query(
    "d8_restricted_set",
    with_sql(
        t.CATALOG_SQL,
        "SELECT fqn, 'extra' AS problem FROM cat WHERE sensitivity IS NULL AND low % 2 = 1 UNION ALL SELECT fqn, 'missing' FROM cat WHERE sensitivity IS NOT NULL AND low % 5 = 0",
    ),
)
def d8(spark, d):
    c = t.catalog(spark, d)
    restricted = c.where(sensitivity_or_default(F.col("sensitivity")) == "restricted")
    agreed = c.where(
        (F.col("sensitivity").isNull() & (F.col("low") % 2 == 0))
        | (F.col("sensitivity").isNotNull() & (F.col("low") % 5 == 0))
    )
    return quality.set_difference(restricted, agreed, "fqn")


@query(
    "u5_inventory_difference",
    "SELECT p_partkey AS k, 'missing' AS problem FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 1)"
    " UNION ALL SELECT DISTINCT l_partkey, 'extra' FROM lineitem WHERE l_linenumber = 1 AND l_partkey NOT IN (SELECT p_partkey FROM part)",
)
def u5(spark, d):
    sold = t.table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_partkey").alias("k"))
    return quality.set_difference(sold, t.table(spark, d, "part").select(F.col("p_partkey").alias("k")), "k")


@query(
    "d10_documented_equals_lock",
    with_sql(
        t.CATALOG_SQL,
        ", o AS (SELECT fqn, documented, row_number() OVER (ORDER BY sha256('3:' || fqn), fqn) <= (SELECT count(*) // 2 FROM cat) AS locked FROM cat)"
        " SELECT fqn, CASE WHEN locked THEN 'missing' ELSE 'extra' END AS problem FROM o WHERE locked <> documented",
    ).replace(" , o AS", ", o AS"),
)
def d10(spark, d):
    c = t.catalog(spark, d)
    return quality.set_difference(
        c.where("documented"), sampling.half_draw(c.select("fqn"), "fqn", 3), "fqn"
    )


@query(
    "d11_contract_violations",
    with_sql(
        t.CATALOG_SQL,
        "SELECT fqn AS row_key, 'questions_runs_executions' AS rule FROM cat WHERE parts < 3 UNION ALL SELECT fqn, 'fingerprints_within_executions' FROM cat WHERE low % 4 = 0",
    ),
)
def d11(spark, d):
    c = t.catalog(spark, d)
    usage = c.select(
        "fqn",
        F.col("parts").alias("executions_agent"),
        F.lit(0).cast("bigint").alias("executions_human"),
        F.when(F.col("low") % 4 == 0, F.col("parts") + 1).otherwise(1).alias("fingerprints_agent"),
        F.lit(0).cast("bigint").alias("fingerprints_human"),
        F.lit(1).cast("bigint").alias("questions"),
        F.lit(3).cast("bigint").alias("runs"),
    )
    return contracts.violations(usage, contracts.column_usage_rules(), "fqn")


_PARTS = "parts AS (SELECT CAST(p_partkey AS VARCHAR) AS k, p_partkey % 7 AS m, p_size % 4 AS w FROM part)"
_CASES = lambda **rules: " UNION ALL ".join(f"SELECT k AS row_key, '{name}' AS rule FROM parts WHERE {when}" for name, when in rules.items())


@query(
    "d11_attribution_violations",
    with_sql(_PARTS, _CASES(maps_or_failure="m = 1 OR m = 2", cause_covers_labels="m = 3", cause_sums_to_one="m = 4", column_sums_to_one="m = 5 OR m = 6")),
)
def d11b(spark, d):
    """Attributions: both maps and a failure (1), one map alone (2), a cause left out (3), sums other than one (4, 5), no column (6)."""
    m = F.col("p_partkey") % 7
    each = 1.0 / len(contracts.CAUSES)
    whole = F.create_map(*[x for c in contracts.CAUSES for x in (F.lit(c), F.lit(each))])
    short = F.create_map(*[x for c in contracts.CAUSES[1:] for x in (F.lit(c), F.lit(1.0 / (len(contracts.CAUSES) - 1)))])
    high = F.create_map(*[x for c in contracts.CAUSES for x in (F.lit(c), F.lit(each + 0.1))])
    column = F.create_map(F.col("p_name"), F.lit(0.25), F.concat("p_name", F.lit(" too")), F.lit(0.75))
    rows = t.table(spark, d, "part").select(
        "p_partkey",
        F.when(m == 3, short).when(m == 4, high).otherwise(whole).alias("cause"),
        F.when(m == 5, F.create_map(F.col("p_name"), F.lit(0.5))).when(m == 6, F.create_map().cast("map<string,double>")).when(m != 2, column).alias("column"),
        F.when(m == 1, "judge failed").alias("failure"),
    )
    return contracts.violations(rows, contracts.attribution_rules(), "p_partkey")


@query(
    "d11_evidence_violations",
    with_sql(
        _PARTS,
        _CASES(
            restricted_has_no_values="w = 0", sensitivity_known="w = 3", top_values_at_least_k="m = 1", top_values_distinct="m = 2", top_values_ordered="m = 3",
            min_not_above_max="m = 4", null_rate_is_share="m = 5",
        ),
    ),
)
def d11c(spark, d):
    """Evidence with profiles: values shown though restricted, an unknown sensitivity, and each of the profile's rules broken."""
    m = F.col("p_partkey") % 7
    top = lambda value, rows: F.struct(F.lit(value).alias("value"), F.lit(rows).cast("bigint").alias("rows"))
    tops = F.when(m == 1, F.array(top("a", 9), top("b", 2))).when(m == 2, F.array(top("a", 9), top("a", 9))).when(m == 3, F.array(top("b", 9), top("a", 9)))
    profile = F.struct(
        F.lit(5).alias("k"),
        F.when(m == 5, 1.5).otherwise(0.25).alias("null_rate"),
        F.when(m == 4, 3.0).otherwise(1.0).alias("min"),
        F.when(m == 6, None).otherwise(2.0).alias("max"),
        tops.otherwise(F.array(top("a", 9), top("b", 9))).alias("top_values"),
    )
    w = F.col("p_size") % 4
    sensitivity = F.when(w == 0, "restricted").when(w == 1, "public").when(w == 2, "internal").otherwise("secret")
    rows = t.table(spark, d, "part").select("p_partkey", sensitivity.alias("sensitivity"), profile.alias("profile"))
    return contracts.violations(rows, contracts.evidence_rules(), "p_partkey")


@query(
    "d13_identifier_uniqueness",
    with_sql(t.CATALOG_SQL, "SELECT column_name, count(*) AS occurrences FROM cat GROUP BY 1 HAVING count(*) > 1"),
)
def d13(spark, d):
    return quality.not_unique(t.catalog(spark, d), ["column_name"])


@query(
    "d14_input_changes",
    "SELECT k, recorded, current FROM (SELECT p_partkey AS k, CASE WHEN p_size % 7 <> 0 THEN md5(p_name) END AS recorded, CASE WHEN p_size % 5 <> 0 THEN md5(CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_name END) END AS current FROM part)"
    " WHERE recorded IS DISTINCT FROM current",
)
def d14(spark, d):
    p = t.table(spark, d, "part").withColumn("k", F.col("p_partkey"))
    recorded = p.where("p_size % 7 <> 0").select("k", F.md5("p_name").alias("h"))
    current = p.where("p_size % 5 <> 0").select(
        "k", F.md5(F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_name"))).alias("h")
    )
    return quality.changed_inputs(recorded, current, "k", "h")


# Samples and draws

_GRAIN_TEXT = "CAST(l_orderkey AS VARCHAR) || ';' || CAST(l_linenumber AS VARCHAR)"


@query(
    "h1_hash_sample",
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE substr(sha256({_GRAIN_TEXT}), 1, 16) < '051eb851eb851eb8'",
)
def h1(spark, d):
    line = t.table(spark, d, "lineitem")
    return sampling.hash_sample(line, ["l_orderkey", "l_linenumber"], 50).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
    )


@query(
    "h2_sample_subset",
    f"SELECT count(*) FILTER (substr(sha256({_GRAIN_TEXT}), 1, 16) < '000d1b71758e2196') AS small, 0::BIGINT AS outside FROM lineitem",
)
def h2(spark, d):
    line = t.table(spark, d, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    small = sampling.hash_sample(line, keys, 5000)
    outside = sampling.outside_sample(small, sampling.hash_sample(line, keys, 50), keys)
    return small.agg(F.count(F.lit(1)).alias("small")).withColumn(
        "outside", outside.agg(F.count(F.lit(1))).scalar()
    )


@query(
    "h3_hash_split",
    "SELECT qid, CASE WHEN row_number() OVER (ORDER BY sha256('1:' || qid), qid) <= 25 THEN 'discovery' ELSE 'holdout' END AS part FROM (SELECT 'Q' || CAST(c_custkey AS VARCHAR) AS qid FROM customer)",
)
def h3(spark, d):
    ids = t.table(spark, d, "customer").select(
        F.concat(F.lit("Q"), F.col("c_custkey").cast("string")).alias("qid")
    )
    return sampling.split(ids, "qid", 1, 25)


@query(
    "h4_half_draw",
    with_sql(
        t.CATALOG_SQL,
        "SELECT fqn FROM (SELECT fqn, row_number() OVER (ORDER BY sha256('3:' || fqn), fqn) AS r, (SELECT count(*) // 2 FROM cat) AS h FROM cat) WHERE r <= h",
    ),
)
def h4(spark, d):
    return sampling.half_draw(t.catalog(spark, d).select("fqn"), "fqn", 3)


_RANDOM = "SELECT fqn FROM cat WHERE NOT documented ORDER BY sha256('2:' || fqn) LIMIT 10"


def random_n(spark, d):
    return sampling.lowest_digests(t.catalog(spark, d).where("NOT documented"), "fqn", 2, 10).select("fqn")


@query("h5_random_draw", with_sql(t.CATALOG_SQL, _RANDOM))
def h5(spark, d):
    return random_n(spark, d)


@query(
    "h6_draw_size",
    with_sql(
        t.CATALOG_SQL,
        "SELECT count(*) AS u, least(10, count(*) // 2) AS n FROM cat WHERE NOT documented AND parts > 3",
    ),
)
def h6(spark, d):
    return sampling.draw_size(t.catalog(spark, d).where("NOT documented AND parts > 3"), "fqn")
