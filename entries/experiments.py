"""Run tables, bands, costs, arm contents, grading and readings."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope import contracts
from colscope.contracts import GRADE_REASONS
from colscope.functions.values import normalized_value
from colscope.operators import experiment, grading, readings, sampling
from colscope.operators.ranking import documented_elsewhere
from colscope.plans.stages import staged
from entries import tables as t
from entries.tables import with_sql
from entries.warehouse import _RANDOM, random_n

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


# Bands


def gated(spark, d):
    docs = t.table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    labels = t.table(spark, d, "labels")
    p = (F.col("n_chars") % 100) / F.lit(100.0)
    failure = F.when(F.col("doc_id") % 9 == 0, "timeout")
    return docs.join(labels, "doc_id", "left").select(
        F.col("lang").alias("arm"),
        F.col("doc_id").cast("string").alias("fqn"),
        F.when(failure.isNull(), p).alias("p_supported"),
        failure.alias("failure"),
        (F.col("quality") == 1).alias("correct"),
    )


_GATED = """gated AS (SELECT lang AS arm, CAST(d.doc_id AS VARCHAR) AS fqn, quality = 1 AS correct,
  CASE WHEN d.doc_id % 9 = 0 THEN 'flagged' WHEN n_chars % 100 >= 80 THEN 'ready' WHEN n_chars % 100 >= 50 THEN 'confirm' ELSE 'flagged' END AS band,
  CASE WHEN d.doc_id % 9 = 0 THEN 'flagged' WHEN n_chars % 100 >= 50 THEN 'ready' ELSE 'flagged' END AS merged
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


@query("p14_bands", with_sql(_GATED, "SELECT arm, band, merged, count(*) AS n FROM gated GROUP BY ALL"))
def p14(spark, d):
    p, f = F.col("p_supported"), F.col("failure")
    return (
        gated(spark, d)
        .groupBy("arm", experiment.band(p, f).alias("band"), experiment.band(p, f, merge=True).alias("merged"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "a25_band_delivery",
    with_sql(
        _GATED,
        "SELECT arm, band, count(*) AS columns, count(*) FILTER (band <> 'flagged') AS delivered, round(avg(CAST(correct AS INTEGER)), 10) AS accuracy FROM gated GROUP BY 1, 2",
    ),
)
def a25(spark, d):
    g = gated(spark, d).withColumn("band", experiment.band(F.col("p_supported"), F.col("failure")))
    return experiment.band_delivery(g).withColumn("accuracy", F.round("accuracy", 10))


@query(
    "a25_monotone_bands",
    with_sql(
        _GATED,
        "SELECT arm, coalesce(avg(CAST(correct AS INTEGER)) FILTER (band = 'ready') >= avg(CAST(correct AS INTEGER)) FILTER (band = 'confirm') AND avg(CAST(correct AS INTEGER)) FILTER (band = 'confirm') >= avg(CAST(correct AS INTEGER)) FILTER (band = 'flagged'), false) AS monotone FROM gated GROUP BY 1",
    ),
)
def a25b(spark, d):
    g = gated(spark, d).withColumn("band", experiment.band(F.col("p_supported"), F.col("failure")))
    return experiment.monotone_bands(experiment.band_delivery(g))


@query(
    "a29_edit_rate",
    "SELECT decision, drafts, drafts / total::DOUBLE AS share FROM (SELECT count(*) AS total FROM labels), (SELECT decision, count(l.doc_id) AS drafts FROM (VALUES ('accepted'), ('edited'), ('rejected')) v(decision) LEFT JOIN labels l ON v.decision = CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'accepted' ELSE 'edited' END GROUP BY 1)",
)
def a29(spark, d):
    decision = (
        F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "accepted").otherwise("edited")
    )
    return experiment.edit_rates(t.table(spark, d, "labels").select(decision.alias("decision")))


# Runs


_MADE = "planned AS (SELECT DISTINCT f.l_returnflag AS configuration, 'Q' || CAST(s_suppkey AS VARCHAR) AS qid, ln.l_linenumber AS repetition FROM supplier, (SELECT DISTINCT l_linenumber FROM lineitem) ln, (SELECT DISTINCT l_returnflag FROM lineitem) f)"


def planned(spark, d):
    """Every (arm, question, repetition) of the run table's own lists, one run each.

    The arms and repetitions are short lists, so they are made inside each question's row.
    """
    line = t.table(spark, d, "lineitem")
    arms = line.agg(F.collect_set("l_returnflag")).scalar()
    reps = line.agg(F.collect_set("l_linenumber")).scalar()
    q = t.table(spark, d, "supplier").select(
        F.concat(F.lit("Q"), F.col("s_suppkey").cast("string")).alias("qid")
    )
    return (
        q.withColumn("_arms", arms)
        .withColumn("_reps", reps)
        .select("qid", "_reps", F.explode("_arms").alias("configuration"))
        .select("qid", "configuration", F.explode("_reps").alias("repetition"))
        .withColumn("repetition", F.col("repetition").cast("bigint"))
        .withColumn("run_key", F.concat_ws("/", "configuration", "qid", F.col("repetition").cast("string")))
    )


def made(spark, d):
    g = t.grades(spark, d).where("n % 11 <> 0")
    return g.select(
        F.concat_ws("/", "arm", "qid", F.col("repetition").cast("string")).alias("run_key"),
        F.when(F.col("n") % 13 != 0, F.col("passed")).alias("passed"),
        (F.col("n") % 4).alias("failed_calls"),
        "error_cause",
        F.when(F.col("n") % 13 == 0, "unsupported value type").alias("harness_error"),
    )


@query(
    "a18_run_counts",
    with_sql(
        f"{t.GRADES_SQL}, {_MADE}, m AS (SELECT * FROM grades WHERE n % 11 <> 0), j AS (SELECT p.*, m.n, m.passed, m.error_cause FROM planned p LEFT JOIN m ON m.arm = p.configuration AND m.qid = p.qid AND m.repetition = p.repetition)",
        "SELECT configuration, count(n) AS runs, count(*) FILTER (passed AND n % 13 <> 0) AS passed, CAST(coalesce(sum(n % 4), 0) AS BIGINT) AS failed_calls,"
        " count(*) FILTER (n % 13 = 0) AS harness_errors, count(*) FILTER (n IS NULL) AS not_made,"
        " count(*) FILTER (error_cause = 'infrastructure') AS infrastructure, count(*) FILTER (error_cause = 'sql') AS sql_errors FROM j GROUP BY 1",
    ),
)
def a18(spark, d):
    counted = experiment.run_counts(planned(spark, d), made(spark, d))
    cause = lambda c: F.coalesce(F.try_element_at("error_causes", F.lit(c)), F.lit(0))
    return counted.withColumns({"infrastructure": cause("infrastructure"), "sql_errors": cause("sql")}).drop(
        "error_causes"
    )


_SCORES = "scores AS (SELECT arm, qid, avg(CAST(passed AS INTEGER)) AS score, count(*) AS repetitions FROM grades GROUP BY 1, 2)"
_PARTS = "parts AS (SELECT qid, CASE WHEN row_number() OVER (ORDER BY sha256('1:' || qid), qid) <= 25 THEN 'discovery' ELSE 'holdout' END AS part FROM (SELECT DISTINCT qid FROM grades))"


def question_parts(spark, d):
    return sampling.split(t.grades(spark, d).select("qid").distinct(), "qid", 1, 25)


@query(
    "a20_accuracy",
    with_sql(
        f"{t.GRADES_SQL}, {_SCORES}, {_PARTS}",
        "SELECT arm, part, round(avg(score), 10) AS accuracy, count(*) AS questions FROM scores JOIN parts USING (qid) GROUP BY 1, 2",
    ),
)
def a20(spark, d):
    scores = experiment.question_scores(t.grades(spark, d))
    return experiment.accuracy(scores, question_parts(spark, d)).withColumn(
        "accuracy", F.round("accuracy", 10)
    )


@query(
    "a20_eligibility",
    with_sql(
        f"{t.GRADES_SQL}, {_SCORES}, m AS (SELECT qid, max(score) FILTER (arm = 'A') AS no_docs, max(score) FILTER (arm = 'R') AS all_docs FROM scores GROUP BY 1)",
        "SELECT qid AS model, round(all_docs - no_docs, 10) AS gap, all_docs BETWEEN 0.5 AND 0.9 AND round(all_docs - no_docs, 12) >= 0.15 AS eligible FROM m",
    ),
)
def a20b(spark, d):
    per = (
        experiment.question_scores(t.grades(spark, d))
        .groupBy(F.col("qid").alias("model"))
        .agg(
            F.max(F.when(F.col("arm") == "A", F.col("score"))).alias("no_docs"),
            F.max(F.when(F.col("arm") == "R", F.col("score"))).alias("all_docs"),
        )
    )
    return experiment.eligibility(per).withColumn("gap", F.round("gap", 10))


@query(
    "a21_flips",
    with_sql(
        t.GRADES_SQL,
        "SELECT g.arm, g.qid, count(*) FILTER (g.passed AND NOT b.passed) AS fail_to_pass, count(*) FILTER (NOT g.passed AND b.passed) AS pass_to_fail"
        " FROM grades g JOIN grades b ON b.arm = 'N' AND b.qid = g.qid AND b.repetition = g.repetition WHERE g.arm <> 'N' GROUP BY 1, 2 HAVING fail_to_pass > 0 OR pass_to_fail > 0",
    ),
)
def a21(spark, d):
    return experiment.flips(t.grades(spark, d), "N")


@query(
    "a23_reason_counts",
    with_sql(
        t.GRADES_SQL,
        "SELECT arm, "
        + ", ".join(f"count(*) FILTER (reason = '{r}') AS {r}" for r in GRADE_REASONS)
        + ", count(*) FILTER (error_cause = 'infrastructure') AS infrastructure FROM grades GROUP BY 1",
    ),
)
def a23(spark, d):
    return experiment.reason_counts(t.grades(spark, d))


def calls(spark, d):
    e = t.table(spark, d, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint")
    return e.select(
        (F.col("user_id") % 5).cast("string").alias("run_id"),
        F.col("event_type").alias("stage"),
        F.when(F.col("user_id") % 2 == 0, "small").otherwise("large").alias("model"),
        F.when(k % 4 == 0, "hit").otherwise("miss").alias("cache"),
        (k * 100).alias("input_tokens"),
        F.when(k % 2 == 0, k * 10).alias("cache_read_tokens"),
        F.when(k % 3 == 0, k * 5).alias("cache_write_tokens"),
        (k * 7).alias("output_tokens"),
    )


@query(
    "a24_call_costs",
    ", c AS ("
    .replace(", c", "WITH c")
    + "SELECT user_id, event_type, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events),"
    " p AS (SELECT CAST(user_id % 5 AS VARCHAR) AS run_id, event_type AS stage, k % 4 = 0 AS hit,"
    " CASE WHEN k % 4 = 0 THEN 0 ELSE ((k * 100 + CASE WHEN k % 2 = 0 THEN k * 10 ELSE 0 END + 2 * CASE WHEN k % 3 = 0 THEN k * 5 ELSE 0 END) * CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE 3.0 END"
    " + k * 7 * CASE WHEN user_id % 2 = 0 THEN 5.0 ELSE 15.0 END)::DOUBLE * 1e-6 END AS cost FROM c)"
    " SELECT run_id, stage, count(*) AS calls, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(sum(cost), 6) AS spend_usd FROM p GROUP BY 1, 2",
)
def a24(spark, d):
    prices = spark.createDataFrame(
        [("small", 1.0, 5.0), ("large", 3.0, 15.0)], "model string, input double, output double"
    )
    return experiment.call_costs(calls(spark, d), prices).withColumn("spend_usd", F.round("spend_usd", 6))


# Row contracts

_GRADE_ROWS = "k AS (SELECT arm || '/' || qid || '/' || CAST(repetition AS VARCHAR) AS row_key, n, repetition, CASE WHEN n % 7 = 0 THEN NOT passed ELSE passed END AS passed, CASE WHEN n % 6 = 3 THEN 'tired' ELSE reason END AS reason FROM grades)"


@query(
    "d11_grade_contract",
    with_sql(
        f"{t.GRADES_SQL}, {_GRADE_ROWS}",
        "SELECT row_key, 'reason_iff_failed' AS rule FROM k WHERE passed <> (reason IS NULL)"
        " UNION ALL SELECT row_key, 'reason_known' FROM k WHERE reason = 'tired'"
        " UNION ALL SELECT row_key, 'repetition_positive' FROM k WHERE repetition = 7",
    ),
)
def d11_grades(spark, d):
    n = F.col("n")
    rows = t.grades(spark, d).select(
        F.concat_ws("/", "arm", "qid", F.col("repetition").cast("string")).alias("run_key"),
        F.when(n % 7 == 0, ~F.col("passed")).otherwise(F.col("passed")).alias("passed"),
        F.when(n % 6 == 3, "tired").otherwise(F.col("reason")).alias("reason"),
        F.when(F.col("repetition") == 7, 0).otherwise(F.col("repetition")).alias("repetition"),
    )
    return contracts.violations(rows, contracts.grade_rules(), "run_key")


@query(
    "d11_gate_contract",
    with_sql(
        _GATED,
        "SELECT fqn AS row_key, 'probability_or_failure' AS rule FROM gated WHERE CAST(fqn AS BIGINT) % 36 = 0"
        " UNION ALL SELECT fqn, 'failure_is_flagged' FROM gated WHERE CAST(fqn AS BIGINT) % 45 = 0"
        " UNION ALL SELECT fqn, 'band_known' FROM gated WHERE CAST(fqn AS BIGINT) % 5 = 0",
    ),
)
def d11_gates(spark, d):
    g, i = gated(spark, d), F.col("fqn").cast("bigint")
    rows = g.withColumn(
        "band", F.when(i % 5 == 0, "later").otherwise(experiment.band(F.col("p_supported"), F.col("failure")))
    ).withColumn("p_supported", F.when(i % 36 == 0, 0.5).otherwise(F.col("p_supported")))
    return contracts.violations(rows, contracts.gate_rules(), "fqn")


@query(
    "d11_draft_contract",
    "WITH w AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS row_key, CASE WHEN doc_id % 3 > 0 THEN text END AS description, CASE WHEN doc_id % 3 = 0 OR doc_id % 7 = 0 THEN 'refused' END AS failure FROM documents)"
    " SELECT row_key, 'description_or_failure' AS rule FROM w WHERE (description IS NULL) = (failure IS NULL)"
    " UNION ALL SELECT row_key, 'description_length' FROM w WHERE length(description) NOT BETWEEN 1 AND 200"
    " UNION ALL SELECT row_key, 'failed_has_no_unknowns' FROM w WHERE failure IS NOT NULL AND doc_id % 2 = 0",
)
def d11_drafts(spark, d):
    i = F.col("doc_id")
    rows = t.table(spark, d, "documents").select(
        i.cast("string").alias("fqn"),
        F.when(i % 3 > 0, F.col("text")).alias("description"),
        F.when((i % 3 == 0) | (i % 7 == 0), "refused").alias("failure"),
        F.when(i % 2 == 0, F.array("lang")).alias("unknowns"),
    )
    return contracts.violations(rows, contracts.draft_rules(), "fqn")


# Bootstrap

_BOOT = (
    f"{t.GRADES_SQL}, {_SCORES}, dd AS (SELECT qid, max(score) FILTER (arm = 'R') - max(score) FILTER (arm = 'A') AS d FROM scores GROUP BY 1 HAVING d IS NOT NULL),"
    " idx AS (SELECT row_number() OVER (ORDER BY qid) - 1 AS i, d FROM dd), n AS (SELECT count(*) AS n FROM idx),"
    " h AS (SELECT j, i, n, sha256('4:' || CAST(j AS VARCHAR) || ':' || CAST(i AS VARCHAR)) AS s FROM range(10000) a(j), idx, n),"
    " fold AS (SELECT j, list_reduce([CAST(0 AS HUGEINT)] || list_transform(range(1, 9), lambda b: CAST(('0x' || substr(s, (8 * (b - 1) + 1)::BIGINT, 8)) AS HUGEINT)), lambda acc, x: (acc * 4294967296 + x) % n) AS pick FROM h),"
    " means AS (SELECT j, avg(d) AS mean FROM fold JOIN idx ON idx.i = pick GROUP BY 1)"
)


def boot_means(spark, d):
    scores = experiment.question_scores(t.grades(spark, d))
    diffs = experiment.score_differences(scores, "R", "A")
    return sampling.bootstrap_means(diffs, "qid", "d", 4, 10_000)


@query("h7_bootstrap_means", with_sql(_BOOT, "SELECT j AS resample, round(mean, 9) + 0.0 AS mean FROM means"))
def h7(spark, d):
    return boot_means(spark, d).select("resample", (F.round("mean", 9) + 0.0).alias("mean"))


@query(
    "w11_percentile_interval",
    with_sql(
        _BOOT,
        ", r AS (SELECT round(mean, 9) + 0.0 AS mean, row_number() OVER (ORDER BY round(mean, 9) + 0.0, j) AS p FROM means), b AS (SELECT max(mean) FILTER (p = 250) AS lower, max(mean) FILTER (p = 9751) AS upper FROM r)"
        " SELECT lower, upper, CASE WHEN lower > 0 THEN 'improves' WHEN upper < 0 THEN 'worse' ELSE 'no difference' END AS verdict FROM b",
    ).replace(" , r AS", ", r AS"),
)
def w11(spark, d):
    means = boot_means(spark, d).withColumn("mean", F.round("mean", 9) + 0.0)
    return sampling.percentile_interval(means, 250, 9751)


# Arms


_TOPN = "topn AS (SELECT fqn FROM cat WHERE NOT documented ORDER BY parts DESC, fqn LIMIT 10), rnd AS (" + _RANDOM + ")"


def top_n(spark, d):
    c = t.catalog(spark, d).where("NOT documented")
    return c.orderBy(F.col("parts").desc(), "fqn").limit(10).select("fqn")


@query(
    "u6_set_overlap",
    with_sql(
        f"{t.CATALOG_SQL}, {_TOPN}",
        "SELECT (SELECT count(*) FROM topn) AS left_size, (SELECT count(*) FROM rnd) AS right_size, (SELECT count(*) FROM topn JOIN rnd USING (fqn)) AS shared",
    ),
)
def u6(spark, d):
    return experiment.overlap(top_n(spark, d), random_n(spark, d), "fqn")


@query(
    "u7_arm_texts",
    with_sql(
        f"{t.CATALOG_SQL}, {_TOPN}",
        "SELECT fqn, CASE WHEN documented THEN description WHEN fqn IN (SELECT fqn FROM topn) AND low % 4 <> 3 THEN 'Draft of ' || column_name END AS text FROM cat",
    ),
)
def u7(spark, d):
    c = t.catalog(spark, d)
    baseline = c.where("documented").select("fqn", F.col("description").alias("text"))
    drafts = c.where("NOT documented").select(
        "fqn",
        F.concat(F.lit("Draft of "), "column_name").alias("description"),
        F.when(F.col("low") % 4 == 3, "flagged").when(F.col("low") % 8 == 1, "ready").otherwise("confirm").alias("band"),
    )
    return experiment.arm_texts(c, baseline, drafts, top_n(spark, d))


@query(
    "j13_picked_shared_names",
    with_sql(
        f"{t.CATALOG_SQL}, {_TOPN}",
        "SELECT a.fqn FROM cat a JOIN topn USING (fqn) WHERE EXISTS (SELECT 1 FROM cat b WHERE b.documented AND b.column_name = a.column_name AND b.table_name <> a.table_name)",
    ),
)
def j13b(spark, d):
    return documented_elsewhere(t.catalog(spark, d)).join(top_n(spark, d), "fqn", "left_semi").select("fqn")


# Grading: each supplier is a question; its gold is the monthly sum per status, a run's
# result the same with columns swapped, rows lost or values changed.


def _long(df, key, cols):
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy("l_linestatus", "l_linenumber")
    vals = F.array(*[normalized_value(F.col(c), df.schema[c].dataType) for c in cols])
    return df.select(F.col(key), F.row_number().over(order).cast("bigint").alias("row_no"), vals.alias("vals"))


@t.memo
def cells(spark, d):
    """The sums that golds and runs are made of, written once: grading reads them six times."""
    summed = (
        t.table(spark, d, "lineitem")
        .groupBy("l_suppkey", "l_linestatus", "l_linenumber")
        .agg(F.sum(F.col("l_extendedprice").cast(t.MONEY)).cast(t.MONEY).alias("amount"))
    )
    return staged(summed, "cells")


def gold_tables(spark, d):
    c = cells(spark, d).withColumn("qid", F.concat(F.lit("Q"), F.col("l_suppkey").cast("string")))
    gold = _long(c, "qid", ["l_linestatus", "l_linenumber", "amount"]).withColumn("variant", F.lit(""))
    twin = c.withColumn("amount", (F.col("amount") + 1).cast(t.MONEY)).where("l_suppkey % 3 = 0")
    other = _long(twin, "qid", ["l_linestatus", "l_linenumber", "amount"]).withColumn("variant", F.lit("plus"))
    rows = gold.unionByName(other)
    heads = rows.groupBy("qid", "variant").agg(
        F.count(F.lit(1)).alias("rows"), F.first(F.size("vals")).alias("width")
    )
    ordered = F.substring("qid", 2, 20).cast("bigint") % 2 == 0
    return heads.withColumn("ordered", ordered), rows


def run_tables(spark, d):
    c = cells(spark, d).withColumn("run_key", F.concat(F.lit("R"), F.col("l_suppkey").cast("string")))
    m = F.col("l_suppkey") % 7
    kept = c.where(~((m == 2) & (F.col("l_linenumber") == 1)))
    changed = kept.withColumn(
        "amount",
        F.when((m == 3) & (F.col("l_linenumber") == 2), F.col("amount") + 5)
        .when(m == 4, F.col("amount") + 1)
        .otherwise(F.col("amount"))
        .cast("double"),
    )
    straight = _long(changed.where("l_suppkey % 7 <> 1"), "run_key", ["l_linestatus", "l_linenumber", "amount"])
    swapped = _long(changed.where("l_suppkey % 7 = 1"), "run_key", ["amount", "l_linenumber", "l_linestatus"])
    rows = straight.unionByName(swapped)
    s = t.table(spark, d, "supplier").select("s_suppkey")
    sk = F.col("s_suppkey")
    counts = rows.groupBy("run_key").agg(F.count(F.lit(1)).alias("rows"))
    runs = s.select(
        F.concat(F.lit("R"), sk.cast("string")).alias("run_key"),
        F.concat(F.lit("Q"), sk.cast("string")).alias("qid"),
        F.lit(1).cast("bigint").alias("repetition"),
        F.when(sk % 7 == 5, "timeout").otherwise("result").alias("outcome"),
        F.when(sk % 7 == 6, 2).otherwise(3).alias("width"),
    ).join(counts, "run_key")
    return runs, rows


_GRADE_SQL = (
    "SELECT 'R' || CAST(s_suppkey AS VARCHAR) AS run_key, 'Q' || CAST(s_suppkey AS VARCHAR) AS qid, 1::BIGINT AS repetition, reason IS NULL AS passed, reason FROM"
    " (SELECT s_suppkey, CASE s_suppkey % 7 WHEN 5 THEN 'timeout' WHEN 6 THEN 'shape_mismatch' WHEN 2 THEN 'row_count_mismatch' WHEN 3 THEN 'value_mismatch'"
    " WHEN 4 THEN CASE WHEN s_suppkey % 3 <> 0 THEN 'value_mismatch' END END AS reason FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem))"
)


@query("g4_grades", _GRADE_SQL)
def g4(spark, d):
    golds, gold_rows = gold_tables(spark, d)
    runs, run_rows = run_tables(spark, d)
    return grading.grades(grading.checks(runs, run_rows, golds, gold_rows))


@query("j10_grade_against_gold", f"SELECT run_key, qid, reason FROM ({_GRADE_SQL.replace('CASE WHEN s_suppkey % 3 <> 0 THEN ' + chr(39) + 'value_mismatch' + chr(39) + ' END', chr(39) + 'value_mismatch' + chr(39))})")
def j10(spark, d):
    golds, gold_rows = gold_tables(spark, d)
    runs, run_rows = run_tables(spark, d)
    own = golds.where("variant = ''"), gold_rows.where("variant = ''")
    return grading.checks(runs, run_rows, *own).select("run_key", "qid", "reason")


@query("j11_accepted_alternatives", f"SELECT run_key, passed FROM ({_GRADE_SQL})")
def j11(spark, d):
    return g4(spark, d).select("run_key", "passed")


@query(
    "g2_shape_and_row_count",
    f"SELECT reason, count(*) AS n FROM ({_GRADE_SQL}) WHERE reason IN ('shape_mismatch', 'row_count_mismatch', 'timeout') GROUP BY 1",
)
def g2(spark, d):
    return (
        j10(spark, d)
        .where(F.col("reason").isin("shape_mismatch", "row_count_mismatch", "timeout"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query("g3_column_orders", f"SELECT run_key FROM ({_GRADE_SQL}) WHERE passed AND CAST(substr(run_key, 2) AS BIGINT) % 7 = 1")
def g3(spark, d):
    # The runs whose columns come swapped pass under another column order only.
    runs, run_rows = run_tables(spark, d)
    golds, gold_rows = gold_tables(spark, d)
    swapped = runs.where("CAST(substring(qid, 2) AS BIGINT) % 7 = 1")
    done = grading.checks(swapped, run_rows, golds.where("variant = ''"), gold_rows.where("variant = ''"))
    return done.where("reason IS NULL").select("run_key")


@query(
    "g1_value_normalization",
    "SELECT tag, val, count(*) AS n FROM (SELECT 'number' AS tag, CAST(CAST(round_even(CAST(CAST(l_extendedprice * 1.375 AS VARCHAR) AS DECIMAL(38,18)), 2) AS DECIMAL(38,2)) AS VARCHAR) AS val FROM lineitem"
    " UNION ALL SELECT 'string', l_returnflag FROM lineitem UNION ALL SELECT 'bool', CASE WHEN l_linenumber = 1 THEN 'true' ELSE 'false' END FROM lineitem"
    " UNION ALL SELECT 'string', strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') FROM lineitem UNION ALL SELECT CASE WHEN l_linenumber = 7 THEN 'null' ELSE 'number' END, CASE WHEN l_linenumber <> 7 THEN CAST(l_linenumber AS VARCHAR) || '.00' END FROM lineitem) GROUP BY 1, 2",
)
def g1(spark, d):
    line = t.table(spark, d, "lineitem").select(
        (F.col("l_extendedprice") * 1.375).alias("price"),
        F.concat(F.lit("  "), "l_returnflag", F.lit("\t")).alias("flag"),
        (F.col("l_linenumber") == 1).alias("first"),
        "l_shipdate",
        F.when(F.col("l_linenumber") != 7, F.col("l_linenumber")).alias("line"),
    )
    vals = F.array(*[normalized_value(F.col(f.name), f.dataType) for f in line.schema])
    return line.select(F.inline(vals)).groupBy("tag", "val").agg(F.count(F.lit(1)).alias("n"))


@query(
    "g5_harness_errors",
    "SELECT 'R' || CAST(s_suppkey AS VARCHAR) AS run_key FROM supplier WHERE s_suppkey % 5 = 0 AND s_suppkey IN (SELECT l_suppkey FROM lineitem)",
)
def g5(spark, d):
    runs, run_rows = run_tables(spark, d)
    odd = F.col("l_suppkey") % 5 == 0
    raw = cells(spark, d).where(odd).select(
        F.concat(F.lit("R"), F.col("l_suppkey").cast("string")).alias("run_key"),
        F.array(normalized_value(F.encode(F.col("l_linestatus"), "utf-8"), spark.range(0).select(F.lit(b"x").alias("b")).schema["b"].dataType)).alias("vals"),
    )
    return grading.unsupported(run_rows.select("run_key", "vals").unionByName(raw))


_SIDES = "a AS (SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R')"


@query(
    "u3_multiset_difference",
    with_sql(
        _SIDES,
        ", ca AS (SELECT l_suppkey, l_linenumber, count(*) AS n FROM a GROUP BY 1, 2), cb AS (SELECT l_suppkey, l_linenumber, count(*) AS n FROM b GROUP BY 1, 2)"
        " SELECT coalesce(ca.n, 0) AS left_rows, coalesce(cb.n, 0) AS right_rows FROM ca FULL OUTER JOIN cb USING (l_suppkey, l_linenumber) WHERE coalesce(ca.n, 0) <> coalesce(cb.n, 0)",
    ).replace(" , ca AS", ", ca AS"),
)
def u3(spark, d):
    line = t.table(spark, d, "lineitem")
    side = lambda f: line.where(F.col("l_returnflag") == f).select("l_suppkey", "l_linenumber")
    return grading.multiset_difference(side("A"), side("R")).select("left_rows", "right_rows")


@query(
    "u4_sequence_difference",
    "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0",
)
def u4(spark, d):
    o = t.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    changed = o.withColumn(
        "o_orderstatus", F.when(F.col("o_orderkey") % 10 == 0, "X").otherwise(F.col("o_orderstatus"))
    )
    return grading.sequence_difference(o, changed, "o_orderkey")


_R3 = """cnt AS (SELECT l_linenumber AS k, CAST(l_quantity AS INTEGER) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC) AS p, lead(n) OVER (PARTITION BY k ORDER BY n DESC) AS following FROM cnt),
tops AS (SELECT k, bool_or(k % 2 = 0 AND p < CASE WHEN k <= 4 THEN 7 ELSE 200 END AND n = following) AS tied, bool_or(k <= 4 AND p = 7 AND n = following) AS cut FROM placed GROUP BY k)"""


@query(
    "r3_gold_rules",
    with_sql(
        _R3,
        "SELECT 'O' || CAST(o_orderpriority AS VARCHAR) AS qid, '' AS variant, 'too many rows' AS problem FROM orders GROUP BY o_orderpriority HAVING count(*) > 200"
        " UNION ALL SELECT 'wide' || r_name, '', 'too many columns' FROM region"
        " UNION ALL SELECT 'list' || n_name, '', 'holds a list or a struct' FROM nation WHERE n_nationkey % 2 = 0"
        " UNION ALL SELECT 'loose' || n_name, '', 'no order for an ordered or limited result' FROM nation WHERE n_nationkey % 5 = 1"
        " UNION ALL SELECT 'T' || CAST(k AS VARCHAR), '', CASE WHEN tied THEN 'two rows tie on the order keys' ELSE 'the limit cuts through a tie' END FROM tops WHERE tied OR cut",
    ),
)
def r3(spark, d):
    """Golds of each kind in one check: long, wide, with lists, without an order, and one a line number, the quantities by
    how many lines have them: ordered if it is even, the first seven up to number four."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("qid")
    head = lambda df, qid, width, rows, ordered=False, limit=None: df.select(
        qid, F.lit("").alias("variant"), F.lit(width).alias("width"), (F.lit(rows) if isinstance(rows, int) else F.col(rows)).cast("bigint").alias("rows"),
        F.lit(ordered).alias("ordered") if isinstance(ordered, bool) else ordered.alias("ordered"),
        (F.lit(limit) if limit is None or isinstance(limit, int) else limit).cast("int").alias("limit_n"),
    )
    o = t.table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    nation, region = t.table(spark, d, "nation"), t.table(spark, d, "region")
    counts = t.table(spark, d, "lineitem").groupBy("l_linenumber", F.col("l_quantity").cast("int").alias("q")).agg(F.count(F.lit(1)).alias("n"))
    tops = counts.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    k = F.col("l_linenumber")
    golds = [
        head(o, name("O", "o_orderpriority"), 2, "n"),
        head(region, name("wide", "r_name"), 6, 1),
        head(nation, name("list", "n_name"), 2, 1),
        head(nation.where("n_nationkey % 5 = 1"), name("loose", "n_name"), 1, 3, limit=3),
        head(tops, name("T", "l_linenumber"), 2, "n", k % 2 == 0, F.when(k <= 4, 7)),
    ]
    listed = nation.withColumn("v", F.when(F.col("n_nationkey") % 2 == 0, F.array("n_name")))
    vals = F.array(*[normalized_value(F.col(c), listed.schema[c].dataType) for c in ("n_name", "v")])
    rows = listed.select(name("list", "n_name"), F.lit("").alias("variant"), vals.alias("vals"))
    keyed = counts.select(name("T", "l_linenumber"), F.lit("").alias("variant"), F.struct((-F.col("n")).alias("k0")).alias("keys"))
    return grading.gold_problems(reduce(DataFrame.unionByName, golds), rows, keyed)


# Readings

_MONTH = {"proc_month": lambda c: c == 199703}
_NATION, _REGION = ("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name")
QUESTIONS = [
    readings.Question("Q01", "month", "Amount processed in March 1997", "price", _MONTH, trap="care_month", rule_out={"care_month": "processed in"}),
    readings.Question(
        "Q02", "provider", "Returned amount per supplier nation", "returned_price", _MONTH, group="supp_nation", label=_NATION,
        trap="customer", accept=("price_by_flag",),
    ),
    readings.Question(
        "Q03", "provider", "Top three customer nations", "price", {"l_returnflag": lambda c: c == "A"}, group="cust_nation", label=_NATION,
        ordered=True, descending=True, top=3, trap="supplier",
    ),
    readings.Question("Q04", "month", "Returned pieces by month of 1996", "returned_qty", {"care_year": lambda c: c == "1996"}, group="care_month", trap="processing_month"),
    readings.Question("Q05", "region", "Returned discounts by supplier region", "returned_disc", {}, group="supp_region", label=_REGION, trap="region_cust", rule_out={"region_part": "supplier"}),
    readings.Question("Q06", "region", "Returned net amount by order region", "returned_net", _MONTH, group="order_region", label=_REGION, trap="region_pay"),
    readings.Question("Q07", "month", "Base by customer band", "base", {"proc_month": lambda c: c == 199610}, group="cust_band", trap="care_month", accept=("base_by_flags",)),
    readings.Question("Q08", "provider", "Base of supplier band 2", "base", {"supp_band": lambda c: c == 2}, trap="customer", rule_out={"care_month": "not by month"}),
]
#: Q02 as a run summed it, by the unfiltered measure, read again with its filtered twin.
REGRADED = readings.with_measure(
    readings.Question("R02", "provider", "", "price", _MONTH, group="supp_nation", label=_NATION), {"price": "returned_price"}
)
TWINS = ("price", "qty", "disc", "net")
ACTORS = ("supp", "cust", "part", "order", "pay", "ship")
_R = lambda: F.col("l_returnflag") == "R"
_R_OR_A = lambda: F.col("l_returnflag").isin("R", "A")
_as = lambda c: lambda: F.col(c)
SWAPS = {
    "price_total": readings.Swap({"returned_price": _as("price")}),
    **{f"{m}_by_flag": readings.Swap({f"returned_{m}": _as(m)}, _R) for m in TWINS},
    "price_returned": readings.Swap({"price": _as("returned_price")}),
    "price_by_flags": readings.Swap({"price": _as("price")}, _R_OR_A),
    "base_by_flags": readings.Swap({"base": _as("base")}, _R_OR_A),
    "care_month": readings.Swap({"proc_month": lambda: F.concat("care_year", "care_month").cast("int")}),
    "processing_month": readings.Swap(
        {"care_year": lambda: F.substring(F.col("proc_month").cast("string"), 1, 4), "care_month": lambda: F.substring(F.col("proc_month").cast("string"), 5, 2)}
    ),
    "customer": readings.Swap({"supp_nation": _as("cust_nation"), "supp_band": _as("cust_band")}),
    "supplier": readings.Swap({"cust_nation": _as("supp_nation"), "cust_band": _as("supp_band")}),
    **{f"region_{a}": readings.Swap({f"{b}_region": _as(f"{a}_region") for b in ACTORS if b != a}) for a in ACTORS},
}


def readings_fact(spark, d):
    """The fact with both actors' bands, a region per actor, and prefiltered twins of four measures.

    A twin is filled for returned lines and for those of the unknown kind, line number 7.
    """
    side = lambda name, p: t.table(spark, d, name).select(
        f"{p[0]}_{p}key", F.col(f"{p[0]}_nationkey").alias(f"{p}_nation"), F.floor(F.col(f"{p[0]}_acctbal") / 2500).cast("int").alias(f"{p}_band")
    )
    c, s = side("customer", "cust"), side("supplier", "supp")
    f = t.fact(spark, d)
    joined = f.join(c, f["o_custkey"] == c["c_custkey"]).join(s, f["l_suppkey"] == s["s_suppkey"])
    regions = dict(zip(ACTORS, ("supp_nation", "cust_nation", "l_partkey", "l_orderkey", "o_custkey", "l_suppkey"), strict=True))
    rows = joined.withColumns({f"{a}_region": F.col(k) % 5 for a, k in regions.items()}).withColumns(
        {"disc": (F.col("price") * F.col("discount")).cast(t.MONEY), "base": (F.col("price") + F.col("qty")).cast(t.MONEY)}
    )
    rows = rows.withColumn("net", (F.col("price") - F.col("disc")).cast(t.MONEY))
    filled = _R() | (F.col("l_linenumber") == 7)
    return rows.withColumns({f"returned_{m}": F.when(filled, F.col(m)).otherwise(F.lit(0).cast(t.MONEY)) for m in TWINS})


@t.memo
def all_reading_rows(spark, d):
    dims = {n: t.table(spark, d, n) for n in ("nation", "region")}
    return readings.result_rows(readings_fact(spark, d), dims, [*QUESTIONS, REGRADED], SWAPS)


def reading_rows(spark, d):
    return all_reading_rows(spark, d).where("qid LIKE 'Q%'")


# The SQL side: each question as a template, each swap as words to put for its columns.
_RF = f"""{t.FACT_SQL}, rf0 AS (SELECT fact.*, c_nationkey AS cust_nation, CAST(floor(c_acctbal / 2500) AS INTEGER) AS cust_band, s_nationkey AS supp_nation, CAST(floor(s_acctbal / 2500) AS INTEGER) AS supp_band,
  s_nationkey % 5 AS supp_region, c_nationkey % 5 AS cust_region, l_partkey % 5 AS part_region, l_orderkey % 5 AS order_region, o_custkey % 5 AS pay_region, l_suppkey % 5 AS ship_region,
  CAST(price * discount AS DECIMAL(18,2)) AS disc, CAST(price + qty AS DECIMAL(18,2)) AS base, l_returnflag = 'R' OR l_linenumber = 7 AS filled
  FROM fact JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey),
rf1 AS (SELECT *, CAST(price - disc AS DECIMAL(18,2)) AS net FROM rf0),
rf AS (SELECT *, CASE WHEN filled THEN price ELSE 0 END AS returned_price, CASE WHEN filled THEN qty ELSE 0 END AS returned_qty, CASE WHEN filled THEN disc ELSE 0 END AS returned_disc, CASE WHEN filled THEN net ELSE 0 END AS returned_net FROM rf1)"""
_TEMPLATES = {
    "Q01": ("price", "proc_month = 199703", "", "", ""),
    "Q02": ("returned_price", "proc_month = 199703", "supp_nation", "n_name FROM nation WHERE n_nationkey", ""),
    "Q03": ("price", "l_returnflag = 'A'", "cust_nation", "n_name FROM nation WHERE n_nationkey", " ORDER BY amount DESC, grp LIMIT 3"),
    "Q04": ("returned_qty", "care_year = '1996'", "care_month", "", ""),
    "Q05": ("returned_disc", "true", "supp_region", "r_name FROM region WHERE r_regionkey", ""),
    "Q06": ("returned_net", "proc_month = 199703", "order_region", "r_name FROM region WHERE r_regionkey", ""),
    "Q07": ("base", "proc_month = 199610", "cust_band", "", ""),
    "Q08": ("base", "supp_band = 2", "", "", ""),
}
_WORDS = {
    "price_total": ({"returned_price": "price"}, ""),
    **{f"{m}_by_flag": ({f"returned_{m}": m}, " AND l_returnflag = 'R'") for m in TWINS},
    "price_returned": ({"price": "returned_price"}, ""),
    "price_by_flags": ({"price": "price"}, " AND l_returnflag IN ('R', 'A')"),
    "base_by_flags": ({"base": "base"}, " AND l_returnflag IN ('R', 'A')"),
    "care_month": ({"proc_month": "CAST(care_year || care_month AS INTEGER)"}, ""),
    "processing_month": ({"care_year": "substr(CAST(proc_month AS VARCHAR), 1, 4)", "care_month": "substr(CAST(proc_month AS VARCHAR), 5, 2)"}, ""),
    "customer": ({"supp_nation": "cust_nation", "supp_band": "cust_band"}, ""),
    "supplier": ({"cust_nation": "supp_nation", "cust_band": "supp_band"}, ""),
    **{f"region_{a}": ({f"{b}_region": f"{a}_region" for b in ACTORS if b != a}, "") for a in ACTORS},
}


def _reading_sql(qid, variant):
    """One reading as SQL, or none if it reads none of the swap's columns."""
    measure, where, group, label, tail = _TEMPLATES[qid]
    words, more = _WORDS.get(variant, ({}, ""))
    swapped = lambda text: re.sub(r"\b\w+\b", lambda m: words.get(m[0], m[0]), text)
    read = set(re.findall(r"\w+", f"{measure} {where} {group}"))
    if variant and not read & set(words):
        return None
    grp = f"(SELECT {label} = {swapped(group)})" if label else f"CAST({swapped(group)} AS VARCHAR)" if group else "NULL"
    by = " GROUP BY 3" if group else ""
    return f"SELECT * FROM (SELECT '{qid}' AS qid, '{variant}' AS variant, {grp} AS grp, CAST(sum({swapped(measure)}) AS DECIMAL(18,2)) AS amount FROM rf WHERE {swapped(where)}{more}{by}{tail})"


_READ = [(q, v) for q in _TEMPLATES for v in ("", *sorted(_WORDS)) if _reading_sql(q, v)]
_R1 = f"{_RF}, rr AS (" + " UNION ALL ".join(_reading_sql(q, v) for q, v in _READ) + ")"
_DECLARED = {("Q01", "care_month"): "rule_out", ("Q02", "price_by_flag"): "accept", ("Q05", "region_part"): "rule_out", ("Q07", "base_by_flags"): "accept", ("Q08", "care_month"): "rule_out"}
_TRAPS = {("Q01", "care_month"), ("Q02", "customer"), ("Q03", "supplier"), ("Q04", "processing_month"), ("Q05", "region_cust"), ("Q06", "region_pay"), ("Q07", "care_month"), ("Q08", "customer")}
_SAYS = ", ".join(
    f"('{q}', '{v}', '{_DECLARED.get((q, v), '')}', {str((q, v) in _TRAPS).lower()})" for q in _TEMPLATES for v in sorted(_WORDS) if (q, v) in _READ or (q, v) in _DECLARED
)


@query("r1_reading_swaps", with_sql(_R1, "SELECT qid, variant, grp, amount FROM rr"))
def r1(spark, d):
    return reading_rows(spark, d)


@query(
    "r2_readings_matrix",
    with_sql(
        _R1,
        f", says(qid, variant, declared, trap) AS (VALUES {_SAYS}), cmp AS (SELECT v.*, EXISTS (SELECT 1 FROM rr a WHERE a.qid = v.qid AND a.variant = v.variant) AS read,"
        " NOT EXISTS ((SELECT grp, amount FROM rr a WHERE a.qid = v.qid AND a.variant = v.variant) EXCEPT ALL (SELECT grp, amount FROM rr g WHERE g.qid = v.qid AND g.variant = ''))"
        " AND (SELECT count(*) FROM rr a WHERE a.qid = v.qid AND a.variant = v.variant) = (SELECT count(*) FROM rr g WHERE g.qid = v.qid AND g.variant = '') AS same FROM says v)"
        " SELECT qid, variant, CASE WHEN read THEN same END AS same, CASE WHEN NOT read THEN 'declared, reads none of its columns' WHEN declared = '' AND NOT same THEN 'changes the result, not declared'"
        " WHEN declared = 'accept' AND same THEN 'accepted, gives the gold''s result' WHEN trap AND same THEN 'trap gives the gold''s result' END AS problem FROM cmp",
    ).replace(" , says", ", says"),
)
def r2(spark, d):
    declared = [
        (q.id, name, "accept" if name in q.accept else "rule_out" if name in q.rule_out else "", name == q.trap)
        for q in QUESTIONS
        for name in SWAPS
    ]
    table = spark.createDataFrame(declared, "qid string, variant string, declared string, trap boolean")
    return readings.reading_matrix(reading_rows(spark, d), table)


@query(
    "r4_measure_regrade",
    with_sql(_R1, "SELECT 'Q02' AS qid, count(*) AS groups, true AS same FROM rr WHERE qid = 'Q02' AND variant = ''"),
)
def r4(spark, d):
    # Graded against the gold: its groups and amounts, group by group.
    rows = all_reading_rows(spark, d).where("variant = ''").groupBy("grp").agg(
        *[F.max(F.when(F.col("qid") == q, F.col("amount"))).alias(q) for q in ("Q02", "R02")],
        *[F.count_if(F.col("qid") == q).alias(f"n_{q}") for q in ("Q02", "R02")],
    )
    own = rows.where("n_Q02 + n_R02 > 0")
    equal = (F.col("n_Q02") == F.col("n_R02")) & F.col("Q02").eqNullSafe(F.col("R02"))
    return own.agg(F.count_if(equal).alias("groups"), F.coalesce(F.bool_and(equal), F.lit(False)).alias("same")).select(
        F.lit("Q02").alias("qid"), "groups", "same"
    )


_QS = (
    "qs AS (SELECT s_suppkey AS k, 'Q' || CAST(s_suppkey % 37 + 2 * (s_suppkey % 37 // 20) AS VARCHAR) AS qid, 'c' || CAST(s_nationkey % 6 AS VARCHAR) AS category, 'm' || CAST(s_suppkey % 6 AS VARCHAR) AS measure, 't' || CAST(s_nationkey % 10 AS VARCHAR) AS trap, CASE WHEN s_suppkey % 2 = 0 THEN 'filtered' ELSE 'plain' END AS half,"
    " (s_suppkey % 2 = 0)::INT + (s_suppkey % 3 = 0)::INT + (s_suppkey % 5 = 0)::INT AS settled FROM supplier),"
    " nums AS (SELECT DISTINCT CAST(substr(qid, 2) AS BIGINT) AS n FROM qs), marked AS (SELECT n, n - row_number() OVER (ORDER BY n) AS shift FROM nums)"
)


@query(
    "r5_question_balance",
    with_sql(
        _QS,
        "SELECT 'half size' AS rule, half AS detail, count(*) AS found FROM qs GROUP BY half HAVING count(*) <> 20"
        " UNION ALL SELECT 'measure cap', measure, count(*) FROM qs WHERE half = 'filtered' GROUP BY measure HAVING count(*) > 6"
        " UNION ALL SELECT 'category minimum', category, count(*) FROM qs GROUP BY category HAVING count(*) < 5"
        " UNION ALL SELECT 'trap minimum', trap, count(*) FROM qs GROUP BY trap HAVING count(*) < 4"
        " UNION ALL SELECT 'repeated id', qid, count(*) FROM qs GROUP BY qid HAVING count(*) > 1"
        " UNION ALL SELECT 'gap before id', 'Q' || CAST(min(n) AS VARCHAR), count(*) FROM marked GROUP BY shift HAVING min(n) > 1"
        " UNION ALL SELECT 'settles fewer than two', qid, settled FROM qs WHERE settled < 2"
        " UNION ALL SELECT 'pilot id', qid, count(*) FROM qs WHERE qid IN (SELECT 'Q' || CAST(n_nationkey * 3 AS VARCHAR) FROM nation) GROUP BY qid"
        " UNION ALL SELECT 'pilot text', qid, count(*) FROM qs WHERE k % 11 = 0 AND k IN (SELECT n_nationkey * 11 FROM nation) GROUP BY qid",
    ),
)
def r5(spark, d):
    s = t.table(spark, d, "supplier")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    k = F.col("s_suppkey")
    number = k % 37 + 2 * F.floor(k % 37 / 20)
    swap = lambda n, name: F.when(k % n == 0, name)
    qs = s.select(
        text("Q", number).alias("qid"),
        text("c", F.col("s_nationkey") % 6).alias("category"),
        text("m", k % 6).alias("measure"),
        text("t", F.col("s_nationkey") % 10).alias("trap"),
        F.when(k % 2 == 0, "filtered").otherwise("plain").alias("half"),
        F.array_compact(F.array(swap(2, "care_month"), swap(3, "region_cust"), swap(5, "supplier"), F.lit("price_total"))).alias("ruled_out"),
        text("How much is ", k).alias("text"),
    )
    pilot = t.table(spark, d, "nation").select(text("Q", F.col("n_nationkey") * 3).alias("qid"), text("HOW MUCH IS ", F.col("n_nationkey") * 11).alias("text"))
    limits = {"per_half": 20, "max_per_measure": 6, "min_per_category": 5, "min_per_trap": 4}
    return readings.balance_problems(qs, limits, pilot)


@query(
    "a19_regrade_counts",
    f"WITH g AS ({_GRADE_SQL}), r AS (SELECT g.*, CAST(substr(qid, 2) AS BIGINT) AS sk FROM g)"
    " SELECT 'C' || CAST(sk % 4 AS VARCHAR) AS configuration, count(*) FILTER (sk % 11 <> 0 AND sk % 13 <> 0 AND CASE WHEN sk % 7 = 5 THEN true ELSE passed END) AS passed,"
    " count(*) FILTER (sk % 11 <> 0) AS graded, count(*) FILTER (sk % 11 = 0) AS other_text FROM r GROUP BY 1",
)
def a19(spark, d):
    golds, gold_rows = gold_tables(spark, d)
    runs, run_rows = run_tables(spark, d)
    again = grading.grades(grading.checks(runs, run_rows, golds, gold_rows))
    sk = F.substring("qid", 2, 20).cast("bigint")
    listed = runs.select(
        F.concat(F.lit("C"), (sk % 4).cast("string")).alias("configuration"),
        "run_key",
        "qid",
        F.concat(F.lit("ask "), "qid", F.when(sk % 11 == 0, " old").otherwise("")).alias("asked"),
        F.lit(True).alias("recorded_passed"),
        (sk % 7 != 5).alias("has_rows"),
        (sk % 13 == 0).alias("harness_error"),
    )
    questions = runs.select("qid", F.concat(F.lit("ask "), "qid").alias("text")).distinct()
    return experiment.regrade_counts(listed, questions, again)
