"""Snapshot, attribution, usage, coverage and ranking over the event history."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from colscope import contracts
from colscope.contracts import DROP_REASONS, REFERENCE_KINDS
from colscope.functions.sqltext import normalize, normalize_once
from colscope.operators import experiment, lineage, mentions, ranking, snapshot, tokens, usage
from colscope.plans import gaps, report
from colscope.plans.stages import shared_folder, staged
from colscope.sources import history as history_source
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


@t.memo
def analysis_parts(spark, d):
    """The references stage, written once."""
    return staged(lineage.query_references(records(spark, d), texts(spark, d)), "references")


@t.memo
def texts(spark, d):
    """The analysed texts stage, written once."""
    found = lineage.analysed(tokens.distinct_texts(records(spark, d)), t.catalog(spark, d))
    return staged(found, "texts")


@t.memo
def classified(spark, d):
    """The snapshot stage, dropped rows included, written once."""
    rows = snapshot.classified(t.history(spark, d), t.actors(spark), t.AS_OF, t.WINDOW_DAYS)
    return staged(rows, "snapshot")


def records(spark, d):
    return snapshot.kept_records(classified(spark, d))


def refs(spark, d):
    return lineage.column_refs(analysis_parts(spark, d))


def scoped(spark, d):
    return usage.with_scope(records(spark, d), t.RUN_ID, t.scope_qids(spark, d))


def touches(spark, d):
    return usage.touched(refs(spark, d), scoped(spark, d).where("scope_reason = 'in_scope'"))


@t.memo
def used(spark, d):
    counted = scoped(spark, d).where("scope_reason = 'in_scope'")
    return usage.column_usage(usage.touched_by_text(texts(spark, d), counted))


@t.memo
def executions(spark, d):
    return usage.catalog_executions(t.catalog(spark, d), used(spark, d))


@t.memo
def ranked(spark, d):
    return ranking.ranked_gaps(executions(spark, d), 1.0)


@query(
    "s5_history_contract",
    with_sql(
        t.HISTORY_SQL,
        "SELECT CASE WHEN event_id % 7 = 0 THEN 'EXECUTION_STATUS' WHEN event_id % 11 = 0 THEN 'DATABASE_NAME' END AS bad_field,"
        " count(*) AS n, count(DISTINCT query_id) AS ids FROM hist GROUP BY 1",
    ),
)
def s5(spark, d):
    h = t.history(spark, d).withColumn("n", F.col("query_id").cast("bigint"))
    line = F.to_json(
        F.struct(
            F.col("query_id").alias("QUERY_ID"),
            F.col("query_text").alias("QUERY_TEXT"),
            F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("START_TIME"),
            F.col("role_name").alias("ROLE_NAME"),
            F.col("query_tag").alias("QUERY_TAG"),
            F.when(F.col("n") % 7 == 0, "RUNNING").otherwise(F.col("execution_status")).alias("EXECUTION_STATUS"),
            F.when(F.col("n") % 11 == 0, "lower").otherwise(F.col("database_name")).alias("DATABASE_NAME"),
            F.col("schema_name").alias("SCHEMA_NAME"),
        ),
        {"ignoreNullFields": "false"},
    )
    path = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    h.select(line).write.text(path)
    good, bad = history_source.read_history(spark, path)
    kept = good.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("query_id").alias("ids")).select(F.lit(None).cast("string").alias("bad_field"), "n", "ids")
    return kept.unionByName(
        bad.groupBy("bad_field").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file", "line").alias("ids"))
    )


@query(
    "p4_time_window",
    "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-17' AND ts < TIMESTAMP '2024-01-31' GROUP BY 1",
)
def p4(spark, d):
    e = t.table(spark, d, "events")
    kept = e.where(snapshot.in_window(F.col("ts"), t.AS_OF, t.WINDOW_DAYS))
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p5_role_to_actor",
    with_sql(t.HISTORY_SQL, "SELECT role, actor, count(*) AS n FROM hist GROUP BY 1, 2"),
)
def p5(spark, d):
    rows = snapshot.with_actor(t.history(spark, d), t.actors(spark))
    return rows.groupBy(F.col("role_name").alias("role"), "actor").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p6_query_tag",
    with_sql(
        t.HISTORY_SQL,
        "SELECT CASE WHEN malformed THEN 'malformed' WHEN run_id IS NULL THEN 'untagged' ELSE 'agent' END AS outcome,"
        " run_id, qid, repetition, count(*) AS n FROM hist GROUP BY ALL",
    ),
)
def p6(spark, d):
    tag = F.col("query_tag")
    h = t.history(spark, d).withColumn("outcome", snapshot.tag_outcome(tag)).withColumns(
        snapshot.tag_fields(tag)
    )
    return h.groupBy("outcome", "run_id", "qid", "repetition").agg(F.count(F.lit(1)).alias("n"))


_REASONS = ", ".join(f"('{r}')" for r in DROP_REASONS)


@query(
    "p7_drop_reasons",
    with_sql(
        t.HISTORY_SQL,
        f"SELECT r.reason, count(s.query_id) AS dropped FROM (VALUES {_REASONS}) r(reason)"
        " LEFT JOIN snap_all s ON s.reason = r.reason GROUP BY 1",
    ),
)
def p7(spark, d):
    return snapshot.drops(classified(spark, d))


_GOOD = with_sql(
    t.HISTORY_SQL,
    "SELECT query_id, good_text AS normalized_sql FROM hist WHERE text_problem IS NULL",
)


@t.memo
def _normalized_all(spark, d):
    """Every text of the history, whatever its window or role, written once."""
    h = t.history(spark, d)
    found = snapshot.normalized_texts(h)
    keyed = h.select("query_id", snapshot.text_id(F.col("query_text")).alias("raw_id"))
    return staged(keyed.join(found, "raw_id"), "normalized")


@query("l1a_redact", _GOOD)
def l1a(spark, d):
    return _normalized_all(spark, d).where("problem IS NULL").select("query_id", "normalized_sql")


@query(
    "l1b_in_list_collapse",
    with_sql(
        t.HISTORY_SQL,
        "SELECT good_text AS normalized_sql, count(*) AS n FROM hist WHERE event_type = 'click' GROUP BY 1",
    ),
)
def l1b(spark, d):
    rows = _normalized_all(spark, d).where(F.col("normalized_sql").contains(" IN (?)"))
    return rows.groupBy("normalized_sql").agg(F.count(F.lit(1)).alias("n"))


@query(
    "l1c_canonical_text",
    with_sql(
        t.HISTORY_SQL,
        "SELECT good_text AS normalized_sql, count(*) AS n, count(DISTINCT k) AS literals FROM hist"
        " WHERE text_problem IS NULL GROUP BY 1",
    ),
)
def l1c(spark, d):
    k = t.table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("query_id"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
    )
    rows = _normalized_all(spark, d).where("problem IS NULL").join(k, "query_id")
    return rows.groupBy("normalized_sql").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("k").alias("literals")
    )


@query(
    "l1d_idempotence",
    with_sql(
        t.HISTORY_SQL,
        "SELECT count(DISTINCT good_text) AS texts, 0::BIGINT AS unstable FROM hist WHERE text_problem IS NULL",
    ),
)
def l1d(spark, d):
    good = _normalized_all(spark, d).where("problem IS NULL").select("normalized_sql").distinct()
    again = good.withColumn("again", normalize_once(F.col("normalized_sql"))["text"])
    return again.agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if(~F.col("again").eqNullSafe(F.col("normalized_sql"))).alias("unstable"),
    )


@query(
    "l1e_statement_kind",
    with_sql(
        t.HISTORY_SQL,
        "SELECT coalesce(text_problem, 'query') AS kind, count(*) AS n FROM hist GROUP BY 1",
    ),
)
def l1e(spark, d):
    rows = _normalized_all(spark, d)
    return rows.groupBy(F.coalesce("problem", F.lit("query")).alias("kind")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "l1f_fingerprint",
    with_sql(
        t.HISTORY_SQL,
        "SELECT fingerprint, succeeded, count(*) AS n FROM snap GROUP BY 1, 2",
    ),
)
def l1f(spark, d):
    return records(spark, d).groupBy("fingerprint", "succeeded").agg(F.count(F.lit(1)).alias("n"))


@query(
    "l1_snapshot",
    with_sql(
        t.HISTORY_SQL,
        "SELECT query_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS start_time, role, actor, run_id, qid, repetition,"
        " CASE WHEN in_session THEN 'ANALYTICS' END AS database_name, CASE WHEN in_session THEN 'MARTS' END AS schema_name,"
        " succeeded, normalized_sql, fingerprint FROM snap",
    ),
)
def l1(spark, d):
    r = records(spark, d).orderBy("start_time", "query_id")
    return r.withColumn("start_time", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query(
    "a6_snapshot_counters",
    with_sql(
        t.HISTORY_SQL,
        "SELECT count(*) AS read, count(*) FILTER (reason IS NULL) AS kept, count(DISTINCT run_id) FILTER (reason IS NULL) AS agent_run_ids, "
        + ", ".join(
            f"count(*) FILTER (reason = '{r}') AS dropped_{r}" for r in DROP_REASONS
        )
        + " FROM snap_all",
    ),
)
def a6(spark, d):
    return snapshot.counters(classified(spark, d))


@query(
    "a7_quality_gates",
    with_sql(
        t.HISTORY_SQL,
        "SELECT 'parse_rate' AS gate, round(1 - count(*) FILTER (reason = 'parse_error') / count(*)::DOUBLE, 12) AS value,"
        " 0.9::DOUBLE AS threshold, 1 - count(*) FILTER (reason = 'parse_error') / count(*)::DOUBLE >= 0.9 AS passed"
        " FROM snap_all WHERE reason IS NULL OR reason IN ('parse_error', 'multiple_statements', 'not_a_query')"
        " UNION ALL SELECT 'rows_kept', count(*)::DOUBLE, 1::DOUBLE, count(*) >= 1 FROM snap",
    ),
)
def a7(spark, d):
    return snapshot.gates(snapshot.counters(classified(spark, d)), 0.9, 1).withColumn(
        "value", F.round("value", 12)
    )


@query(
    "w9_duplicate_query_ids",
    "SELECT CAST(user_id AS VARCHAR) AS query_id, count(*) AS occurrences FROM events GROUP BY user_id HAVING count(*) > 1",
)
def w9(spark, d):
    e = t.table(spark, d, "events").select(F.col("user_id").cast("string").alias("query_id"))
    return snapshot.repeated_ids(e)


# Attribution

_SCOPES = with_sql(
    t.HISTORY_SQL,
    """, texts AS (SELECT DISTINCT event_type, event_id % 2 AS odd, tbl, col, CASE WHEN event_type <> 'signup' THEN tbl2 END AS tbl2,
      CASE WHEN event_type <> 'signup' THEN col2 END AS col2, in_session, good_text FROM snap),
    per AS (SELECT CASE WHEN good_text LIKE '%EXCLUDE%' THEN 1 ELSE CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 1 ELSE 2 END END AS scopes, in_session, good_text FROM texts)
    SELECT scopes, count(*) AS texts FROM (SELECT DISTINCT scopes, in_session, good_text FROM per) GROUP BY 1""".replace(
        ", texts AS", "SELECT * FROM (WITH texts AS", 1
    )
    + ")",
)


@query("l2_scope_assignment", _SCOPES)
def l2(spark, d):
    toks = tokens.scoped(tokens.token_rows(tokens.distinct_texts(records(spark, d))))
    per_text = toks.groupBy("text_id").agg(F.count_distinct("scope").alias("scopes"))
    return per_text.groupBy("scopes").agg(F.count(F.lit(1)).alias("texts"))


@query(
    "l3_source_binding",
    with_sql(
        t.REFS_SQL,
        "SELECT regexp_extract(fqn, '([^.]+)[.][^.]+$', 1) AS table_name, clause, count(*) AS n FROM refs GROUP BY 1, 2",
    ),
)
def l3(spark, d):
    table_name = F.element_at(F.split("name", r"\."), -2)
    return (
        lineage.weighted_references(records(spark, d), texts(spark, d))
        .where("kind = 'resolved'")
        .groupBy(table_name.alias("table_name"), "clause")
        .agg(F.sum("queries").alias("n"))
    )


@query(
    "l4_reference_kinds",
    with_sql(t.REFS_SQL, "SELECT query_id, kind, name, clause FROM refs_all"),
)
def l4(spark, d):
    return analysis_parts(spark, d)


@query(
    "l5_star_expansion",
    with_sql(
        t.REFS_SQL,
        "SELECT r.query_id, count(*) AS columns FROM refs r JOIN snap s ON s.query_id = r.query_id"
        " WHERE event_type IN ('signup', 'click') GROUP BY 1",
    ),
)
def l5(spark, d):
    starred = records(spark, d).where(F.col("normalized_sql").contains("SELECT *"))
    resolved = F.size(F.filter("refs", lambda r: r["kind"] == "resolved")).cast("bigint")
    per_text = texts(spark, d).select("text_id", resolved.alias("columns")).where("columns > 0")
    # Both sides grow with the history, so neither is broadcast.
    return (
        lineage.with_text_id(starred)
        .join(per_text.hint("merge"), "text_id")
        .select("query_id", "columns")
    )


@query(
    "l6_ordinals_and_aliases",
    with_sql(
        t.REFS_SQL,
        "SELECT clause, count(*) AS n FROM refs r JOIN snap s ON s.query_id = r.query_id WHERE event_type = 'view' GROUP BY 1",
    ),
)
def l6(spark, d):
    ordinal = records(spark, d).where(F.col("normalized_sql").contains(" GROUP BY 1 "))
    return (
        lineage.weighted_references(ordinal, texts(spark, d))
        .where("kind = 'resolved'")
        .groupBy("clause")
        .agg(F.sum("queries").alias("n"))
    )


@query(
    "l7_set_operations",
    with_sql(
        t.REFS_SQL,
        "SELECT r.query_id, kind, name, clause FROM refs_all r JOIN snap s ON s.query_id = r.query_id WHERE event_type = 'error'",
    ),
)
def l7(spark, d):
    unions = records(spark, d).where(F.col("normalized_sql").contains(" UNION ALL "))
    return analysis_parts(spark, d).join(unions.select("query_id"), "query_id")


@query("l8_column_refs", with_sql(t.REFS_SQL, "SELECT query_id, fqn, clause FROM refs"))
def l8(spark, d):
    return refs(spark, d).orderBy("query_id", "fqn", "clause")


@query(
    "a11_reference_counts",
    with_sql(
        t.REFS_SQL,
        "SELECT (SELECT count(*) FROM snap) AS queries_read, (SELECT count(*) FROM snap WHERE event_type = 'error' AND event_id % 10 = 3) AS queries_qualify_failed,"
        " (SELECT count(*) FROM snap WHERE event_type = 'signup') AS queries_top_level_star, "
        + ", ".join(f"count(*) FILTER (kind = '{k}') AS columns_{k}" for k in REFERENCE_KINDS)
        + " FROM refs_all",
    ),
)
def a11(spark, d):
    return lineage.reference_counts(records(spark, d), texts(spark, d))


@query(
    "d11_reference_contract",
    with_sql(
        t.REFS_SQL,
        "SELECT query_id || ' ' || fqn || ' ' || clause AS row_key, 'clause_known' AS rule FROM refs WHERE clause = 'where'"
        " UNION ALL SELECT query_id || ' ' || fqn || ' ' || clause, 'fqn_shape' FROM refs WHERE clause = 'join'",
    ),
)
def d11_references(spark, d):
    # References are checked once a text, and what is broken meets the text's queries.
    found = lineage.text_references(texts(spark, d)).where("kind = 'resolved'")
    rows = found.select(
        F.concat_ws(" ", "text_id", "name", "clause").alias("ref"),
        F.when(F.col("clause") == "join", F.lower("name")).otherwise(F.col("name")).alias("fqn"),
        F.when(F.col("clause") == "where", "filter").otherwise(F.col("clause")).alias("clause"),
    )
    broken = contracts.violations(rows, contracts.column_ref_rules(), "ref").select(
        F.substring_index("row_key", " ", 1).alias("text_id"),
        F.regexp_replace("row_key", "^[^ ]* ", "").alias("ref"),
        "rule",
    )
    queries = lineage.with_text_id(records(spark, d)).select("query_id", "text_id")
    return queries.join(broken, "text_id").select(F.concat_ws(" ", "query_id", "ref").alias("row_key"), "rule")


@query(
    "d11_record_contract",
    with_sql(
        t.HISTORY_SQL,
        "SELECT query_id AS row_key, 'fingerprint_is_hash' AS rule FROM snap WHERE event_type = 'view'"
        " UNION ALL SELECT query_id, 'tag_all_or_none' FROM snap WHERE run_id IS NOT NULL AND event_type = 'click'"
        " UNION ALL SELECT query_id, 'actor_known' FROM snap WHERE actor = 'human'",
    ),
)
def d11_records(spark, d):
    sql = F.col("normalized_sql")
    rows = records(spark, d).withColumns(
        {
            "fingerprint": F.when(sql.contains(" GROUP BY 1 "), F.md5(sql)).otherwise(F.col("fingerprint")),
            "qid": F.when(~sql.contains(" IN (?)"), F.col("qid")),
            "actor": F.when(F.col("actor") != "human", F.col("actor")).otherwise("person"),
        }
    )
    return contracts.violations(rows, contracts.query_record_rules(), "query_id")


# Usage, coverage and rank


@query("j6_touched_columns", with_sql(t.USAGE_SQL, "SELECT query_id, fqn, actor, qid FROM touch"))
def j6(spark, d):
    return touches(spark, d).select("query_id", "fqn", "actor", "qid")


@query("j7_catalog_zero_fill", with_sql(t.USAGE_SQL, "SELECT fqn, executions FROM execs"))
def j7(spark, d):
    return executions(spark, d).select("fqn", "executions")


@query(
    "j8_stray_references",
    with_sql(
        t.USAGE_SQL,
        "SELECT r.query_id, r.fqn, r.clause FROM refs r LEFT JOIN snap s ON s.query_id = r.query_id AND s.actor = 'agent'"
        " WHERE s.query_id IS NULL",
    ),
)
def j8(spark, d):
    # Checked against a snapshot cut to the agents' queries, so strays exist.
    r = records(spark, d)
    return usage.stray_text_references(r, texts(spark, d), r.where("actor = 'agent'"))


@query(
    "j8_stray_usage",
    with_sql(
        t.USAGE_SQL,
        "SELECT u.fqn, u.executions_agent FROM usage u JOIN cat c ON c.fqn = u.fqn WHERE c.low % 2 = 1",
    ),
)
def j8b(spark, d):
    half = t.catalog(spark, d).where("low % 2 = 0")
    return usage.stray_usage(used(spark, d), half).select("fqn", "executions_agent")


@query("a8_column_usage", with_sql(t.USAGE_SQL, "SELECT * FROM usage"))
def a8(spark, d):
    return used(spark, d)


@query(
    "a9_scope_accounting",
    with_sql(
        t.USAGE_SQL,
        "SELECT count(*) AS queries_read, "
        + ", ".join(
            f"count(*) FILTER (scope_reason = '{r}') AS queries_{r}" for r in usage.SCOPE_REASONS
        )
        + ", (SELECT count(*) FROM qids WHERE qid NOT IN (SELECT qid FROM scoped WHERE scope_reason = 'in_scope')) AS qids_without_queries FROM scoped",
    ),
)
def a9(spark, d):
    return usage.scope_counts(scoped(spark, d), t.scope_qids(spark, d))


_COVERAGE = (
    "SELECT count(*) FILTER (documented) AS columns_documented, count(*) AS columns_total,"
    " CAST(coalesce(sum(executions) FILTER (documented), 0) AS BIGINT) AS executions_documented,"
    " CAST(sum(executions) AS BIGINT) AS executions_total FROM execs"
)


@query("a10_coverage", with_sql(t.USAGE_SQL, _COVERAGE))
def a10(spark, d):
    return usage.coverage(executions(spark, d))


_RANKED = (
    "ranked AS (SELECT row_number() OVER (ORDER BY executions DESC, fqn) AS rank, fqn, ln(1 + executions) AS score,"
    " executions, 0::DOUBLE AS failure_rate FROM execs WHERE NOT documented)"
)


@query(
    "w2_gap_score",
    with_sql(
        t.USAGE_SQL,
        "SELECT fqn, round(ln(1 + executions) * (1 + 1.0 * (low % 4) / 4.0), 10) AS score FROM execs",
    ),
)
def w2(spark, d):
    rate = (F.col("low") % 4) / F.lit(4.0)
    return executions(spark, d).select(
        "fqn", F.round(ranking.gap_score(F.col("executions"), rate, 1.0), 10).alias("score")
    )


@query(
    "w3_ranked_gaps",
    with_sql(
        f"{t.USAGE_SQL}, {_RANKED}",
        "SELECT rank, fqn, round(score, 10) AS score, executions, failure_rate FROM ranked",
    ),
)
def w3(spark, d):
    return ranked(spark, d).withColumn("score", F.round("score", 10))


@query(
    "w10_ties_at_n",
    with_sql(
        f"{t.USAGE_SQL}, {_RANKED}",
        "SELECT count(*) FILTER (executions = (SELECT executions FROM ranked WHERE rank = 10)) AS tied_at_n,"
        " count(*) FILTER (executions = (SELECT executions FROM ranked WHERE rank = 10) AND rank <= 10) AS tied_inside,"
        " count(*) FILTER (rank <= 10 AND executions = 0) AS untouched_in_top FROM ranked",
    ),
)
def w10(spark, d):
    return ranking.ties_at(ranked(spark, d), 10)


@query(
    "l9_history_to_gaps",
    with_sql(
        f"{t.USAGE_SQL}, {_RANKED}",
        "SELECT rank, fqn, executions FROM ranked",
    ),
)
def l9(spark, d):
    done = gaps.analyse(
        t.history(spark, d),
        t.catalog(spark, d),
        t.actors(spark),
        t.scope_qids(spark, d),
        as_of=t.AS_OF,
        window_days=t.WINDOW_DAYS,
        run_id=t.RUN_ID,
        weight=1.0,
    )
    return done.ranked.select("rank", "fqn", "executions")


@query(
    "a28_projected_coverage",
    with_sql(
        f"{t.USAGE_SQL}, {_RANKED}",
        _COVERAGE.replace("(documented)", "(documented OR fqn IN (SELECT fqn FROM ranked WHERE rank <= 10))"),
    ),
)
def a28(spark, d):
    return usage.projected_coverage(executions(spark, d), ranked(spark, d).where("rank <= 10"))


@query(
    "s17_report_counts",
    with_sql(
        t.USAGE_SQL,
        "SELECT 'coverage' AS stage, name, value FROM (UNPIVOT (" + _COVERAGE + ") ON COLUMNS(*) INTO NAME name VALUE value)",
    ),
)
def s17(spark, d):
    return report.all_counts({"coverage": usage.coverage(executions(spark, d))})


def _of(name):
    return f"({SQL[name]})"


@query(
    "s17_report_lines",
    "SELECT 'coverage' AS section, unit AS item, documented || ' | ' || total || ' | ' || share AS line FROM {shares}"
    " UNION ALL SELECT 'gates', 'snapshot.' || gate, round(value, 6) || ' | ' || threshold || ' | ' || passed FROM {gates}"
    " UNION ALL SELECT 'counts', 'snapshot.' || name, CAST(value AS VARCHAR) FROM (UNPIVOT {a6} ON COLUMNS(*) INTO NAME name VALUE value)"
    " UNION ALL SELECT 'counts', 'resolve.' || name, CAST(value AS VARCHAR) FROM (UNPIVOT {a11} ON COLUMNS(*) INTO NAME name VALUE value)"
    " UNION ALL SELECT 'counts', 'coverage.' || name, CAST(value AS VARCHAR) FROM (UNPIVOT {a10} ON COLUMNS(*) INTO NAME name VALUE value)"
    " UNION ALL SELECT 'gaps', CAST(rank AS VARCHAR), fqn || ' | ' || printf('%.4f', score) || ' | ' || executions || ' | ' || printf('%.2f', failure_rate) FROM {w3}",
)
def s17c(spark, d):
    counters = snapshot.counters(classified(spark, d))
    coverage = usage.coverage(executions(spark, d))
    counts = report.all_counts({"snapshot": counters, "resolve": QUERIES["a11_reference_counts"](spark, d), "coverage": coverage})
    gates = snapshot.gates(counters, 0.9, 1).withColumn("stage", F.lit("snapshot"))
    return report.lines(counts, gates, coverage, ranked(spark, d))


@query(
    "s17_report_shares",
    with_sql(
        t.USAGE_SQL,
        f", c AS ({_COVERAGE}) SELECT 'columns' AS unit, columns_documented AS documented, columns_total AS total,"
        " CAST(round_even(CAST(1000 * columns_documented AS DECIMAL(18,0)) / columns_total / 10, 1) AS DECIMAL(18,1)) || '%' AS share FROM c"
        " UNION ALL SELECT 'executions', executions_documented, executions_total,"
        " CAST(round_even(CAST(1000 * executions_documented AS DECIMAL(18,0)) / executions_total / 10, 1) AS DECIMAL(18,1)) || '%' FROM c",
    ).replace(" , c AS", ", c AS"),
)
def s17b(spark, d):
    return report.coverage_shares(usage.coverage(executions(spark, d)))


@query(
    "j12_confusion_pairs",
    with_sql(
        t.REFS_SQL,
        ", run_cols AS (SELECT DISTINCT s.query_id AS run_key, s.qid, r.fqn FROM refs r JOIN snap s ON s.query_id = r.query_id WHERE s.qid IS NOT NULL AND NOT s.succeeded),"
        " gold AS (SELECT DISTINCT s.qid, r.fqn FROM refs r JOIN snap s ON s.query_id = r.query_id WHERE s.qid IS NOT NULL AND s.event_type = 'click' AND s.k < 30)"
        " SELECT run_key, fqn, 'run' AS side FROM run_cols WHERE (qid, fqn) NOT IN (SELECT (qid, fqn) FROM gold)"
        " UNION ALL SELECT DISTINCT w.run_key, g.fqn, 'gold' FROM (SELECT DISTINCT run_key, qid FROM run_cols) w JOIN gold g ON g.qid = w.qid"
        " WHERE (w.run_key, g.fqn) NOT IN (SELECT (run_key, fqn) FROM run_cols)",
    ).replace(" , run_cols", ", run_cols"),
)
def j12(spark, d):
    return experiment.confusion_pairs(*_run_and_gold_columns(spark, d))


@query(
    "j12_attribution_agreement",
    with_sql(
        t.REFS_SQL,
        ", run_cols AS (SELECT DISTINCT s.query_id AS run_key, s.qid, r.fqn FROM refs r JOIN snap s ON s.query_id = r.query_id WHERE s.qid IS NOT NULL AND NOT s.succeeded),"
        " gold AS (SELECT DISTINCT s.qid, r.fqn FROM refs r JOIN snap s ON s.query_id = r.query_id WHERE s.qid IS NOT NULL AND s.event_type = 'click' AND s.k < 30),"
        " att AS (SELECT run_key, qid, min(fqn) AS fqn FROM run_cols GROUP BY 1, 2)"
        " SELECT count(*) AS attributed, count(*) FILTER ((qid, fqn) NOT IN (SELECT (qid, fqn) FROM gold)) AS agreed,"
        " round(count(*) FILTER ((qid, fqn) NOT IN (SELECT (qid, fqn) FROM gold)) / nullif(count(*), 0)::DOUBLE, 10) AS rate FROM att",
    ).replace(" , run_cols", ", run_cols"),
)
def j12b(spark, d):
    run, gold = _run_and_gold_columns(spark, d)
    attributed = run.groupBy("run_key").agg(F.min("fqn").alias("fqn"))
    return experiment.confused_attributions(attributed, run, gold).withColumn(
        "rate", F.round("rate", 10)
    )


def _run_and_gold_columns(spark, d):
    r = lineage.with_text_id(records(spark, d).where("qid IS NOT NULL")).select("query_id", "text_id", "qid", "succeeded")
    read = usage.text_columns(texts(spark, d))
    k = t.table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("query_id"),
        "event_type",
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
    )
    # What grows with the history is not broadcast; golds shrink to (text, question) before they meet columns.
    failed = r.where("NOT succeeded").select("query_id", "text_id", "qid").join(read.hint("merge"), "text_id")
    gold = (
        r.select("query_id", "text_id", "qid")
        .join(k.where("event_type = 'click' AND k < 30").select("query_id").hint("merge"), "query_id")
        .select("text_id", "qid")
        .distinct()
        .join(read.hint("merge"), "text_id")
        .select("qid", "fqn")
        .distinct()
    )
    return failed.select(F.col("query_id").alias("run_key"), "qid", "fqn"), gold


@query(
    "l10_question_columns",
    with_sql(
        t.REFS_SQL,
        ", own AS (SELECT s.qid, r.fqn, s.event_type = 'view' AND r.fqn = 'ANALYTICS.MARTS.' || s.tbl || '.' || s.col2 AS measured FROM refs r JOIN snap s ON s.query_id = r.query_id WHERE s.qid IS NOT NULL"
        " UNION ALL SELECT s.qid, c.fqn, false FROM snap s JOIN cat c ON c.table_name = s.tbl AND c.column_name <> s.col2 WHERE s.qid IS NOT NULL AND s.in_session AND s.good_text LIKE 'SELECT * EXCLUDE%'),"
        " per AS (SELECT qid, fqn, bool_or(measured) AS measured FROM own GROUP BY 1, 2),"
        " q AS (SELECT qid, count(*) AS columns, count(*) FILTER (measured) AS measures, CASE WHEN count(*) FILTER (measured) = 1 THEN min(fqn) FILTER (measured) END AS measure FROM per GROUP BY 1)"
        " SELECT q.*, CASE WHEN documented THEN 'no trap' WHEN measure IS NOT NULL THEN 'filtered' END AS half FROM q LEFT JOIN cat ON cat.fqn = measure",
    ).replace(" , own AS", ", own AS"),
)
def l10(spark, d):
    kept = records(spark, d).where("qid IS NOT NULL")
    asked = lineage.with_text_id(kept).select("text_id", "qid")
    c = t.catalog(spark, d)
    read = mentions.mentions(tokens.distinct_texts(kept), c, t.DATABASE, t.SCHEMA)
    return mentions.question_columns(read, asked, c.where("documented"))


@query(
    "a22_soft_failure_rate",
    with_sql(
        t.USAGE_SQL,
        ", failed AS (SELECT s.query_id, CASE WHEN s.event_id % 2 = 0 THEN 0.6::DOUBLE ELSE 0.25::DOUBLE END AS p_meaning FROM scoped s WHERE scope_reason = 'in_scope' AND NOT succeeded),"
        " cols AS (SELECT DISTINCT f.query_id, f.p_meaning, r.fqn, count(*) OVER (PARTITION BY f.query_id) AS n FROM failed f JOIN (SELECT DISTINCT query_id, fqn FROM refs) r ON r.query_id = f.query_id)"
        " SELECT u.fqn, u.runs, round(coalesce(sum(p_meaning / n), 0), 10) AS soft_failures, round(coalesce(sum(p_meaning / n), 0) / u.runs, 10) AS failure_rate"
        " FROM usage u LEFT JOIN cols c ON c.fqn = u.fqn WHERE u.runs > 0 GROUP BY u.fqn, u.runs",
    ).replace(" , failed", ", failed"),
)
def a22(spark, d):
    failed = scoped(spark, d).where("scope_reason = 'in_scope' AND NOT succeeded")
    per_query = (
        refs(spark, d)
        .select("query_id", "fqn")
        .distinct()
        .join(failed.select("query_id"), "query_id")
        .groupBy("query_id")
        .agg(F.collect_list("fqn").alias("fqns"))
    )
    even = F.col("query_id").cast("bigint") % 2 == 0
    p = F.when(even, F.lit(0.6)).otherwise(F.lit(0.25))
    attributions = per_query.select(
        F.create_map(F.lit("column_meaning"), p, F.lit("other"), 1 - p).alias("cause"),
        F.map_from_arrays(
            "fqns", F.transform("fqns", lambda _: F.lit(1.0) / F.size("fqns"))
        ).alias("column"),
    )
    return ranking.soft_failure_rate(attributions, used(spark, d)).withColumns(
        {"soft_failures": F.round("soft_failures", 10), "failure_rate": F.round("failure_rate", 10)}
    )


SQL["s17_report_lines"] = SQL["s17_report_lines"].format(
    shares=_of("s17_report_shares"), gates=_of("a7_quality_gates"), a6=_of("a6_snapshot_counters"), a11=_of("a11_reference_counts"), a10=_of("a10_coverage"), w3=_of("w3_ranked_gaps")
)
