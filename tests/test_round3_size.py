"""Tests of the third round's findings at size."""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import functions as F

from colscope.functions.hashing import digest_remainders
from colscope.operators import lineage, sampling, snapshot, tokens, usage
from entries import experiments


def test_draws_are_made_over_arrays(spark, monkeypatch):
    whole = lambda i: int(hashlib.sha256(f"4:9:{i}".encode()).hexdigest(), 16)
    for n in (1, 7, 360_000, (1 << 31) - 1):
        got = digest_remainders(n)(b"4:9:", [b"%d" % i for i in range(50)])
        assert got.tolist() == [whole(i) % n for i in range(50)]
    rows = spark.createDataFrame([(f"q{i:02d}", float(i * i)) for i in range(20)], "qid string, d double")
    one = sampling.bootstrap_means(rows, "qid", "d", 4, 30)
    monkeypatch.setattr(sampling, "DRAWS_AT_ONCE", 6)
    blocks = sampling.bootstrap_means(rows, "qid", "d", 4, 30)
    assert sorted(one.collect()) == sorted(blocks.collect())
    assert "MapInArrow" in blocks._jdf.queryExecution().executedPlan().toString()
    assert sampling.bootstrap_means(rows.limit(0), "qid", "d", 4, 30).count() == 0


def _history(spark, n=40):
    i = F.col("id")
    return spark.range(n).select(
        i.cast("string").alias("query_id"),
        F.concat(F.lit("select a, b from t where b = "), (i % 7).cast("string"), F.lit(" group by 1, 2")).alias("query_text"),
        F.when(i % 2 == 0, F.lit("2024-01-30 00:00:00")).otherwise("2023-01-30 00:00:00").cast("timestamp").alias("start_time"),
        F.when(i % 3 == 0, "ANALYST").otherwise("AGENT_READER").alias("role_name"),
        F.when(i % 5 == 0, "agent:broken").when(i % 5 == 1, "agent:run0:q1:2").alias("query_tag"),
        F.lit("SUCCESS").alias("execution_status"),
        F.lit("D").alias("database_name"),
        F.lit("S").alias("schema_name"),
    )


def _classified(spark):
    actors = spark.createDataFrame([("AGENT_READER", "agent"), ("ANALYST", "human")], "role string, actor string")
    return snapshot.classified(_history(spark), actors, datetime(2024, 1, 31), 14)


def _catalog(spark):
    return spark.createDataFrame([(f"D.S.T.{c}", "T", c) for c in "AB"], "fqn string, table_name string, column_name string")


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_history_is_read_once(spark):
    rows = _classified(spark)
    assert "Range (" not in _plan(rows)
    got = {r["query_id"]: r for r in rows.collect()}
    assert len(got) == 40 and got["1"]["reason"] == "outside_window" and got["0"]["reason"] == "malformed_tag"
    text = "SELECT A, B FROM T WHERE B = ? GROUP BY 1, 2"
    assert (got["2"]["reason"], got["2"]["normalized_sql"], got["2"]["qid"]) == (None, text, None)
    assert (got["6"]["actor"], got["6"]["run_id"], got["6"]["repetition"]) == ("human", "run0", 2)
    assert got["2"]["fingerprint"] == hashlib.sha256(text.encode()).hexdigest()


def test_texts_are_told_apart_before_they_are_looked_at(spark):
    kept = snapshot.kept_records(_classified(spark))
    # A stage read twice is one of distinct texts, never the snapshot itself.
    done = lineage.analysed(tokens.distinct_texts(kept), _catalog(spark))
    assert "normalized_sql" not in _plan(done)


def test_counts_and_strays_by_text_equal_those_by_query(spark):
    kept = snapshot.kept_records(_classified(spark))
    texts = lineage.analysed(tokens.distinct_texts(kept), _catalog(spark))
    per_query = lineage.query_references(kept, texts)
    keys = ["kind", "name", "clause"]
    by_text = lineage.weighted_references(kept, texts).groupBy(*keys).agg(F.sum("queries").alias("n"))
    assert sorted(by_text.collect()) == sorted(per_query.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect()) != []
    agents = kept.where("actor = 'agent'")
    want = usage.stray_references(lineage.column_refs(per_query), agents)
    assert sorted(usage.stray_text_references(kept, texts, agents).collect()) == sorted(want.collect()) != []


def test_grading_reads_the_lines_once(spark):
    plan = _plan(experiments.QUERIES["j11_accepted_alternatives"](spark, "/root/testdata/sf0.001"))
    assert "l_extendedprice" not in plan and "amount" in plan
