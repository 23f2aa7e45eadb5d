"""Column usage counts, scope accounting and documentation coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.functions.guards import require_empty
from colscope.operators.tokens import context_id

SCOPE_REASONS = ("in_scope", "untagged", "other_run", "other_question")


def scope_reason(run_id: str, in_scope_qids: Column) -> Column:
    """Where a query stands to a ranking scope: its run's queries for its questions count."""
    return (
        F.when(F.col("run_id").isNull(), "untagged")
        .when(F.col("run_id") != run_id, "other_run")
        .when(~in_scope_qids, "other_question")
        .otherwise("in_scope")
    )


def with_scope(snapshot: DataFrame, run_id: str, qids: DataFrame) -> DataFrame:
    """Every snapshot row with its ``scope_reason``. ``qids`` is the scope's question list."""
    scope = qids.select("qid").distinct().withColumn("_listed", F.lit(True))
    return (
        snapshot.join(scope, "qid", "left")
        .withColumn(
            "scope_reason", scope_reason(run_id, F.coalesce("_listed", F.lit(False)))
        )
        .drop("_listed")
    )


def scope_counts(scoped: DataFrame, qids: DataFrame) -> DataFrame:
    """One row: queries per scope reason and the scope questions no query belongs to."""
    counted = scoped.agg(
        F.count(F.lit(1)).alias("queries_read"),
        *[F.count_if(F.col("scope_reason") == r).alias(f"queries_{r}") for r in SCOPE_REASONS],
    )
    asked = scoped.where(F.col("scope_reason") == "in_scope").select("qid").distinct()
    unmatched = (
        qids.select("qid")
        .distinct()
        .join(asked, "qid", "left_anti")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.withColumn("qids_without_queries", unmatched.scalar())


def scope_errors(scoped: DataFrame, scope_given: bool) -> DataFrame:
    """Why the counted traffic must be refused: tagged traffic without a scope, or a scope
    no query belongs to. No row means it may be counted."""
    counted = scoped.agg(
        F.count_if(F.col("run_id").isNotNull()).alias("tagged"),
        F.count_if(F.col("scope_reason") == "in_scope").alias("in_scope"),
    )
    problem = (
        F.when(F.col("in_scope") == 0, "no query belongs to the scope")
        if scope_given
        else F.when(F.col("tagged") > 0, "tagged traffic needs a scope")
    )
    return counted.select(problem.alias("problem")).where(F.col("problem").isNotNull())


def touched(refs: DataFrame, counted: DataFrame) -> DataFrame:
    """One row per (column, counted query), whatever clauses the column is in."""
    return (
        refs.select("query_id", "fqn")
        .distinct()
        .join(
            counted.select("query_id", "actor", "run_id", "qid", "repetition", "fingerprint"),
            "query_id",
        )
    )


def text_columns(texts: DataFrame) -> DataFrame:
    """(text_id, fqn): the columns each text reads, each once, whatever clauses they are in."""
    return texts.select("text_id", F.inline("refs")).where("kind = 'resolved'").select(
        "text_id", F.col("name").alias("fqn")
    ).distinct()


def touched_by_text(texts: DataFrame, counted: DataFrame) -> DataFrame:
    """What ``column_usage`` counts, folded by text: the counted queries of each text, actor,
    run, question and repetition, once for each column the text reads.

    Queries shrink to their texts before columns are met, so no (query, column) row is made.
    ``texts`` has text_id and refs, ``counted`` the snapshot's fields.
    """
    columns = text_columns(texts)
    queries = (
        counted.withColumn("text_id", context_id())
        .groupBy("text_id", "actor", "fingerprint", "run_id", "qid", "repetition")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return queries.join(columns, "text_id")


def stray_references(refs: DataFrame, snapshot: DataFrame) -> DataFrame:
    """References to queries the snapshot doesn't hold."""
    return refs.join(snapshot.select("query_id"), "query_id", "left_anti")


def stray_text_references(queries: DataFrame, texts: DataFrame, snapshot: DataFrame) -> DataFrame:
    """``stray_references`` of the queries' texts: the queries that the snapshot lacks are told
    first, and only theirs meet references."""
    resolved = texts.select("text_id", F.inline("refs")).where("kind = 'resolved'")
    strays = queries.select("query_id", context_id().alias("text_id")).join(
        snapshot.select("query_id"), "query_id", "left_anti"
    )
    return strays.join(resolved, "text_id").select("query_id", F.col("name").alias("fqn"), "clause")


def stray_usage(usage: DataFrame, catalog: DataFrame) -> DataFrame:
    """Usage of columns the catalog doesn't hold."""
    return usage.join(catalog.select("fqn"), "fqn", "left_anti")


def column_usage(touches: DataFrame) -> DataFrame:
    """Executions, distinct fingerprints, questions and runs per column.

    Queries are folded per (column, actor, text, run, question, repetition) first: what
    each distinct count needs survives, and a popular column shrinks before it meets
    the final grouping. Distinct counts then run as Spark's two-phase distinct.
    """
    weight = F.col("n") if "n" in touches.columns else F.lit(1)
    folded = touches.groupBy(
        "fqn", "actor", "fingerprint", "run_id", "qid", "repetition"
    ).agg(F.sum(weight).alias("n"))
    agent, human = F.col("actor") == "agent", F.col("actor") == "human"
    tagged = agent & F.col("qid").isNotNull()
    return folded.groupBy("fqn").agg(
        F.sum(F.when(agent, F.col("n")).otherwise(0)).alias("executions_agent"),
        F.sum(F.when(human, F.col("n")).otherwise(0)).alias("executions_human"),
        F.count_distinct(F.when(agent, F.col("fingerprint"))).alias("fingerprints_agent"),
        F.count_distinct(F.when(human, F.col("fingerprint"))).alias("fingerprints_human"),
        F.count_distinct(F.when(tagged, F.col("qid"))).alias("questions"),
        F.count_distinct(F.when(tagged, F.struct("run_id", "qid", "repetition"))).alias("runs"),
    )


def catalog_executions(catalog: DataFrame, usage: DataFrame) -> DataFrame:
    """Every catalog column with its executions, 0 when no counted query touched it."""
    counts = usage.select(
        "fqn", (F.col("executions_agent") + F.col("executions_human")).alias("executions")
    )
    return catalog.join(counts, "fqn", "left").fillna(0, ["executions"])


def coverage(executions: DataFrame) -> DataFrame:
    """One row: documented and total columns and executions."""
    return executions.agg(
        F.count_if(F.col("documented")).alias("columns_documented"),
        F.count(F.lit(1)).alias("columns_total"),
        F.coalesce(F.sum(F.when(F.col("documented"), F.col("executions"))), F.lit(0))
        .cast("bigint")
        .alias("executions_documented"),
        F.coalesce(F.sum("executions"), F.lit(0)).cast("bigint").alias("executions_total"),
    )


def projected_coverage(executions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Coverage as if the chosen columns were documented."""
    picked = chosen.select("fqn").distinct().withColumn("_chosen", F.lit(True))
    return coverage(
        executions.join(picked, "fqn", "left").withColumn(
            "documented", F.col("documented") | F.coalesce("_chosen", F.lit(False))
        )
    )


def usage_of(
    snapshot: DataFrame, refs: DataFrame, run_id: str, qids: DataFrame
) -> DataFrame:
    """Usage of one scope's traffic, its guards applied."""
    scoped = with_scope(snapshot, run_id, qids)
    require_empty(scope_errors(scoped, True), "no query belongs to the ranking scope")
    require_empty(stray_references(refs, snapshot), "a reference to a query not in the snapshot")
    return column_usage(touched(refs, scoped.where(F.col("scope_reason") == "in_scope")))
