"""Query history to a redacted, fingerprinted snapshot, with every dropped row counted."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.contracts import DROP_REASONS
from colscope.functions.guards import require_empty
from colscope.functions.sqltext import normalize, without_values
from colscope.functions.text import REPETITION, TAG_ID
from colscope.operators.quality import not_unique
from colscope.plans.stages import staged


def in_window(time: Column, as_of: datetime, days: int) -> Column:
    """The half-open window ``[as_of - days, as_of)``. Instants are UTC, and so is the session."""
    end = F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
    start = F.lit((as_of - timedelta(days=days)).strftime("%Y-%m-%d %H:%M:%S.%f")).cast(
        "timestamp_ntz"
    )
    at = time.cast("timestamp_ntz")
    return (at >= start) & (at < end)


def with_actor(history: DataFrame, actors: DataFrame) -> DataFrame:
    """The actor of each row's role; null for an unmapped role.

    ``actors`` is a role map (role, actor); Spark broadcasts it while it is small.
    """
    return history.join(
        actors.select(F.col("role").alias("role_name"), "actor"), "role_name", "left"
    )


def tag_outcome(tag: Column) -> Column:
    """``agent`` with a well-formed agent tag, ``malformed`` with a broken one, else ``untagged``."""
    parts = F.split(tag, ":")
    formed = (
        (F.size(parts) == 4)
        & F.get(parts, F.lit(1)).rlike(TAG_ID)
        & F.get(parts, F.lit(2)).rlike(TAG_ID)
        & F.get(parts, F.lit(3)).rlike(REPETITION)
    )
    return (
        F.when(tag.isNull() | ~tag.startswith("agent:"), "untagged")
        .when(F.coalesce(formed, F.lit(False)), "agent")
        .otherwise("malformed")
    )


def tag_fields(tag: Column, outcome: Column | None = None) -> dict[str, Column]:
    """run_id, qid and repetition of a well-formed agent tag, else nulls."""
    formed = (tag_outcome(tag) if outcome is None else outcome) == "agent"
    part = lambda i: F.when(formed, F.get(F.split(tag, ":"), F.lit(i)))
    return {"run_id": part(1), "qid": part(2), "repetition": part(3).cast("bigint")}


def text_id(text: Column) -> Column:
    """The key a text is told apart by: its sha256, so no two texts share one."""
    return F.sha2(text, 256)


def normalized_texts(texts: DataFrame, column: str = "query_text") -> DataFrame:
    """(raw_id, normalized_sql, problem), each distinct text analysed once, plain values aside.

    Logs repeat: the grouping combines on the map side, so a text a third of the log
    holds reaches the shuffle once per task. The distinct texts are then spread over all
    cores by number: they are few bytes and much work, which AQE would put in one task.
    Most differ in their values alone, so what is analysed are the texts without them.
    """
    width = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Never null, so the join infers no filter on it, which would be computed in the scan.
    plain_id = F.coalesce(text_id(F.col("_plain")), F.lit("")).alias("_plain_id")
    plain = (
        texts.select(text_id(F.col(column)).alias("raw_id"), F.col(column).alias("_text"))
        .distinct()
        .repartition(width, "raw_id")
        .select("raw_id", without_values(F.col("_text")).alias("_plain"))
    )
    analysed = _analysed(plain.select(plain_id, "_plain")).select("_plain_id", "normalized_sql", "problem")
    return (
        plain.select("raw_id", plain_id)
        .join(analysed, "_plain_id")
        .select("raw_id", "normalized_sql", "problem")
    )


def _analysed(plain: DataFrame) -> DataFrame:
    """(_plain_id, normalized_sql, fingerprint, problem) of the distinct texts without their values."""
    width = int(plain.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        plain.distinct()
        .repartition(width, "_plain_id")
        .select("_plain_id", normalize(F.col("_plain")).alias("_n"))
        .select("_plain_id", F.col("_n.text").alias("normalized_sql"), F.col("_n.problem").alias("problem"))
        .withColumn("fingerprint", F.sha2("normalized_sql", 256))
    )


def classified(
    history: DataFrame, actors: DataFrame, as_of: datetime, window_days: int
) -> DataFrame:
    """Every history row with its drop reason, null when it is kept, and its snapshot fields.

    The history is read once: its rows are written with their text less its values, which
    is what is analysed, each distinct one once. Only a text's hash travels to the join. It
    is a plain equi-join, so Spark broadcasts few texts and splits a hot one (AQE). Rows
    that reach no text, mostly most of them, join under keys of their own, which no text
    has: under a null they would all meet in one task.
    """
    outcome = F.col("_outcome")
    early = (
        F.when(~in_window(F.col("start_time"), as_of, window_days), "outside_window")
        .when(F.col("actor").isNull(), "unmapped_role")
        .when(outcome == "malformed", "malformed_tag")
    )
    rows = (
        with_actor(history, actors)
        .withColumn("_outcome", tag_outcome(F.col("query_tag")))
        .withColumn("early_reason", early)
    )
    reaches = F.col("early_reason").isNull()
    keyed = rows.select(
        "query_id",
        "start_time",
        F.col("role_name").alias("role"),
        "actor",
        *[c.alias(n) for n, c in tag_fields(F.col("query_tag"), outcome).items()],
        "database_name",
        "schema_name",
        (F.col("execution_status") == "SUCCESS").alias("succeeded"),
        "early_reason",
        F.when(reaches, without_values(F.col("query_text"))).alias("_plain"),
    )
    own_key = F.concat(F.lit("-"), F.coalesce("query_id", F.lit("")))
    plain_id = F.when(reaches, F.coalesce(text_id(F.col("_plain")), F.lit(""))).otherwise(own_key)
    written = staged(keyed.withColumn("_plain_id", plain_id), "keyed")
    texts = _analysed(written.where(reaches).select("_plain_id", "_plain"))
    reason = F.coalesce("early_reason", "problem")
    kept = reason.isNull()
    return written.drop("_plain").join(texts, "_plain_id", "left").select(
        "query_id",
        "start_time",
        "role",
        "actor",
        "run_id",
        "qid",
        "repetition",
        "database_name",
        "schema_name",
        "succeeded",
        F.when(kept, F.col("normalized_sql")).alias("normalized_sql"),
        F.when(kept, F.col("fingerprint")).alias("fingerprint"),
        reason.alias("reason"),
    )


def kept_records(rows: DataFrame) -> DataFrame:
    """The snapshot: the kept rows' contract fields."""
    return rows.where(F.col("reason").isNull()).drop("reason")


def repeated_ids(history: DataFrame) -> DataFrame:
    """Query ids listed more than once; keeping one of them is refused."""
    return not_unique(history, ["query_id"])


def require_unique_ids(history: DataFrame) -> None:
    require_empty(repeated_ids(history), "a query_id appears twice in the history")


def counters(rows: DataFrame) -> DataFrame:
    """One row: read, kept, agent run ids and the drops per reason. One pass."""
    kept = F.col("reason").isNull()
    return rows.agg(
        F.count(F.lit(1)).alias("read"),
        F.count_if(kept).alias("kept"),
        F.count_distinct(F.when(kept, F.col("run_id"))).alias("agent_run_ids"),
        *[
            F.count_if(F.coalesce(F.col("reason") == r, F.lit(False))).alias(f"dropped_{r}")
            for r in DROP_REASONS
        ],
    )


def drops(rows: DataFrame) -> DataFrame:
    """Rows dropped per reason, every reason listed."""
    counted = counters(rows).select(
        *[F.col(f"dropped_{r}").alias(r) for r in DROP_REASONS]
    )
    return counted.unpivot([], list(DROP_REASONS), "reason", "dropped")


def gates(counted: DataFrame, min_parse_rate: float, min_rows_kept: int) -> DataFrame:
    """The quality gates over the counters: value, threshold and verdict.

    The parse rate is over the texts that reached the parser; nothing reaching it fails.
    """
    failed = F.col("dropped_parse_error") + F.col("dropped_unstable_normalization")
    parsed = (
        F.col("kept") + F.col("dropped_multiple_statements") + F.col("dropped_not_a_query")
    )
    rate = F.when(parsed + failed == 0, F.lit(0.0)).otherwise(parsed / (parsed + failed))
    each = F.array(
        F.struct(
            F.lit("parse_rate").alias("gate"),
            rate.alias("value"),
            F.lit(float(min_parse_rate)).alias("threshold"),
        ),
        F.struct(
            F.lit("rows_kept").alias("gate"),
            F.col("kept").cast("double").alias("value"),
            F.lit(float(min_rows_kept)).alias("threshold"),
        ),
    )
    return counted.select(F.inline(each)).withColumn(
        "passed", F.col("value") >= F.col("threshold")
    )
