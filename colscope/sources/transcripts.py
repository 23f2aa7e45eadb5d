"""Agent transcripts (nested JSON) and call logs (JSON lines)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A transcript's fields; a message's content, a text or a list of blocks, stays a variant.
TRANSCRIPT = {
    "run_id": "string", "qid": "string", "repetition": "bigint", "failed_calls": "bigint",
    "messages": "array<struct<role:string,content:variant>>", "tool_calls": "bigint", "final_sql": "string",
    "outcome": "string", "error_cause": "string", "error_detail": "string", "result_rows": "bigint",
}
CALL_LOG = (
    "run_id string, stage string, item string, event string, duration_ms double, model string, "
    "cache string, input_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint, "
    "output_tokens bigint, cost_usd double, outcome string, exception_type string, "
    "transient boolean"
)
# Fixed value: the tool whose input is a query.
QUERY_TOOL = "run_sql"


def read_transcripts(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """One row per transcript: a file each, or, if not ``whole_files``, a line each."""
    return parse_transcripts(spark.read.text(path, wholetext=whole_files).withColumnRenamed("value", "text"))


def parse_transcripts(documents: DataFrame) -> DataFrame:
    """Transcripts from a text column. A document is parsed once, into a variant; one that is no JSON gives nulls."""
    # A generator, which the optimizer doesn't put in for each of the fields that read it.
    parsed = documents.select(F.explode_outer(F.array(F.try_parse_json("text"))).alias("_t"))
    return parsed.select(*[F.try_variant_get("_t", f"$.{f}", kind).alias(f) for f, kind in TRANSCRIPT.items()])


def _asked(content: Column) -> Column:
    """A message's text; blocks as JSON."""
    return F.coalesce(F.try_variant_get(content, "$", "string"), F.to_json(content))


def runs(transcripts: DataFrame) -> DataFrame:
    """The run table: how each run ended. The first message asks the question."""
    return transcripts.select(
        "run_id",
        "qid",
        "repetition",
        "outcome",
        "error_cause",
        "failed_calls",
        "tool_calls",
        "final_sql",
        "result_rows",
        _asked(F.get("messages", F.lit(0))["content"]).alias("asked"),
    )


def tool_uses(transcripts: DataFrame) -> DataFrame:
    """One row per tool use in call order, with its SQL when it is a query."""
    messages = transcripts.select(
        "run_id", "qid", "repetition", F.posexplode("messages").alias("message_no", "message")
    ).where(F.col("message.role") == "assistant")
    blocks = messages.select(
        "run_id",
        "qid",
        "repetition",
        "message_no",
        # Content that is a plain text is no array and drops out.
        F.posexplode(F.try_variant_get("message.content", "$", "array<variant>")).alias("block_no", "b"),
    ).where(F.try_variant_get("b", "$.type", "string") == "tool_use")
    tool = F.try_variant_get("b", "$.name", "string")
    return blocks.select(
        "run_id",
        "qid",
        "repetition",
        "message_no",
        "block_no",
        F.try_variant_get("b", "$.id", "string").alias("tool_use_id"),
        tool.alias("tool"),
        F.when(tool == QUERY_TOOL, F.try_variant_get("b", "$.input.sql", "string")).alias("sql"),
    )


def as_history(
    transcripts: DataFrame, start_time: str, role: str, database: str, schema: str
) -> DataFrame:
    """The traffic of runs as history rows: each query tool call and each final SQL."""
    calls = tool_uses(transcripts).where(F.col("sql").isNotNull()).select(
        "run_id",
        "qid",
        "repetition",
        F.concat_ws("-", F.lit("call"), "message_no", "block_no").alias("step"),
        "sql",
    )
    finals = transcripts.where(F.col("final_sql").isNotNull()).select(
        "run_id", "qid", "repetition", F.lit("final").alias("step"), F.col("final_sql").alias("sql")
    )
    tag = F.concat_ws(":", F.lit("agent"), "run_id", "qid", "repetition")
    return calls.unionByName(finals).select(
        F.concat_ws("/", "run_id", "qid", "repetition", "step").alias("query_id"),
        F.col("sql").alias("query_text"),
        F.lit(start_time).cast("timestamp").alias("start_time"),
        F.lit(role).alias("role_name"),
        tag.alias("query_tag"),
        F.lit("SUCCESS").alias("execution_status"),
        F.lit(database).alias("database_name"),
        F.lit(schema).alias("schema_name"),
    )


def read_call_log(spark: SparkSession, path: str) -> DataFrame:
    """Call-log events, one per line."""
    return spark.read.schema(CALL_LOG).json(path)


def parse_call_log(lines: DataFrame) -> DataFrame:
    """Call-log events from a text column."""
    return lines.select(F.from_json("value", CALL_LOG).alias("e")).select("e.*")
