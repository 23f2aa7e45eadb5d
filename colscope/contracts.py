"""Table contracts: declared schemas and the row rules each artifact must keep."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colscope.functions import text

# The vocabularies of the contracts.
ACTORS = ("agent", "human")
CLAUSES = ("select", "where", "join", "group_by", "having", "order_by", "other")
GRADE_REASONS = ("error", "timeout", "shape_mismatch", "row_count_mismatch", "value_mismatch")
CAUSES = (
    "column_meaning",
    "wrong_table",
    "wrong_join",
    "wrong_filter",
    "wrong_grain",
    "other",
)
FAILURES = ("timeout", "malformed_answer", "refused", "retries_exhausted", "budget_exhausted")
SENSITIVITIES = ("public", "internal", "restricted")
BANDS = ("ready", "confirm", "flagged")
DROP_REASONS = (
    "outside_window",
    "unmapped_role",
    "malformed_tag",
    "parse_error",
    "multiple_statements",
    "not_a_query",
    "unstable_normalization",
)
REFERENCE_KINDS = ("resolved", "unmanaged", "information_schema", "unresolved")
SUM_TOLERANCE = 1e-6
MAX_DESCRIPTION = 200


# Contracts are DDL text, which readers and casts take as they are.
HISTORY = (
    "QUERY_ID string, QUERY_TEXT string, START_TIME string, ROLE_NAME string, "
    "QUERY_TAG string, EXECUTION_STATUS string, DATABASE_NAME string, SCHEMA_NAME string"
)
QUERY_RECORD = (
    "query_id string, start_time timestamp, role string, actor string, run_id string, "
    "qid string, repetition bigint, database_name string, schema_name string, "
    "succeeded boolean, normalized_sql string, fingerprint string"
)
COLUMN_REF = "query_id string, fqn string, clause string"
COLUMN_USAGE = (
    "fqn string, executions_agent bigint, executions_human bigint, fingerprints_agent bigint, "
    "fingerprints_human bigint, questions bigint, runs bigint"
)
RANKED_GAP = (
    "rank bigint, fqn string, score double, executions bigint, failure_rate double"
)
GRADE = "qid string, repetition bigint, passed boolean, reason string"
ATTRIBUTION = (
    "qid string, repetition bigint, cause map<string,double>, column map<string,double>, "
    "failure string"
)
TOP_VALUES = "array<struct<value:string,rows:bigint>>"
PROFILE = (
    "struct<k:int,null_rate:double,distinct_count:bigint,min:double,max:double,"
    f"top_values:{TOP_VALUES}>"
)
EVIDENCE = (
    "fqn string, data_type string, sensitivity string, table_description string, "
    f"lineage_sql string, upstream_expression string, profile {PROFILE}"
)
DRAFT = (
    "fqn string, evidence_sha256 string, description string, unknowns array<string>, failure string"
)
GATE_RESULT = (
    "fqn string, draft_sha256 string, p_supported double, band string, failure string"
)


@dataclass(frozen=True)
class Rule:
    """A row rule: ``holds`` must be true; false or null is a violation."""

    name: str
    holds: Column


def _all_or_none(*columns: str) -> Column:
    missing = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("int") for c in columns])
    return missing.isin(0, len(columns))


def _sums_to_one(map_column: str) -> Column:
    total = F.aggregate(F.map_values(map_column), F.lit(0.0), lambda a, p: a + p)
    return F.abs(total - 1) <= SUM_TOLERANCE


def _probability(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.between(0, 1)


def query_record_rules() -> list[Rule]:
    return [
        Rule("fingerprint_is_hash", F.col("fingerprint") == F.sha2("normalized_sql", 256)),
        Rule("tag_all_or_none", _all_or_none("run_id", "qid", "repetition")),
        Rule("actor_known", F.col("actor").isin(*ACTORS)),
        Rule("text_not_empty", F.length("normalized_sql") > 0),
        Rule("repetition_positive", F.coalesce(F.col("repetition") >= 1, F.lit(True))),
    ]


def column_ref_rules() -> list[Rule]:
    return [
        Rule("fqn_shape", F.col("fqn").rlike(text.FQN)),
        Rule("clause_known", F.col("clause").isin(*CLAUSES)),
    ]


def column_usage_rules() -> list[Rule]:
    return [
        Rule("fqn_shape", F.col("fqn").rlike(text.FQN)),
        Rule(
            "fingerprints_within_executions",
            (F.col("fingerprints_agent") <= F.col("executions_agent"))
            & (F.col("fingerprints_human") <= F.col("executions_human")),
        ),
        Rule(
            "questions_runs_executions",
            (F.col("questions") <= F.col("runs")) & (F.col("runs") <= F.col("executions_agent")),
        ),
    ]


def grade_rules() -> list[Rule]:
    return [
        Rule("reason_iff_failed", F.col("passed") == F.col("reason").isNull()),
        Rule(
            "reason_known", F.coalesce(F.col("reason").isin(*GRADE_REASONS), F.lit(True))
        ),
        Rule("repetition_positive", F.col("repetition") >= 1),
    ]


def attribution_rules() -> list[Rule]:
    judged = F.col("cause").isNotNull()
    return [
        Rule(
            "maps_or_failure",
            (F.col("cause").isNull() == F.col("column").isNull())
            & (F.col("cause").isNull() != F.col("failure").isNull()),
        ),
        Rule(
            "cause_covers_labels",
            F.when(
                judged,
                F.array_sort(F.map_keys("cause")) == F.lit(sorted(CAUSES)),
            ).otherwise(True),
        ),
        Rule("cause_sums_to_one", F.when(judged, _sums_to_one("cause")).otherwise(True)),
        Rule(
            "column_sums_to_one",
            F.when(
                F.col("column").isNotNull(),
                (F.size("column") > 0) & _sums_to_one("column"),
            ).otherwise(True),
        ),
    ]


def profile_rules(profile: str = "profile") -> list[Rule]:
    p = F.col(profile)
    tops = p["top_values"]
    in_order = F.array_sort(
        tops,
        lambda a, b: F.when(a["rows"] > b["rows"], -1)
        .when(a["rows"] < b["rows"], 1)
        .when(a["value"] < b["value"], -1)
        .when(a["value"] > b["value"], 1)
        .otherwise(0),
    )
    return [
        Rule("top_values_at_least_k", F.forall(tops, lambda t: t["rows"] >= p["k"])),
        Rule(
            "top_values_distinct",
            F.size(F.array_distinct(F.transform(tops, lambda t: t["value"]))) == F.size(tops),
        ),
        Rule("top_values_ordered", tops == in_order),
        Rule("min_not_above_max", F.coalesce(p["min"] <= p["max"], F.lit(True))),
        Rule("null_rate_is_share", _probability(p["null_rate"])),
    ]


def evidence_rules() -> list[Rule]:
    p = F.col("profile")
    return [
        Rule(
            "restricted_has_no_values",
            F.when(
                F.col("sensitivity") == "restricted",
                p["min"].isNull() & p["max"].isNull() & (F.size(p["top_values"]) == 0),
            ).otherwise(True),
        ),
        Rule("sensitivity_known", F.col("sensitivity").isin(*SENSITIVITIES)),
        *profile_rules(),
    ]


def draft_rules() -> list[Rule]:
    return [
        Rule(
            "description_or_failure", F.col("description").isNull() != F.col("failure").isNull()
        ),
        Rule(
            "description_length",
            F.coalesce(F.length("description").between(1, MAX_DESCRIPTION), F.lit(True)),
        ),
        Rule(
            "failed_has_no_unknowns",
            F.col("failure").isNull() | (F.size(F.coalesce("unknowns", F.array())) == 0),
        ),
    ]


def gate_rules() -> list[Rule]:
    return [
        Rule(
            "probability_or_failure", F.col("p_supported").isNull() != F.col("failure").isNull()
        ),
        Rule(
            "failure_is_flagged", F.col("failure").isNull() | (F.col("band") == "flagged")
        ),
        Rule("band_known", F.col("band").isin(*BANDS)),
    ]


def check_bands(ready_min: float, confirm_min: float) -> None:
    """The band thresholds must satisfy 0 < confirm < ready."""
    if not 0 < confirm_min < ready_min:
        raise ValueError("bands need 0 < confirm_min < ready_min")


def violations(df: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """One row per (row, broken rule): ``key`` as text and the rule's name. One scan."""
    broken = F.array_compact(
        F.array(
            *[F.when(F.coalesce(r.holds, F.lit(False)), None).otherwise(r.name) for r in rules]
        )
    )
    return df.select(F.col(key).cast("string").alias("row_key"), F.explode(broken).alias("rule"))


def schema_differences(found: T.StructType, ddl: str) -> list[str]:
    """What keeps two schemas apart, by position: name, then type. Nullability is not compared."""
    contract = T.StructType.fromDDL(ddl)
    out = []
    for i in range(max(len(found), len(contract))):
        a = found[i].simpleString() if i < len(found) else None
        b = contract[i].simpleString() if i < len(contract) else None
        if a != b:
            out.append(f"field {i + 1}: {a} != {b}")
    return out


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Cast every column to its contract type, in contract order. ANSI casts fail on overflow."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(ddl)])
