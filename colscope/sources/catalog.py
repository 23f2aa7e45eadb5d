"""The warehouse catalog from model manifests: one row per mart column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colscope.functions.text import IDENTIFIER, is_documented, trimmed

# The manifest version and the adapters that are read, and which node
# types are relations.
MANIFEST_VERSION = "https://schemas.getdbt.com/dbt/manifest/v12.json"
ADAPTERS = ("duckdb", "snowflake")
RELATIONS = ("model", "seed", "snapshot")
_COLUMN = (
    "struct<name:string,description:string,data_type:string,quote:boolean,"
    "meta:map<string,string>>"
)
MANIFEST = (
    "metadata struct<dbt_schema_version:string,adapter_type:string>, "
    "nodes map<string,struct<resource_type:string,unique_id:string,description:string,"
    "database:string,schema:string,alias:string,"
    "config:struct<contract:struct<enforced:boolean>,meta:map<string,string>>,"
    f"columns:map<string,{_COLUMN}>>>"
)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manifest files as (manifest, text), one row per file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("manifest"), F.col("value").alias("text")
    )


def nodes(manifests: DataFrame, database: str, schema: str) -> DataFrame:
    """One row per node, with whether it is a relation of the marts."""
    parsed = manifests.select("manifest", F.from_json("text", MANIFEST).alias("m"))
    exploded = parsed.select(
        "manifest",
        F.col("m.metadata.dbt_schema_version").alias("version"),
        F.col("m.metadata.adapter_type").alias("adapter"),
        F.explode(F.map_values("m.nodes")).alias("n"),
    )
    in_marts = (
        F.col("n.resource_type").isin(*RELATIONS)
        & (F.upper("n.database") == database)
        & (F.upper("n.schema") == schema)
    )
    return exploded.select(
        "manifest",
        "version",
        "adapter",
        F.col("n.unique_id").alias("model_id"),
        F.col("n.resource_type").alias("resource_type"),
        F.coalesce(F.col("n.config.contract.enforced"), F.lit(False)).alias("enforced"),
        F.try_element_at("n.config.meta", F.lit("owner")).alias("owner"),
        F.upper(F.coalesce("n.alias", F.lit(""))).alias("table_name"),
        F.col("n.description").alias("table_description"),
        F.coalesce(in_marts, F.lit(False)).alias("in_marts"),
        F.map_values("n.columns").alias("columns"),
    )


def columns(node_rows: DataFrame) -> DataFrame:
    """One row per declared column; a node without columns has one row with a null name."""
    return node_rows.select(
        "*", F.explode_outer("columns").alias("c")
    ).select(
        *[c for c in node_rows.columns if c != "columns"],
        F.col("c.name").alias("declared_name"),
        F.upper("c.name").alias("column_name"),
        F.col("c.data_type").alias("data_type"),
        F.col("c.description").alias("description"),
        F.col("c.quote").alias("quote"),
        F.try_element_at("c.meta", F.lit("sensitivity")).alias("sensitivity"),
    )


def rejects(column_rows: DataFrame) -> DataFrame:
    """What keeps a manifest's marts from being read: (model_id, column_name, problem)."""
    marts = column_rows.where("in_marts")
    quoted_mixed = F.coalesce("quote", F.lit(False)) & (
        F.col("declared_name") != F.upper("declared_name")
    )
    named = {
        "another manifest version": F.coalesce(F.col("version"), F.lit("")) != MANIFEST_VERSION,
        "another adapter": ~F.coalesce(F.col("adapter").isin(*ADAPTERS), F.lit(False)),
        "not a contracted model": (F.col("resource_type") != "model") | ~F.col("enforced"),
        "table is no identifier": ~F.col("table_name").rlike(IDENTIFIER),
        "no columns": F.col("declared_name").isNull(),
        "quoted mixed case": quoted_mixed,
        "no data type": F.col("declared_name").isNotNull()
        & (F.coalesce("data_type", F.lit("")) == ""),
        "column is no identifier": ~F.coalesce(
            F.col("column_name").rlike(IDENTIFIER), F.lit(True)
        ),
    }
    problems = F.array_compact(F.array(*[F.when(c, n) for n, c in named.items()]))
    per_row = marts.select("model_id", "column_name", F.explode(problems).alias("problem"))
    twice = (
        marts.where(F.col("column_name").isNotNull())
        .groupBy("model_id", "column_name")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select("model_id", "column_name", F.lit("declared twice").alias("problem"))
    )
    same_table = (
        marts.select("table_name", "model_id")
        .distinct()
        .groupBy("table_name")
        .agg(F.count(F.lit(1)).alias("n"), F.max("model_id").alias("model_id"))
        .where(F.col("n") > 1)
        .select(
            "model_id",
            F.lit(None).cast("string").alias("column_name"),
            F.lit("a second relation of that name").alias("problem"),
        )
    )
    return per_row.distinct().unionByName(twice).unionByName(same_table)


def catalog(column_rows: DataFrame, database: str, schema: str) -> DataFrame:
    """The marts' columns: (fqn, table_name, column_name, data_type, description,
    sensitivity, owner, documented, table_description)."""
    marts = column_rows.where("in_marts").where(F.col("column_name").isNotNull())
    return marts.select(
        F.concat_ws(".", F.lit(database), F.lit(schema), "table_name", "column_name").alias("fqn"),
        "table_name",
        "column_name",
        "data_type",
        F.when(trimmed(F.coalesce("description", F.lit(""))) != "", F.col("description")).alias(
            "description"
        ),
        "sensitivity",
        "owner",
        is_documented(F.col("description")).alias("documented"),
        "table_description",
    )
