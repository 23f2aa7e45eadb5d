"""Sources and sinks over lines and documents that Spark derives from the tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.contracts import COLUMN_USAGE
from colscope.functions.guards import require_empty
from colscope.operators import experiment, lineage, mentions, quality, snapshot, tokens
from colscope.plans.stages import shared_folder, staged
from colscope.sources import artifacts, catalog, delimited, dictionary, transcripts
from colscope.sources.file_facts import file_facts
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


DDL = (
    "l_orderkey int, l_linenumber int, l_quantity int, l_extendedprice decimal(18,2), "
    "l_returnflag string, filler string"
)
COLUMNS = [c.split()[0] for c in DDL.split(", ")]


HEADER = ";".join([*COLUMNS[:-1], ""])


def lines(spark, d):
    """Lines of monthly-like fact files: a file a year of shipment and 4 million orders, odd years gzipped."""
    line = t.table(spark, d, "lineitem")
    year = F.year("l_shipdate")
    name = F.concat(F.lit("L"), year.cast("string"), F.lit("_"), F.expr("string(l_orderkey div 4000000)"), F.when(year % 2 == 1, ".csv.gz").otherwise(".csv"))
    return line.select(
        name.alias("file"),
        "l_orderkey",
        "l_linenumber",
        F.concat_ws(
            ";",
            F.col("l_orderkey").cast("string"),
            F.col("l_linenumber").cast("string"),
            F.when(F.col("l_linenumber") == 7, "").otherwise(F.col("l_quantity").cast("int").cast("string")),
            F.col("l_extendedprice").cast(t.MONEY).cast("string"),
            "l_returnflag",
            F.lit(""),
        ).alias("value"),
    )


_FILES = """lines AS (SELECT 'L' || CAST(year(l_shipdate) AS VARCHAR) || '_' || CAST(l_orderkey // 4000000 AS VARCHAR) || CASE WHEN year(l_shipdate) % 2 = 1 THEN '.csv.gz' ELSE '.csv' END AS file_name, year(l_shipdate) AS year, l_orderkey, l_linenumber,
 CAST(l_orderkey AS VARCHAR) || ';' || CAST(l_linenumber AS VARCHAR) || ';' || CASE WHEN l_linenumber = 7 THEN '' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END || ';' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) || ';' || l_returnflag || ';' AS value FROM lineitem),
files AS (SELECT file_name, year, count(*) AS rows, sha256('l_orderkey;l_linenumber;l_quantity;l_extendedprice;l_returnflag;' || chr(10) || string_agg(value, chr(10) ORDER BY l_orderkey, l_linenumber, value) || chr(10)) AS sha256 FROM lines GROUP BY 1, 2)"""


@t.memo
def fact_files(spark, d):
    """The paths of those files, written to the shared folder."""
    folder = f"{shared_folder(spark)}/fact-files-{uuid.uuid4().hex}"
    rows = lines(spark, d)
    paths = []
    for gzip in (False, True):
        own = rows.where(F.col("file").endswith(".gz") == gzip)
        head = own.select("file").distinct().withColumn("value", F.lit(HEADER))
        paths += delimited.write_files(own, head, ["l_orderkey", "l_linenumber", "value"], folder, gzip)
    return paths


@t.memo
def fact_facts(spark, d):
    return staged(file_facts(spark, fact_files(spark, d)), "fact-facts").withColumn(
        "year", F.regexp_extract("file_name", "L([0-9]+)", 1).cast("int")
    )


def load_facts(spark, d):
    """The files' rows by a whole load, with pins, into a new folder with a new ledger."""
    folder = f"{shared_folder(spark)}/loaded-{uuid.uuid4().hex}"
    delimited.load(spark, fact_files(spark, d), DDL, fact_facts(spark, d), f"{folder}/raw", f"{folder}/ledger")
    return delimited.loaded(spark, f"{folder}/raw", f"{folder}/ledger", DDL)


@query(
    "s1_delimited_fact",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 7 THEN CAST(l_quantity AS INTEGER) END AS l_quantity,"
    " CAST(l_extendedprice AS DECIMAL(18,2)) AS l_extendedprice, l_returnflag, NULL AS filler FROM lineitem",
)
def s1(spark, d):
    return load_facts(spark, d).drop("source_file")


@t.memo
def supplier_files(spark, d):
    """A file of suppliers a nation, some with a renamed, a missing or a filled last field in the header."""
    n = F.col("s_nationkey")
    rows = t.table(spark, d, "supplier").select(
        F.concat(F.lit("f"), n.cast("string"), F.lit(".csv")).alias("file"),
        "s_nationkey",
        "s_suppkey",
        F.concat_ws(";", F.col("s_suppkey").cast("string"), F.lit("1"), F.lit("2"), F.lit("3.50"), F.lit("A"), F.lit("")).alias("value"),
    )
    head = (
        F.when(n % 5 == 1, HEADER.replace("l_quantity", "L_QTY"))
        .when(n % 5 == 2, HEADER.replace(";l_returnflag;", ""))
        .when(n % 5 == 3, HEADER + "x")
        .otherwise(HEADER)
    )
    heads = rows.select("file", "s_nationkey").distinct().select("file", head.alias("value"))
    return delimited.write_files(rows.drop("s_nationkey"), heads, ["s_suppkey"], f"{shared_folder(spark)}/supplier-files-{uuid.uuid4().hex}")


@query(
    "s2_header_check",
    "SELECT DISTINCT 'f' || CAST(s_nationkey AS VARCHAR) || '.csv' AS file, CASE s_nationkey % 5 WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE 6 END AS field,"
    " CASE s_nationkey % 5 WHEN 1 THEN 'L_QTY' WHEN 3 THEN 'x' END AS found, CASE s_nationkey % 5 WHEN 1 THEN 'l_quantity' WHEN 2 THEN 'l_returnflag' ELSE '' END AS expected"
    " FROM supplier WHERE s_nationkey % 5 IN (1, 2, 3)",
)
def s2(spark, d):
    return delimited.header_differences(delimited.headers(file_facts(spark, supplier_files(spark, d))), COLUMNS)


#: Stored bytes of a gzipped file depend on the packer, so SQL can tell a plain file's hash alone.
_PLAIN = "CASE WHEN file_name LIKE '%.csv' THEN sha256 END"


@query(
    "s3_load_ledger",
    with_sql(
        _FILES,
        f"SELECT file_name, {_PLAIN} AS sha256, CASE year % 4 WHEN 0 THEN 'load' WHEN 1 THEN 'skip' WHEN 2 THEN 'other bytes' ELSE 'other ddl' END AS action FROM files",
    ),
)
def s3(spark, d):
    f = fact_facts(spark, d)
    m = F.col("year") % 4
    ledger = f.where(m != 0).select(
        "file_name",
        F.when(m == 2, "old").otherwise(F.col("sha256")).alias("sha256"),
        F.when(m == 3, "ddl0").otherwise("ddl1").alias("ddl_sha256"),
    )
    plan = delimited.load_plan(f, ledger, "ddl1")
    return plan.withColumn("sha256", F.when(F.col("file_name").endswith(".csv"), F.col("sha256")))


@query(
    "s4_pin_reconciliation",
    with_sql(
        _FILES,
        "SELECT file_name, CASE year % 5 WHEN 0 THEN 'rows' WHEN 1 THEN 'sha256' ELSE 'bytes,sha256,rows' END AS differs FROM files WHERE year % 5 < 3",
    ),
)
def s4(spark, d):
    """Pins of plain files come from the table, but for the hash; those of gzipped ones from the files."""
    f = fact_facts(spark, d)
    m = F.col("year") % 5
    counted = lines(spark, d).groupBy(F.col("file").alias("file_name")).agg(
        F.count(F.lit(1)).alias("lines"), (F.sum(F.octet_length("value") + 1) + len(HEADER) + 1).alias("size")
    )
    pins = f.join(counted, "file_name").where(m != 2).select(
        "file_name",
        F.when(F.col("file_name").endswith(".csv"), F.col("size")).otherwise(F.col("bytes")).alias("bytes"),
        F.when(m == 1, "other").otherwise(F.col("sha256")).alias("sha256"),
        F.when(m == 0, F.col("lines") + 1).otherwise(F.col("lines")).alias("rows"),
    )
    return delimited.pin_mismatches(f.select("file_name", "bytes", "sha256", "rows"), pins)


@query("d12_not_null_on_load", "SELECT 'l_quantity' AS column_name, count(*) AS nulls FROM lineitem WHERE l_linenumber = 7 HAVING count(*) > 0")
def d12(spark, d):
    """What a load under a stricter declaration is refused for, seen while the rows were written."""
    strict = DDL.replace("l_quantity int", "l_quantity int not null").replace("l_returnflag string", "l_returnflag string not null")
    _, empties = delimited.stage(spark, fact_files(spark, d), strict, f"{shared_folder(spark)}/refused-{uuid.uuid4().hex}")
    return empties


# Manifests: one document per brand, a node per model, a column per part name.


@t.memo
def manifests(spark, d):
    c = t.catalog(spark, d)
    column = F.struct(
        F.col("column_name").alias("name"),
        F.col("description"),
        F.col("data_type"),
        F.create_map(F.lit("sensitivity"), F.col("sensitivity")).alias("meta"),
    )
    models = c.groupBy("table_name").agg(
        F.map_from_entries(F.collect_list(F.struct(F.lower("column_name"), column))).alias("columns"),
        F.sum("parts").alias("n"),
    )
    # A staging twin of each model, outside the marts, must be ignored.
    node = lambda schema, enforced: F.struct(
        F.lit("model").alias("resource_type"),
        F.concat(F.lit("model.shop."), F.lit(schema), F.lit("."), F.lower("table_name")).alias("unique_id"),
        F.concat(F.lit("Model of "), "table_name").alias("description"),
        F.lit("analytics").alias("database"),
        F.lit(schema).alias("schema"),
        F.lower("table_name").alias("alias"),
        F.struct(
            F.struct(enforced.alias("enforced")).alias("contract"),
            F.create_map(F.lit("owner"), F.when(F.col("n") % 5 == 0, " ").otherwise("data-team")).alias("meta"),
        ).alias("config"),
        F.col("columns"),
    )
    document = F.struct(
        F.struct(
            F.lit(catalog.MANIFEST_VERSION).alias("dbt_schema_version"),
            F.lit("duckdb").alias("adapter_type"),
        ).alias("metadata"),
        F.create_map(
            F.lit("mart"),
            node("marts", F.col("n") % 7 != 0),
            F.lit("stg"),
            node("staging", F.lit(False)),
        ).alias("nodes"),
    )
    return models.select(F.col("table_name").alias("manifest"), F.to_json(document).alias("text"))


@t.memo
def manifest_columns(spark, d):
    return catalog.columns(catalog.nodes(manifests(spark, d), t.DATABASE, t.SCHEMA))


_MODELS = f"{t.CATALOG_SQL}, models AS (SELECT table_name, sum(parts) AS n FROM cat GROUP BY 1)"


@query(
    "s6_catalog_source",
    with_sql(
        _MODELS,
        "SELECT fqn, c.table_name, column_name, data_type, CASE WHEN documented THEN description END AS description, sensitivity, CASE WHEN n % 5 = 0 THEN ' ' ELSE 'data-team' END AS owner, documented, 'Model of ' || c.table_name AS table_description FROM cat c JOIN models m ON m.table_name = c.table_name",
    ),
)
def s6(spark, d):
    return catalog.catalog(manifest_columns(spark, d), t.DATABASE, t.SCHEMA)


@query(
    "s6_catalog_rejects",
    with_sql(
        _MODELS,
        "SELECT 'model.shop.marts.' || lower(c.table_name) AS model_id, column_name, 'not a contracted model' AS problem FROM cat c JOIN models m ON m.table_name = c.table_name WHERE n % 7 = 0",
    ),
)
def s6b(spark, d):
    return catalog.rejects(manifest_columns(spark, d))


@query(
    "d5_metadata_lint",
    with_sql(
        _MODELS,
        "SELECT 'model.shop.' || s || '.' || lower(table_name) || ': no owner' AS gap FROM models, (VALUES ('marts'), ('staging')) v(s) WHERE n % 5 = 0"
        " UNION ALL SELECT 'model.shop.marts.' || lower(table_name) || '.' || column_name || ': no known sensitivity' FROM cat WHERE sensitivity IS NULL",
    ),
)
def d5(spark, d):
    return quality.metadata_gaps(manifest_columns(spark, d))


@query(
    "s7_code_list_source",
    """SELECT n_nationkey AS code, n_name || ', "the" nation' AS "code_LIB" FROM nation UNION ALL SELECT c_custkey, c_name FROM customer""",
)
def s7(spark, d):
    n = t.table(spark, d, "nation").select(F.col("n_nationkey").alias("code"), F.concat("n_name", F.lit(', "the" nation')).alias("code_LIB"))
    c = t.table(spark, d, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("code_LIB"))
    path = f"{shared_folder(spark)}/code-list-{uuid.uuid4().hex}"
    n.unionByName(c).write.option("header", True).option("escape", '"').csv(path)
    return dictionary.read_code_list(spark, path, "code")


# Sheets: each conversation is a sheet; a first turn opens a list, every fourth ends it.


def sheet_rows(spark, d):
    c = t.table(spark, d, "conversations")
    m = F.col("turn") % 4
    return c.select(
        F.col("conv_id").alias("sheet"),
        F.col("turn").alias("row_no"),
        F.when(m == 3, F.array(F.lit(None).cast("string"), F.lit(None).cast("string")))
        .when(m == 0, F.array(F.when(F.col("conv_id") % 2 == 0, "VAR_A").otherwise("VAR_B"), F.lit(" the label ")))
        .otherwise(
            F.array(
                F.when(F.col("conv_id") % 9 == 4, "x1").otherwise((F.col("conv_id") * 100 + F.col("turn")).cast("string")),
                F.when(F.col("conv_id") % 9 == 5, "  ").otherwise(F.concat(F.lit(" "), "role", F.lit(" "))),
            )
        )
        .alias("cells"),
    )


_SHEET = "conv AS (SELECT * FROM conversations), op AS (SELECT DISTINCT conv_id, turn - turn % 4 AS start FROM conv WHERE turn % 4 = 0), body AS (SELECT c.*, CASE WHEN conv_id % 2 = 0 THEN 'VAR_A' ELSE 'VAR_B' END AS variable FROM conv c WHERE turn % 4 IN (1, 2) AND (conv_id, turn - turn % 4) IN (SELECT (conv_id, start) FROM op))"


@query(
    "s8_sectioned_lists",
    with_sql(
        _SHEET,
        "SELECT variable, CASE WHEN conv_id % 9 <> 4 THEN CAST(conv_id * 100 + turn AS INTEGER) END AS code, CASE WHEN conv_id % 9 <> 5 THEN role END AS label FROM body",
    ),
)
def s8(spark, d):
    return dictionary.code_lists(sheet_rows(spark, d), ["VAR_A", "VAR_B"])


@query(
    "s8_sectioned_list_problems",
    with_sql(
        _SHEET,
        "SELECT variable, CASE WHEN conv_id % 9 = 4 THEN 'x1' ELSE CAST(conv_id * 100 + turn AS VARCHAR) END AS detail, CASE WHEN conv_id % 9 = 4 THEN 'code is no integer' ELSE 'no label' END AS problem FROM body WHERE conv_id % 9 IN (4, 5)"
        " UNION ALL SELECT 'VAR_C', NULL, 'no code list'",
    ),
)
def s8b(spark, d):
    return dictionary.code_list_problems(sheet_rows(spark, d), ["VAR_A", "VAR_B", "VAR_C"])


def variables(spark, d):
    p = t._names(t.table(spark, d, "part"))
    return p.groupBy(F.col("col").alias("name")).agg(F.min("p_size").alias("low"), F.min("p_type").alias("kind"))


@query(
    "s9_dictionary_texts",
    with_sql(
        t.CATALOG_SQL,
        "SELECT col AS variable, min(p_type) AS label, min(p_type) || CASE WHEN min(p_size) % 2 = 0 THEN chr(10) || 'from ' || CAST(min(p_size) AS VARCHAR) ELSE '' END AS text FROM parts GROUP BY col",
    ),
)
def s9(spark, d):
    body = variables(spark, d).select(
        F.lit("dictionary").alias("sheet"),
        (F.xxhash64("name").bitwiseAND(F.lit(0xFFFFFFFFFF)) + 2).alias("row_no"),
        F.array(
            F.lit(None).cast("string"),
            F.concat(F.lit(" "), "name"),
            F.concat("kind", F.lit("  ")),
            F.when(F.col("low") % 2 == 0, F.concat(F.lit("from "), F.col("low").cast("string"))).otherwise("  "),
        ).alias("cells"),
    )
    head = spark.range(1).select(
        F.lit("dictionary").alias("sheet"),
        F.lit(1).cast("bigint").alias("row_no"),
        F.array(F.lit("Category"), F.lit("Name"), F.lit("Label"), F.lit("Comment")).alias("cells"),
    )
    return dictionary.sheet_variable_texts(head.unionByName(body), ["Name", "Label", "Comment"]).select(
        "variable", "label", "text"
    )


_DOCS = "vars AS (SELECT col, min(p_size) AS low, min(p_type) AS kind FROM parts GROUP BY col), docs AS (SELECT col AS column_name, CASE WHEN low % 3 = 0 THEN 'Text of ' || kind WHEN low % 3 = 1 THEN 'Label of ' || kind END AS text FROM vars)"


def docs(spark, d):
    v = variables(spark, d)
    texts = v.where("low % 3 = 0").select(F.col("name").alias("variable"), F.concat(F.lit("Text of "), "kind").alias("text"))
    labels = v.where("low % 3 = 1").select(F.col("name").alias("variable"), F.concat(F.lit("Label of "), "kind").alias("text"))
    return dictionary.column_docs(t.catalog(spark, d), texts, labels)


@query("s10_docs_assembly", with_sql(f"{t.CATALOG_SQL}, {_DOCS}", "SELECT column_name, text FROM docs"))
def s10(spark, d):
    return docs(spark, d)


@query(
    "d9_columns_without_text",
    with_sql(f"{t.CATALOG_SQL}, {_DOCS}", "SELECT column_name FROM docs WHERE text IS NULL"),
)
def d9(spark, d):
    return dictionary.undocumented(docs(spark, d))


@query("u7_ceiling_texts", with_sql(f"{t.CATALOG_SQL}, {_DOCS}", "SELECT fqn, text FROM cat JOIN docs USING (column_name)"))
def u7b(spark, d):
    return experiment.ceiling_texts(t.catalog(spark, d), docs(spark, d))


@query(
    "s11_typed_artifact",
    with_sql(
        t.CATALOG_SQL,
        "SELECT fqn, parts AS executions_agent, 0::BIGINT AS executions_human, 1::BIGINT AS fingerprints_agent, 0::BIGINT AS fingerprints_human, 1::BIGINT AS questions, CAST(low AS BIGINT) AS runs FROM cat",
    ),
)
def s11(spark, d):
    usage = t.catalog(spark, d).select(
        "fqn",
        F.col("parts").alias("executions_agent"),
        F.lit(0).alias("executions_human"),
        F.lit(1).alias("fingerprints_agent"),
        F.lit(0).alias("fingerprints_human"),
        F.lit(1).alias("questions"),
        F.col("low").alias("runs"),
    )
    path = f"{shared_folder(spark)}/column-usage-{uuid.uuid4().hex}"
    artifacts.write_artifact(usage.where("executions_agent > 1"), COLUMN_USAGE, ["fqn"], path)
    artifacts.write_artifact(usage, COLUMN_USAGE, ["fqn"], path)
    require_empty(artifacts.order_breaks(spark, path), "the artifact isn't in its total order")
    return artifacts.read_artifact(spark, COLUMN_USAGE, path)


@query(
    "s12_content_hash",
    """WITH r AS (SELECT sha256('{"c_custkey":' || CAST(c_custkey AS VARCHAR) || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","c_nationkey":' || CAST(c_nationkey AS VARCHAR) || '}') AS d FROM customer),
l AS (SELECT sha256(d || ':' || CAST(count(*) AS VARCHAR)) AS line FROM r GROUP BY d)
SELECT sha256(concat_ws(':', count(*), sum(CAST(CAST('0x' || substr(line, 1, 15) AS BIGINT) AS HUGEINT)), sum(CAST(CAST('0x' || substr(line, 16, 15) AS BIGINT) AS HUGEINT)),
  sum(CAST(CAST('0x' || substr(line, 31, 15) AS BIGINT) AS HUGEINT)), sum(CAST(CAST('0x' || substr(line, 46, 15) AS BIGINT) AS HUGEINT)))) AS content_sha256 FROM l""",
)
def s12(spark, d):
    c = t.table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    # Another row order and another partitioning give the same hash.
    return artifacts.content_hash(c.repartition(5, "c_nationkey"))


@query(
    "s13_provenance",
    with_sql(
        _FILES,
        "SELECT file_name AS stem, CASE year % 4 WHEN 0 THEN 'no stored result' WHEN 1 THEN 'result with no owner' ELSE 'stored from other SQL or other data' END AS problem FROM files WHERE year % 4 < 3 OR year = 1995",
    ),
)
def s13(spark, d):
    """A result a file, stored with the hash of the SQL that made it and of the files' pins."""
    f = fact_facts(spark, d)
    stems = f.select(F.col("file_name").alias("stem"), (F.col("year") % 4).alias("m"), "year")
    sql = F.concat(F.lit("SELECT count(*) FROM raw WHERE source_file = '"), "stem", F.lit("'"))
    pins = f.select("file_name", "bytes", "sha256", "rows")
    older = pins.withColumn("rows", F.col("rows") - 1)
    edited = F.when(F.col("year") == 1995, F.concat(sql, F.lit(" LIMIT 1"))).otherwise(sql)
    stored = artifacts.stamped(stems.where("m in (1, 3)"), edited, pins).unionByName(artifacts.stamped(stems.where("m = 2"), sql, older))
    expected = artifacts.stamped(stems.where("m <> 1"), sql, pins)
    keep = ("stem", "sql_sha256", "data_sha256")
    return artifacts.stale_results(stored.select(*keep), expected.select(*keep))


@query(
    "s16_missing_mart_tables",
    with_sql(
        t.CATALOG_SQL,
        "SELECT table_name FROM cat GROUP BY 1 HAVING sum(parts) % 2 = 0",
    ),
)
def s16(spark, d):
    c = t.catalog(spark, d)
    present = c.groupBy("table_name").agg(F.sum("parts").alias("n")).where("n % 2 = 1")
    stale = t.table(spark, d, "nation").select(F.col("n_name").alias("table_name"))
    return artifacts.missing_tables(c, present.select("table_name").unionByName(stale))


@query(
    "s16_exported_marts",
    "SELECT 'mart_nation' AS table_name, count(*) AS rows, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM nation UNION ALL SELECT 'mart_customer', count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer WHERE c_custkey % 3 = 0",
)
def s16b(spark, d):
    """Two exports of the same marts, the second with fewer tables: the current version holds those alone."""
    path = f"{shared_folder(spark)}/marts-{uuid.uuid4().hex}"
    customers = t.table(spark, d, "customer")
    t.table(spark, d, "nation").createOrReplaceTempView("mart_nation")
    t.table(spark, d, "region").createOrReplaceTempView("mart_region")
    customers.createOrReplaceTempView("mart_customer")
    artifacts.export_marts(spark, ["MART_NATION", "MART_REGION", "MART_CUSTOMER"], path)
    customers.where("c_custkey % 3 = 0").createOrReplaceTempView("mart_customer")
    artifacts.export_marts(spark, ["MART_NATION", "MART_CUSTOMER"], path)
    counted = lambda name, df: df.agg(F.count(F.lit(1)).alias("rows"), F.sum(df.columns[0]).cast("bigint").alias("keys")).select(F.lit(name).alias("table_name"), "rows", "keys")
    return reduce(DataFrame.unionByName, [counted(n, df) for n, df in artifacts.exported(spark, path).items()])


# Transcripts: a document per event of the history, its query as a tool call.


@t.memo
def transcript_docs(spark, d):
    """The documents, written a line each and read back."""
    h = t.history(spark, d).where("query_tag LIKE 'agent:run%'")
    parts = F.split("query_tag", ":")
    nothing = lambda kind: F.lit(None).cast(kind)
    block = lambda kind, id_, name, value: F.struct(F.lit(kind).alias("type"), id_.alias("id"), name.alias("name"), value.alias("input"))
    call = F.array(
        block("text", nothing("string"), nothing("string"), nothing("map<string,string>")),
        block("tool_use", F.concat(F.lit("t"), "query_id"), F.lit("run_sql"), F.create_map(F.lit("sql"), F.col("query_text"))),
        block("tool_use", F.concat(F.lit("d"), "query_id"), F.lit("describe"), F.create_map(F.lit("table"), F.lit("T"))),
    )
    question = F.concat(F.lit('"question '), F.get(parts, F.lit(2)), F.lit('"'))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), F.parse_json(content).alias("content"))
    failed = F.col("execution_status") == "FAIL"
    doc = F.struct(
        F.get(parts, F.lit(1)).alias("run_id"),
        F.get(parts, F.lit(2)).alias("qid"),
        F.col("query_id").cast("bigint").alias("repetition"),
        (F.col("query_id").cast("bigint") % 3).alias("failed_calls"),
        F.array(message("user", question), message("assistant", F.to_json(call))).alias("messages"),
        F.lit(2).alias("tool_calls"),
        F.when(~failed, F.col("query_text")).alias("final_sql"),
        F.when(failed, "error").otherwise("result").alias("outcome"),
        F.when(failed, "sql").alias("error_cause"),
    )
    path = f"{shared_folder(spark)}/transcripts-{uuid.uuid4().hex}"
    h.select(F.to_json(doc)).write.text(path)
    return transcripts.read_transcripts(spark, path, whole_files=False)


_TAGGED = "tagged AS (SELECT * FROM hist WHERE run_id IS NOT NULL)"


@query(
    "s14_transcript_runs",
    with_sql(
        f"{t.HISTORY_SQL}, {_TAGGED}",
        "SELECT run_id, qid, event_id AS repetition, CASE WHEN succeeded THEN 'result' ELSE 'error' END AS outcome, CASE WHEN NOT succeeded THEN 'sql' END AS error_cause, event_id % 3 AS failed_calls, 'question ' || qid AS asked FROM tagged",
    ),
)
def s14(spark, d):
    runs = transcripts.runs(transcript_docs(spark, d))
    return runs.select("run_id", "qid", "repetition", "outcome", "error_cause", "failed_calls", "asked")


@query(
    "s14_transcript_tool_calls",
    with_sql(
        f"{t.HISTORY_SQL}, {_TAGGED}",
        "SELECT run_id, qid, event_id AS repetition, 1 AS message_no, 1 AS block_no, 't' || query_id AS tool_use_id, 'run_sql' AS tool, true AS has_sql FROM tagged"
        " UNION ALL SELECT run_id, qid, event_id, 1, 2, 'd' || query_id, 'describe', false FROM tagged",
    ),
)
def s14b(spark, d):
    uses = transcripts.tool_uses(transcript_docs(spark, d))
    return uses.withColumn("has_sql", F.col("sql").isNotNull()).drop("sql")


@query(
    "l11_tool_call_traffic",
    with_sql(
        f"{t.REFS_SQL}, {_TAGGED}",
        """, made AS (SELECT g.*, event_type = 'signup' OR good_text LIKE 'SELECT * EXCLUDE%' AS starred FROM tagged g, (VALUES (1), (2)) v(i) WHERE text_problem IS NULL AND (i = 1 OR succeeded)),
 named AS (SELECT m.event_id, succeeded, unnest(CASE event_type WHEN 'signup' THEN [] WHEN 'purchase' THEN [tbl || '.' || col, tbl2 || '.' || col2]
   WHEN 'error' THEN CASE WHEN event_id % 10 = 3 THEN [] ELSE [tbl || '.' || col2, tbl || '.' || col, tbl2 || '.' || col2] END ELSE [tbl || '.' || col, tbl || '.' || col2] END) AS name FROM made m),
 reads AS (SELECT event_id, count(DISTINCT name) AS n, 0 AS s FROM named JOIN cat ON cat.table_name || '.' || cat.column_name = name GROUP BY event_id
   UNION ALL SELECT event_id, count(*), count(*) FROM tagged JOIN cat ON cat.table_name = tbl
     WHERE text_problem IS NULL AND (event_type = 'signup' AND event_id % 2 = 0 OR good_text LIKE 'SELECT * EXCLUDE%' AND cat.column_name <> col2) GROUP BY event_id),
 sums AS (SELECT sum(n) AS n, sum(s) AS s FROM made JOIN reads USING (event_id))
 SELECT count(*) AS queries, count(*) FILTER (starred) AS starred, round(100.0 * count(*) FILTER (starred) / count(*), 1)::DOUBLE AS star_percent,
  CAST(any_value(n) AS BIGINT) AS column_reads, CAST(any_value(s) AS BIGINT) AS star_reads, round(100.0 * any_value(s) / any_value(n), 1)::DOUBLE AS star_read_percent FROM made, sums""",
    ).replace(" , made AS", ", made AS"),
)
def l11(spark, d):
    """The share of queries with a star at the top, and of their column reads that come from a star alone."""
    # Events count from 0, but the repetition of a well-formed tag from 1.
    docs_ = transcript_docs(spark, d).withColumn("repetition", F.col("repetition") + 1)
    h = transcripts.as_history(docs_, "2024-01-30 00:00:00", "AGENT_READER", t.DATABASE, t.SCHEMA)
    kept = staged(snapshot.kept_records(snapshot.classified(h, t.actors(spark), t.AS_OF, t.WINDOW_DAYS)), "traffic")
    texts = tokens.distinct_texts(kept)
    weights = lineage.with_text_id(kept).groupBy("text_id").agg(F.count(F.lit(1)).alias("n"))
    stars = mentions.segments(texts).groupBy("text_id").agg(F.bool_or("star").alias("star"))
    read = mentions.mentions(texts, t.catalog(spark, d), t.DATABASE, t.SCHEMA).where("NOT ambiguous")
    reads = read.groupBy("text_id").agg(F.count(F.lit(1)).alias("reads"), F.count_if("by_star").alias("by_star"))
    per = weights.join(stars, "text_id", "left").join(reads, "text_id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    sums = per.agg(
        total("n").alias("queries"),
        total(F.when(F.col("star"), F.col("n"))).alias("starred"),
        total(F.col("n") * F.col("reads")).alias("column_reads"),
        total(F.col("n") * F.col("by_star")).alias("star_reads"),
    )
    percent = lambda a, b: F.round(F.try_divide(100.0 * F.col(a), F.col(b)), 1)
    return sums.withColumns({"star_percent": percent("starred", "queries"), "star_read_percent": percent("star_reads", "column_reads")})


@query(
    "s15_call_log",
    "SELECT event_type AS stage, CAST(user_id % 5 AS VARCHAR) AS run_id, count(*) AS events, CAST(sum(CAST(regexp_extract(props, '[0-9]+') AS BIGINT)) AS BIGINT) AS input_tokens FROM events GROUP BY 1, 2",
)
def s15(spark, d):
    e = t.table(spark, d, "events")
    line = F.to_json(
        F.struct(
            (F.col("user_id") % 5).cast("string").alias("run_id"),
            F.col("event_type").alias("stage"),
            F.col("event_id").cast("string").alias("item"),
            F.lit("model_call").alias("event"),
            F.col("value").alias("duration_ms"),
            F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("input_tokens"),
        )
    )
    path = f"{shared_folder(spark)}/call-log-{uuid.uuid4().hex}"
    e.select(line).write.text(path)
    log = transcripts.read_call_log(spark, path)
    return log.groupBy("stage", "run_id").agg(
        F.count(F.lit(1)).alias("events"), F.sum("input_tokens").alias("input_tokens")
    )

