"""Files on disk: history lines, delimited facts, idempotent loads."""

from __future__ import annotations

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from colscope.functions.guards import ContractViolation
from colscope.sources import artifacts, delimited, file_facts, history, transcripts

DDL = "A int, B decimal(18,2), C int, FILLER string"
ROW = {
    "QUERY_ID": "7f3", "QUERY_TEXT": "select title from books where owner = 'HIDE ME'", "START_TIME": "2031-05-11T07:30:00Z",
    "ROLE_NAME": "DESK", "QUERY_TAG": "desk", "EXECUTION_STATUS": "FAIL", "DATABASE_NAME": "LIBRARY", "SCHEMA_NAME": None,
}


def test_history_rejects_name_line_and_field(spark, tmp_path):
    rows = [ROW, {**ROW, "EXTRA": 1}, {**ROW, "QUERY_TEXT": None}, {**ROW, "START_TIME": "2031-05-11 07:30"}, {**ROW, "DATABASE_NAME": "low"}]
    path = tmp_path / "h.jsonl"
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    good, bad = history.read_history(spark, str(path))
    assert good.count() == 1
    assert {(r["line"], r["bad_field"]) for r in bad.collect()} == {
        (2, "EXTRA"), (3, "QUERY_TEXT"), (4, "START_TIME"), (5, "DATABASE_NAME"),
    }
    assert "value" not in bad.columns


def test_history_lines_are_strict(spark, tmp_path):
    good = json.dumps(ROW)
    lines = [good, good + " x", good + good, good + "," + good, "[]", "", json.dumps({**ROW, "QUERY_ID": 7}), json.dumps({**ROW, "QUERY_TAG": 1}), good[:-1] + ', "QUERY_ID": "2"}', json.dumps({**ROW, "QUERY_TAG": None}), json.dumps({**ROW, "ROLE_NAME": ""})]
    (tmp_path / "h.jsonl").write_text("\n".join(lines) + "\n")
    rows, bad = history.read_history(spark, str(tmp_path / "h.jsonl"))
    assert rows.count() == 2
    none = "(not an object)"
    assert sorted((r["line"], r["bad_field"]) for r in bad.collect()) == [
        (2, none), (3, none), (4, none), (5, none), (6, none), (7, "QUERY_ID"), (8, "QUERY_TAG"), (9, none), (11, "ROLE_NAME"),
    ]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parsejson") == 1


def test_transcripts_of_whole_files(spark, tmp_path):
    for i, content in enumerate(["plain", [{"type": "tool_use", "id": "a", "name": "run_sql", "input": {"sql": "select 1"}}, {"type": "text", "text": "x"}, {"type": "tool_use", "id": "b", "name": "other", "input": {"sql": "no"}}]]):
        doc = {"run_id": "r", "qid": f"q{i}", "repetition": i, "messages": [{"role": "user", "content": "ask"}, {"role": "assistant", "content": content}], "outcome": "result"}
        (tmp_path / f"{i}.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "bad.json").write_text("{")
    docs = transcripts.read_transcripts(spark, str(tmp_path))
    assert docs._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1
    assert sorted((r["qid"] or "", r["asked"] or "") for r in transcripts.runs(docs).collect()) == [("", ""), ("q0", "ask"), ("q1", "ask")]
    uses = transcripts.tool_uses(docs).collect()
    assert [(r["qid"], r["message_no"], r["block_no"], r["tool_use_id"], r["tool"], r["sql"]) for r in uses] == [
        ("q1", 1, 0, "a", "run_sql", "select 1"), ("q1", 1, 2, "b", "other", None),
    ]


def test_load_is_idempotent(spark, tmp_path):
    path = tmp_path / "m1.csv"
    path.write_text("A;B;C;\n1;.61;;\n2;1.50;3;\n")
    paths = [str(path)]
    pins = delimited.file_digests(spark, paths).join(delimited.file_rows(spark, paths, DDL), "file_name")
    args = (spark, paths, DDL, pins, str(tmp_path / "raw"), str(tmp_path / "ledger"))
    assert [r["rows"] for r in delimited.load(*args).collect()] == [2]
    assert delimited.load(*args).count() == 0
    raw = spark.read.parquet(str(tmp_path / "raw"))
    assert {(r["A"], str(r["B"]), r["C"]) for r in raw.collect()} == {(1, "0.61", None), (2, "1.50", 3)}
    bad = tmp_path / "m2.csv"
    bad.write_text("A;X;C;\n1;1;1;\n")
    with pytest.raises(ContractViolation, match="header"):
        delimited.load(spark, [str(bad)], DDL, pins, *args[4:])


def _load(spark, tmp_path, text, ddl=DDL, name="m.csv", pin=None):
    path = tmp_path / name
    if name.endswith(".gz"):
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path.write_text(text)
    paths = [str(path)]
    pins = delimited.file_digests(spark, paths).join(delimited.file_rows(spark, paths, DDL), "file_name")
    pins = pins.withColumns(pin or {})
    out = delimited.load(spark, paths, ddl, pins, str(tmp_path / "raw"), str(tmp_path / "ledger"))
    return [r["rows"] for r in out.collect()]


def _nothing_loaded(tmp_path):
    return not list((tmp_path / "raw").rglob("*.parquet")) and not (tmp_path / "ledger").exists()


def test_gzipped_files_load(spark, tmp_path):
    assert _load(spark, tmp_path, "A;B;C;\n7;1.25;9;\n8;;;\n", name="m.csv.gz") == [2]
    raw = spark.read.parquet(str(tmp_path / "raw"))
    assert {(r["A"], r["B"], r["C"]) for r in raw.select("A", F.col("B").cast("double"), "C").collect()} == {(7, 1.25, 9), (8, None, None)}


def test_an_empty_required_field_loads_nothing(spark, tmp_path):
    with pytest.raises(ContractViolation, match="NOT NULL"):
        _load(spark, tmp_path, "A;B;C;\n7;1.25;9;\n;2;3;\n", ddl="A int not null, B decimal(18,2), C int, FILLER string")
    assert _nothing_loaded(tmp_path)


def test_a_value_of_another_type_loads_nothing(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        _load(spark, tmp_path, "A;B;C;\nseven;1.25;9;\n")
    assert _nothing_loaded(tmp_path)


@pytest.mark.parametrize("pin", [("rows", 5), ("sha256", "0" * 64), ("bytes", 1)])
def test_a_file_other_than_its_pin_loads_nothing(spark, tmp_path, pin):
    with pytest.raises(ContractViolation, match="pin"):
        _load(spark, tmp_path, "A;B;C;\n7;1.25;9;\n", pin={pin[0]: F.lit(pin[1])})
    assert _nothing_loaded(tmp_path)


def test_facts_of_files_in_small_steps(spark, tmp_path):
    data = b"A;B;\n" + b"".join(b"%d;\xc3\xa9x;\n" % i if i % 5 else b" \r\n" for i in range(3000)) + b"9;9;"
    files = {"a.csv": data, "b.csv.gz": gzip.compress(data[:777]) + gzip.compress(data[777:]), "empty.csv": b"", "head.csv": b"A;B", "empty.csv.gz": gzip.compress(b"")}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    paths = [str(tmp_path / n) for n in files]
    for step in (64, 1 << 20):
        got = {r["file_name"]: r for r in file_facts.file_facts(spark, paths, step).collect()}
        assert {n: (r["bytes"], r["sha256"]) for n, r in got.items()} == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in files.items()}
        assert {n: (r["header"], r["rows"]) for n, r in got.items()} == {
            "a.csv": ("A;B;", 2401), "b.csv.gz": ("A;B;", 2401), "empty.csv": (None, 0), "head.csv": ("A;B", 0), "empty.csv.gz": ("", 0),
        }
    assert file_facts.file_facts(spark, paths).rdd.getNumPartitions() == len(paths)
    (tmp_path / "cut.csv.gz").write_bytes(gzip.compress(data)[:-20])
    with pytest.raises(Exception, match="gzip"):
        file_facts.file_facts(spark, [str(tmp_path / "cut.csv.gz")]).collect()


def test_a_load_is_published_by_its_ledger_row_alone(spark, tmp_path):
    raw, ledger = str(tmp_path / "raw"), str(tmp_path / "ledger")
    assert delimited.loaded(spark, raw, ledger, DDL).count() == 0
    assert _load(spark, tmp_path, "A;B;C;\n7;1.25;9;\n") == [1]
    # a load that was cut short leaves rows that no ledger row names
    delimited.stage(spark, [str(tmp_path / "m.csv")], DDL, f"{raw}/load=cut")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        _load(spark, tmp_path, "A;B;C;\nx;1.25;9;\n", name="n.csv")
    assert _load(spark, tmp_path, "A;B;C;\n8;-.8;;\n9;2;1;\n", name="n.csv") == [2]
    got = delimited.loaded(spark, raw, ledger, DDL)
    assert got.columns == ["A", "B", "C", "FILLER", "source_file"]
    assert {(r["A"], str(r["B"]), r["C"], r["source_file"]) for r in got.collect()} == {(7, "1.25", 9, "m.csv"), (8, "-0.80", None, "n.csv"), (9, "2.00", 1, "n.csv")}


def test_files_are_read_once_as_stored_and_once_as_rows(spark, tmp_path):
    (tmp_path / "m.csv").write_text("A;B;C;\n1;2;;\n;2;3;\n")
    strict = DDL.replace("A int", "A int not null").replace("C int", "C int not null")
    rows, empties = delimited.stage(spark, [str(tmp_path / "m.csv")], strict, str(tmp_path / "out"))
    assert rows == 2 and {tuple(r) for r in empties.collect()} == {("A", 1), ("C", 1)}


def test_written_files_have_their_names_headers_and_order(spark, tmp_path):
    lines = spark.createDataFrame([("b.csv", 2, "2;"), ("a.csv.gz", 9, "9;"), ("b.csv", 1, "1;")], "file string, n int, value string")
    heads = spark.createDataFrame([("b.csv", "H;"), ("a.csv.gz", "H;")], "file string, value string")
    paths = delimited.write_files(lines.where("file = 'b.csv'"), heads.where("file = 'b.csv'"), ["n"], str(tmp_path))
    paths += delimited.write_files(lines.where("file <> 'b.csv'"), heads.where("file <> 'b.csv'"), ["n"], str(tmp_path), gzip=True)
    assert [p.rsplit("/", 1)[-1] for p in paths] == ["b.csv", "a.csv.gz"]
    assert (tmp_path / "b.csv").read_text() == "H;\n1;\n2;\n"
    assert gzip.decompress((tmp_path / "a.csv.gz").read_bytes()) == b"H;\n9;\n"


def test_other_bytes_or_another_ddl_are_conflicts(spark, tmp_path):
    assert _load(spark, tmp_path, "A;B;C;\n7;1.25;9;\n") == [1]
    with pytest.raises(ContractViolation, match="other bytes"):
        _load(spark, tmp_path, "A;B;C;\n7;1.26;9;\n")
    with pytest.raises(ContractViolation, match="another DDL"):
        _load(spark, tmp_path, "A;B;C;\n7;1.25;9;\n", ddl=DDL.replace("C int", "C bigint"))


def test_content_hash_ignores_order_and_sees_every_change(spark):
    rows = [(i, f"t{i % 7}") for i in range(200)] + [(3, "t3")]
    hashed = lambda r, n: artifacts.content_hash(spark.createDataFrame(r, "a int, b string").repartition(n)).first()[0]
    assert hashed(rows, 3) == hashed(rows[::-1], 5)
    assert len({hashed(rows, 2), hashed(rows[:-1], 2), hashed([*rows[:50], (50, "x"), *rows[51:]], 2)}) == 3


def test_an_artifact_is_its_last_commit(spark, tmp_path):
    path, ddl = str(tmp_path / "a"), "k bigint, v string"
    with pytest.raises(ValueError, match="nothing is committed"):
        artifacts.read_artifact(spark, ddl, path)
    rows = lambda n: spark.range(n).select(F.col("id").alias("k"), F.lit("x").alias("v"), F.lit(1).alias("more")).repartition(3)
    artifacts.write_artifact(rows(50), ddl, ["k"], path)
    # a write that broke off: rows without a commit
    rows(9).write.parquet(f"{path}/version-broken/rows")
    got = artifacts.read_artifact(spark, ddl, path)
    assert got.columns == ["k", "v"] and got.count() == 50
    assert artifacts.order_breaks(spark, path).count() == 0
    artifacts.write_artifact(rows(7).unionAll(rows(3)), ddl, ["k"], path)
    assert artifacts.read_artifact(spark, ddl, path).count() == 10
    assert artifacts.order_breaks(spark, path).count() == 3  # keys that repeat are no total order
    rows(5).select(F.col("k").cast("int"), "v").write.parquet(f"{path}/version-other/rows")
    artifacts.commit(spark, path, "version-other", ["rows"], ["k"])
    with pytest.raises(ValueError, match="differs from its contract"):
        artifacts.read_artifact(spark, ddl, path)


def test_an_export_is_whole_or_not_seen(spark, tmp_path):
    path = str(tmp_path / "out")
    assert artifacts.exported(spark, path) == {}
    for name, n in (("one", 3), ("two", 4)):
        spark.range(n).createOrReplaceTempView(name)
    artifacts.export_marts(spark, ["ONE", "TWO"], path)
    with pytest.raises(ValueError, match="THREE"):
        artifacts.export_marts(spark, ["ONE", "THREE"], path)
    spark.range(5).select(F.expr("if(id = 4, raise_error('broken'), id)").alias("id")).createOrReplaceTempView("two")
    spark.range(9).createOrReplaceTempView("one")
    with pytest.raises(Exception, match="broken"):
        artifacts.export_marts(spark, ["ONE", "TWO"], path)
    assert {n: df.count() for n, df in artifacts.exported(spark, path).items()} == {"one": 3, "two": 4}
