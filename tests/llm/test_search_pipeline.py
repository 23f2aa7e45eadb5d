"""Nearest neighbours, the pipeline, and the registered queries against their SQL."""

from __future__ import annotations

from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from colscope.llm import ann, exact_dedup, line_dedup, mixing, quality, sharding, simhash, toxicity
from colscope.llm.common import cut

DATA = "/root/testdata/sf0.001"


def test_tables_give_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 16, (500, 4)).astype(np.uint16)
    codes[::3] &= 0xFF0F
    codes[5] = codes[9] = codes[0]
    tables = ann.Tables(codes)
    for radius in (0, 3, 14, 25, 64):
        each, more = divmod(radius + 1, 4)
        shares = [each + (i < more) - 1 for i in range(4)]
        for q in codes[:20]:
            want = np.flatnonzero(np.bitwise_count(codes ^ q).sum(1) <= radius)
            assert tables.within(q, radius, shares).tolist() == want.tolist()
    # looking ball members up and trying all values give the same
    big = ann.Tables(rng.integers(0, 1 << 16, (30_000, 1)).astype(np.uint16))
    value = np.uint16(12345)
    want = np.flatnonzero(np.bitwise_count(big.keys[0] ^ value) <= 2)
    assert np.flatnonzero(big.near(0, value, 2)).tolist() == want.tolist()


def plain_search(rows, queries, k):
    out = {}
    for q, v in queries:
        best = defaultdict(lambda: -2.0)
        for i, w in rows:
            if i != q:
                a, b = np.array(v, float), np.array(w, float)
                best[i] = max(best[i], float(a @ b / np.sqrt((a @ a) * (b @ b))))
        out[q] = sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return out


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24)).astype(np.float32)
    x[100:160] = x[7]  # copies: ties go to smaller ids
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(5000, None), (None, [1.0] * 24), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, [None] * 24), (5004, [float("inf")] * 24), (5005, []), (5006, [1.0, 2.0]), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id long, embedding array<float>, _id string")
    usable = cut(ann.vectors(df))
    assert usable.count() == 1500
    got = defaultdict(list)
    for r in ann.search(usable.where("_id % 50 = 0"), usable, 5).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = plain_search(rows, [r for r in rows if r[0] % 50 == 0], 5)
    assert set(got) == set(want)
    assert all([r for r, _, _ in sorted(g)] == [1, 2, 3, 4, 5] for g in got.values())
    hits = sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    assert [i for _, i, _ in sorted(got[100])] == [7, 101, 102, 103, 104]
    truth = dict(rows)
    for q, g in got.items():
        for _, i, s in g:
            a, b = np.array(truth[q]), np.array(truth[i])
            assert abs(s - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12


def test_blocks_stream_whatever_the_batches(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 8)).astype(np.float32))]
    df = cut(ann.vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    monkeypatch.setattr(ann, "INDEX_VALUES", 8 * 40)  # ten blocks
    monkeypatch.setattr(ann, "LEAST_BLOCKS", 1)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # blocks begin and end inside batches
    try:
        found = ann.search(df.where("_id % 20 = 0"), df, 4)
        got = defaultdict(set)
        for r in found.collect():
            got[r["query_id"]].add(r["vec_id"])
        want = plain_search(rows, [r for r in rows if r[0] % 20 == 0], 4)
        assert {q: len(g) for q, g in got.items()} == {q: 4 for q in want}
        assert sum(len(got[q] & {i for i, _ in want[q]}) for q in want) >= 0.9 * 4 * len(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    few = ann.vectors(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])], schema))
    got = ann.search(few.where("_id = 0"), few, 5).orderBy("rank").collect()
    assert [(r["vec_id"], round(r["score"], 6)) for r in got] == [(1, 0.707107), (2, -1.0)]
    none = ann.vectors(spark.createDataFrame([], schema))
    assert ann.search(none, none, 5).count() == 0
    one = ann.vectors(spark.createDataFrame([(0, [1.0, 0.0])], schema))
    assert ann.search(one, one, 5).count() == 0


def test_pipeline_stages_take_effect(spark, tmp_path):
    docs, dropped, before = spark.read.parquet(f"{DATA}/documents.parquet"), [], None
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(i))
        stage(spark, docs, DATA).write.parquet(path)
        out = spark.read.parquet(path)
        if i < 4:
            assert out.columns == docs.columns
            was, now = Counter(map(tuple, docs.collect())), Counter(map(tuple, out.collect()))
            assert set(now) <= set(was)
            dropped.append(len(was) - len(now))
            if i == 3:
                assert max(now.values()) <= 2
            elif i:
                assert max(now.values()) == 1
        docs, before = out, docs
    assert docs.count() == before.count()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "0")).select("doc_id").collect()}
    # fitted on some 70 labels here
    assert np.mean([(i in kept) == bool(q) for i, q in labels.items()]) > 0.9
    assert dropped[0] > 0 and dropped[1] > 0
    ran = corpus_pipeline.run(spark, DATA)
    assert sorted(map(repr, ran.collect())) == sorted(map(repr, docs.collect()))


CLASHING = {"KEPT": "'x'", "Times": "1", "Shard": "2", "_label": "3", "_id": "'i'", "_order": "4", "_time": "5", "size": "6", "score": "7", "keep_id": "8", "a.b": "9", "_text": "'t'", "_doc": "0", "__0": "10"}


def _clashing(spark, rows):
    docs = rows.withColumns({f"{c}": F.expr(v) for c, v in CLASHING.items()})
    return docs, {c: spark.sql(f"SELECT {v}").head()[0] for c, v in CLASHING.items()}


def test_columns_of_any_name_pass_the_pipeline(spark):
    docs, values = _clashing(spark, spark.read.parquet(f"{DATA}/documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        rows = out.select(*[f"`{c}`" for c in CLASHING]).distinct().collect()
        assert [r.asDict() for r in rows] == [values], name
    assert corpus_pipeline.encoded(spark, docs, DATA).count() == docs.count()


@pytest.mark.parametrize("name", ["exact", "lines", "shards", "mixed", "near", "quality", "toxic"])
def test_columns_of_any_name_pass_the_operators(spark, name):
    docs, _ = _clashing(spark, spark.read.parquet(f"{DATA}/documents.parquet").limit(40))
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    run = {
        "exact": lambda: exact_dedup.exact_dedup(docs),
        "lines": lambda: line_dedup.drop_boilerplate(docs, line_dedup.host_of(F.col("source")), line_dedup.text_lines(F.col("text"))),
        "shards": lambda: sharding.uniform_shards(docs, 4),
        "mixed": lambda: mixing.mix(docs),
        "near": lambda: simhash.drop_near_duplicates(docs),
        "quality": lambda: quality.classify(docs, quality.fit(docs, labels)),
        "toxic": lambda: toxicity.score(docs, toxicity.fit(docs, labels)),
    }[name]
    out = run()
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    assert out.select(*[f"`{c}`" for c in out.columns]).count() > 0


def test_empty_tables_and_text_ids(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.createDataFrame([("x", "a b c d e"), ("w", "a b c d e"), (None, "")], "doc_id string, text string")
    assert {r["component_id"] for r in simhash.near_duplicates(docs).collect()} == {"w", None}


def test_documents_without_words_follow_their_source(spark):
    rows = [(i, "one two three", "a") for i in range(9)] + [(9, "", "a"), (10, None, "a"), (11, " \n", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = Counter(r["doc_id"] for r in corpus_pipeline.mixed(spark, docs, "").collect())
    assert all(taken[i] >= 1 for i in range(11))  # source a gives 1.5 times its words: each row once at least
    assert taken[11] == 0  # a source without words has no target


@pytest.mark.parametrize("name", ["op6_token_counts", "op7_line_dedup", "op8_mixing", "op9_exact_dedup", "op11_minhash", "op12_trie", "op13_hard_negatives"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = entry.queries()[name](spark, DATA)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    plain = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    assert sorted(map(repr, (plain(r) for r in got.select(*columns).collect()))) == sorted(repr(plain(r)) for r in cur.fetchall())
    assert set(got.columns) == set(columns)
