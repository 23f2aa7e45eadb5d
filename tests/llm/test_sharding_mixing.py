"""Sharding, mixing and token-count rollups."""

from __future__ import annotations

import random
import re
import shutil
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from colscope.llm import mixing, sharding
from colscope.llm.token_counts import Rollup, image


def test_hypergeometric_has_its_mean_and_variance():
    rng = random.Random(2)
    good, bad, draws = 60, 140, 50
    got = [sharding.hypergeometric(good, bad, draws, rng) for _ in range(20_000)]
    n = good + bad
    mean, variance = draws * good / n, draws * good * bad * (n - draws) / n**2 / (n - 1)
    assert abs(sum(got) / len(got) - mean) < 0.08
    assert abs(sum((x - mean) ** 2 for x in got) / len(got) - variance) < 0.3
    assert sharding.hypergeometric(0, 5, 3, rng) == 0 and sharding.hypergeometric(5, 0, 3, rng) == 3
    big = sharding.hypergeometric(10**11, 10**12, 10**6, rng)
    assert abs(big - 10**6 / 11) < 3000


def test_matrix_sums():
    rows = [0, 1, 100, 57, 3]
    cells = sharding.matrix(rows, 7, 1)
    assert [sum(r) for r in cells] == rows
    assert sorted(map(sum, zip(*cells, strict=True))) == [23] * 7
    assert sharding.matrix([], 3, 1) == []


@pytest.mark.parametrize("group_rows", [16_384, 20])
def test_shards_are_exact_and_keep_every_row(spark, monkeypatch, group_rows):
    monkeypatch.setattr(sharding, "GROUP_ROWS", group_rows)
    rows = [(i % 50 if i % 7 else None, None if i % 3 else "t", "old", i) for i in range(1003)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, _part long").repartition(6).cache()
    out = sharding.uniform_shards(df, 24).collect()
    assert Counter((r["doc_id"], r["text"], r["_part"]) for r in out) == Counter((a, b, d) for a, b, _, d in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert sorted(map(len, slots.values())) == [41] * 5 + [42] * 19 and set(slots) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = {(r["_part"], r["shard"], r["slot"]) for r in sharding.uniform_shards(df, 24).collect()}
    assert again == {(r["_part"], r["shard"], r["slot"]) for r in out}
    other = {(r["_part"], r["shard"]) for r in sharding.uniform_shards(df, 24, seed=5).collect()}
    assert other != {(r["_part"], r["shard"]) for r in out}
    # neighbours in the input are no neighbours in the output
    at = {r["_part"]: (r["shard"], r["slot"]) for r in out}
    assert sum(at[i][0] == at[i + 1][0] for i in range(1002)) < 100


def test_no_rows_no_shards_and_written_shards(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long")
    assert sharding.uniform_shards(empty, 24).count() == 0
    sharding.write_shards(spark.range(100).toDF("doc_id"), str(tmp_path / "s"), 3)
    got = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(r["count"] for r in got.groupBy("shard").count().collect()) == [33, 33, 34]


def plain_targets(sizes, share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    names += [None] if None in sizes else []
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, budget, open_ = {}, share * sum(sizes.values()), list(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if budget * weight[s] / total >= most * sizes[s]]
        if not over:
            out |= {s: budget * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
            budget -= out[s]
            open_.remove(s)
    return out


@pytest.mark.parametrize("broadcast", [mixing.BROADCAST_SOURCES, 0])
def test_mix_meets_its_targets(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", broadcast)
    rng = random.Random(4)
    rows = [
        (i if i % 9 else None, " ".join(["w"] * rng.randrange(60)) if i % 11 else None, rng.choice(["a", "b", "B", "é", "𝄞", "", None] + ["hot"] * 5), "s", 1.5)
        for i in range(2500)
    ] + [(5000, "w " * 30_000, "b", "s", 1.0), (5001, "", "wordless", "s", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string, _draw double").repartition(5)
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken, longest = Counter(), Counter(), Counter()
    for r in out:
        assert r["size"] == count(r["text"]) and r["taken"] in (0, r["size"], 2 * r["size"])
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    want = plain_targets(sizes)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= longest[s] / 2 + 1e-6 or s != "b"
        assert abs(taken[s] - want[s]) <= longest[s] + 1e-6
    again = Counter((r["doc_id"], r["text"], r["taken"]) for r in mixing.mix(df.repartition(3)).collect())
    assert again == Counter((r["doc_id"], r["text"], r["taken"]) for r in out)


def test_a_hot_source_is_no_hot_task(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    rows = [(i, "a b", None if i % 2 else "hot" if i % 4 else f"s{i}") for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    for k, v in zip(old, ("false", "-1", "8"), strict=True):
        spark.conf.set(k, v)
    try:
        out = mixing.mix(docs).withColumn("part", F.spark_partition_id()).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(out) == 6000 and max(Counter(r["part"] for r in out).values()) < 1500
    monkeypatch.undo()
    same = Counter((r["doc_id"], r["taken"]) for r in mixing.mix(docs).collect())
    assert same == Counter((r["doc_id"], r["taken"]) for r in out)


def test_mix_of_nothing(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    (r,) = mixing.mix(spark.createDataFrame([(1, None, None)], schema)).collect()
    assert (r["size"], r["source_size"], r["target"], r["taken"]) == (0, 0, 0.0, 0)


def changes(spark, rows):
    pair = "source string, lang string, version string, tokens long"
    schema = f"before struct<{pair}>, after struct<{pair}>, extra string"
    return spark.createDataFrame([(b, a, "x") for b, a in rows], schema)


def totals(rollup):
    return sorted((tuple(r) for r in rollup.totals().collect()), key=repr)


def test_rollup_takes_each_batch_once(spark, tmp_path):
    root = Rollup(spark, str(tmp_path / "r"))
    load = changes(spark, [(None, ("s", "en", "v1", 10)), (None, ("s", "en", "v1", 5)), (None, (None, None, "v1", None))])
    assert root.commit("load", load) and not root.commit("load", load)
    assert totals(root) == sorted([("s", "en", "v1", 2, 15), (None, None, "v1", 1, 0)], key=repr)
    revise = changes(spark, [(("s", "en", "v1", 10), ("s", "en", "v2", 12)), (("s", "en", "v1", 5), None), (None, None)])
    assert root.commit("revise/1", revise)
    assert totals(root) == sorted([("s", "en", "v2", 1, 12), (None, None, "v1", 1, 0)], key=repr)
    with pytest.raises(ValueError, match="other changes"):
        root.commit("load", revise)
    assert root.commit("nothing", changes(spark, []))
    assert len(totals(root)) == 2


def test_a_batch_that_broke_off_does_not_count(spark, tmp_path):
    root = Rollup(spark, str(tmp_path / "r"))
    root.commit("a", changes(spark, [(None, ("s", "en", "v1", 1))]))
    broken = spark.createDataFrame([("b", "s", "en", "v1", 9, 99)], "batch string, source string, lang string, version string, documents long, tokens long")
    broken.write.parquet(root._named("deltas", "b"))
    assert totals(root) == [("s", "en", "v1", 1, 1)]
    root.commit("b", changes(spark, [(None, ("s", "en", "v1", 2))]))
    assert totals(root) == [("s", "en", "v1", 2, 3)]


def test_image_casts(spark):
    df = spark.range(1).select(image(F.lit("s"), F.lit(None), F.lit("v"), F.lit(3)).alias("i"))
    assert df.dtypes[0][1] == "struct<source:string,lang:string,version:string,tokens:bigint>"


def test_rollup_keeps_totals(spark, tmp_path):
    root = Rollup(spark, str(tmp_path / "r"))
    a, b = ("s", "en", "v1", 5), (None, None, "v1", 7)
    root.commit("one", changes(spark, [(None, a), (None, b), (None, b)]))
    before = totals(root)
    assert root.compact() == 0 and totals(root) == before
    assert root.compact() == 0  # no batch since
    assert not root.commit("one", changes(spark, [(None, a), (None, b), (None, b)]))
    root.commit("two", changes(spark, [(a, ("s", "en", "v2", 6)), (b, None)]))
    want = [(None, None, "v1", 1, 7), ("s", "en", "v2", 1, 6)]
    assert totals(root) == sorted(want, key=repr)
    # later batches alone are read: the deltas of the first may go
    shutil.rmtree(tmp_path / "r" / "deltas" / b"one".hex())
    assert totals(root) == sorted(want, key=repr)
    # a base that broke off before its list of batches isn't seen
    assert root.compact() == 1
    shutil.rmtree(tmp_path / "r" / "bases" / "1" / "batches")
    assert totals(root) == sorted(want, key=repr)
    assert root.compact() == 1 and totals(root) == sorted(want, key=repr)
