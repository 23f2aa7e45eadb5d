"""The LSH forest against plain set comparisons."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colscope.llm import minhash

SCHEMA = "doc_id long, text string, _set string, _KEY string, kept boolean"


def plain(rows, words, percent):
    """Components by comparing all pairs."""
    sets = []
    for _, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        k = min(words, len(w))
        sets.append({" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set())
    root = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= percent * len(x | y) and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    least = {}
    for (key, _), r in zip(rows, root, strict=True):
        if key is not None:
            least[r] = min(key, least.get(r, key))
    return [(key, len(s), least.get(r), key == least.get(r)) for (key, _), s, r in zip(rows, sets, root, strict=True)]


def found(spark, rows, words=2, percent=80):
    docs = spark.createDataFrame([(*r, "x", "y", True) for r in rows], SCHEMA)
    return [tuple(r) for r in minhash.near_duplicates(docs, words=words, percent=percent).collect()]


def drafts(seed):
    """Families whose members drift apart, texts that share half their words, and unrelated ones."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = r.choices(vocabulary, k=60)
    rows = []
    for family in range(12):
        base = r.choices(vocabulary, k=r.choice([12, 60, 200]))
        for _ in range(r.choice([1, 2, 9])):
            text = list(base)
            for _ in range(r.randint(0, len(base) // 12)):
                text[r.randrange(len(text))] = r.choice(vocabulary)
            if family % 3 == 0:
                base = text
            rows.append(" ".join(text))
    rows += [" ".join(shared + r.choices(vocabulary, k=r.randint(10, 40))) for _ in range(40)]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "oNE"), (6, "one two"), (7, "ONE\x0btwo"), (None, "one two"), (None, "alone here"), (8, "é É"), (9, "É É"), (6, "one two"), (10, "a b"), (10, "c d"), (11, "C D")]
    assert Counter(found(spark, rows)) == Counter(plain(rows, 2, 80))
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(("seed", "words"), [(1, 2), (2, 5)])
def test_classes_equal_plain_ones(spark, seed, words):
    rows = drafts(seed)
    assert Counter(found(spark, rows, words)) == Counter(plain(rows, words, 80))


def test_regions_are_divided_and_nothing_within_a_class_is_paired(spark, monkeypatch):
    monkeypatch.setattr(minhash, "STRANGERS", 2)
    rows = drafts(3)
    assert Counter(found(spark, rows)) == Counter(plain(rows, 2, 80))
    # a family of 300 different texts: each meets a few leaders, not the others
    base = [f"v{i}" for i in range(150)]
    family = [(i, " ".join([*base, f"end{i}"])) for i in range(300)]
    docs = spark.createDataFrame(family, "doc_id long, text string")
    nodes = minhash.signed(docs, "doc_id", "text", 2).withColumnRenamed("_id", "_at")
    rows = minhash.grouped(nodes, 80).cache()
    assert minhash.leaders(rows).count() <= 3 * 300
    at = rows.drop("lead", "n_lead", "agree").join(nodes.select("_set", "_at"), "_set")
    one = at.withColumn("_class", F.lit(b"0")).withColumn("_other", F.lit(False)).drop("_at")
    assert minhash.strangers(one).count() == 0 == minhash.neighbours(one, 80, 4).count()
    stranger = at.withColumn("_class", F.when(F.col("_at") == 7, F.lit(b"1")).otherwise(F.lit(b"0"))).drop("_at")
    nodes = nodes.withColumn("_first", F.struct(F.col("_key").alias("key")))
    confirming = minhash.Confirming(docs, "doc_id", "text", 2, 80, nodes)
    assert confirming.regions(minhash.strangers(stranger)).distinct().count() == 299
    stranger = stranger.withColumn("_other", F.col("_class") == b"1")
    assert 0 < minhash.neighbours(stranger, 80, 4).count() <= 6
    assert {r[2] for r in found(spark, family)} == {0}


def test_long_texts_are_whole(spark):
    words = [f"word{i % 30011}x{i}" for i in range(160_000)]  # over a piece, so cut at an edge
    text = " ".join(words)
    assert len(text) > minhash.PIECE_BYTES
    assert len(minhash.shingles(text, 2)) == len(words) - 1
    other = " ".join(words[:130_000] + ["changed"] * 30_000)
    rows = [(1, text), (2, other), (3, text + " more")]
    assert sorted((i, c) for i, _, c, _ in found(spark, rows)) == [(1, 1), (2, 1), (3, 1)]
