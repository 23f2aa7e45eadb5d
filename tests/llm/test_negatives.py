"""Hard negatives against plain scores."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from colscope.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, _id string, ID int, `_vector` string"


def plain(rows, every=50):
    taken = {
        (i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v))
        for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    out = Counter()
    for i, label, v in taken:
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=False)), j, other) for j, other, w in taken if j != i]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:5]:
            close = sorted(x for x in scored if x[2] != label and -50 * s <= -100 * x[0] <= -95 * s)[:3]
            out.update((i, p, rank, n, -s, -t) for rank, (t, n, _) in enumerate(close, 1))
    return out


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    taken = negatives.usable(df, "vec_id", "embedding", "label")
    return Counter(tuple(r) for r in negatives.hard_negatives(taken, F.col("_id") % 50 == 0).collect())


def clouds(n, width, seed, spread=0.6):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, width))
    x = centres[r.integers(0, 6, n)] * spread + r.normal(size=(n, width)) * 0.4
    return [(i, (v / np.linalg.norm(v)).tolist(), int(r.integers(0, 5))) for i, v in enumerate(x)]


def test_odd_rows(spark):
    good = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.8, 0.3], 2), (3, [0.8, 0.3], 2), (2, [0.8, 0.3], 2), (4, [0.0, -1.0], 1), (5, [], 1), (6, [0.7], 3), (7, [-1.0, 0.0], 2), (50, [0.0, 0.0], 2), (100, [0.5, 0.5], 9)]
    bad = [(150, None, 1), (200, [1.0, None], 1), (250, [float("nan"), 1.0], 1), (300, [float("-inf"), 1.0], 1), (350, [1.0, 0.0], None), (None, [1.0, 0.0], 1)]
    assert found(spark, good + bad) == plain(good + bad)
    assert found(spark, []) == Counter()
    assert found(spark, [(0, [1.0], 1)]) == Counter()
    assert found(spark, [(0, [0.0], 1), (1, [0.0], 1), (2, [0.0], 2)]) == Counter([(0, 1, 1, 2, 0, 0)])


@pytest.mark.parametrize("width", [3, 40])
def test_negatives_equal_plain_ones(spark, monkeypatch, width):
    rows = clouds(700, width, width)
    rows += [(1000 + i, rows[3][1], 2) for i in range(60)]  # ties
    rows = [(i, v, 0 if i % 3 == 0 else label) for i, v, label in rows]  # a third of one label
    monkeypatch.setattr(negatives, "LABEL_ROWS", 100)
    monkeypatch.setattr(negatives, "INDEX_ROWS", 150)
    assert found(spark, rows) == plain(rows)


def test_index_gives_every_pair_over_its_threshold(monkeypatch):
    monkeypatch.setattr(negatives, "PART_ROWS", 300)
    for scale in (1, 10**4, 10**8):  # single, double, and whole numbers without a bound
        x = np.array([[math.floor(256 * c) for c in v] for _, v, _ in clouds(900, 30, 9, 1.5)]) * scale
        index = negatives.Index(np.arange(900), np.zeros(900, int), x)
        q, tails = index.asked(x[:50])
        scores = x[:50].astype(object) @ x.T.astype(object)
        for share in (-2, 0.1, 0.5, 0.9):
            least = np.sort(scores.astype(float), axis=1)[:, -5] * share
            a, b, s = index.over(q, tails, least)
            want = {(i, j) for i, j in zip(*np.nonzero(scores >= least[:, None]), strict=True)}
            assert set(zip(a.tolist(), b.tolist(), strict=True)) == want and len(a) == len(want)
            assert all(max(-(2**63), min(scores[i, j], 2**63 - 1)) == t for i, j, t in zip(a, b, s.tolist(), strict=True))


def test_lists_leave_out_dimensions_below_the_threshold():
    x = np.zeros((4, 32), np.int64)
    x[:, 0], x[:, 31] = 100, [1, 2, 3, 90]
    index = negatives.Index(np.arange(4), np.zeros(4, int), x)
    q, tails = index.asked(x[:1])
    a, b, s = index.over(q, tails, np.array([9_000.0]))
    assert sorted(zip(b.tolist(), s.tolist(), strict=True)) == [(0, 10_001), (1, 10_002), (2, 10_003), (3, 10_090)]
