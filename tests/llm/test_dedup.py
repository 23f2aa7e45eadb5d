"""Exact and near dedup against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from colscope.llm import exact_dedup as ed
from colscope.llm import simhash as sh
from colscope.llm.components import components

SCHEMA = "doc_id long, text string, kept string, _sha string, _len string, word string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in rows], SCHEMA)


def plain_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for key, members in groups.items():
        best = min(members, key=lambda m: m[:3])
        sha = hashlib.sha256(key.encode()).hexdigest()
        free = True
        for m in members:
            out.append((m[3], best[3], len(members), m == best and free, sha))
            free = free and m != best
    return sorted(out, key=repr)


MESSY = [
    (1, "a b"), (2, "ab"), (3, " a\tb "), (4, None), (5, ""), (6, "\n\x0b \r"), (7, "a b"), (None, "q"), (8, "q"),
    (None, None), (9, "long " * 40_000), (10, "long" * 40_000), (11, "same"), (11, "same"), (11, "same"), (12, "same"),
    (13, "tie"), (12, "tie"), (20, "𝄞é"), (21, "𝄞 é"),
]


@pytest.mark.parametrize("bits", [ed.MAX_BITS, 64])
def test_exact_dedup_equals_plain(spark, bits):
    rows = MESSY + [(100 + i, f"one of a kind {i}") for i in range(300)]
    out = ed.exact_dedup(frame(spark, rows).repartition(5), max_bits=bits)
    assert {"_sha", "_len", "word"} <= set(out.columns)
    got = out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == plain_exact(rows)
    assert {r["_sha"] for r in out.select("_sha").distinct().collect()} == {"y"}


def test_exact_dedup_hot_group_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(ed, "HOT_SHARE", 1)
    rows = [(i, "copy" if i % 2 else f"t{i}") for i in range(3000)]
    out = ed.exact_dedup(frame(spark, rows).repartition(7))
    got = out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == plain_exact(rows)
    assert ed.exact_dedup(frame(spark, [])).count() == 0


def test_only_possible_repeats_shuffle(spark):
    words = ed.repeated_bits(
        spark.range(1000).select(F.sha2(F.col("id").cast("string"), 256).alias("_sha")), 1 << 16
    )
    # 1,000 texts on 65,536 bits: few positions are met twice
    assert words.agg(F.sum(F.bit_count("set_bits"))).head()[0] < 60


def plain_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def plain_components(prints):
    parent = {p: p for p in prints}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    ps = sorted(parent)
    for i, a in enumerate(ps):
        for b in ps[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    return {p: find(p) for p in ps}


def test_near_duplicates_equal_plain(spark):
    rng = random.Random(3)
    base = " ".join(f"w{rng.randrange(400)}" for _ in range(900))
    rows = list(MESSY)
    for i in range(40):
        words = base.split()
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = f"n{rng.randrange(99)}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(2000 + i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(30))) for i in range(60)]
    got = sh.near_duplicates(frame(spark, rows).repartition(4)).collect()
    roots = plain_components({plain_print(t) for _, t in rows})
    least = defaultdict(list)
    for i, t in rows:
        least[roots[plain_print(t)]].append(i)
    want = [
        (i, f"{plain_print(t):016x}", min((x for x in least[roots[plain_print(t)]] if x is not None), default=None))
        for i, t in rows
    ]
    assert sorted(((r["_id"], r["fingerprint"], r["component_id"]) for r in got), key=repr) == sorted(want, key=repr)
    assert len({r["component_id"] for r in got if r["_id"] and 960 < r["_id"] <= 1000}) < 40  # some are linked


def test_one_of_each_group_stays(spark):
    rows = [*MESSY, (500, "x y z"), (501, "X  y\tz"), (502, "other words here altogether")]
    out = sh.drop_near_duplicates(frame(spark, rows))
    assert out.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    prints = defaultdict(set)
    for r in out.collect():
        prints[plain_print(r["text"])].add((r["doc_id"], r["text"]))
    assert set(prints) == {plain_print(t) for _, t in rows}
    assert all(len(s) == 1 for s in prints.values())
    assert sh.near_duplicates(frame(spark, [])).count() == 0


def test_pieces_of_a_long_text_give_the_same_print(monkeypatch):
    text = "Alpha beta  gamma\tdelta " * 300 + "end\x0b"
    whole = sh.fingerprint(text)
    assert whole == plain_print(text)
    monkeypatch.setattr(sh, "PIECE_BYTES", 37)
    assert sh.fingerprint(text) == whole


def test_links_lose_no_pair(spark):
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(30)]
    prints = set(centres)
    for c in centres:
        for _ in range(12):
            p = c
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                p ^= 1 << b
            prints.add(p)
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    df = spark.createDataFrame([(s,) for s in signed.values()], "_print long")
    got = {(r["a"], r["b"]) for r in sh.links(df).collect()}
    ps = list(signed)
    want = {
        tuple(sorted((signed[a], signed[b]))) for i, a in enumerate(ps) for b in ps[:i] if (a ^ b).bit_count() <= 4
    }
    assert got == want


def test_components_of_a_path_a_star_and_nothing(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(1000, 1000 + i) for i in range(1, 60)] + [(1005, 1005), (None, 3)]
    got = components(spark.createDataFrame(path + star, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == {i: 0 for i in range(1, 41)} | {1000 + i: 1000 for i in range(1, 60)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
