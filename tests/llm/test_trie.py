"""The prefix trie against a plain one."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from colscope.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, turns string, `A.b` int, KEY string"


def plain(rows, rebuild=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    paths = dict(own)
    if rebuild:
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % 9
            paths[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, own_members in members.items():
        ends = ",".join(str(c) for c in sorted(own_members) if len(paths[c]) == len(p))
        above = min(members[p[:-1]]) if p else None
        out.append((min(own_members), len(p), above, len(own_members), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def found(spark, rows, rebuild=True):
    turns = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    convs = trie.encoded(turns)
    return Counter(tuple(r) for r in trie.prefix_trie(trie.rebuilt(convs) if rebuild else convs).collect())


def test_odd_rows(spark):
    rows = [(0, 2, "user", "b"), (0, None, "user", "a"), (0, 1, None, None), (1, 0, "", ""), (1, 0, "", ""), (2, 5, "user", "é"), (2, 5, "bot", "z"), (7, 1, "u", "x" * 300_000), (8, 1, "u", "x" * 300_000), (None, 1, "u", "lost"), (11, 3, "user", "a")]
    for rebuild in (True, False):
        assert found(spark, rows, rebuild) == plain(rows, rebuild)
    assert found(spark, []) == Counter()
    assert found(spark, [(None, 1, "u", "t")]) == Counter()


@pytest.mark.parametrize("rebuild", [True, False])
def test_trie_equals_plain_one_over_many_shards(spark, monkeypatch, rebuild):
    monkeypatch.setattr(trie, "SHARD_TURNS", 60)
    r = random.Random(4)
    rows = []
    for c in range(300):
        # a third are copies of one conversation, many share a first turn, a few are long
        n = 3 if c % 3 == 0 else r.choice([1, 2, 4, 8, 40])
        rows += [(c, t, "user", f"copy {t}" if c % 3 == 0 else r.choice(["hi", f"t{r.randint(0, 3)}", f"u{r.random()}"])) for t in range(n)]
    r.shuffle(rows)
    assert found(spark, rows, rebuild) == plain(rows, rebuild)


def test_boundaries_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(trie, "BROADCAST_ROWS", 0)
    rows = [(c, t, "user", f"{(c >> t) % 3}") for c in range(60) for t in range(4)]
    assert found(spark, rows, False) == plain(rows, False)


def test_tree_is_balanced_by_medians():
    sequences = [[i] for i in range(1023)]
    tree = trie.Tree(sequences, sequences, [1] * 1023, list(range(1023)))
    deepest, todo = 0, [(tree.down[0], 1)]
    while todo:
        node, depth = todo.pop()
        if node >= 0:
            deepest = max(deepest, depth)
            todo += [(tree.low[node], depth + 1), (tree.high[node], depth + 1)]
    assert deepest == 10
    assert [tree.value[n] for n in tree.path([700])] == [-1, 700]
