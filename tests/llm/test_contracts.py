"""The registered queries without SQL: what each column holds, worked out again row by row."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def rows(spark, name, columns):
    got = entry.queries()[name](spark, DATA)
    assert set(columns) <= set(got.columns)
    return got.select(*columns).collect()


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def crc(text):
    return zlib.crc32(text.encode())


def test_op1(spark):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    got = defaultdict(list)
    for r in rows(spark, "op1_nearest", ["query_id", "rank", "vec_id", "score"]):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in vectors if i % 50 == 0}
    hits = 0
    for q, found in got.items():
        cosine = lambda i: vectors[q] @ vectors[i] / np.sqrt((vectors[q] @ vectors[q]) * (vectors[i] @ vectors[i]))  # noqa: B023, E731
        assert [r for r, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
        assert all(abs(s - cosine(i)) < 1e-12 and i != q for _, i, s in found)
        assert [s for _, _, s in sorted(found)] == sorted((s for _, _, s in found), reverse=True)
        hits += len({i for _, i, _ in found} & set(sorted((i for i in vectors if i != q), key=lambda i: (-cosine(i), i))[:5]))
    assert hits >= 0.9 * 5 * len(got)


def test_op2(spark, texts):
    def fingerprint(text):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        w = re.findall(r"[^\x20\x09-\x0D]+", lower)
        grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = {i: fingerprint(t) for i, t in texts.items()}
    component = {i: i for i in prints}
    for i in sorted(prints):
        for j in sorted(prints):
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 4 and component[i] != component[j]:
                low, high = sorted((component[i], component[j]))
                component = {k: low if c == high else c for k, c in component.items()}
    want = {(i, f"{p:016x}", component[i]) for i, p in prints.items()}
    assert {tuple(r) for r in rows(spark, "op2_simhash", ["doc_id", "fingerprint", "component_id"])} == want


@pytest.mark.parametrize(("name", "modulus", "held", "threshold"), [("op3_toxicity", 3, 1, 0.7), ("op10_quality", 5, 0, 0.3)])
def test_op3_and_op10(spark, texts, name, modulus, held, threshold):
    got = rows(spark, name, ["doc_id", "held_out", "score", "predicted"])
    assert {r["doc_id"] for r in got} == set(texts) and len(got) == len(texts)
    for r in got:
        assert r["held_out"] == (crc(str(r["doc_id"])) % modulus == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)


def test_op4(spark, texts):
    got = rows(spark, "op4_sharding", ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"])
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got} == {(i, len(t.encode()) + 8, crc(t)) for i, t in texts.items()}
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r["slot"])
    assert set(shards) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())
    sizes = Counter(len(s) for s in shards.values())
    assert max(sizes) - min(sizes) <= 1


def test_op5(spark, texts):
    import public_tokenizers
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    ranks = load_tiktoken_bpe(str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    coder = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for i, text in texts.items():
        ids = coder.encode_ordinary(text)
        want.add((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha(text.encode())))
    assert {tuple(r) for r in rows(spark, "op5_byte_bpe", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])} == want
