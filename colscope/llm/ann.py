"""Approximate nearest neighbours: multi-index hashing over learned, rotated binary codes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colscope.llm.common import cut, ship, table

#: Vectors that rotations are fitted on at most, and queries that the radius is measured with.
FIT_ROWS, FIT_QUERIES = 8000, 200
#: Bits of a code, and of a substring.
BITS, SUBSTRING = 128, 16
#: The radius holds this share of the sample's true neighbours.
REACH = 0.97
#: Components that an index block holds, about (65,536 vectors of 64); queries answered at once; blocks at least.
INDEX_VALUES, QUERY_ROWS, LEAST_BLOCKS = 1 << 22, 2048, 48
#: Balls of larger radius aren't listed.
MOST_LISTED = 6


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rotation(x: np.ndarray, seed: int, rounds: int = 40) -> np.ndarray:
    """A rotation after which the signs of centred ``x`` lie nearest to ``x`` itself (iterative quantization)."""
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1], x.shape[1])))
    for _ in range(rounds):
        u, _, v = np.linalg.svd(x.T @ np.where(x @ turn > 0, 1.0, -1.0))
        turn = u @ v
    return turn


class Coder:
    """Codes of unit vectors, the radius to search, and that radius dealt out to the substrings."""

    def __init__(self, sample: np.ndarray, k: int, bits: int = BITS, reach: float = REACH, seed: int = 3):
        x = _unit(sample)
        self.mean = x.mean(0)
        centred = x - self.mean
        turns = -(-bits // x.shape[1])
        self.axes = np.concatenate([rotation(centred, seed + i) for i in range(turns)], axis=1)[:, :bits]
        self.substrings = bits // SUBSTRING
        self.radius = self._measured(x, k, reach)
        # pigeonhole: within the radius, one substring is within its own share; shares + 1 sum to radius + 1
        each, more = divmod(self.radius + 1, self.substrings)
        self.shares = [each + (i < more) - 1 for i in range(self.substrings)]

    def codes(self, x: np.ndarray) -> np.ndarray:
        """One row of 16-bit substrings for each vector."""
        signs = (_unit(x) - self.mean) @ self.axes > 0
        return np.packbits(signs, axis=1).view(np.uint16)

    def _measured(self, x: np.ndarray, k: int, reach: float) -> int:
        own = self.codes(x)
        at = np.arange(min(FIT_QUERIES, len(x)))
        cosines = x[at] @ x.T
        cosines[at, at] = -np.inf
        k = min(k, len(x) - 1)
        if k < 1:
            return self.substrings * SUBSTRING
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        apart = np.bitwise_count(own[at][:, None, :] ^ own[near]).sum(2)
        return int(np.quantile(apart, reach, method="higher"))


@lru_cache(maxsize=32)
def _ball(radius: int) -> np.ndarray:
    """All 16-bit masks with at most ``radius`` set bits."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(SUBSTRING), n)]
    return np.array(masks, np.uint16)


class Tables:
    """One hash table a substring: its distinct values in order, and each row's place among them."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        tables = [np.unique(codes[:, s], return_inverse=True) for s in range(codes.shape[1])]
        self.keys, self.places = [k for k, _ in tables], [p for _, p in tables]

    def near(self, s: int, value: np.uint16, share: int) -> np.ndarray:
        """Which of a table's values lie within ``share`` bits: by listing the ball and looking each
        member up, or, where the table holds fewer values than the ball, by trying them all."""
        keys = self.keys[s]
        if share > MOST_LISTED or len(keys) <= 4 * len(_ball(share)):
            return np.bitwise_count(keys ^ value) <= share
        probes = _ball(share) ^ value
        at = np.searchsorted(keys, probes)
        at[at == len(keys)] = 0
        out = np.zeros(len(keys), bool)
        out[at[keys[at] == probes]] = True
        return out

    def within(self, code: np.ndarray, radius: int, shares: list[int]) -> np.ndarray:
        """Every row whose code lies within ``radius`` bits of ``code``."""
        hit = np.zeros(len(self.codes), bool)
        for s, share in enumerate(shares):
            if share >= 0:
                hit |= self.near(s, code[s], share)[self.places[s]]
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(1) <= radius]


class Block:
    """An index block: its tables, and its vectors for exact cosines.

    Vectors are scaled by their largest component first, so that no square overflows or vanishes.
    """

    def __init__(self, coder: Coder, x: np.ndarray, ids: np.ndarray):
        self.coder, self.ids, self.tables = coder, ids, Tables(coder.codes(x))
        self.x = x / np.abs(x).max(1, keepdims=True)
        self.length = np.sqrt((self.x * self.x).sum(1))

    def search(self, code: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best candidates for a query: retrieved by code, ranked by exact cosine.

        The radius grows where it holds fewer than ``k``, up to all of the block.
        """
        radius, shares = self.coder.radius, self.coder.shares
        most = self.coder.substrings * SUBSTRING
        while True:
            rows = self.tables.within(code, radius, shares)
            rows = rows[self.ids[rows] != own]
            if len(rows) >= k or radius >= most:
                break
            radius = min(most, radius + self.coder.substrings)
            shares = [s + 1 for s in shares] if radius < most else [SUBSTRING] * self.coder.substrings
        q = query / np.abs(query).max()
        cosines = (self.x[rows] @ q) / (self.length[rows] * np.sqrt((q * q).sum()))
        best = np.lexsort((self.ids[rows], -cosines))[:k]
        return self.ids[rows][best], cosines[best]


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``_id`` and ``_vector`` (doubles) of the rows that take part, each different row once.

    Ids or vectors that are null, vectors of zeros alone, and vectors with a null or non-finite
    component take no part; of several lengths, those of the commonest (then the longest) do.
    """
    v = F.col("_vector")
    usable = (
        rows.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_vector"))
        .where(F.col("_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
        .where(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
        .where(F.exists(v, lambda c: c != 0))
    )
    lengths = usable.groupBy(F.size("_vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).head()
    return usable.where(F.size("_vector") == (lengths["n"] if lengths else 0)).distinct()


def fit(usable: DataFrame, k: int, rows: int = FIT_ROWS) -> Coder | None:
    """A coder of up to ``rows`` vectors, those of the smallest seeded hashes; none for an empty table."""
    got = usable.orderBy(F.xxhash64("_id", "_vector", F.lit(7)), "_id").limit(rows).select("_vector").collect()
    return Coder(np.array([r[0] for r in got]), k) if got else None


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)


def _answers(block: Block, asks: pa.RecordBatch, k: int) -> pa.RecordBatch:
    """The nearest rows of one block for each of some queries."""
    vectors, own = _matrix(asks.column("_vector")), asks.column("_id").to_numpy()
    out = [block.search(code, v, i, k) for code, v, i in zip(block.coder.codes(vectors), vectors, own, strict=True)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(own, [len(ids) for ids, _ in out]), pa.int64()),
            pa.array(np.concatenate([ids for ids, _ in out]), pa.int64()),
            pa.array(np.concatenate([scores for _, scores in out]), pa.float64()),
        ],
        names=["query_id", "vec_id", "score"],
    )


def _streamed(shared: Broadcast, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """In partitions sorted by block, index rows before queries: one block at a time is held, its queries stream past."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("_block", "_asks")], axis=1)
            edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1), len(marks)]
            for start, end in zip(edges, edges[1:], strict=False):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                if marks[start, 0] != at:
                    at, held, block = marks[start, 0], [], None
                if not marks[start, 1]:
                    held.append(part)
                    continue
                if held:
                    x, ids = (np.concatenate([f(p) for p in held]) for f in (lambda p: _matrix(p.column("_vector")), lambda p: p.column("_id").to_numpy()))
                    held, block = [], Block(shared.value, x, ids)
                if block is not None:
                    for first in range(0, part.num_rows, QUERY_ROWS):
                        yield _answers(block, part.slice(first, QUERY_ROWS), k)

    return run


def search(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """For each query (``_id``, ``_vector``) its ``k`` nearest index rows found: query_id, rank, vec_id, score.

    A query's own id is no candidate. Scores are cosines, ties go to the smaller id, and an id with
    several vectors counts once, with its best. Fewer candidates than ``k`` are all returned.

    The index is dealt into blocks of bounded size: each of its rows is sent once, to one task, however many
    queries there are, and each query once a block. A task indexes one block at a time by substring, queries pass
    it as a stream, and ``k`` rows a query and block come back. The coder (some 200 KB) is broadcast.
    """
    spark = index.sparkSession
    ship(spark)
    coder = fit(index, k)
    held = max(1, INDEX_VALUES // len(coder.mean)) if coder else 1
    blocks = max(LEAST_BLOCKS, -(-index.count() // held))
    block = F.pmod(F.xxhash64("_id", "_vector", F.lit(1)), F.lit(blocks)).cast("int")
    left = index.select(block.alias("_block"), F.lit(0).alias("_asks"), "_id", "_vector")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), F.lit(1).alias("_asks"), "_id", "_vector")
    dealt = left.unionByName(right).repartition("_block").sortWithinPartitions("_block", "_asks")
    found = dealt.mapInArrow(_streamed(spark.sparkContext.broadcast(coder), k), "query_id long, vec_id long, score double")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op1_nearest(spark, sf_dir):
    usable = cut(vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding")))
    return search(usable.where("_id % 50 = 0"), usable, 5)
