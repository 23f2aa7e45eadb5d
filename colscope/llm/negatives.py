"""Hard-negative mining: threshold joins over an inverted index cut by suffix norms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colscope.llm.common import ship, table
from colscope.plans.stages import staged

POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these shares of the positive's, in hundredths.
LEAST_SHARE, MOST_SHARE = 50, 95
#: Rows of an index at most, and of one label's index; rows that are worth a task of their own.
INDEX_ROWS, LABEL_ROWS, LEAST_ROWS = 262_144, 65_536, 2_048
#: Dimensions that are accumulated between two checks; anchors that are scored at once, and rows.
CHUNK, ANCHORS, PART_ROWS = 8, 256, 8_192
#: Thresholds for positives, as shares of the largest possible score; the last pass has none.
LEVELS = (0.6, 0.45, 0.3, 0.15)
#: How far a window's threshold is lowered from its upper end towards its lower one, pass by pass.
STEPS = (0.125, 0.5, 1.0)
_LONG = np.iinfo(np.int64)


def _matrix(lists: pa.ChunkedArray | pa.Array, width: int = 0) -> np.ndarray:
    """Rows of a list column as a matrix; shorter ones count as filled with zeros."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    width = max([width, *sizes])
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == width * len(sizes):
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _tails(x: np.ndarray) -> np.ndarray:
    """Norms of each row from every chunk's start to the end; a last column of zeros."""
    squares = np.add.reduceat(x.astype(np.float64) ** 2, np.arange(0, x.shape[1], CHUNK), axis=1)
    sums = np.cumsum(squares[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.c_[sums, np.zeros(len(x))])


class Index:
    """Integer vectors by chunks of dimensions, the heaviest dimensions first, with suffix norms."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels = ids, labels
        x = x if x.shape[1] else np.zeros((len(x), 1), np.int64)
        self.order = np.argsort(-(x.astype(np.float64) ** 2).sum(0), kind="stable")
        self.x = x[:, self.order]
        self.tails = _tails(self.x)
        self.longest = self.tails[:, 0].max()

    def asked(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anchors' vectors in the index's order of dimensions, and their suffix norms; what one side lacks is zero there."""
        q = np.pad(q, ((0, 0), (0, max(0, len(self.order) - q.shape[1]))))[:, self.order]
        return q, _tails(q)

    def over(self, q: np.ndarray, q_tails: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs (anchor, row, score) whose score is at least the anchor's threshold ``least``.

        A row is not listed under its last dimensions where no anchor's threshold can be reached by
        them alone, so rows sorted by their listed length are a prefix in each dimension's list. Scores add
        up list by list; halfway, pairs whose score can't be reached by the remaining norms go, and where
        few are left those alone are completed.
        """
        found = [self._part(q, q_tails, least, at) for at in range(0, len(self.x), PART_ROWS)]
        return tuple(np.concatenate(c) for c in zip(*found, strict=True))

    def _part(self, q, q_tails, least, at):
        x, tails = self.x[at : at + PART_ROWS], self.tails[at : at + PART_ROWS]
        bound = self.longest * q_tails[:, 0].max(initial=0)
        # sums of products never exceed the norms' product: whole numbers stay exact below these
        kind = np.float32 if bound < 1 << 23 else np.float64 if bound < 1 << 52 else object
        need = least - 1 - 1e-6 * np.abs(least)
        chunks = tails.shape[1] - 1
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.where(need[:, None] > 0, need[:, None] / q_tails, -1.0)
        listed = (tails >= np.nanmin(share, axis=0)[None, :])[:, :chunks].sum(1)
        rows = np.argsort(-listed, kind="stable")
        x, tails, listed = x[rows], tails[rows], listed[rows]
        xs, qs = x.astype(kind), q.astype(kind)
        scores = np.zeros((len(q), len(x)), kind)
        for c in range(chunks):
            n = np.searchsorted(-listed, -c, "left")  # rows with more than c listed chunks
            scores[:, :n] += qs[:, c * CHUNK : (c + 1) * CHUNK] @ xs[:n, c * CHUNK : (c + 1) * CHUNK].T
            if c + 1 == (chunks + 1) // 2 or c + 1 == chunks:
                done = np.minimum(listed, c + 1)
                left = tails[np.arange(len(x)), done]
                rest = np.stack([q_tails[:, d] for d in range(chunks + 1)])[done].T
                live = np.asarray(scores + left * rest >= need[:, None], bool)
                if c + 1 == chunks or live.mean() < 0.125:
                    break
        a, b = np.nonzero(live)
        total, done = scores[a, b], done[b]
        for start in np.unique(done):
            own = np.flatnonzero(done == start)
            for i in range(0, len(own), 1 << 16):
                o = own[i : i + (1 << 16)]
                total[o] += (qs[a[o], start * CHUNK :] * xs[b[o], start * CHUNK :]).sum(1)
        good = np.asarray(total >= least[a], bool)
        total = np.clip(total[good], _LONG.min, _LONG.max) if kind is object else total[good]
        return a[good], at + rows[b[good]], total.astype(np.int64)


def _best(index: Index, own: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best rows (anchor, row, score) of each anchor, its own id left out."""
    q, q_tails = index.asked(q)
    open_, out = np.arange(len(q)), []
    for level in (*LEVELS, None):
        least = np.full(len(open_), -np.inf) if level is None else level * index.longest * q_tails[open_, 0]
        a, b, s = index.over(q[open_], q_tails[open_], least)
        a = open_[a]
        other = index.ids[b] != own[a]
        a, b, s = a[other], b[other], s[other]
        by = np.lexsort((index.ids[b], -s, a))
        a, b, s = a[by], b[by], s[by]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        full = np.bincount(a, minlength=len(q)) >= k
        taken = (place < k) & (full[a] | (level is None))
        out.append((a[taken], b[taken], s[taken]))
        open_ = open_[~full[open_]]
        if not len(open_):
            break
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _within(index: Index, labels: np.ndarray, q: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
    """Of each window (its anchor's place, lowest and highest score) the k best rows of another label."""
    q, q_tails = index.asked(q)
    open_, out = np.flatnonzero(low <= high), []
    for step in STEPS:
        if not len(open_):
            break
        least = low if step == 1 else np.maximum(low, high - np.floor(step * (high - low)).astype(np.int64))
        asked, at = np.unique(anchor[open_], return_inverse=True)
        own = np.full(len(asked), np.inf)
        np.minimum.at(own, at, least[open_].astype(np.float64))
        a, b, s = index.over(q[asked], q_tails[asked], own)
        other = index.labels[b] != labels[asked[a]]
        a, b, s = a[other], b[other], s[other]
        by = np.lexsort((index.ids[b], -s, a))
        a, b, s = a[by], b[by], s[by]
        values = np.unique(s)
        width = len(values) + 1
        keys = a * width + (len(values) - 1 - np.searchsorted(values, s))
        first = np.searchsorted(keys, at * width + (len(values) - np.searchsorted(values, high[open_], "right")))
        end = np.searchsorted(keys, at * width + (len(values) - np.searchsorted(values, least[open_], "left")))
        taken = np.clip(end - first, 0, k)
        full = (taken == k) | (step == 1)
        w = np.repeat(np.flatnonzero(full), taken[full])
        place = np.arange(len(w)) - np.repeat(np.cumsum(taken[full]) - taken[full], taken[full])
        out.append((open_[w], b[first[w] + place], s[first[w] + place]))
        open_ = open_[~full]
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else tuple(np.empty(0, np.int64) for _ in range(3))


def _streamed(answer: Callable, schema: pa.Schema) -> Callable:
    """In partitions sorted by group, index rows before anchors: one index at a time is built and held,
    and its anchors pass it as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, index = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("_group", "_block", "_asks")], axis=1)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1), len(marks)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                if tuple(marks[start, :2]) != group:
                    group, held, index = tuple(marks[start, :2]), [], None
                if not marks[start, 2]:
                    held.append(part)
                    continue
                if held:
                    rows = pa.Table.from_batches(held)
                    index = Index(rows["_id"].to_numpy(), rows["_label"].to_numpy(), _matrix(rows["_vector"]))
                    held = []
                if index is not None:
                    for at in range(0, part.num_rows, ANCHORS):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(answer(index, part.slice(at, ANCHORS)), schema.types, strict=True)], schema=schema
                        )

    return run


def _positive(index: Index, asks: pa.RecordBatch):
    a, b, s = _best(index, asks.column("_id").to_numpy(), _matrix(asks.column("_vector")), POSITIVES)
    return asks.column("_anchor").to_numpy()[a], index.ids[b], s


def _negative(index: Index, asks: pa.RecordBatch):
    windows = asks.column("_windows")
    anchor = np.repeat(np.arange(len(asks)), np.diff(windows.offsets.to_numpy()))
    flat = windows.flatten()
    place, low, high = (flat.field(i).to_numpy() for i in range(3))
    w, b, s = _within(index, asks.column("_label").to_numpy(), _matrix(asks.column("_vector")), anchor, low, high, NEGATIVES)
    return asks.column("_anchor").to_numpy()[anchor[w]], place[w], index.ids[b], s


def _met(index: DataFrame, asks: DataFrame, answer: Callable, schema: pa.Schema, kinds: str) -> DataFrame:
    """Index rows and anchors by group (``_group``, ``_block``). Each index row is sent once, each anchor once a block."""
    ship(index.sparkSession)
    both = index.withColumn("_asks", F.lit(0)).unionByName(asks.withColumn("_asks", F.lit(1)), allowMissingColumns=True)
    dealt = both.repartition("_group", "_block").sortWithinPartitions("_group", "_block", "_asks")
    return dealt.mapInArrow(_streamed(answer, schema), kinds)


def quantized(vector: str | Column, scale: int = 256) -> Column:
    """Each component as floor(scale * component), of the component as a double."""
    return F.transform(F.col(vector) if isinstance(vector, str) else vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``_id``, ``_label`` and ``_vector`` (integers) of the rows that take part, each different row once.

    Null ids and labels, null vectors and vectors with a null or non-finite component take no part.
    """
    v = F.col("_v")
    got = rows.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("long").alias("_label"), F.col(vector_col).alias("_v"))
    whole = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return got.where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & v.isNotNull() & whole).select(
        "_id", "_label", quantized("_v").alias("_vector")
    ).distinct()


def hard_negatives(rows: DataFrame, anchors: Column | str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``rows`` has ``_id``, ``_label`` and ``_vector`` (integers; see ``usable``), and ``anchors`` tells which rows are
    anchors. Scores are integer inner products, higher first, ties by smaller id. An anchor's positives are its
    first 5 rows of its label with another id (all, if fewer). For each of them come the first 3 rows (all, if
    fewer) of another label that score between 50 and 95 hundredths of it; a positive below zero has no such
    rows. Shorter vectors count as filled with zeros; scores beyond a long are cut to its range. Of an id's
    different rows each is one. An anchor alone in its label, or an empty table, gives no rows.

    Two threshold joins: anchors meet the rows of their label, then, with their windows, all rows. In each block
    thresholds are lowered until an anchor's list or windows are full or at their lower end; the blocks'
    few best are merged. A block is sent once, to one task, which holds one block's index; anchors pass it
    as a stream. Labels over LABEL_ROWS rows are split; only their counts are broadcast, at most one in
    LABEL_ROWS rows.
    """
    rows = staged(rows.withColumn("_anchor", F.xxhash64("_id", "_label", "_vector")).withColumn("_asked", F.expr(anchors) if isinstance(anchors, str) else anchors), "vectors")
    n = rows.count()
    spread = lambda blocks: F.pmod(F.xxhash64("_id", "_vector", F.lit(1)), blocks)
    each = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))

    large = rows.groupBy(F.col("_label").alias("_l")).agg(F.count(F.lit(1)).alias("_c")).where(f"_c > {LABEL_ROWS}")
    large = large.select("_l", F.ceil(F.col("_c") / LABEL_ROWS).alias("_blocks"))
    by_label = rows.join(F.broadcast(large), F.col("_label") == F.col("_l"), "left").withColumn(
        "_blocks", F.coalesce("_blocks", F.lit(1).cast("long"))
    )
    taken = ("_id", "_label", "_vector", "_anchor")
    same = by_label.select(F.col("_label").alias("_group"), spread(F.col("_blocks")).alias("_block"), *taken)
    asks = by_label.where("_asked").select(F.col("_label").alias("_group"), each(F.col("_blocks")).alias("_block"), *taken)
    schema = pa.schema([("_anchor", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
    met = _met(same, asks, _positive, schema, "_anchor long, positive_id long, positive_score long")
    best = Window.partitionBy("_anchor").orderBy(F.desc("positive_score"), "positive_id")
    positives = staged(met.withColumn("_place", F.row_number().over(best).cast("long")).where(F.col("_place") <= POSITIVES), "positives")

    score = F.col("positive_score")
    low = F.expr(f"({LEAST_SHARE} * positive_score + 99) div 100")
    high = F.expr(f"({MOST_SHARE} * positive_score) div 100")
    windows = positives.where(score >= 0).groupBy("_anchor").agg(
        F.collect_list(F.struct("_place", low.alias("low"), high.alias("high"))).alias("_windows")
    )
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.lit(max(-(-n // INDEX_ROWS), min(parts, -(-n // LEAST_ROWS)), 1)).cast("long")
    zero = F.lit(0).cast("long").alias("_group")
    others = rows.select(zero, spread(blocks).alias("_block"), *taken)
    asks = rows.where("_asked").join(windows, "_anchor").select(zero, each(blocks).alias("_block"), *taken, "_windows")
    schema = pa.schema([(c, pa.int64()) for c in ("_anchor", "_place", "negative_id", "negative_score")])
    met = _met(others, asks, _negative, schema, "_anchor long, _place long, negative_id long, negative_score long")
    first = Window.partitionBy("_anchor", "_place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = met.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= NEGATIVES)
    named = rows.where("_asked").select("_anchor", F.col("_id").alias("anchor_id"))
    return ranked.join(positives, ["_anchor", "_place"]).join(named, "_anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def op13_hard_negatives(spark, sf_dir):
    rows = usable(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"), "vec_id", "embedding", "label")
    moved = rows.withColumn("_label", F.expr("if(_id % 7 = 0, (_label + 1) % 10, _label)"))
    return hard_negatives(moved, "_id % 50 = 0")


SQL = """
WITH taken AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vector
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.vector, b.vector)::BIGINT AS score
    FROM taken a JOIN taken b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 3
"""
