"""MinHash near-dedup: an LSH forest of sorted signature orders, with depth chosen per region."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import documents, join_hot, ship, with_arrays
from colscope.llm.components import components
from colscope.plans.stages import staged

WORDS, PERCENT = 5, 80
#: Sorted orders, and signature values that an order sorts by. Each order has functions of its own.
ORDERS, DEPTH = 16, 8
#: Values that a region's members share at least.
LEAST_DEPTH = 3
#: A region with more members outside its largest class is divided by its next signature value.
STRANGERS = 64
#: Of 128 one-bit signature values a pair agrees in so many, or is no candidate. Sets of similarity 0.8
#: agree in 115 on average with a deviation of 3.4, so 1 of 5 million such pairs agrees in fewer.
AGREE = 98
#: Leaders that a set is compared with before classes are known, at most; then, round by round, its neighbours of
#: other classes among so many rows before and after it. The regions see to the rest.
LEADERS, WINDOWS = 3, (4, 16, 64)
#: Rows of a sorted range; bytes of sets that meet in one task; keys that are broadcast at most.
RANGE_ROWS, TASK_BYTES, BROADCAST_ROWS = 400_000, 16 << 20, 200_000
#: Tasks at least that compare strangers with the members of their regions.
LEAST_TASKS = 32
#: A text is split into words in pieces of about so many bytes.
PIECE_BYTES = 1 << 20
#: Digests shared by 1 / HOT_SHARE of the rows or more are joined back by broadcast.
HOT_SHARE = 1000

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_FACTORS = np.random.default_rng(11).integers(1 << 62, 1 << 63, ORDERS * DEPTH, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads each 64-bit value over all its bits, one to one."""
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return (x ^ (x >> np.uint64(29))) * _MIX


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; with fewer words the whole sequence is one.

    A-Z are lower-cased and words split at spaces and the controls from tab to carriage return, as
    bytes.lower and bytes.split do. No words give an empty set.
    """
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    hashes, at = [], 0
    while at < len(raw):
        cut_at = _SPACE.search(raw, at + PIECE_BYTES)
        end = cut_at.start() if cut_at else len(raw)
        part = raw[at:end].split()
        hashes.append(np.fromiter(map(xxhash.xxh3_64_intdigest, part), np.uint64, len(part)))
        at = end + 1
    w = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    taken = min(words, len(w))
    if not taken:
        return w
    run = np.full(len(w) - taken + 1, taken, np.uint64)
    for i in range(taken):
        run = _mixed(run * _MIX + w[i : i + len(run)])
    return np.unique(run)


def signature(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each order's key (two longs, 8 values of 16 bits, the first one on top), and 128 one-bit values (two longs)."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(found), 2048):
        np.minimum(least, np.multiply.outer(found[i : i + 2048], _FACTORS).min(0), out=least)
    least = _mixed(least)
    values = (least >> np.uint64(48)).astype(">u2")
    bits = np.packbits((least >> np.uint64(20) & np.uint64(1)).astype(np.uint8))
    return values.view(">i8").astype(np.int64), bits.view(np.int64)


def _digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def signed(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """Of every row ``_id``, ``_key`` (of id and text), ``_n`` (size of its set), ``_set`` (the set's digest),
    ``_orders`` (the orders' keys) and ``_bits``."""
    ship(docs.sparkSession)

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, orders, bits = [], [], [], []
            for text in batch.column(2):
                found = shingles(text.as_py(), words)
                keys, own = signature(found)
                sizes.append(len(found))
                digests.append(_digest(found))
                orders.append(keys)
                bits.append(own)
            yield with_arrays(
                batch.select([0, 1]),
                _n=pa.array(sizes, pa.int64()),
                _set=pa.array(digests, pa.binary()),
                _orders=pa.array(orders, pa.list_(pa.int64())),
                _bits=pa.array(bits, pa.list_(pa.int64())),
            )

    rows = docs.select(F.col(id_col).alias("_id"), _row_key(id_col, text_col).alias("_key"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(
        signatures, f"_id {kind}, _key long, _n long, _set binary, _orders array<long>, _bits array<long>"
    )


def _row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _exploded(nodes: DataFrame, *more: str) -> DataFrame:
    """A row for each node and order, with the order's key in ``_k0`` and ``_k1``."""
    at = F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1)))
    rows = nodes.select("_set", "_n", "_bits", "_orders", *more, at.alias("_order"))
    key = lambda i: F.element_at("_orders", F.col("_order") * 2 + i)
    return rows.select(
        F.col("_order").cast("byte").alias("_order"), key(1).alias("_k0"), key(2).alias("_k1"), "_set", "_n",
        F.col("_bits")[0].alias("_b0"), F.col("_bits")[1].alias("_b1"), *more,
    )


def _sorted(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray] | None:
    """A sorted range as one table, and how many leading values each row shares with the one before."""
    held = list(batches)
    if not held:
        return None
    table = pa.Table.from_batches(held).combine_chunks()
    order, k0, k1 = (table.column(c).to_numpy() for c in ("_order", "_k0", "_k1"))
    shared = np.zeros(len(order), np.int64)
    same = np.r_[False, order[1:] == order[:-1]]
    x0, x1 = (np.r_[-1, k[1:] ^ k[:-1]].view(np.uint64) for k in (k0, k1))
    for depth in range(1, DEPTH + 1):
        x, left = (x0, 64 - 16 * depth) if depth <= 4 else (x1, 128 - 16 * depth)
        same &= x >> np.uint64(left) == 0
        shared += same
    return table, shared


def _agree(x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """Of 128 one-bit values how many are equal, by the differing bits of both longs."""
    return 128 - np.bitwise_count(x0.view(np.uint64)).astype(np.int32) - np.bitwise_count(x1.view(np.uint64))


def _likely(table: pa.Table, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """In how many one-bit values rows agree, and whether a pair may be similar enough."""
    n, b0, b1 = (table.column(c).to_numpy() for c in ("_n", "_b0", "_b1"))
    agree = _agree(b0[i] ^ b0[j], b1[i] ^ b1[j])
    fits = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
    return agree, fits & (agree >= AGREE)


def _led(percent: int):
    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows that share a region, each with the first row of those that share its longest prefix before it."""
        if (found := _sorted(batches)) is None:
            return
        table, shared = found
        at = leader = np.arange(len(shared))
        for depth in range(LEAST_DEPTH, DEPTH + 1):
            first = np.maximum.accumulate(np.where(shared < depth, at, 0))
            leader = np.where(shared == depth, first, leader)
        agree, likely = _likely(table, at, leader, percent)
        # a range's first and last row may have company in the next one
        company = (shared >= LEAST_DEPTH) | (np.r_[shared[1:], DEPTH] >= LEAST_DEPTH) | (at == 0)
        rows = np.flatnonzero(company)
        chosen = pa.array(leader[rows], mask=~(likely & (leader != at))[rows])
        kept = table.take(pa.array(rows))
        kept = kept.append_column("lead", table.column("_set").take(chosen)).append_column("n_lead", table.column("_n").take(chosen))
        yield from kept.append_column("agree", pa.array(agree[rows], pa.int32())).combine_chunks().to_batches(20_000)

    return led


def _near(percent: int, window: int, most: int):
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In a sorted range, each row outside its region's largest class (a) with the ``most`` rows of other classes
        that it agrees with best, among ``window`` rows of its region before it and as many after it."""
        if (found := _sorted(batches)) is None:
            return
        table, shared = found
        classes = np.unique(table.column("_class").to_numpy(zero_copy_only=False), return_inverse=True)[1]
        other = table.column("_other").to_numpy()
        least, asks, asked, agreed = shared, [], [], []
        for back in range(1, min(window, len(shared) - 1) + 1):
            least = np.minimum(least, np.r_[np.zeros(back - 1, np.int64), shared[: len(shared) - back + 1]])
            i = np.flatnonzero(least >= LEAST_DEPTH)
            if not len(i):
                break
            i = i[(classes[i] != classes[i - back]) & (other[i] | other[i - back])]
            agree, likely = _likely(table, i, i - back, percent)
            i, agree = i[likely], agree[likely]
            asks.append(np.where(other[i], i, i - back))
            asked.append(np.where(other[i], i - back, i))
            agreed.append(agree)
        if not asks:
            return
        a, b, agree = np.concatenate(asks), np.concatenate(asked), np.concatenate(agreed)
        by = np.lexsort((b, -agree, a))
        a, b, agree = a[by], b[by], agree[by]
        taken = np.arange(len(a)) - np.searchsorted(a, a) < most
        a, b, agree = pa.array(a[taken]), pa.array(b[taken]), agree[taken]
        sets, sizes = table.column("_set").combine_chunks(), table.column("_n").combine_chunks()
        yield pa.RecordBatch.from_arrays(
            [sets.take(a), sets.take(b), sizes.take(a), sizes.take(b), pa.array(agree, pa.int32())], ["a", "b", "n_a", "n_b", "agree"]
        )

    return near


_PAIR = "a binary, b binary, n_a long, n_b long, agree int"
_ROW = "_order byte, _k0 long, _k1 long, _set binary, _n long, _b0 long, _b1 long"
_BY = ["_order", "_k0", "_k1", "_set"]


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _ranged(rows: DataFrame, count: int) -> DataFrame:
    """Rows sorted by range in every order, ties by digest, so a family that shares all values is dealt out too."""
    return rows.repartitionByRange(max(_partitions(rows), -(-count // RANGE_ROWS)), *_BY).sortWithinPartitions(*_BY)


def _best(pairs: DataFrame, most: int) -> DataFrame:
    """Of each a the ``most`` pairs that agree best."""
    best = F.slice(F.sort_array(F.collect_set(F.struct((-F.col("agree")).alias("x"), "b", "n_b"))), 1, most)
    return pairs.groupBy("a", "n_a").agg(F.explode(best).alias("p")).select("a", F.col("p.b").alias("b"), "n_a", F.col("p.n_b").alias("n_b"))


def grouped(nodes: DataFrame, percent: int) -> DataFrame:
    """The sorted orders' rows that share a region of LEAST_DEPTH values, each with its leader, if that is likely
    similar: by longest common prefix, the first of the sets that share the most leading values with it."""
    return _ranged(_exploded(nodes), nodes.count() * ORDERS).mapInArrow(_led(percent), f"{_ROW}, lead binary, n_lead long, agree int")


def leaders(rows: DataFrame) -> DataFrame:
    """Candidates (a, b, n_a, n_b): each set and the LEADERS of its leaders that it agrees with best."""
    return _best(rows.where("lead is not null").select(F.col("_set").alias("a"), F.col("lead").alias("b"), F.col("_n").alias("n_a"), F.col("n_lead").alias("n_b"), "agree"), LEADERS)


def neighbours(rows: DataFrame, percent: int, window: int) -> DataFrame:
    """Candidates (a, b, n_a, n_b) of different classes ``_class`` among sorted rows that are near one another; a lies
    outside its region's largest class (``_other``)."""
    most = window * 3 // 2
    return _best(_ranged(rows, rows.count()).mapInArrow(_near(percent, window, -(-most // 8)), _PAIR), most)


def _regions(rows: DataFrame, depth: int) -> DataFrame:
    """``rows`` with the region they are in at a depth (``_p0``, ``_p1``), its largest class ``_main`` and how many
    members are of others; regions of one class are left out."""
    if depth <= 4:
        prefix = [F.shiftright("_k0", 64 - 16 * depth), F.lit(0).cast("long")]
    else:
        prefix = [F.col("_k0"), F.shiftright("_k1", 128 - 16 * depth)]
    rows = rows.withColumns(dict(zip(("_p0", "_p1"), prefix, strict=True)))
    classes = rows.groupBy("_order", "_p0", "_p1", "_class").agg(F.count(F.lit(1)).alias("_c"))
    regions = (
        classes.groupBy("_order", "_p0", "_p1")
        .agg(F.count(F.lit(1)).alias("_classes"), F.sum("_c").alias("_size"), F.max(F.struct("_c", "_class")).alias("_top"))
        .where("_classes > 1")
        .select("_order", "_p0", "_p1", F.col("_top._class").alias("_main"), (F.col("_size") - F.col("_top._c")).alias("_others"))
    )
    return rows.join(regions, ["_order", "_p0", "_p1"])


def strangers(rows: DataFrame) -> DataFrame:
    """The rows of regions with several classes, with ``_region`` and whether they are outside its largest (``_other``).

    A region is all rows of an order with a common prefix. It is as deep as it needs: three values, and
    one more wherever more than STRANGERS members lie outside its largest class, up to all eight.
    """
    found = None
    for depth in range(LEAST_DEPTH, DEPTH + 1):
        rows = staged(_regions(rows, depth), "regions")
        ready = F.lit(True) if depth == DEPTH else F.col("_others") <= STRANGERS
        final = rows.where(ready).select(
            "_set", "_class", "_n", "_b0", "_b1", F.xxhash64("_order", F.lit(depth), "_p0", "_p1").alias("_region"), (F.col("_class") != F.col("_main")).alias("_other")
        )
        found = final if found is None else found.unionAll(final)
        rows = rows.where(~ready).drop("_main", "_others", "_p0", "_p1")
        if depth == DEPTH or rows.isEmpty():
            break
    return found


def _untried(pairs: DataFrame, tried: list[DataFrame]) -> DataFrame:
    """Each pair once, whichever way round, without those of ``tried``."""
    once = pairs.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(
        F.first(F.struct("a", "b", "n_a", "n_b")).alias("p")
    )
    for before in tried:
        once = once.join(before.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")), ["x", "y"], "left_anti")
    return once.select("p.*")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _links(pairs: list[tuple[bytes, bytes]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in pairs], pa.binary()), "b": pa.array([b for _, b in pairs], pa.binary())})


def _held(table: pa.Table) -> dict[bytes, np.ndarray]:
    return {k: np.frombuffer(v, np.uint64) for k, v in zip(table["_set"].to_pylist(), table["_found"].to_pylist(), strict=True)}


class Confirming:
    """Comparisons of whole sets. Only the sets that are asked for are made, from their texts, and each is sent once
    to each task that asks for it."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, nodes: DataFrame):
        self.rows = docs.select(F.col(text_col).alias("_text"), _row_key(id_col, text_col).alias("_key"))
        self.words, self.percent, self.nodes = words, percent, nodes

    def _tasks(self, total: int | None, least: int) -> int:
        return max(least, -(-8 * (total or 0) // TASK_BYTES))

    def _sent(self, asked: DataFrame) -> DataFrame:
        """``asked`` (_task, _set) with the sets, ``_found``."""
        words = self.words

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for text in batch.column(0):  # one set a batch: they may be long
                    found = shingles(text.as_py(), words)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([_digest(found)], pa.binary()), pa.array([found.tobytes()], pa.binary())], ["_made", "_found"]
                    )

        keys = self.nodes.join(asked.select("_set").distinct(), "_set", "left_semi").select(F.col("_first.key").alias("_key")).distinct()
        keys = staged(keys, "asked-keys")
        wanted = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
        sets = self.rows.join(wanted, "_key", "left_semi").select("_text").mapInArrow(made, "_made binary, _found binary")
        return asked.join(sets, F.col("_set") == F.col("_made")).select("_task", "_set", "_found")

    def pairs(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b, n_a, n_b) that are similar enough, as (a, b). Pairs are dealt out by a."""
        percent = self.percent

        def compared(left: pa.Table, right: pa.Table) -> pa.Table:
            sets = _held(left)
            both = zip(right["a"].to_pylist(), right["b"].to_pylist(), strict=True)
            return _links([(a, b) for a, b in both if _similar(sets[a], sets[b], percent)])

        total = pairs.agg(F.sum(F.col("n_a") + F.col("n_b"))).head()[0]
        tasks = self._tasks(total, 2 * _partitions(pairs))
        dealt = pairs.withColumn("_task", F.pmod(F.xxhash64("a"), F.lit(tasks)))
        asked = staged(dealt.select("_task", F.explode(F.array("a", "b")).alias("_set")).distinct(), "asked")
        met = self._sent(asked).groupBy("_task").cogroup(dealt.select("_task", "a", "b").groupBy("_task"))
        return staged(met.applyInArrow(compared, "a binary, b binary"), "links")

    def regions(self, rows: DataFrame) -> DataFrame:
        """The links (a, b) between rows of different classes in one region (``strangers``).

        In a region, all rows outside its largest class meet all its rows. Members are dealt out by set, and a
        row that asks is sent to each task with members of its regions; a task pairs them and gives
        links alone, so no row stands for a pair.
        """
        percent = self.percent

        def compared(left: pa.Table, right: pa.Table) -> pa.Table:
            sets = _held(left)
            rows = right.to_pylist()
            by_region: dict[int, list[int]] = {}
            asks = [r for r in rows if r["_asks"]]
            for i, r in enumerate(asks):
                for region in r["_regions"]:
                    by_region.setdefault(region, []).append(i)
            n, b0, b1 = (np.array([r[c] for r in asks], np.int64) for c in ("_n", "_b0", "_b1"))
            links = []
            for r in rows:
                if r["_asks"]:
                    continue
                met = np.unique(np.concatenate([np.empty(0, np.int64), *[by_region[x] for x in r["_regions"] if x in by_region]]).astype(np.int64))
                agree = _agree(b0[met] ^ r["_b0"], b1[met] ^ r["_b1"])
                fits = 100 * np.minimum(n[met], r["_n"]) >= percent * np.maximum(n[met], r["_n"])
                for i in met[fits & (agree >= AGREE)]:
                    if asks[i]["_class"] != r["_class"] and _similar(sets[asks[i]["_set"]], sets[r["_set"]], percent):
                        links.append((r["_set"], asks[i]["_set"]))
            return _links(links)

        # Sixteen regions a set at most, one an order.
        own = ("_set", "_class", "_n", "_b0", "_b1")
        total = rows.select("_set", "_n").distinct().agg(F.sum("_n")).head()[0]
        task = F.pmod(F.xxhash64("_set"), F.lit(self._tasks(total, LEAST_TASKS)))
        members = rows.withColumn("_task", task)
        asking = rows.where("_other").join(members.select("_region", "_task").distinct(), "_region")
        listed = lambda df, asks: df.groupBy("_task", *own).agg(F.collect_set("_region").alias("_regions")).withColumn("_asks", F.lit(asks))
        met = staged(listed(members, False).unionByName(listed(asking, True)), "met")
        sent = self._sent(staged(met.select("_task", "_set").distinct(), "asked"))
        return staged(sent.groupBy("_task").cogroup(met.groupBy("_task")).applyInArrow(compared, "a binary, b binary"), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: ``_id``, n_shingles (size of its set), component_id and kept.

    Documents link when their sets of distinct ``words``-word shingles are similar (intersection by union)
    by ``percent`` / 100 or more; component_id is the smallest id reachable by links, and kept says that it
    is the row's own. Candidates come from the forest, links are confirmed on whole sets; shingles are told
    apart by 64-bit hashes. Two sets that share s of their shingles share an order's first three values
    with probability s^3, so one of 16 orders finds a pair of 0.8 in all but 1 of 100,000 cases, one of
    0.9 in all but 1 of 10^9; where regions are divided further it is 1 of 5,000 at four values, 1 of 600
    at five.

    Sets alike are one node, whatever the number of their documents. First each set meets a few leaders by
    longest common prefix, then neighbours of other classes, which joins families by a few comparisons a
    member; at last sets of one region that are still in different classes meet. So pairs within a class
    aren't compared.

    Null and empty texts and texts without words have an empty set and link with nothing: their component
    is their own id. A null id comes last, a component of null ids alone has a null one. Rows alike in id
    and text each get their row. Long texts are read whole, piece by piece. An empty table gives no rows.
    """
    rows = staged(signed(docs, id_col, text_col, words), "signed")
    hot = max(1000, rows.count() // HOT_SHARE)
    place = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_key").alias("key"))
    nodes = staged(
        rows.where("_n > 0")
        .groupBy("_set")
        .agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_rows"), *[F.first(c).alias(c) for c in ("_n", "_orders", "_bits")]),
        "nodes",
    )
    confirming = Confirming(docs, id_col, text_col, words, percent, nodes)
    named = lambda stars: stars.select(F.col("node").alias("a"), F.col("root").alias("b"))
    shared = staged(grouped(nodes, percent), "shared")
    tried = [staged(leaders(shared), "leaders")]
    stars = staged(components(confirming.pairs(tried[0])), "stars")
    rows_in = shared.drop("lead", "n_lead", "agree")
    for window in WINDOWS:
        classed = rows_in.join(stars, F.col("_set") == F.col("node"), "left").withColumn("_class", F.coalesce("root", "_set"))
        mixed = _regions(classed.drop("node", "root"), LEAST_DEPTH).withColumn("_other", F.col("_class") != F.col("_main"))
        rows_in = staged(mixed.drop("_main", "_others", "_p0", "_p1"), "classed")
        if rows_in.isEmpty():
            break
        near = staged(_untried(neighbours(rows_in, percent, window), tried), "neighbours")
        links = confirming.pairs(near)
        tried.append(near)
        rows_in = rows_in.drop("_class", "_other")
        stars = staged(components(named(stars).unionAll(links)), "stars")
    classed = rows_in.drop("_class", "_other").join(stars, F.col("_set") == F.col("node"), "left")
    classed = classed.withColumn("_class", F.coalesce("root", "_set"))
    more = confirming.regions(staged(strangers(classed.drop("node", "root")), "strangers"))
    stars = components(named(stars).unionAll(more))

    rooted = nodes.join(stars, F.col("_set") == F.col("node"), "left").select(
        F.hex("_set").alias("_set"), F.col("_first"), "_rows", F.hex(F.coalesce("root", "_set")).alias("_root")
    )
    rooted = staged(rooted, "rooted")
    roots = rooted.groupBy("_root").agg(F.min("_first").alias("_least"), F.count(F.lit(1)).alias("_nodes"))
    groups = join_hot(rooted, roots, "_root", "_nodes", hot).select("_set", "_rows", F.col("_least.id").alias("_component"))
    # rows without words have no group, and keys of their own, so they meet in no task
    own = F.when(F.col("_n") > 0, F.hex("_set")).otherwise(F.concat(F.lit("~"), F.col("_key").cast("string")))
    joined = join_hot(rows.select("_id", "_n", own.alias("_set")), groups, "_set", "_rows", hot)
    component = F.when(F.col("_n") > 0, F.col("_component")).otherwise(F.col("_id"))
    return joined.select(
        "_id", F.col("_n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("_id")).alias("kept")
    )


def op11_minhash(spark, sf_dir):
    found = near_duplicates(documents(spark, sf_dir), words=2)
    return found.select(F.col("_id").alias("doc_id"), "n_shingles", "component_id", "kept")


#: Pairs share one of the rarest shingles of each, as many as 0.8 leaves out and one more.
SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) < 2 THEN w
        ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
    FROM words
), items AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets
), ranked AS (
    SELECT doc_id, n, item, row_number() OVER (PARTITION BY doc_id ORDER BY holders, item) AS place
    FROM items JOIN (SELECT item, count(*) AS holders FROM items GROUP BY item) USING (item)
), rare AS (
    SELECT doc_id, n, item FROM ranked WHERE place <= n - (80 * n + 99) // 100 + 1
), pairs AS (
    SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM rare x JOIN rare y ON x.item = y.item AND x.doc_id <> y.doc_id
    WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
), links AS (
    SELECT a, b FROM (
        SELECT a, b, len(x.s) + len(y.s) AS total, len(list_intersect(x.s, y.s)) AS common
        FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
    ) WHERE 100 * common >= 80 * (total - common)
), reached AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT reached.doc_id, links.b FROM reached JOIN links ON reached.other = links.a
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) USING (doc_id)
"""
