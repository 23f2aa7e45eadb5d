"""Prefix trie of conversations: ternary search trees per range shard, merged at the shards' boundaries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import join_hot, ship, table
from colscope.plans.stages import staged

#: Turns in a shard, about.
SHARD_TURNS = 500_000
#: Turns that occur in 1 / HOT_SHARE of all rows or more get their number by broadcast.
HOT_SHARE = 10_000
#: The boundaries' nodes are broadcast up to so many.
BROADCAST_ROWS = 100_000

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: What a shard gives: nodes of its own (0), its part of a boundary's node (1), conversations ending at one (2).
_PART = f"kind byte, key binary, parent_key binary, bytes long, {_NODE}"
_ROOT = hashlib.blake2b(digest_size=16).digest()


def dictionary(turns: DataFrame) -> DataFrame:
    """Every distinct turn (role, text) once: ``_key`` (its digest), ``_id`` in the order of role and text,
    ``_bytes`` of its text and ``_n``, its rows. Written once, so ids stay."""
    found = turns.groupBy("role", "text").agg(F.count(F.lit(1)).alias("_n")).orderBy("role", "text")
    return staged(
        found.select(_digest().alias("_key"), F.monotonically_increasing_id().alias("_id"), F.octet_length("text").cast("long").alias("_bytes"), "_n"),
        "turns",
    )


def _digest() -> Column:
    return F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)


def encoded(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns``, an array of (id, bytes) in order, of every conversation.

    Turns are ordered by ``turn``, null first, ties by role and text; repeated rows are turns of their own. A
    null role or text counts as empty; rows with a null conv_id take no part. Other columns are left.
    A conversation is one row.
    """
    empty = F.lit("")
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"),
    )
    numbers = dictionary(rows)
    hot = max(1000, rows.count() // HOT_SHARE)
    coded = join_hot(rows.select("conv_id", "turn", _digest().alias("_key")), numbers, "_key", "_n", hot)
    listed = F.sort_array(F.collect_list(F.struct("turn", F.col("_id").alias("id"), F.col("_bytes").alias("bytes"))))
    return coded.groupBy("conv_id").agg(listed.alias("turns")).select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["bytes"].alias("bytes"))).alias("turns")
    )


class Tree:
    """A ternary search tree of sorted, different sequences, put in by medians, so each level is balanced.

    Node 0 is the root. A node stands for the sequence that leads to it; the sequences that go through it
    are its ``members``, and ``ends`` has the place of the sequence that ends there.
    """

    def __init__(self, sequences: list[list[int]], sizes: list[int], counts: list[int], least: list[int]):
        self.value, self.bytes = [-1], [0]
        self.low, self.high, self.down = [-1], [-1], [-1]
        self.members, self.least, self.ends = [0], [None], [-1]
        todo = [(0, len(sequences))]
        while todo:
            start, end = todo.pop()
            if start < end:
                middle = (start + end) // 2
                self._put(middle, sequences[middle], sizes[middle], counts[middle], least[middle])
                todo += [(start, middle), (middle + 1, end)]

    def _new(self, value: int, size: int) -> int:
        for column, x in ((self.value, value), (self.bytes, size), (self.low, -1), (self.high, -1), (self.down, -1), (self.members, 0), (self.least, None), (self.ends, -1)):
            column.append(x)
        return len(self.value) - 1

    def _put(self, place: int, sequence: list[int], sizes: list[int], count: int, least: int) -> None:
        node = 0
        self._pass(node, count, least)
        for value, size in zip(sequence, sizes, strict=True):
            links, at = self.down, node
            node = links[at]
            while node >= 0 and self.value[node] != value:
                links, at = (self.low if value < self.value[node] else self.high), node
                node = links[at]
            if node < 0:
                node = links[at] = self._new(value, size)
            self._pass(node, count, least)
        self.ends[node] = place

    def _pass(self, node: int, count: int, least: int) -> None:
        self.members[node] += count
        if self.least[node] is None or least < self.least[node]:
            self.least[node] = least

    def walk(self) -> tuple[list[int], list[int], list[int]]:
        """The nodes, parents before their children; each one's depth and its parent's place in the list."""
        order, depth, parent, todo = [0], [0], [-1], [(self.down[0], 0)]
        while todo:
            node, above = todo.pop()
            if node >= 0:
                todo += [(self.low[node], above), (self.high[node], above), (self.down[node], len(order))]
                order.append(node)
                depth.append(depth[above] + 1)
                parent.append(above)
        return order, depth, parent

    def path(self, sequence: list[int]) -> list[int]:
        """The nodes along a sequence that was put in, the root first."""
        nodes = [0]
        for value in sequence:
            node = self.down[nodes[-1]]
            while self.value[node] != value:
                node = self.low[node] if value < self.value[node] else self.high[node]
            nodes.append(node)
        return nodes


def _joined(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sequences, sizes, convs = [], [], []
    for batch in batches:
        for conv, ids, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if not sequences or sequences[-1] != ids:
                sequences.append(ids)
                sizes.append(size)
                convs.append([])
            convs[-1].append(conv)
    if not sequences:
        return
    tree = Tree(sequences, sizes, [len(c) for c in convs], [c[0] for c in convs])
    order, depth, parent = tree.walk()
    keys = {}  # of the nodes that another shard may have too: those along the first and the last sequence
    for sequence in (sequences[0], sequences[-1]):
        key = _ROOT
        for node, value in zip(tree.path(sequence), [None, *sequence], strict=True):
            key = key if value is None else hashlib.blake2b(key + value.to_bytes(8, "big"), digest_size=16).digest()
            keys[node] = key
    n = len(order)
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        node = order[i]
        if node not in keys:
            leaves[i] += not children[i]
            saved[i] += (tree.members[node] - 1) * tree.bytes[node]
            above = parent[i]
            children[above] += 1
            leaves[above] += leaves[i]
            saved[above] += saved[i]
    rows = []
    for i, node in enumerate(order):
        above = order[parent[i]] if i else None
        ended = convs[tree.ends[node]] if tree.ends[node] >= 0 else []
        shared = node in keys
        up = None if above is None or shared else tree.least[above]
        rows.append((int(shared), keys.get(node), keys.get(above), tree.bytes[node], tree.least[node], depth[i], up, tree.members[node], children[i], leaves[i], saved[i], None if shared else _joined(ended)))
        if shared:
            rows += [(2, keys[node], None, None, conv, *[None] * 7) for conv in ended]
    for at in range(0, len(rows), 10_000):
        yield _batch(rows[at : at + 10_000], _PARTS)


_PARTS = pa.schema(
    [("kind", pa.int8()), ("key", pa.binary()), ("parent_key", pa.binary()), ("bytes", pa.int64())]
    + [(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string())]
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each key its sorted ids' digest; ids are read as a stream and none is held."""
    key, running = None, None
    done: list[tuple[bytes, str]] = []
    for batch in batches:
        for own, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if own != key:
                if key is not None:
                    done.append((key, running.hexdigest()))
                key, running = own, hashlib.sha256(b"%d" % conv)
            else:
                running.update(b",%d" % conv)
    if key is not None:
        done.append((key, running.hexdigest()))
    yield _batch(done, pa.schema([("_ended", pa.binary()), ("_digest", pa.string())]))


def _rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The boundaries' nodes with what lies below them, from the deepest up."""
    rows = {r["key"]: r for batch in batches for r in batch.to_pylist()}
    if not rows:
        return
    for row in sorted(rows.values(), key=lambda r: -r["depth"]):
        row["n_leaves"] += not row["n_children"]
        row["saved_tokens"] += (row["n_convs"] - 1) * row["bytes"]
        above = rows.get(row["parent_key"])
        if above:
            row["parent_conv_id"] = above["conv_id"]
            above["n_children"] += 1
            above["n_leaves"] += row["n_leaves"]
            above["saved_tokens"] += row["saved_tokens"]
    names = ("key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    yield pa.RecordBatch.from_arrays(
        [pa.array([r.get(c) for r in rows.values()], pa.binary() if c == "key" else pa.int64()) for c in names], list(names)
    )


def prefix_trie(convs: DataFrame) -> DataFrame:
    """The trie of ``convs`` (conv_id, one row each; turns, an array of (id, bytes)): a row for each node.

    A node is a sequence of first turns, from the empty one (the root, depth 0) on; its members are the
    conversations that start with it, and conv_id is the smallest of them. parent_conv_id is the parent's
    (root: null), n_convs counts members, n_children children, n_leaves childless nodes in its subtree (its top
    included), saved_tokens sums (n_convs - 1) x bytes of the last text over the subtree, and ends_sha256
    is the digest of the comma-joined conv_ids of the members that end there, ascending.

    Conversations are sorted by sequence and id into shards of bounded size, equal ones too, so a family of
    copies is dealt out. A shard builds its own tree; only nodes along its first and last sequence can be another
    shard's as well, so those alone are merged, at most two paths a shard, and rolled up in one task.
    A SHA-256 can only be computed in order: the ids that end at one shared node pass one task as a
    stream. Empty sequences end at the root; without conversations there is no row.
    """
    ship(convs.sparkSession)
    rows = staged(
        convs.select("conv_id", F.transform("turns", lambda t: t["id"]).alias("ids"), F.transform("turns", lambda t: t["bytes"]).alias("sizes")),
        "sequences",
    )
    turns = rows.agg(F.sum(F.size("ids") + 1)).head()[0] or 0
    shards = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD_TURNS))
    parts = staged(
        rows.repartitionByRange(shards, "ids", "conv_id").sortWithinPartitions("ids", "conv_id").mapInArrow(_shard, _PART), "parts"
    )
    merged = (
        parts.where("kind = 1")
        .groupBy("key")
        .agg(
            *[F.first(c).alias(c) for c in ("parent_key", "bytes", "depth")], F.min("conv_id").alias("conv_id"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        )
    )
    names = [c.split()[0] for c in _NODE.split(", ")]
    rolled = staged(
        merged.repartition(1).mapInArrow(_rolled, f"key binary, {_NODE.rpartition(',')[0]}"), "boundaries"
    )
    ends = parts.where("kind = 2").select("key", "conv_id").repartition("key").sortWithinPartitions("key", "conv_id")
    ended = ends.mapInArrow(_hashed, "_ended binary, _digest string")
    shared = rolled.join(ended, F.col("key") == F.col("_ended"), "left").select(
        *names[:-1], F.coalesce("_digest", F.lit(_joined([]))).alias("ends_sha256")
    )
    inner = parts.where("kind = 0")
    below = inner.where("parent_key is not null")
    above = rolled.select(F.hex("key").alias("_key"), F.col("conv_id").alias("_above"), F.col("n_children").alias("_n"))
    if above.count() <= BROADCAST_ROWS:
        below = below.join(F.broadcast(above), F.hex("parent_key") == F.col("_key"))
    else:
        below = join_hot(below.withColumn("_key", F.hex("parent_key")), above, "_key", "_n", max(1000, turns // HOT_SHARE))
    below = below.withColumn("parent_conv_id", F.col("_above"))
    return shared.unionByName(inner.where("parent_key is null").select(*names)).unionByName(below.select(*names))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % 5 before its own turns after its
    first h, h = crc32(c as text) % 9; an absent conversation gives no turn, and none may be left."""
    given = convs.where("conv_id % 5 = 0").select(F.col("conv_id").alias("_from"), F.slice("turns", 1, 8).alias("_first"))
    h = F.expr("int(crc32(cast(cast(conv_id as string) as binary)) % 9)")
    joined = convs.withColumn("_h", h).join(given, F.col("conv_id") - F.col("conv_id") % 5 == F.col("_from"), "left")
    first = F.coalesce(F.slice("_first", F.lit(1), F.col("_h")), F.slice("turns", 1, 0))
    return joined.select("conv_id", F.concat(first, F.slice("turns", F.col("_h") + 1, F.size("turns"))).alias("turns"))


def op12_trie(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return prefix_trie(rebuilt(staged(encoded(turns), "encoded")))


SQL = r"""
WITH own AS (
    SELECT conv_id, list({'role': r, 'text': t} ORDER BY turn NULLS FIRST, r, t) AS turns
    FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)
    GROUP BY conv_id
), heads AS (
    SELECT conv_id, turns, (4294967295 - list_reduce(list_concat([4294967295::BIGINT],
        flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END)) % 9 AS h
    FROM own
), rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(f.turns[1:c.h], []), c.turns[c.h + 1:]) AS path
    FROM heads c LEFT JOIN own f ON f.conv_id = c.conv_id - c.conv_id % 5
), members AS (
    SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM rebuilt
), nodes AS (
    SELECT path[1:depth] AS node, depth, count(*) AS n_convs, min(conv_id) AS conv_id,
        string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = len(path)) AS ends
    FROM members GROUP BY ALL
), children AS (
    SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), counted AS (
    SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (node)
), placed AS (
    SELECT *, unnest(range(0, depth + 1)) AS above FROM counted
), sums AS (
    SELECT node[1:above] AS node, count(*) FILTER (WHERE n_children = 0) AS n_leaves,
        sum(CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(node[depth].text) ELSE 0 END) AS saved_tokens
    FROM placed GROUP BY ALL
)
SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves,
    saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(c.ends, '')) AS ends_sha256
FROM counted c JOIN sums ON sums.node = c.node LEFT JOIN nodes p ON c.depth > 0 AND p.node = c.node[1:c.depth - 1]
"""
