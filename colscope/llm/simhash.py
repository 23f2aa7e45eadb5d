"""SimHash near-dedup: multi-index hashing over two fingerprint halves."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import carried, cut, documents, join_hot, ship, with_arrays
from colscope.llm.components import components

WORDS, SEED, RADIUS = 4, 42, 4
#: A text is read in pieces of about so many bytes, so a long one doesn't fill a worker.
PIECE_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Fingerprints shared by 1 / HOT_SHARE of the rows or more are joined back by broadcast.
HOT_SHARE = 1000


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, piece by piece."""
    at = 0
    while at < len(raw):
        cut_at = _SPACE.search(raw, at + PIECE_BYTES)
        end = cut_at.start() if cut_at else len(raw)
        yield raw[at:end].split()
        at = end + 1


def _hashes(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 of each run of ``n`` words."""
    text, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    digest = xxhash.xxh64_intdigest
    last = len(words) - n + 1
    return np.fromiter(
        (digest(text[s:e], SEED) for s, e in zip(starts[:last], ends[n - 1 :], strict=True)), np.uint64, last
    )


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text's 4-word shingles, repeats counted; 0 for a text without words.

    A-Z are lower-cased and words split at spaces and the controls from tab to carriage return, which
    is what bytes.lower and bytes.split do. Fewer words than four are one shingle.
    """
    counts, total, held = np.zeros(64, np.int64), 0, []
    for words in _pieces((text or "").encode("utf-8", "surrogatepass").lower()):
        held += words
        if len(held) >= WORDS:
            h = _hashes(held, WORDS)
            for i in range(0, len(h), 1 << 16):
                part = h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
                counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
            total += len(h)
            held = held[1 - WORDS :]
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(held), SEED) if held else 0
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column(2)], np.uint64)
        yield with_arrays(batch.select([0, 1]), _print=pa.array(prints.view(np.int64)))


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id``, ``_sha`` (sha256 of the text) and ``_print``, the fingerprint as a signed long, of every row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), text_digest(text_col).alias("_sha"), F.col(text_col).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(_fingerprints, f"_id {kind}, _sha string, _print long")


def text_digest(text_col: str) -> Column:
    """Tells texts apart; null counts as empty."""
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)


def _half(which: int) -> Column:
    """One half of the fingerprint as a table key: the half's 32 bits, and which half it is above them."""
    bits = F.shiftrightunsigned("_print", 32 * which).bitwiseAND(F.lit(0xFFFFFFFF))
    return bits.bitwiseOR(F.lit(which << 32))


def _ball(which: int) -> Column:
    """Keys within one bit of the half, each with the flipped bit (-1: none)."""
    own = F.struct(_half(which).alias("key"), F.lit(-1).alias("bit"))
    flipped = [
        F.struct(_half(which).bitwiseXOR(F.lit(1 << i)).alias("key"), F.lit(i).alias("bit")) for i in range(32)
    ]
    return F.array(own, *flipped)


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b; a < b) of the distinct fingerprints ``_print`` that differ in 4 bits or fewer.

    Of 4 differing bits at most 1 lies in the low half or at most 2 in the high half. Low halves within
    1 bit: one side looks up the 33 keys around its half in a table of plain halves. High halves within
    2 bits: both sides list the 33 keys around theirs and meet in the middle. Matches are verified on
    the complete distance inside the join, so only links leave it.
    """
    if radius != RADIUS:
        raise ValueError("the two halves' radii, 1 and 2, fit 4 differing bits")
    probes = prints.select(F.col("_print").alias("a"), F.inline(F.concat(_ball(0), _ball(1))))
    exact = F.array(F.struct(_half(0).alias("key"), F.lit(-1).alias("bit")))
    entries = prints.select(F.col("_print").alias("b"), F.inline(F.concat(exact, _ball(1)))).withColumnsRenamed(
        {"key": "e_key", "bit": "e_bit"}
    )
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    # the same bit flipped on both sides: equal halves, which meet unflipped too
    once = (F.col("bit") < 0) | (F.col("bit") != F.col("e_bit"))
    return probes.join(
        entries, (F.col("key") == F.col("e_key")) & (F.col("a") < F.col("b")) & once & near
    ).select("a", "b").distinct()


def _hexed(column: str) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``_id``, ``_sha``, fingerprint (16 hex digits), component_id and kept.

    Documents link when their fingerprints differ in 4 bits or fewer; component_id is the smallest id
    reachable by links. Of a component the document with that id stays (``kept``); of several with it,
    the one whose text has the smallest sha256, ``_sha``. Null and empty texts have fingerprint 0 and
    link as others do; a null id comes last, a component of null ids alone has a null one; rows alike in
    id and text each get their row and stay or go together; other columns take no part. An empty table
    gives none.

    Copies share a fingerprint, so only distinct fingerprints are indexed, linked and contracted.
    """
    rows = cut(fingerprints(docs, id_col, text_col))
    n = rows.count()
    place = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_sha").alias("sha"))
    nodes = cut(rows.groupBy("_print").agg(F.min(place).alias("_least"), F.count(F.lit(1)).alias("_rows")))
    stars = components(links(nodes.select("_print")))
    rooted = nodes.join(stars, F.col("_print") == F.col("node"), "left").withColumn(
        "_root", F.coalesce("root", "_print")
    )
    # a root may hold very many fingerprints: sizes are folded first and hot roots served by broadcast
    rooted = rooted.select("_print", "_least", "_rows", _hexed("_root").alias("_root"))
    roots = rooted.groupBy("_root").agg(F.min("_least").alias("_first"), F.count(F.lit(1)).alias("_nodes"))
    groups = join_hot(rooted, roots, "_root", "_nodes", max(1000, n // HOT_SHARE)).select(
        _hexed("_print").alias("fingerprint"), "_rows", "_first"
    )
    joined = join_hot(
        rows.select("_id", "_sha", _hexed("_print").alias("fingerprint")), groups, "fingerprint", "_rows", max(1000, n // HOT_SHARE)
    )
    return joined.select(
        "_id", "_sha", "fingerprint", F.col("_first.id").alias("component_id"), place.eqNullSafe(F.col("_first")).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one a component if rows differ in id or text; all columns as they were.

    Those that go are taken out by a join on their id and digest, so only few rows' keys travel.
    """
    gone = near_duplicates(docs, id_col, text_col).where(~F.col("kept"))
    gone = gone.select(F.col("_id").alias("_gone_id"), F.col("_sha").alias("_gone_sha")).distinct()
    first, _, last = carried(docs, [])
    rows = docs.select(*first, F.col(id_col).alias("_id"), text_digest(text_col).alias("_sha"))
    alike = F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_sha") == F.col("_gone_sha"))
    return rows.join(gone, alike, "left_anti").select(*last)


def op2_simhash(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir)).select(
        F.col("_id").alias("doc_id"), "fingerprint", "component_id"
    )
