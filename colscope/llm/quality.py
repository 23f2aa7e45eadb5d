"""Quality classifier: labelled neighbours in a latent-semantic space vote, weighted by similarity."""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import carried, carried_as, documents, ship, table, with_arrays
from colscope.llm.fitting import fit_sample, remainder

#: Labelled rows to fit on at most; latent dimensions; neighbours that vote; power of their similarity.
FIT_ROWS, DIMENSIONS, NEIGHBOURS, POWER = 4000, 48, 25, 8.0
THRESHOLD = 0.3
#: Documents whose products with all labelled vectors are held at once.
BLOCK = 256
#: A text is read in parts of about so many bytes, cut between words. Different words are told apart by so many hashes.
PART_BYTES, WORD_HASHES = 1 << 20, 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")

_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\t\n\x0b\x0c\r", b".", b",", b"!", b"?", b"|", b"#$%&*@^~=+`", b"\"'", b"()[]{}<>", b"-_/\\:;"]
KINDS = len(_GROUPS) + 2
_KIND = np.full(256, KINDS - 1, np.uint16)  # other controls
_KIND[128:] = KINDS - 2
for _i, _group in enumerate(_GROUPS):
    _KIND[list(_group)] = _i
SHAPES = KINDS**3
#: Beside the shapes: words, words like the one before, different words.
TERMS = SHAPES + 3


def terms(text: str | None) -> np.ndarray:
    """Square roots of term shares: the kinds of three bytes in a row, and how words repeat.

    Shares of shapes and of words each sum to 1; a text without any is all zeros. They are those of the whole
    text: no word is cut by a part's edge, and different words are marked in one array for all parts.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    shapes, words, before, at = np.zeros(SHAPES, np.int64), np.zeros(2, np.int64), None, 0
    seen = np.empty(0, np.int64)
    while at < len(raw):
        cut_at = _SPACE.search(raw, at + PART_BYTES)
        end = cut_at.start() if cut_at else len(raw)
        k = _KIND[np.frombuffer(raw[max(0, at - 2) : end], np.uint8)]
        if len(k) >= 3:
            shapes += np.bincount(k[:-2] * (KINDS * KINDS) + k[1:-1] * KINDS + k[2:], minlength=SHAPES)
        w = raw[at:end].split()
        if w:
            words += [len(w), sum(map(eq, w, w[1:])) + (w[0] == before)]
            seen = np.union1d(seen, np.fromiter(map(crc32, w), np.int64, len(w)) % WORD_HASHES)
            before = w[-1]
        at = end
    out = np.zeros(TERMS, np.float32)
    out[:SHAPES] = np.sqrt(shapes / max(1, shapes.sum()))
    out[SHAPES:] = np.sqrt(np.array([*words, len(seen)]) / max(1, words[0]))
    return out


class Space:
    """The latent space and its labelled vectors."""

    def __init__(self, x: np.ndarray, y: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 5):
        self.prior = float(y.mean()) if len(y) else 0.5
        n = len(x)
        df = (x > 0).sum(0)
        self.weight = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
        weighed = x * self.weight
        rng = np.random.default_rng(seed)
        basis = rng.normal(size=(x.shape[1], min(dimensions + 16, x.shape[1]))).astype(np.float32)
        for _ in range(4):  # subspace iteration towards the leading right singular vectors
            basis, _ = np.linalg.qr(weighed.T @ (weighed @ basis)) if n else (basis, None)
        small = weighed @ basis
        _, _, turn = np.linalg.svd(small, full_matrices=False) if n else (0, 0, np.eye(basis.shape[1]))
        self.axes = (basis @ turn.T[:, :dimensions]).astype(np.float32)
        self.vectors = self._unit(weighed @ self.axes)
        self.labels = y.astype(np.float32)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        length = np.linalg.norm(v, axis=1, keepdims=True)
        return (v / np.where(length > 0, length, 1)).astype(np.float32)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The labels of each row's nearest labelled vectors, weighted by a power of the cosine.

        A row that is near to none (an empty text) gets the labels' mean.
        """
        if not len(self.labels) or not len(x):
            return np.full(len(x), self.prior)
        cosines = np.maximum(self._unit((x * self.weight) @ self.axes) @ self.vectors.T, 0)
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        votes = np.take_along_axis(cosines, near, 1).astype(np.float64) ** POWER
        total = votes.sum(1)
        score = (votes * self.labels[near]).sum(1) / np.where(total > 0, total, 1)
        return np.clip(np.where(total > 0, score, self.prior), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Space:
    """The space of up to ``rows`` labelled documents; 4,000 rows of 4,099 terms are 66 MB on the driver."""

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [terms(t) for t in batch["_text"]]
            at = [np.flatnonzero(t).astype(np.int32) for t in found]
            values = [t[i] for t, i in zip(found, at, strict=True)]
            yield pd.DataFrame({"at": at, "value": values, "label": batch["_label"]})

    ship(docs.sparkSession)
    sample = fit_sample(docs, labels, "quality", 5, 0, rows)
    got = sample.mapInPandas(featured, "at array<int>, value array<float>, label int").collect()
    x = np.zeros((len(got), TERMS), np.float32)
    for i, r in enumerate(got):
        x[i, r["at"]] = r["value"]
    return Space(x, np.array([r["label"] for r in got], np.float32))


def classify(docs: DataFrame, space: Space, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with score (0 to 1, higher: quality 1 likelier) and predicted.

    The labelled vectors, at most FIT_ROWS of them (some 2 MB with the axes), are broadcast and each
    document's exact cosine with every one of them is computed, in blocks. Only the text is read; a
    null or empty one gets the fitted labels' mean. Rows may repeat; columns named score or predicted
    are replaced. An empty table gives none.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(space)
    results = ("score", "predicted")
    first, _, last = carried(docs, results)
    rest, text_name = docs.select(*first), carried_as(docs, results, text_col)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            texts = batch.column(batch.schema.get_field_index(text_name))
            for at in range(0, batch.num_rows, BLOCK):
                part = texts.slice(at, BLOCK).to_pylist()
                out[at : at + BLOCK] = own.scores(np.stack([terms(t) for t in part]))
            yield with_arrays(batch, score=pa.array(out))

    schema = rest.withColumn("score", F.lit(0.0)).schema
    predicted = (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    return rest.mapInArrow(scored, schema).select(*last, "score", predicted)


def op10_quality(spark, sf_dir):
    docs = documents(spark, sf_dir)
    space = fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return classify(docs, space).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted"
    )
