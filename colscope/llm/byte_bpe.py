"""Byte-level BPE encoding and decoding with a sentencepiece model serialised from the vocabulary."""

from __future__ import annotations

import base64
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colscope.llm.common import documents, ship, with_arrays

#: Field numbers and codes of the sentencepiece model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, TYPE = 1, 2, 3
NORMAL, UNKNOWN = 1, 2
MODEL_TYPE, BPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID = 3, 2, 4, 40, 41, 42, 43
NAME, ADD_DUMMY_PREFIX, REMOVE_EXTRA_WHITESPACES, ESCAPE_WHITESPACES = 1, 3, 4, 5

#: Between pre-tokens in a call of the model.
SEPARATOR = "\n"
#: Pre-tokens encoded at once, the characters from which a text is read in parts, and the characters
#: of the rows that are read, encoded and sent back together.
AT_ONCE, LONG_TEXT, SLICE_CHARS = 1 << 19, 1 << 21, 1 << 19
#: Distinct pre-tokens in one text that the model gets: its queue of merges stays short.
AT_A_CALL = 32


def byte_characters() -> list[str]:
    """A visible character for each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = {b: chr(b) for b in shown}
    for b in range(256):
        chars.setdefault(b, chr(0x100 + b - sum(x < b for x in shown)))
    return [chars[b] for b in range(256)]


def _varint(n: int) -> bytes:
    out = b""
    n &= (1 << 64) - 1
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary file's byte strings in order of rank."""
    with open(path, "rb") as f:
        ranked = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    if sorted(ranked) != list(range(len(ranked))):
        raise ValueError("ranks must run from 0 without a gap")
    return [ranked[i] for i in range(len(ranked))]


def serialised_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model of the vocabulary: the piece of rank r has id r and score -r, bytes
    are written as characters, and texts are taken as they are."""
    chars = byte_characters()
    out = b"".join(
        _bytes(
            PIECES,
            _bytes(PIECE, "".join(chars[b] for b in token).encode())
            + _varint(SCORE << 3 | 5)
            + struct.pack("<f", -rank)
            + _number(TYPE, NORMAL),
        )
        for rank, token in enumerate(tokens)
    )
    unknown = len(tokens)
    # never produced: each single byte is a piece. A name that no byte string maps to.
    out += _bytes(PIECES, _bytes(PIECE, b"\xe2\x96\x81unknown") + _number(TYPE, UNKNOWN))
    trainer = _number(MODEL_TYPE, BPE) + _number(VOCAB_SIZE, unknown + 1) + _number(UNK_ID, unknown)
    trainer += b"".join(_number(field, -1) for field in (BOS_ID, EOS_ID, PAD_ID))
    off = b"".join(_number(f, 0) for f in (ADD_DUMMY_PREFIX, REMOVE_EXTRA_WHITESPACES, ESCAPE_WHITESPACES))
    return out + _bytes(TRAINER, trainer) + _bytes(NORMALIZER, _bytes(NAME, b"identity") + off)


def _ranges(holds, top: int) -> str:
    """The characters up to ``top`` for which ``holds`` is true, as the inside of a character class."""
    out, start = [], None
    for c in range(top + 2):
        if c <= top and holds(c):
            start = c if start is None else start
        elif start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


def _classes(top: int) -> dict[str, str]:
    """Letters, numbers and white space as Unicode has them; re's own \\s also takes U+001C to U+001F."""
    kind = unicodedata.category
    return {
        r"\p{L}": _ranges(lambda c: kind(chr(c))[0] == "L", top),
        r"\p{N}": _ranges(lambda c: kind(chr(c))[0] == "N", top),
        r"\s": _ranges(lambda c: chr(c).isspace() and not 0x1C <= c <= 0x1F, top),
    }


@lru_cache(maxsize=4)
def compiled(pattern: str, top: int) -> re.Pattern:
    """The pre-token pattern for texts of characters up to ``top``, for re, which is twice as fast at
    it as modules that know \\p{L}, if classes end at U+FFFF."""
    out, at, inside = "", 0, False
    classes = _classes(top)
    while at < len(pattern):
        name = next((n for n in classes if pattern.startswith(n, at)), None)
        if name:
            out += classes[name] if inside else f"[{classes[name]}]"
            at += len(name)
        elif pattern.startswith(r"\S", at):
            out += f"[^{classes[chr(92) + 's']}]"
            at += 2
        else:
            inside = pattern[at] == "[" or inside and pattern[at] != "]"
            out += pattern[at]
            at += 1
    return re.compile(out)


class Codec:
    """Encodes texts by pre-token and decodes ids, with one loaded model."""

    def __init__(self, model: bytes, pattern: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern = pattern
        chars = byte_characters()
        back = {c: b for b, c in enumerate(chars)}
        self.unknown = self.pieces.get_piece_size() - 1
        self.token = [bytes(back[c] for c in self.pieces.id_to_piece(i)) for i in range(self.unknown)]
        # UTF-8 has no byte 0xFF: it parts pre-tokens, as a character that no piece holds
        self.to_char = "".join(chars[:255]) + SEPARATOR

    def _distinct(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pre-tokens, one after another, and where each one's ids start (and end)."""
        joined = [b"\xff".join([*raw[i : i + AT_A_CALL], b""]) for i in range(0, len(raw), AT_A_CALL)]
        coded = self.pieces.encode([j.decode("latin-1").translate(self.to_char) for j in joined], num_threads=1)
        ids = np.fromiter(chain.from_iterable(coded), np.int32)
        parted = np.flatnonzero(ids == self.unknown)
        starts = np.concatenate([[0], parted - np.arange(len(parted))])
        ids = ids[ids != self.unknown]
        return ids, starts

    def _block(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens, one after another, and how many each has; each distinct one is encoded once."""
        coded = pa.array(words, pa.string()).dictionary_encode()
        ids, starts = self._distinct(coded.dictionary.cast(pa.binary()).to_pylist())
        index = coded.indices.to_numpy()
        sizes = np.diff(starts)[index]
        ends = np.cumsum(sizes)
        return ids[np.repeat(starts[index] - (ends - sizes), sizes) + np.arange(ends[-1])], sizes

    def encode_all(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each text has; a null text has none."""
        parts, sizes = [np.empty(0, np.int32)], np.zeros(len(texts), np.int64)
        words: list[str] = []
        owners: list[tuple[int, int]] = []

        def flush() -> None:
            if words:
                ids, counts = self._block(words)
                parts.append(ids)
                upto = np.concatenate([[0], np.cumsum(counts)])
                ends = np.cumsum([n for _, n in owners])
                np.add.at(sizes, [i for i, _ in owners], np.diff(upto[np.concatenate([[0], ends])]))
            words.clear()
            owners.clear()

        for i, text in enumerate(texts):
            for found in self._pre_tokens(text or ""):
                words.extend(found)
                owners.append((i, len(found)))
                if len(words) >= AT_ONCE:
                    flush()
        flush()
        return np.concatenate(parts), sizes

    def _pre_tokens(self, text: str) -> Iterator[list[str]]:
        wide = len(text.encode("utf-16-le", "surrogatepass")) > 2 * len(text)
        pattern = compiled(self.pattern, sys.maxunicode if wide else 0xFFFF)
        if len(text) <= LONG_TEXT:
            yield pattern.findall(text)
        else:
            found = (m.group() for m in pattern.finditer(text))
            while words := list(islice(found, AT_ONCE)):
                yield words

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one text."""
        return self.encode_all([text])[0]

    def decode(self, ids) -> bytes:
        """The bytes of ids, by the inverse mapping of their pieces."""
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(model: bytes, pattern: str) -> Codec:
    return Codec(model, pattern)


def _model(path: str | None, pattern: str | None) -> tuple[bytes, str]:
    if path is None or pattern is None:
        import public_tokenizers

        path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    model = serialised_model(read_ranks(path))
    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = pieces.get_piece_size() - 1
    if any(ids != [i] for i, ids in enumerate(pieces.encode([pieces.id_to_piece(i) for i in range(n)], num_threads=1))):
        raise ValueError("a piece that its own merges don't lead to would be encoded otherwise")
    return model, pattern


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows with SLICE_CHARS characters of text or little more."""
    start, chars = 0, 0
    for i, n in enumerate(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
        chars += n
        if chars >= SLICE_CHARS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(
    docs: DataFrame,
    text_col: str = "text",
    path: str | None = None,
    pattern: str | None = None,
    into: str = "ids",
    decoded: str | None = None,
    keep_text: bool = True,
) -> DataFrame:
    """Every row of ``docs`` with ``into``: the text's token ids as array<int>, no special tokens.

    Texts are cut into pre-tokens by ``pattern`` and each is encoded by itself with the sentencepiece
    model built from the vocabulary at ``path`` (which the driver reads; tasks get the model, about
    1 MB). With ``decoded``, the ids are decoded in the same task and that column holds the bytes, to
    check the round trip. Without ``keep_text`` the text isn't sent back. Workers take some megabytes
    of text at a time, however large the batch.

    A null or empty text has no ids. Repeated rows and other columns pass through; a column named
    like a result is replaced. An empty table gives none.
    """
    model, pattern = _model(path, pattern)
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model, pattern))
    carry = docs.drop(into, *([decoded] if decoded else []))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*shared.value)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            rest = batch if keep_text else batch.select([i for i in range(batch.num_columns) if i != at])
            for start, end in _slices(batch.column(at)):
                ids, sizes = own.encode_all(batch.column(at).slice(start, end - start).to_pylist())
                ends = np.concatenate([[0], np.cumsum(sizes)])
                added = {into: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))}
                if decoded:
                    texts = [own.decode(ids[a:b].tolist()) for a, b in pairwise(ends.tolist())]
                    added[decoded] = pa.array(texts, pa.binary())
                yield with_arrays(rest.slice(start, end - start), **added)
            pa.default_memory_pool().release_unused()

    rest = carry if keep_text else carry.drop(text_col)
    schema = rest.withColumn(into, F.lit(None).cast("array<int>"))
    if decoded:
        schema = schema.withColumn(decoded, F.lit(None).cast("binary"))
    return carry.mapInArrow(encoded, schema.schema)


def decode(
    rows: DataFrame, ids_col: str = "ids", path: str | None = None, into: str = "decoded"
) -> DataFrame:
    """Every row with ``into``: the bytes that its ids stand for. Null ids give no bytes.

    A column named like ``into`` is replaced. Ids outside the vocabulary are an error.
    """
    model, pattern = _model(path, None)
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast((model, pattern))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*shared.value)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col))
            found = [own.decode(x.values.to_numpy().tolist() if x.is_valid else ()) for x in ids]
            yield with_arrays(batch, **{into: pa.array(found, pa.binary())})

    rest = rows.drop(into)
    return rest.mapInArrow(decoded, rest.withColumn(into, F.lit(None).cast("binary")).schema)


def digests(encoded: DataFrame) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of rows with ids and decoded, beside doc_id."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_byte_bpe(spark, sf_dir):
    return digests(encode(documents(spark, sf_dir), decoded="decoded", keep_text=False))
