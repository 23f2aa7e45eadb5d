"""Hash keys, hash draws and canonical row hashes as column expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def joined_text(columns: Sequence[str | Column], separator: str) -> Column:
    """The columns' text joined by ``separator``, a null counting as the empty text."""
    cells = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.concat_ws(separator, *[F.coalesce(c.cast("string"), F.lit("")) for c in cells])


def surrogate_key(columns: Sequence[str | Column]) -> Column:
    """md5 of the pipe-joined grain fields."""
    return F.md5(joined_text(columns, "|"))


def seeded_digest(seed: int | Column, *parts: Column) -> Column:
    """Hex sha256 of ``seed:part[:part...]``: the order every hash draw sorts by."""
    head = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.sha2(F.concat_ws(":", head, *[p.cast("string") for p in parts]), 256)


def sample_threshold(one_in: int) -> str:
    """``2**64 // one_in`` as 16 lower-case hex digits.

    Fixed-width lower-case hex compares as text the way the unsigned integer does.
    A rate of 1 in 1 keeps everything, which 16 digits can't say; callers skip the filter.
    """
    if one_in < 2:
        raise ValueError("one_in must be at least 2")
    return format(2**64 // one_in, "016x")


def in_sample(key: Column, one_in: int) -> Column:
    """Whether the first 8 bytes of sha256(key), big-endian, fall under ``2**64 // one_in``."""
    if one_in == 1:
        return F.lit(True)
    return F.substring(F.sha2(key, 256), 1, 16) < F.lit(sample_threshold(one_in))


def digest_modulo(hex_digest: Column, n: int) -> Column:
    """The hex digest read as one big integer, modulo ``n``, without leaving 64 bits.

    The 64 digits are read 8 at a time, so ``remainder * 16**8 + block`` stays in a bigint
    for every n below 2**31; a larger n is refused. Give a column that holds the digest,
    so it isn't hashed again for each of its blocks.
    """
    if not 0 < n < 1 << 31:
        raise ValueError("the modulus must be from 1 to 2**31 - 1")
    remainder = F.lit(0).cast("bigint")
    for block in range(8):
        piece = F.conv(F.substring(hex_digest, 8 * block + 1, 8), 16, 10).cast("bigint")
        remainder = (remainder * F.lit(1 << 32) + piece) % F.lit(n)
    return remainder


def digest_remainders(n: int) -> Callable[[bytes, Sequence[bytes]], np.ndarray]:
    """``digest_modulo`` inside a task: sha256(head + tail) modulo ``n`` for each tail, read as arrays.

    A closure, so it travels to the workers whole and they need no module of this package.
    """
    if not 0 < n < 1 << 31:
        raise ValueError("the modulus must be from 1 to 2**31 - 1")

    def remainders(head: bytes, tails: Sequence[bytes]) -> np.ndarray:
        sha256 = hashlib.sha256
        digests = b"".join([sha256(head + tail).digest() for tail in tails])
        blocks = np.frombuffer(digests, dtype=">u4").reshape(-1, 8).astype(np.uint64)
        remainder = np.zeros(len(tails), dtype=np.uint64)
        for i in range(8):
            remainder = ((remainder << np.uint64(32)) | blocks[:, i]) % np.uint64(n)
        return remainder.astype(np.int64)

    return remainders


def canonical_json(columns: Sequence[str]) -> Column:
    """One row as compact JSON, keys sorted, nulls kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def row_digest(columns: Sequence[str]) -> Column:
    """sha256 of the row's canonical JSON."""
    return F.sha2(canonical_json(columns), 256)
