"""Packed exchanges: arrays of numbers that travel between tasks as a few binary rows.

Corpus-wide joins on hashes (of substrings, of n-grams) would be a JVM row for
every position of every text.  Here a task packs what goes to each destination
into one binary value, so that a shuffle moves 8 bytes a hash and a destination
works on whole arrays.  Blocks are groups of documents, shards are ranges of
hashes; their numbers grow with the input, so that either fits a task.
"""

from __future__ import annotations

import ctypes
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stash

#: Stands for a null id: before all others.
NO_ID = -(2**63)


def lean() -> None:
    """Lets a worker give large arrays back to the system as soon as they are freed.

    Workers are reused and idle ones stay, so what their allocators keep adds up.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, and no longer adapted
    except (OSError, AttributeError):
        pass  # not glibc


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def parts(total: int, each: int, least: int = 4, most: int = 200_000) -> int:
    """How many parts of about `each` bytes."""
    return max(least, min(most, ceil(total / each)))


def doc_long(col: str = "doc_id") -> Column:
    """The id as a long that is never null."""
    return F.coalesce(F.col(col).cast("long"), F.lit(NO_ID))


def rowed(docs: DataFrame) -> DataFrame:
    """docs with __row, a long that no two rows share, in the order of ids.

    It is the id (NO_ID for null) if none occurs twice.  Else rows are written in the
    order of id and the text's hash and numbered; rows alike in both come in any order.
    """
    out = docs.withColumn("__row", doc_long())
    if out.groupBy("__row").count().where("count > 1").isEmpty():
        return out
    n = parts(text_bytes(docs), 16_000_000)
    out = out.withColumn("__sha", F.sha2(F.col("text").cast("binary"), 256)).withColumn("__tie", F.monotonically_increasing_id())
    out = out.repartitionByRange(n, "__row", "__sha", "__tie").sortWithinPartitions("__row", "__sha", "__tie")
    return stash(out.drop("__sha", "__tie").withColumn("__row", F.monotonically_increasing_id()), "rows")


def block(doc: Column, n: int) -> Column:
    """The block of a document's long id; block_of() is the same in NumPy."""
    return F.pmod(F.hash(doc), F.lit(n)).cast("int")


def block_of(ids: np.ndarray, n: int) -> np.ndarray:
    """Spark's hash() of longs (32-bit Murmur3, seed 42), modulo n."""
    u = np.uint32

    def rot(x, r):
        return (x << u(r)) | (x >> u(32 - r))

    def mix(h, k):
        h = h ^ (rot(k * u(0xCC9E2D51), 15) * u(0x1B873593))
        return rot(h, 13) * u(5) + u(0xE6546B64)

    x = ids.astype(np.int64).view(np.uint64)
    h = mix(np.full(len(x), 42, u), (x & np.uint64(0xFFFFFFFF)).astype(u))
    h = mix(h, (x >> np.uint64(32)).astype(u)) ^ u(8)
    h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
    h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
    h = h ^ (h >> u(16))
    return np.mod(h.view(np.int32).astype(np.int64), n).astype(np.int32)


def shard_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The shard of 64-bit keys: ranges in the order of the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def cuts(keys_sorted: np.ndarray, n: int) -> np.ndarray:
    """Where each of n shards begins in sorted keys; n + 1 places."""
    return np.searchsorted(shard_of(keys_sorted, n), np.arange(n + 1))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes; unpack() needs their types."""
    sizes = np.array([len(a) for a in arrays], np.int64)
    return sizes.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(data: bytes, *kinds) -> list[np.ndarray]:
    """The arrays of pack()."""
    sizes, at, out = np.frombuffer(data, np.int64, len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(data, kind, int(n), at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def small(counts: np.ndarray) -> bytes:
    """Counts, most of them small, at about a byte each."""
    big = np.flatnonzero(counts > 254)
    return pack(np.minimum(counts, 255).astype(np.uint8), big.astype(np.uint32), counts[big].astype(np.int64))


def unsmall(data: bytes) -> np.ndarray:
    """The inverse of small()."""
    low, big, more = unpack(data, np.uint8, np.uint32, np.int64)
    out = low.astype(np.int64)
    out[big] = more
    return out


#: Low bits that key() clears: 48 are left, so a key that is not there is taken for one of n with probability n / 2**48.
CLEARED = 16


def key(hashes: np.ndarray) -> np.ndarray:
    """Hashes as keys that thin() packs well."""
    return hashes & ~np.uint64((1 << CLEARED) - 1)


def thin(keys: np.ndarray) -> bytes:
    """Sorted distinct keys at about four bytes each: their differences, and in full those that need more."""
    d = np.diff(keys >> np.uint64(CLEARED), prepend=np.uint64(0))
    big = np.flatnonzero(d >= 2**32 - 1)
    return pack(np.minimum(d, np.uint64(2**32 - 1)).astype(np.uint32), big.astype(np.uint32), d[big])


def unthin(data: bytes) -> np.ndarray:
    """The inverse of thin()."""
    low, big, more = unpack(data, np.uint32, np.uint32, np.uint64)
    d = low.astype(np.uint64)
    d[big] = more
    return np.cumsum(d, dtype=np.uint64) << np.uint64(CLEARED)
