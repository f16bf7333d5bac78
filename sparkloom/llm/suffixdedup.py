"""Removal of repeated substrings with suffix arrays built by two-stage sorting.

A byte goes if a string of `length` bytes that covers it also starts earlier in
the corpus.  Three steps, each over all documents:

1. Anchors.  Of the hashes of all K-byte strings in a window of `length` bytes the
   least is its anchor, so equal windows have equal anchors at equal places.
   Anchors that occur once in the corpus rule their windows out.  Of an anchor's
   occurrences with all bytes alike for a window's reach on both sides, all
   but the earliest lie in repeats as a whole.
2. Suffix arrays.  The distinct surroundings of an anchor go to one task in two
   pieces, by the anchor with what is next to it on the left and on the right (a
   window reaches far enough on one of these sides).  Their suffixes are sorted in
   two stages: those smaller than their successors directly, the others are
   induced by one scan over the buckets; adjacent common prefixes of at least
   `length` bytes are the repeats, of which the earliest stays.
3. Removal.  Covered bytes are cut from each document.

Scale: about 3 anchors per 100 bytes travel, packed; copies within a batch are
folded before that, so a hot string is one entry a batch.  Only documents' own
texts and what surrounds repeats' borders are ever in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import NO_ID, block, block_of, cuts, doc_long, lean, pack, parts, rowed, shard_of, text_bytes, unpack
from .neardup import _mixed
from .shared import stash

LENGTH, K = 100, 32
#: Reaches beside an anchor are packed in two bytes, the pieces' sizes too.
LONGEST = 16_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))
_TABLE = np.random.Generator(np.random.PCG64(11)).integers(0, 2**64 - 1, 256, np.uint64, endpoint=True)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse, up to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        for k, base in enumerate((_STEP, _BACK)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


class Hashes:
    """Hashes of any substring of a text, by prefix sums."""

    def __init__(self, data: np.ndarray):
        self.up, down = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * down[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.up[start])


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every `width` neighbours, by doubling."""
    at = 1
    while at * 2 <= width:
        x = op(x[:-at], x[at:])
        at *= 2
    return x if at == width else op(x[: len(x) - (width - at)], x[width - at :])


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(hash, hash of the surroundings, place, reach to the left, to the right) of a text's anchors."""
    n, wide = len(data), length - K
    if n < length:
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    h = Hashes(data)
    at = np.arange(n - K + 1)
    grams = h.of(at, at + K)
    least = _sliding(grams, wide + 1, np.minimum)
    pad = np.zeros(wide, np.uint64)
    most = _sliding(np.concatenate([pad, least, pad]), wide + 1, np.maximum)
    place = np.flatnonzero(grams == most)
    left, right = np.minimum(place, wide), np.minimum(n - K - place, wide)
    around = h.of(place - left, place + K + right) ^ _mixed((left * 65536 + right).astype(np.uint64))
    # least hashes are small ones; mixed anew, they deal evenly
    return _mixed(grams[place] ^ _STEP), around, place, left, right


def _first_of(order_keys: tuple[np.ndarray, ...], same: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether each in that order is the first of its equals): sorted by `same`, then order_keys."""
    order = np.lexsort((*order_keys[::-1], *same[::-1]))
    first = np.ones(len(order), bool)
    if len(order):
        differs = [x[order][1:] != x[order][:-1] for x in same]
        first[1:] = np.logical_or.reduce(differs)
    return order, first


_KINDS = (np.uint64, np.uint64, np.int64, np.uint32, np.uint16, np.uint16)
_SPANS = (np.int64, np.uint32, np.uint32)


def _later(order, first, doc, place) -> np.ndarray:
    """Which of the sorted entries have an earlier equal: not the first, nor the same place again."""
    head = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    d, p = doc[order], place[order]
    return ~first & ((d != d[head]) | (p != p[head]))


def _words(text: np.ndarray, depth: int) -> np.ndarray:
    """The 8 bytes from every place on, as a number; 0 bytes follow the text."""
    padded = np.concatenate([text, np.zeros(depth + 16, np.uint8)]).astype(np.uint64)
    words = np.zeros(len(text) + depth + 8, np.uint64)
    for k in range(8):
        words |= padded[k : k + len(words)] << np.uint64(56 - 8 * k)
    return words


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of `text` in order of their first `depth` bytes at least, by two-stage sorting."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    t = text.astype(np.int64)
    nxt = np.append(t[1:], -1)
    # smaller than the successor: decided by the next byte that differs
    change = np.flatnonzero(t != nxt)
    small = (t < nxt)[change[np.searchsorted(change, np.arange(n))]]
    words = _words(text, depth)
    # stage one: direct sort, word by word, of those that are still tied
    chosen = np.flatnonzero(small)
    order = chosen[np.argsort(words[chosen], kind="stable")]
    group = np.zeros(len(order), np.int64)
    if len(order):
        w = words[order]
        group[1:] = np.cumsum(w[1:] != w[:-1])
    for at in range(8, depth, 8):
        size = np.bincount(group) if len(group) else np.zeros(0, np.int64)
        tied = np.flatnonzero(size[group] > 1) if len(group) else group
        if not len(tied):
            break
        s, g = order[tied], group[tied]
        w = words[s + at]
        again = np.lexsort((w, g))
        order[tied] = s[again]
        w = w[again]
        border = np.zeros(len(order), bool)
        border[0] = True
        border[1:] = group[1:] != group[:-1]
        inner = np.flatnonzero((w[1:] != w[:-1]) & (g[1:] == g[:-1])) + 1
        border[tied[inner]] = True
        group = np.cumsum(border) - 1
    # stage two: buckets in order; each induces the greater suffixes before its own
    ends = np.searchsorted(t[order], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    last = n - 1
    waiting[t[last]].append(np.array([last]))  # nothing follows it: greater than its successor
    out = []

    def give(found: np.ndarray, own: int) -> np.ndarray:
        """What stands before `found` and is greater goes to its bucket; that of bucket `own` is returned."""
        before = found[found > 0] - 1
        before = before[~small[before]]
        c = t[before]
        here = before[c == own]
        before, c = before[c != own], c[c != own]
        if len(before):
            by = np.argsort(c, kind="stable")
            before, c = before[by], c[by]
            at = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            for b, p in zip(c[at], np.split(before, at[1:]), strict=True):
                waiting[b].append(p)
        return here

    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = give(wave, c)
        direct = order[ends[c] : ends[c + 1]]
        if len(direct):
            out.append(direct)
            give(direct, c)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Of each suffix in order with the one before: the length of their common prefix, up to `most`; 0 for the first."""
    words = _words(text, most)
    out = np.zeros(len(order), np.int64)
    alive = np.arange(1, len(order))
    for at in range(0, most, 8):
        if not len(alive):
            break
        differ = words[order[alive] + at] ^ words[order[alive - 1] + at]
        leading = np.zeros(len(alive), np.int64)
        for k in range(1, 9):
            leading += differ >> np.uint64(64 - 8 * k) == 0
        out[alive] = np.minimum(at + leading, most)
        alive = alive[differ == 0]
    return out


def _repeats(pieces: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc, start, end) of windows in the pieces that another piece has earlier."""
    sizes = np.array([len(p) for p in pieces])
    text = np.frombuffer(b"".join(p + b"\0" for p in pieces), np.uint8)
    begins = np.cumsum(sizes + 1) - sizes - 1
    piece = np.repeat(np.arange(len(pieces)), sizes + 1)
    order = suffix_order(text, length)
    whole = np.arange(len(text)) - begins[piece] + length <= sizes[piece]
    order = order[whole[order]]
    if not len(order):
        return
    same = common_prefixes(text, order, length) >= length
    run = np.cumsum(~same)
    d, p = doc[piece[order]], start[piece[order]] + order - begins[piece[order]]
    by, first = _first_of((d, p), (run,))
    later = by[_later(by, first, d, p)]
    yield d[later], p[later], p[later] + length


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document joined where they touch."""
    if not len(doc):
        return doc, start, end
    by = np.lexsort((start, doc))
    doc, start, end = doc[by], start[by].astype(np.int64), end[by].astype(np.int64)
    _, rank = np.unique(doc, return_inverse=True)
    lift = rank * np.int64(2**33)  # documents follow one another on one axis
    reach = np.maximum.accumulate(end + lift)
    new = np.append(True, start[1:] + lift[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return doc[at], start[at], (np.append(reach[at[1:] - 1], reach[-1]) - lift[at])


def _rows(blocks: np.ndarray, kind: int, *arrays: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(block, kind, packed arrays) for each block."""
    by = np.argsort(blocks, kind="stable")
    b = blocks[by]
    if not len(b):
        return
    at = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
    for lo, hi in zip(at, np.append(at[1:], len(b)), strict=True):
        yield int(b[lo]), kind, pack(*(x[by[lo:hi]] for x in arrays))


def _table(rows, names=("block", "kind", "data")) -> pa.Table:
    rows = list(rows)
    kinds = [pa.int32()] * (len(names) - 1) + [pa.binary()]
    return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, kinds, strict=True))})


def repeats(docs: DataFrame, length: int = LENGTH, block_bytes: int = 6_000_000, shard_bytes: int = 6_000_000, piece_bytes: int = 1_000_000) -> tuple[DataFrame, int, DataFrame]:
    """Of rowed() docs, the texts by block and, packed by block, the spans to remove: (docs, number of blocks, spans)."""
    if not K < length <= LONGEST:
        raise ValueError(f"length is from {K + 1} to {LONGEST}")
    total = text_bytes(docs)
    n_blocks, n_shards, n_cores = parts(total, block_bytes), parts(total, shard_bytes), parts(total, shard_bytes // 4)
    wide, half = length - K, (length - K + 1) // 2

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors to shards; what a batch alone shows to be repeated goes along."""
        lean()
        n = 0
        held: list[tuple] = []
        size = 0

        def sent() -> pa.RecordBatch:
            nonlocal n
            h, c, place, left, right, doc = (np.concatenate([x[k] for x in held]) for k in range(6))
            order, first = _first_of((doc, place), (h, c))
            gone = order[_later(order, first, doc, place)]
            spans = _merged(doc[gone], (place - left)[gone], (place + K + right)[gone])
            keep = order[first]
            h, c, doc, place, left, right = (x[keep] for x in (h, c, doc, place, left, right))
            at = cuts(h, n_shards)
            n += 1
            rows = []
            for k in range(n_shards):
                s = slice(at[k], at[k + 1])
                own = spans if k == n % n_shards else [x[:0] for x in spans]
                if s.stop > s.start or len(own[0]):
                    arrays = (h[s], c[s], doc[s], place[s], left[s], right[s], *own)
                    rows.append((k, pack(*(x.astype(t) for x, t in zip(arrays, _KINDS + _SPANS, strict=True)))))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "data"])

        for b in batches:
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                found = anchors(data, length)
                held.append((*found, np.full(len(found[0]), doc.as_py(), np.int64)))
                size += len(data)
                if size >= block_bytes:
                    yield sent()
                    held, size = [], 0
        if held:
            yield sent()

    def settle(key, t):
        """Of a shard of anchors: spans of later copies, and the surroundings that differ."""
        lean()
        got = [unpack(x.as_py(), *_KINDS, *_SPANS) for x in t.column("data")]
        h, c, doc, place, left, right = (np.concatenate([g[k] for g in got]) for k in range(6))
        by = np.argsort(h, kind="stable")
        s = h[by]
        twice = np.zeros(len(s), bool)
        twice[1:] = s[1:] == s[:-1]
        twice[:-1] |= twice[1:].copy()
        h, c, doc, place, left, right = (x[by[twice]] for x in (h, c, doc, place, left, right))
        place, left, right = (x.astype(np.int64) for x in (place, left, right))
        order, first = _first_of((doc, place), (h, c))
        gone = order[_later(order, first, doc, place)]
        spans = [np.concatenate(x) for x in zip((doc[gone], place[gone] - left[gone], place[gone] + K + right[gone]), *(g[6:] for g in got), strict=True)]
        doc_, start, end = _merged(*spans)
        rows = list(_rows(block_of(doc_, n_blocks), 0, doc_, start.astype(np.uint32), end.astype(np.uint32)))
        heads = order[first]
        hh = h[heads]
        more = np.zeros(len(hh), bool)  # anchors with two surroundings or more
        more[1:] = hh[1:] == hh[:-1]
        more[:-1] |= more[1:].copy()
        heads = heads[more]
        rows += _rows(block_of(doc[heads], n_blocks), 1, h[heads], doc[heads], place[heads].astype(np.uint32))
        return _table(rows)

    def cut(key, texts, asked):
        """The pieces around the anchors asked for, by the shard of what they have in common."""
        lean()
        of = {d: x for d, x in zip(texts.column("doc").to_pylist(), texts.column("text").to_pylist(), strict=True)}
        got = [unpack(x.as_py(), np.uint64, np.int64, np.uint32) for x in asked.column("data")]
        out: dict[int, list] = {}
        for _, docs_, places in got:
            by = np.argsort(docs_, kind="stable")
            last, data = None, b""
            for doc, place in zip(docs_[by].tolist(), places[by].tolist(), strict=True):
                if doc != last:
                    last, data = doc, (of.get(doc) or "").encode()
                for lo, hi, a, z in ((place - wide, place + K + half, place - half, place + K), (place - half, place + K + wide, place, place + K + half)):
                    if a >= 0 and z <= len(data):
                        lo, hi = max(lo, 0), min(hi, len(data))
                        if hi - lo >= length:
                            core = xxhash.xxh3_64_intdigest(data[a:z])
                            out.setdefault(core * n_cores >> 64, []).append((core, doc, lo, data[lo:hi]))
        rows = []
        for k, x in out.items():
            sizes = np.array([len(p[3]) for p in x], np.uint16)
            rows.append((k, pack(np.array([p[0] for p in x], np.uint64), np.array([p[1] for p in x], np.int64), np.array([p[2] for p in x], np.uint32), sizes, np.frombuffer(b"".join(p[3] for p in x), np.uint8))))
        return _table(rows, ("shard", "data"))

    def compare(key, t):
        """Suffix arrays over the pieces that share their core."""
        lean()
        cores, docs_, starts, pieces = [], [], [], []
        for x in t.column("data"):
            core, doc, start, sizes, data = unpack(x.as_py(), np.uint64, np.int64, np.uint32, np.uint16, np.uint8)
            cores.append(core)
            docs_.append(doc)
            starts.append(start)
            raw, ends = data.tobytes(), np.cumsum(sizes.astype(np.int64))
            pieces += [raw[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        core, doc, start = np.concatenate(cores), np.concatenate(docs_), np.concatenate(starts).astype(np.int64)
        # equal pieces: the earliest stands for all, the others are repeats as a whole
        spans: list[tuple] = []
        kept: list[int] = []
        gone: list[int] = []
        head: tuple | None = None
        for c_, piece, d_, s_, k in sorted(zip(core.tolist(), pieces, doc.tolist(), start.tolist(), range(len(pieces)), strict=True)):
            if head and head[0] == c_ and head[1] == piece:
                if (d_, s_) != head[2:]:
                    gone.append(k)
            else:
                head = (c_, piece, d_, s_)
                kept.append(k)
        if gone:
            g = np.array(gone)
            spans.append((doc[g], start[g], start[g] + np.array([len(pieces[k]) for k in gone])))
        kept_ = np.array(kept)
        c = core[kept_]
        several = np.zeros(len(c), bool)
        several[1:] = c[1:] == c[:-1]
        several[:-1] |= several[1:].copy()
        kept_, c = kept_[several], c[several]
        at = 0
        while at < len(kept_):  # whole cores, of about piece_bytes together
            size, to = 0, at
            while to < len(kept_) and (size < piece_bytes or c[to] == c[to - 1]):
                size += len(pieces[kept_[to]])
                to += 1
            part = kept_[at:to]
            spans += _repeats([pieces[k] for k in part], doc[part], start[part], length)
            at = to
        if not spans:
            return _table([])
        doc_, lo, hi = _merged(*(np.concatenate([s[k] for s in spans]) for k in range(3)))
        return _table(_rows(block_of(doc_, n_blocks), 0, doc_, lo.astype(np.uint32), hi.astype(np.uint32)))

    d = docs.select(F.col("__row").alias("doc"), "text", doc_long().alias("id"))
    found = d.select("doc", "text").mapInArrow(find, "shard int, data binary").groupBy("shard").applyInArrow(settle, "block int, kind int, data binary")
    found = stash(found, "spans")
    d = d.withColumn("block", block(F.col("doc"), n_blocks))
    # all columns of d, as in _removed(), so that texts are shuffled once
    pieces = d.groupBy("block").cogroup(found.where("kind = 1").groupBy("block")).applyInArrow(cut, "shard int, data binary")
    more = pieces.groupBy("shard").applyInArrow(compare, "block int, kind int, data binary")
    return d, n_blocks, found.where("kind = 0").unionByName(more).select("block", "data")


def remove(docs: DataFrame, length: int = LENGTH, as_text: bool = False, **sizes) -> DataFrame:
    """Takes doc_id (a whole number) and text.

    Returns a row per row of docs: doc (doc_id; NO_ID for null), n_bytes,
    n_removed, n_spans (maximal removed runs) and kept (binary, the other bytes; with
    as_text a string, without the rests of characters that were cut in two).

    Null or empty text: 0 bytes.  A null id comes before all others.  Rows that
    repeat an id are documents of their own, in the order of their texts' SHA-256.
    No rows: no rows.  length is from 33 to 16,000 bytes, else a ValueError.
    """
    return _removed(rowed(docs.select("doc_id", "text")), length, as_text, **sizes).drop("row")


def _removed(docs: DataFrame, length: int, as_text: bool, **sizes) -> DataFrame:
    """remove() of rowed() docs, and the row."""
    d, _, spans = repeats(docs, length, **sizes)

    def finish(key, texts, found):
        lean()
        got = [unpack(x.as_py(), *_SPANS) for x in found.column("data")]
        if got:
            doc, start, end = _merged(*(np.concatenate([g[k] for g in got]) for k in range(3)))
        else:
            doc, start, end = (np.zeros(0, np.int64),) * 3
        rows: list[tuple] = []
        for row, ident, text in zip(texts.column("doc").to_pylist(), texts.column("id").to_pylist(), texts.column("text"), strict=True):
            data = (text.as_py() or "").encode()
            a, z = np.searchsorted(doc, row), np.searchsorted(doc, row, "right")
            at, parts_, n = 0, [], 0
            for s, e in zip(start[a:z].tolist(), end[a:z].tolist(), strict=True):
                e = min(e, len(data))
                if s < e:
                    parts_.append(data[at:s])
                    at = e
                    n += 1
            kept = b"".join([*parts_, data[at:]])
            rows.append((row, ident, len(data), len(data) - len(kept), n, kept.decode("utf-8", "ignore") if as_text else kept))
        kinds = {"row": pa.int64(), "doc": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.string() if as_text else pa.binary()}
        return pa.table({x: pa.array([r[k] for r in rows], t) for k, (x, t) in enumerate(kinds.items())})

    return d.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(finish, f"row long, doc long, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}")


def rewritten(docs: DataFrame, length: int = LENGTH, **sizes) -> DataFrame:
    """docs, all columns, with repeats cut from text (characters cut in two go as a
    whole) and n_chars, if there is such a column, counted anew.  Rows whose text
    has no repeat are untouched."""
    rows = rowed(docs)
    cut = _removed(rows.select("__row", "doc_id", "text"), length, True, **sizes).where("n_removed > 0")
    changed = stash(cut.select(F.col("row").alias("__changed"), F.col("kept").alias("__new")), "cut")
    out = rows.join(changed, rows["__row"] == changed["__changed"], "left")
    new = changed["__new"]
    columns = []
    for c in docs.columns:
        if c.lower() == "text":
            columns.append(F.coalesce(new, rows[c]).alias(c))
        elif c.lower() == "n_chars":
            columns.append(F.when(new.isNotNull(), F.char_length(new)).otherwise(rows[c]).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(rows[c])
    return out.select(*columns)


__all__ = ["LENGTH", "NO_ID", "anchors", "common_prefixes", "remove", "repeats", "rewritten", "shard_of", "suffix_order"]
