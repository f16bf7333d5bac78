"""Spelling variants: words one edit apart, found by intersecting automata with tries.

Distinct words lie in sorted shards, each a compact trie: nodes in breadth-first order, so that a node's children are
neighbours, and a word's tail isn't spelled out once it is the only one left.  A word's distance-one Levenshtein automaton is run
through a trie depth first: along the word's own path, at each place every branch that leaves it is the one
edit (replaced, inserted or deleted), behind which the rest must match to the end.  A pair's edit is put at the first place where the two
differ, so that each neighbour is met once.

An edit lies in a word's first half or behind it.  Behind it, the neighbour shares the first half, so that only shards of words that
begin so can accept it; before, it shares the end, and likewise only few shards of the reversed words can.  All
others die at their root and aren't entered.  So each word meets about two shards, however many there are.

Scale: tries that together stay under a checked size are broadcast, and words are searched where they lie.  Beyond it, words are
dealt to the shards that they can enter; a shard has a bounded number of words.  Only counts and the best form of each word and shard travel.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from math import ceil, log2, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exchange import pack, unpack
from .shared import stash

#: Fixed values of the contract: letters of a word, its least length and count, the slips' divisor and what a form must have of a word's count.
FIRST_LETTER, LAST_LETTER, LEAST_LENGTH, LEAST_COUNT, SLIPS, RATIO = 0xC0, 0xFF, 7, 2, 31, 10
#: Words of a shard; bytes of all tries up to which they are broadcast.
SHARD_WORDS, BROADCAST_BYTES = 50_000, 24_000_000
#: Distinct words that a task counts before it sends them on.
COUNTED = 200_000
#: Characters of a shard's bounds.
BOUND = 64

# A-Z lower-cased, other letters for themselves, all else a blank; a text is encoded in Latin-1 first, with ? for what that lacks
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or FIRST_LETTER <= b <= LAST_LETTER else 32 for b in range(256))


def words_of(text: str | None, ident: str, slips: int = SLIPS) -> list[bytes]:
    """The words of a text in Latin-1.  Where `slips` (0: never) divides the CRC-32 of ident:word, a letter that it chooses is left out."""
    if not text:
        return []
    words = text.encode("latin-1", "replace").translate(_LETTERS).split()
    if slips:
        begun = zlib.crc32(f"{ident}:".encode())
        if text.isascii():
            h = [zlib.crc32(w, begun) for w in words]
        else:
            h = [zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), begun) for w in words]
        for k in np.flatnonzero(np.array(h, np.int64) % slips == 0).tolist():
            w, at = words[k], h[k] % len(words[k])
            words[k] = w[:at] + w[at + 1 :]
    return words


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slips: int = SLIPS) -> DataFrame:
    """(word, n) of the words of docs (doc_id, text) with that length and count.  Tasks count before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array(list(held), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([w.as_py().decode("latin-1") for w in words], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for ident, text in zip(batch.column(0), batch.column(1), strict=True):
                held.update([w for w in words_of(text.as_py(), ident.as_py(), slips) if len(w) >= least_length])
                if len(held) >= COUNTED:
                    yield out()
                    held.clear()
        if held:
            yield out()

    named = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("ident"), "text")
    return named.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Trie:
    """Sorted distinct words in Latin-1 with their counts.

    labels[v] leads to node v, whose children are first[v] to first[v + 1] - 1; word[v] is one more than the word that ends in v, or
    than the only word below v, which then has no children.  0 stands for no word.
    """

    __slots__ = ("counts", "first", "labels", "offsets", "texts", "word")

    def __init__(self, words: list[bytes], counts):
        self.offsets = array("q", np.cumsum([0, *map(len, words)]).tolist())
        self.texts, self.counts = b"".join(words), array("q", counts)
        labels, first, word = bytearray(b"\0"), array("q", [1]), array("q")
        open_ = [(0, len(words), 0)]
        for lo, hi, depth in open_:  # grows while it is gone through: breadth first
            if hi - lo < 2:
                word.append(hi)
            else:
                at = lo + (len(words[lo]) == depth)
                word.append(at if at > lo else 0)
                while at < hi:
                    c, start = words[at][depth], at
                    while at < hi and words[at][depth] == c:
                        at += 1
                    labels.append(c)
                    open_.append((start, at, depth + 1))
            first.append(len(labels))
        self.labels, self.first, self.word = bytes(labels), first, word

    def packed(self) -> bytes:
        small = lambda x: np.array(x, np.int64).astype(np.uint32)
        return pack(np.frombuffer(self.labels, np.uint8), small(self.first), small(self.word), np.frombuffer(self.texts, np.uint8), small(self.offsets), np.array(self.counts, np.int64))

    @classmethod
    def unpacked(cls, data: bytes) -> Trie:
        self = cls.__new__(cls)
        labels, first, word, texts, offsets, counts = unpack(data, np.uint8, np.uint32, np.uint32, np.uint8, np.uint32, np.int64)
        wide = lambda x, kind: array(kind, x.tobytes())
        self.labels, self.texts = labels.tobytes(), texts.tobytes()
        self.first, self.word, self.offsets, self.counts = wide(first, "I"), wide(word, "I"), wide(offsets, "I"), wide(counts, "q")
        return self

    def text(self, k: int) -> bytes:
        return self.texts[self.offsets[k] : self.offsets[k + 1]]

    def _rest(self, v: int, depth: int, w: bytes, at: int) -> int:
        """The word below v whose letters from depth on are w's from `at` on; -1 for none."""
        first, labels = self.first, self.labels
        while True:
            lo, hi = first[v], first[v + 1]
            if lo == hi:
                k = self.word[v] - 1
                return k if k >= 0 and self.text(k)[depth:] == w[at:] else -1
            if at == len(w):
                return self.word[v] - 1
            v = labels.find(w[at], lo, hi)
            if v < 0:
                return -1
            depth, at = depth + 1, at + 1

    def near(self, w: bytes, start: int) -> list[int]:
        """The words one edit from w that first differ from it at `start` or behind: w's automaton, depth first."""
        first, labels, rest = self.first, self.labels, self._rest
        out: list[int] = []
        v, d, size = 0, 0, len(w)
        while True:
            lo, hi = first[v], first[v + 1]
            if lo == hi:  # one word is left
                k = self.word[v] - 1
                if k >= 0 and _one_apart(w, self.text(k), d, start):
                    out.append(k)
                return out
            own = w[d] if d < size else -1
            if d >= start:
                if d == size - 1 and self.word[v]:
                    out.append(self.word[v] - 1)  # the last letter deleted
                after = w[d + 1] if d + 1 < size else -1
                for e in range(lo, hi):
                    c = labels[e]
                    if c == own:
                        continue
                    if d < size and (k := rest(e, d + 1, w, d + 1)) >= 0:
                        out.append(k)  # replaced
                    if (k := rest(e, d + 1, w, d)) >= 0:
                        out.append(k)  # inserted
                    if c == after and (k := rest(e, d + 1, w, d + 2)) >= 0:
                        out.append(k)  # deleted
            if d == size:
                return out
            v = labels.find(own, lo, hi)
            if v < 0:
                return out
            d += 1


def _one_apart(w: bytes, x: bytes, same: int, start: int) -> bool:
    """w and x, of which the first `same` letters agree, are one edit apart and agree up to `start`."""
    most = min(len(w), len(x))
    p = same
    while p < most and w[p] == x[p]:
        p += 1
    if p < start:
        return False
    if len(w) == len(x):
        return p < most and w[p + 1 :] == x[p + 1 :]
    return abs(len(w) - len(x)) == 1 and (w[p + 1 :] == x[p:] if len(w) > len(x) else w[p:] == x[p + 1 :])


def searched(trie: Trie, word: bytes, n: int, back: bool) -> tuple[int, int, bytes | None]:
    """How many neighbours of word the trie accepts, and the count and text of the best; back: of those that share the word's end but
    not its first half, in a trie of reversed words."""
    half = len(word) // 2
    w = word[::-1] if back else word
    found = trie.near(w, len(w) - half if back else half)
    if back:
        head = w[len(w) - half :]
        found = [k for k in found if not trie.text(k).endswith(head)]
    if not found:
        return 0, 0, None
    most = max(trie.counts[k] for k in found)
    texts = [trie.text(k) for k in found if trie.counts[k] == most]
    return len(found), most, min(x[::-1] for x in texts) if back else min(texts)


def shards(words: DataFrame, back: bool, size: int = SHARD_WORDS) -> DataFrame:
    """(shard, back, lo, hi, n_words, trie): words, or reversed words, in ranges of about `size`, each a packed trie."""
    key = F.reverse("word") if back else F.col("word")
    n = max(1, ceil(words.count() / size))
    dealt = words.select(key.alias("word"), "n").repartitionByRange(n, "word").sortWithinPartitions("word").withColumn("part", F.spark_partition_id())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        counts: list[int] = []
        part = None

        def out() -> pa.RecordBatch:
            text = lambda x: x[:BOUND].decode("latin-1")
            row = (part, back, text(held[0]), text(held[-1]), len(held), Trie(held, counts).packed())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], ["part", "back", "lo", "hi", "n_words", "trie"])

        for b in batches:  # sorted; a range may hold more than its share, a trie doesn't
            for w, c, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if len(held) >= 2 * size:
                    yield out()
                    held, counts = [], []
                held.append(w.encode("latin-1"))
                counts.append(c)
                part = p
        if held:
            yield out()

    return dealt.mapInArrow(build, "part int, back boolean, lo string, hi string, n_words long, trie binary")


class Bounds:
    """Which shards a word can enter."""

    def __init__(self, rows: list):
        """rows: (lo, hi, shard) of one direction, in the order of lo."""
        self.lo, self.hi, self.shard = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]

    def of(self, prefix: str) -> list[int]:
        """Shards that can hold words with this prefix.  Bounds are cut off, so they are compared as far as they go."""
        p = prefix[:BOUND]
        # all before the first whose last word reaches p end before it; all from the first that begins behind p's words on can't
        return self.shard[bisect_left(self.hi, p) : bisect_right(self.lo, p + "￿")]


def near_counts(spark: SparkSession, words: DataFrame, shard_words: int = SHARD_WORDS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(word, n, n_near, form_n, form) of a written table (word, n) of distinct words: how many are one edit away, and the most
    frequent of them (ties: the first by code points), null where there is none."""
    both = shards(words, False, shard_words).unionByName(shards(words, True, shard_words))
    tries = stash(both.withColumn("shard", F.monotonically_increasing_id()), "tries")
    rows = tries.select("back", "lo", "hi", "shard", F.octet_length("trie").alias("size")).orderBy("lo", "hi").collect()  # a row a shard
    bounds = {back: Bounds([(r.lo, r.hi, r.shard) for r in rows if r.back == back]) for back in (False, True)}
    schema = "word string, n long, n_near long, form_n long, form string"
    names = ["word", "n", "n_near", "form_n", "form"]

    def batch(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate(kinds)], names)

    def row(trie: Trie, word: str, n: int, back: bool) -> tuple | None:
        near, most, form = searched(trie, word.encode("latin-1"), n, back)
        return (word, n, near, most, form.decode("latin-1")) if near else None if back else (word, n, 0, None, None)

    def entered(word: str) -> list[tuple[bool, int]]:
        half = len(word) // 2
        return [(False, s) for s in bounds[False].of(word[:half])] + [(True, s) for s in bounds[True].of(word[half:][::-1])]

    if sum(r.size for r in rows) <= broadcast_bytes:
        sent = spark.sparkContext.broadcast({r.shard: bytes(r.trie) for r in tries.select("shard", "trie").collect()})
        opened: dict[int, Trie] = {}

        def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = []
                for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for back, s in entered(word):
                        if s not in opened:
                            opened[s] = Trie.unpacked(sent.value[s])
                        found.append(row(opened[s], word, n, back))
                yield batch([x for x in found if x])

        found = words.select("word", "n").mapInArrow(here, schema)
    else:

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [(s, word, n, back) for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for back, s in entered(word)]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.bool_()))], ["shard", "word", "n", "back"])

        def answer(asked: pa.Table, data: pa.Table) -> pa.Table:
            trie = Trie.unpacked(data.column("trie")[0].as_py())
            each = zip(*(asked.column(c).to_pylist() for c in ("word", "n", "back")), strict=True)
            return pa.Table.from_batches([batch([x for x in (row(trie, *e) for e in each) if x])])

        asked = words.select("word", "n").mapInArrow(ask, "shard long, word string, n long, back boolean")
        found = asked.groupBy("shard").cogroup(tries.select("shard", "trie").groupBy("shard")).applyInArrow(answer, schema)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), "form")))
    return found.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form"))


def variants(words: DataFrame, ratio: int = RATIO, shard_words: int = SHARD_WORDS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Takes (word, n), words of Latin-1 characters; returns a row a word: word, n, n_near, form, form_n and root.

    The form is the most frequent near word (ties: the first by code points) if it is at least `ratio` times (above 1) as frequent; the root is where forms
    lead in the end, the word itself if it has no form.  Rows of one word count as one, with the sum of their n; null
    and empty words are left out.  No rows: no rows.
    """
    if ratio < 2:
        raise ValueError("ratio: 2 or more, so that forms end")
    one = words.where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))
    held = stash(one, "words")
    near = near_counts(words.sparkSession, held, shard_words, broadcast_bytes)
    has = F.col("form_n") >= ratio * F.col("n")
    near = stash(near.select("word", "n", "n_near", F.when(has, F.col("form")).alias("form"), F.when(has, F.col("form_n")).alias("form_n")), "near")
    most = held.agg(F.max("n")).first()[0]
    # a chain of forms multiplies n by ratio at each step, so that its length is known; each round doubles the way
    steps = int(log10(max(1, most or 1)) / log10(ratio)) + 1
    lead = near.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(ceil(log2(steps)) if steps > 1 else 0):
        further = lead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        lead = stash(lead.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return near.join(lead, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, ratio: int = RATIO, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slips: int = SLIPS, shard_words: int = SHARD_WORDS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """variants() of the words of docs (doc_id, text): runs of Latin letters, A-Z lower-cased, of least_length letters or more that
    occur least_count times or more, after the slips that words_of() makes.

    Null and empty texts have no words; a null id is an empty string.  Repeated rows count each.  No rows: no rows.
    """
    return variants(word_counts(docs, least_length, least_count, slips), ratio, shard_words, broadcast_bytes)
