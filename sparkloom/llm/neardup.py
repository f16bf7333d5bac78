"""Near-duplicate documents with SetSketch registers.

A document is the set of its 5-word shingles (64-bit hashes).  Register i of a
sketch is floor(1 - log_b(x)), cut to [0, q + 1], of the least of exponential
variates x_i over the set: minima on an exponentially spaced scale, of which
the maximum of two sketches is the sketch of the union, and which agree with
about the Jaccard similarity as probability.  Bands of registers find
candidates; the joint likelihood of a pair's greater, lesser and equal
registers estimates its similarity.  A bitmap of parities, in which each element
flips one bit, bounds the symmetric difference of two sets from below, so that it
rules out only pairs under the threshold.  What is left is confirmed on full sets.

Scale.  Copies (equal sets) are folded by a fingerprint first.  In a bucket, all
members are paired with the least one; links found make components; only
members of a bucket that are still in different components are compared further,
by pairs of cells of bounded size that any task can take, and only pairs whose
estimate comes near the threshold leave them.  So a group of copies or near copies
costs as many pairs as members, while no link between different components goes
unchecked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .exchange import lean, rowed
from .shared import stash

SHINGLE = 5
BANDS, ROWS = 30, 5
M = BANDS * ROWS
#: Bits of the bitmap of parities.
PARITY = 2048
#: SetSketch parameters: base, rate and the largest register less 1.
B, A, Q = 1.001, 20.0, 65534
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIERS = np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, M, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, span: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles: of `span` words each, A-Z
    lower-cased; of a shorter text the whole sequence; of none, nothing."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z, and \x20 \x09-\x0D
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - span + 1)
    k = min(span, len(words))
    g = np.full(n, k, np.uint64)
    for j in range(k):
        g = g * _MIX + h[j : j + n]
    return np.unique(_mixed(g))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The M registers of a set of hashes; all 0 for the empty set."""
    if not len(hashes):
        return np.zeros(M, np.uint16)
    low = np.full(M, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 256):
        np.minimum(low, (hashes[at : at + 256, None] * _MULTIPLIERS).min(0), out=low)
    x = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**64) / A
    return np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, Q + 1).astype(np.uint16)


def parities(hashes: np.ndarray) -> np.ndarray:
    """PARITY bits as 64-bit words; each element flips the bit of its leading bits."""
    odd = np.bincount((hashes >> np.uint64(64 - PARITY.bit_length() + 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def possible(n1: np.ndarray, n2: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether pairs with these set sizes and parities can have 100 * intersection >= percent * union.

    With a symmetric difference d this means d * (100 + percent) <= (n1 + n2) * (100 - percent);
    d is no less than the bits that differ, nor than the difference of the sizes.
    """
    d = np.maximum(np.bitwise_count(x ^ y).sum(-1, dtype=np.int64), np.abs(n1 - n2))
    return d * (100 + percent) <= (n1 + n2) * (100 - percent)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def estimate(n1: np.ndarray, n2: np.ndarray, greater: np.ndarray, lesser: np.ndarray, grid: int = 200) -> np.ndarray:
    """Similarities by joint likelihood, of pairs with known set sizes and so many
    registers that are greater and lesser in the first; the rest are equal."""
    if len(n1) > 1024:  # bounded memory
        return np.concatenate([estimate(*(x[k : k + 1024] for x in (n1, n2, greater, lesser)), grid) for k in range(0, len(n1), 1024)])
    n1, n2 = n1.astype(float), n2.astype(float)
    u, v = (n1 / (n1 + n2))[:, None], (n2 / (n1 + n2))[:, None]
    j = np.linspace(0, 1, grid)[None, :] * np.minimum(u / v, v / u) * (1 - 1e-9)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)

    up, down = p(u - v * j), p(v - u * j)
    eps = 1e-12
    like = greater[:, None] * np.log(up + eps) + lesser[:, None] * np.log(down + eps) + (M - greater - lesser)[:, None] * np.log(np.maximum(1 - up - down, eps))
    return np.take_along_axis(j, like.argmax(1)[:, None], 1)[:, 0]


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n, print, registers, parities) of every row of docs; print is null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                ns, prints, regs, odd = [], [], [], []
                for text in b.column(1):
                    s = shingles(text.as_py())
                    ns.append(len(s))
                    prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    regs.append(sketch(s).tobytes())
                    odd.append(parities(s).tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), *(pa.array(x, pa.binary()) for x in (prints, regs, odd))], ["doc_id", "n", "print", "registers", "parities"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, print binary, registers binary, parities binary")


def bands(reps: DataFrame) -> DataFrame:
    """(bucket, rep) for every band of every sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                regs = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
                key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), regs.shape[:2]).copy()
                for k in range(ROWS):
                    key = _mixed(key * _MIX + regs[:, :, k])
                rep = pa.array(np.repeat(np.asarray(b.column(0)), BANDS))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), rep], ["bucket", "rep"])

    return reps.select("rep", "registers").mapInArrow(run, "bucket long, rep long")


def likely(pairs: DataFrame, reps: DataFrame, percent: int, least: float) -> DataFrame:
    """The pairs (a, b) that can be links and whose estimated similarity is at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n1, n2 = b.column(2).to_numpy(), b.column(3).to_numpy()
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(-1, M) for k in (4, 5))
            p, q = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint64).reshape(-1, PARITY // 64) for k in (6, 7))
            at = np.flatnonzero(possible(n1, n2, p, q, percent))
            x, y = x[at], y[at]
            at = pa.array(at[estimate(n1[at], n2[at], (x > y).sum(1), (x < y).sum(1)) >= least])
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["a", "b"])

    one = reps.select(F.col("rep").alias("a"), F.col("n").alias("n1"), F.col("registers").alias("r1"), F.col("parities").alias("p1"))
    two = reps.select(F.col("rep").alias("b"), F.col("n").alias("n2"), F.col("registers").alias("r2"), F.col("parities").alias("p2"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "n1", "n2", "r1", "r2", "p1", "p2").mapInArrow(run, "a long, b long")


def confirm(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union, on full sets.  The
    sets are intersected row by row in the JVM: two sets at a time, however long."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py()).view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))], ["rep", "hashes"])

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(wanted, "rep", "left_semi")
    full = stash(texts.mapInArrow(sets, "rep long, hashes array<long>"), "sets")
    one = full.select(F.col("rep").alias("a"), F.col("hashes").alias("x"))
    two = full.select(F.col("rep").alias("b"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    j = pairs.join(one, "a").join(two, "b").select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("sizes"))
    return j.where(100 * F.col("both") >= percent * (F.col("sizes") - F.col("both"))).select("a", "b").distinct()


def cells(members: DataFrame, cell: int) -> DataFrame:
    """members with low, high and `second`: the members of a bucket of more than `cell` are dealt to cells of about that size by their
    component, and each goes to every pair (low, high) of cells that its own is part of, but for pairs within one component; second tells the cell of the two.

    A component of more than `cell` members has cells of its own, to which they are dealt by their hash; smaller ones share cells in order. Any
    two members of a bucket in different components meet in one pair of cells, whose size is bounded. So a bucket that is one
    component but for a few members sends its members about once for each cell of these few.
    """
    counts = members.groupBy("bucket", "component").agg(F.count("*").alias("n_"))
    size = counts.groupBy("bucket").agg(F.sum("n_").alias("size")).where(F.col("size") > cell).select("bucket")
    large = F.col("n_") > cell
    counts = counts.join(size, "bucket").withColumn("own_cells", F.when(large, F.ceil(F.col("n_") / cell)).otherwise(0).cast("int")).withColumn("small", F.when(large, 0).otherwise(F.col("n_")))
    order = Window.partitionBy("bucket").orderBy(large.desc(), "component")
    whole = Window.partitionBy("bucket")
    # cells of large components first, each its own; behind them those that small ones fill in order
    before = F.sum("own_cells").over(order) - F.col("own_cells")
    begun = F.sum("own_cells").over(whole) + F.floor((F.sum("small").over(order) - F.col("small")) / cell)
    placed = counts.withColumn("base", F.when(large, before).otherwise(begun).cast("int"))
    placed = placed.withColumn("cells", F.max(F.col("base") + F.greatest("own_cells", F.lit(1))).over(whole).cast("int"))
    dealt = members.join(placed.select("bucket", "component", "own_cells", "base", "cells"), ["bucket", "component"], "left")
    within = F.when(F.col("own_cells") > 0, F.pmod(F.xxhash64("rep"), F.col("own_cells"))).otherwise(0)
    dealt = dealt.withColumn("own", (F.coalesce("base", F.lit(0)) + F.coalesce(within, F.lit(0))).cast("int"))
    others = F.sequence(F.lit(0), F.coalesce("cells", F.lit(1)) - 1)
    apart = F.filter(others, lambda k: (F.coalesce("own_cells", F.lit(0)) == 0) | (k < F.col("base")) | (k >= F.col("base") + F.col("own_cells")))
    each = dealt.withColumn("other", F.explode(apart))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return each.select(*members.columns, low.alias("low"), high.alias("high"), (F.col("own") > F.col("other")).alias("second"))


def across(members: DataFrame, percent: int, least: float, cell: int = 2048) -> DataFrame:
    """(bucket, rep, component, n, registers, parities) to the pairs (a, b) that share a
    bucket but no component, can be links, and whose estimate is at least `least`.
    Pairs of cells of a bucket are streamed, so a task holds two cells at a time and a
    hot bucket is spread over all tasks; few pairs leave, for those that pass are
    nearly all links between components."""

    def pairs(one: tuple, two: tuple | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Within one cell if two is None, else between cells."""
        step = 128
        one = tuple(x[np.argsort(one[1], kind="stable")] for x in one)
        two_ = one if two is None else tuple(x[np.argsort(two[1], kind="stable")] for x in two)
        rep, comp, n, regs, odd = one
        rep_, comp_, n_, regs_, odd_ = two_
        for i in range(0, len(rep), step):
            for j in range(i if two is None else 0, len(rep_), step):
                c, c_ = comp[i : i + step], comp_[j : j + step]
                if c[0] == c[-1] == c_[0] == c_[-1]:
                    continue  # one component, as they are in order
                p, q = np.nonzero(c[:, None] != c_[None, :])
                if two is None and i == j:
                    p, q = p[p < q], q[p < q]
                p, q = p + i, q + j
                if len(p):
                    good = possible(n[p], n_[q], odd[p], odd_[q], percent)
                    p, q = p[good], q[good]
                if len(p):
                    x, y = regs[p], regs_[q]
                    good = estimate(n[p], n_[q], (x > y).sum(1), (x < y).sum(1)) >= least
                    a, b = rep[p[good]], rep_[q[good]]
                    yield np.minimum(a, b), np.maximum(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held: tuple[list, list] = ([], [])
        now = None

        def arrays(rows: list) -> tuple:
            rep, comp, n, regs, odd = zip(*rows, strict=True)
            regs, odd = np.frombuffer(b"".join(regs), np.uint16), np.frombuffer(b"".join(odd), np.uint64)
            return np.array(rep), np.array(comp), np.array(n), regs.reshape(-1, M), odd.reshape(-1, PARITY // 64)

        def closed() -> Iterator[pa.RecordBatch]:
            if now[1] == now[2]:
                found = pairs(arrays(held[0]), None)
            elif held[0] and held[1]:
                found = pairs(arrays(held[0]), arrays(held[1]))
            else:
                return
            for a, b in found:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for bucket, low, high, second, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, low, high) != now:
                    if now:
                        yield from closed()
                    held, now = ([], []), (bucket, low, high)
                held[second].append(row)
        if now:
            yield from closed()

    key = ["bucket", "low", "high"]
    dealt = cells(members, cell).select(*key, "second", "rep", "component", "n", "registers", "parities")
    return dealt.repartition(*key).sortWithinPartitions(*key, "rep").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, slack: float = 0.15, cell: int = 2048) -> DataFrame:
    """Takes doc_id (a whole number) and text.

    Returns a row per row of docs: doc_id, n_shingles, component_id (the smallest
    doc_id reachable over links, itself included) and kept (doc_id = component_id).
    Documents are linked if 100 * intersection >= percent * union of their sets.
    A pair of that similarity shares no band with probability under 3e-8; pairs
    whose estimate is more than `slack` (over four standard deviations) below are dropped.
    Buckets of more than `cell` members are compared by cells of about that size.

    Null or empty text, or no words: an empty set, linked with nothing.  A null
    id: linked with nothing, component null, kept.  Rows that repeat an id share its
    component.  No rows: no rows.
    """
    least = percent / 100 - slack
    all_ = stash(sketches(docs), "sketches")
    usable = all_.where(F.col("print").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "n", "print", "registers", "parities")
    # one document of each set stands for its copies
    reps = usable.groupBy("print").agg(F.min(F.struct("doc_id", "n", "registers", "parities")).alias("r"))
    reps = stash(reps.select("print", F.col("r.doc_id").alias("rep"), F.col("r.n").alias("n"), F.col("r.registers").alias("registers"), F.col("r.parities").alias("parities")), "reps")
    spread = bands(reps)
    shared = spread.groupBy("bucket").agg(F.min("rep").alias("first"), F.count("*").alias("members")).where("members > 1")
    buckets = stash(spread.join(shared, "bucket"), "buckets")
    stars = buckets.where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b")).distinct()
    tried = stash(likely(stars, reps, percent, least), "tried")
    links = stash(confirm(tried, docs, percent), "links")
    first = connected_components(links)
    named = buckets.where("members > 2").join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    torn = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket")
    open_ = named.join(torn, "bucket", "left_semi").join(reps.select("rep", "n", "registers", "parities"), "rep")
    rest = stash(across(open_, percent, least, cell).join(tried, ["a", "b"], "left_anti"), "rest")
    more = stash(confirm(rest, docs, percent), "links")
    # components of components: what the first pass settled is not walked again
    name = first.withColumnRenamed("component", "c")
    up = more.join(name.withColumnRenamed("node", "a"), "a", "left").withColumn("a", F.coalesce("c", "a")).drop("c")
    up = up.join(name.withColumnRenamed("node", "b"), "b", "left").withColumn("b", F.coalesce("c", "b")).select("a", "b")
    joined = connected_components(up).withColumnRenamed("node", "c").withColumnRenamed("component", "top")
    whole = reps.select("print", "rep").join(name.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("c", "rep"))
    whole = whole.join(joined, "c", "left").select(F.col("print").alias("print_"), F.coalesce("top", "c").alias("component"))
    of_id = stash(usable.select("doc_id", F.col("print").alias("print_")).join(whole, "print_").select("doc_id", "component"), "components")
    return _by_id(all_, of_id)


def _by_id(all_: DataFrame, of_id: DataFrame) -> DataFrame:
    """The least component of each id, beside every row."""
    kind = all_.schema["doc_id"].dataType
    least = of_id.groupBy(F.col("doc_id").alias("id_")).agg(F.min("component").alias("component"))
    out = all_.select("doc_id", F.col("n").alias("n_shingles")).join(least, F.col("doc_id") == F.col("id_"), "left")
    component = F.coalesce(F.col("component").cast(kind), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of docs, all columns, that stand for their component: one row of each,
    also where rows repeat an id or have none (a null id comes before all others)."""
    rows = rowed(docs)
    judged = near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"), percent)
    gone = stash(judged.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")), "gone")
    return rows.join(gone, rows["__row"] == gone["__gone"], "left_anti").select(*docs.columns)
