"""Vector similarity: top-k against all rows, pairs within groups, mean vectors."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import first_by

#: So many probe vectors travel to the executors at once.
PROBES_AT_ONCE = 20_000
#: Vectors of a block, and rows of a block that are multiplied at once: 8 MB of products.  What a product of matrices may be off.
BLOCK, ROWS_AT_ONCE, MARGIN = 2048, 512, 1e-9


def _unit(rows: list) -> np.ndarray:
    m = np.array(rows, np.float64)
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(n > 0, n, 1.0)


def top_similar(vectors: DataFrame, probes: DataFrame, k: int = 10, digits: int = 4, least: float | None = None) -> DataFrame:
    """(id, vector) twice to (probe, id, cosine, rank): each probe's k nearest others.

    Cosines in double precision, rounded before they are ranked; ties go to the
    smaller id.  Probes go out in chunks of bounded size, each against all
    vectors; a task keeps k rows a probe before the shuffle.
    """
    spark = vectors.sparkSession
    out = None
    last = None
    while True:
        chunk = probes if last is None else probes.where(F.col("id") > F.lit(last))
        rows = chunk.orderBy("id").limit(PROBES_AT_ONCE).collect()  # a bounded chunk
        if not rows:
            break
        last = rows[-1]["id"]
        held = spark.sparkContext.broadcast((np.array([r["id"] for r in rows], np.int64), _unit([r["vector"] for r in rows])))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, mine = held.value
            best: list[list[tuple]] = [[] for _ in names]
            for whole in batches:
                for at in range(0, whole.num_rows, 2048):
                    b = whole.slice(at, 2048)
                    ids = np.asarray(b.column(0))
                    cos = np.round(mine @ _unit(b.column(1).to_pylist()).T, digits) + 0.0
                    for p, row in enumerate(cos):
                        near = np.lexsort((ids, -row))[: k + 1]
                        best[p] = sorted([*best[p], *((-row[x], int(ids[x])) for x in near if ids[x] != names[p] and (least is None or row[x] >= least))])[:k]
            out = [(int(n), i, -c + 0.0) for n, x in zip(names, best, strict=True) for c, i in x]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["probe", "id", "cosine"])

        part = vectors.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(run, "probe long, id long, cosine double")
        out = part if out is None else out.unionAll(part)
        if len(rows) < PROBES_AT_ONCE:
            break
    if out is None:
        return spark.createDataFrame([], "probe long, id long, cosine double, rank long")
    from .relational import top_by

    return top_by(out, ["probe"], [F.desc("cosine"), F.col("id")], k).withColumn("rank", F.col("rank").cast("long"))


def _close(rows: pd.DataFrame, least: float, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and cosines of the pairs of a cell that reach `least`, nearly or surely.  A product of matrices finds them; their
    cosines are summed anew from the first number to the last, as scalar.dot does, so that both are the same to the bit."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    size = rows["vector"].map(len).to_numpy()
    side, ids = rows["side"].to_numpy(), rows["id"].to_numpy()
    for n in np.unique(size):  # vectors of different lengths have no cosine
        at = np.flatnonzero(size == n)
        m = np.stack(rows["vector"].to_numpy()[at]).astype(np.float64)
        length = np.sqrt(sum((m[:, d] * m[:, d] for d in range(n)), np.zeros(len(m))))
        length[length == 0] = 1.0
        unit, own = m / length[:, None], side[at[0]] == 2
        left, right = (np.flatnonzero(side[at] == (2 if own else k)) for k in (0, 1))
        for k in range(0, len(left), ROWS_AT_ONCE):
            one = left[k : k + ROWS_AT_ONCE]
            x, y = np.nonzero(~(unit[one] @ unit[right].T < least - margin))
            x, y = one[x], right[y]
            keep = ids[at[x]] < ids[at[y]] if own else ids[at[x]] != ids[at[y]]
            x, y = x[keep], y[keep]
            for j in range(0, len(x), 1 << 18):
                u, v = x[j : j + (1 << 18)], y[j : j + (1 << 18)]
                found.append((at[u], at[v], sum((m[u, d] * m[v, d] for d in range(n)), np.zeros(len(u))) / (length[u] * length[v])))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _cells(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, vector, _i, _j, side): the vectors of each group dealt to blocks of about BLOCK, and each block to the cells where it meets
    itself (side 2) and the others (side 0 the earlier block, 1 the later)."""
    blocks = vectors.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_n"))
    v = vectors.where("vector IS NOT NULL").join(blocks.hint("merge"), keys).withColumn("_b", F.pmod(F.xxhash64("id"), "_n").cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda o: F.struct(F.least("_b", o).alias("i"), F.greatest("_b", o).alias("j"), F.when(o == F.col("_b"), 2).when(F.col("_b") < o, 0).otherwise(1).alias("side")))
    return v.withColumn("_c", F.explode(others)).select(*keys, "id", "vector", F.col("_c.i").alias("_i"), F.col("_c.j").alias("_j"), F.col("_c.side").alias("side"))


def similar_pairs(vectors: DataFrame, keys: list[str], least: float, digits: int = 4) -> DataFrame:
    """(keys, id, vector) to (keys, a, b, cosine), a < b in one group, cosine of at least `least`.

    Groups are cut into blocks; two blocks meet in one task as matrices, so that a group of any size is in none.  All pairs
    are looked at: the time grows with the square of a group, and so may the rows.
    """
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in (*keys, "id")}

    margin = 10.0**-digits + MARGIN

    def run(key, rows):
        x, y, cos = _close(rows, least, margin)
        ids = rows["id"].to_numpy()
        a, b = np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])
        return pd.DataFrame({**dict(zip(keys, ([k] * len(x) for k in key), strict=False)), "a": a, "b": b, "cosine": cos})

    out = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"a {kinds['id']}", f"b {kinds['id']}", "cosine double"])
    near = _cells(vectors.select(*keys, "id", "vector"), keys).groupBy(*keys, "_i", "_j").applyInPandas(run, out)
    return near.withColumn("cosine", F.round("cosine", digits)).where(F.col("cosine") >= least)


def similar_forest(vectors: DataFrame, keys: list[str], least: float, digits: int = 4) -> DataFrame:
    """(keys, id, vector) to (a, b): pairs of similar_pairs() that connect what all of them connect.

    Of each two blocks that meet, only a spanning forest is given, fewer edges than they have vectors.
    """
    kind = vectors.schema["id"].dataType.simpleString()

    margin = 10.0**-digits + MARGIN

    def run(rows):
        x, y, cos = _close(rows, least, margin)
        ids, up, kept = rows["id"].to_numpy(), list(range(len(rows))), []
        # rounded as Spark does, halves up by the decimal digits; only cosines beside the limit need it
        unsure = np.abs(cos - least) < 2 * margin
        sure = cos >= least
        sure[unsure] = [float(Decimal(repr(float(c))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) >= least for c in cos[unsure]]

        def top(k: int) -> int:
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        for u, v in zip(x[sure].tolist(), y[sure].tolist(), strict=True):
            if (p := top(u)) != (q := top(v)):
                up[p] = q
                kept.append((ids[u], ids[v]))
        return pd.DataFrame(kept, columns=["a", "b"])

    cells = _cells(vectors.select(*keys, "id", "vector"), keys)
    return cells.groupBy(*keys, "_i", "_j").applyInPandas(run, f"a {kind}, b {kind}")


def mean_vectors(vectors: DataFrame, key: str) -> DataFrame:
    """(key, position, value): the mean vector of each key at unit length.  Sums by position, before the shuffle."""
    each = vectors.select(key, F.posexplode("vector").alias("position", "x")).groupBy(key, "position").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    length = each.groupBy(key).agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("length"))
    return each.join(length, key).select(key, "position", F.when(F.col("length") > 0, F.col("mean") / F.col("length")).otherwise(F.col("mean")).alias("value"))


__all__ = ["first_by", "mean_vectors", "similar_forest", "similar_pairs", "top_similar"]
