"""Mixing sources to target weights: a time-varying curriculum.

Every source has a weight schedule over the training run, t in [0, 1], given
as knots (t, weight) joined by straight lines.  Its integral is the source's
share of the mix; the inverse of the cumulated schedule turns "this document
starts after so many of its source's words" into a training position, and the
documents are range-sorted by it.  DataFrame functions only.

Scale: a source may hold a third of all rows, so nothing is ever windowed over
a whole source.  Rows are dealt by (source, first hex digits of the md5 of the
id); totals of these cells give every cell's offset, and only a cell is sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stash, word_count

Knots = Sequence[tuple[float, float]]

#: Production schedules; their integrals are 3, 1 and 2: web text fades out,
#: the small source fades in, the third stays level.
SCHEDULES: tuple[Knots, ...] = (((0.0, 4.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 2.0), (1.0, 2.0)))

#: What mixed_corpus() adds.
ADDED = ("mix_size", "mix_target", "mix_taken", "mix_passes", "mix_position")


def integral(knots: Knots) -> float:
    """Area below a schedule."""
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))


def _check(knots: Knots) -> None:
    times = [t for t, _ in knots]
    if len(knots) < 2 or times != sorted(set(times)) or times[0] != 0 or times[-1] != 1:
        raise ValueError("knots run from t=0 to t=1, in order")
    if any(w < 0 for _, w in knots) or integral(knots) <= 0:
        raise ValueError("weights are not negative and not all 0")


def _segments(knots: Knots) -> list[tuple[float, float, float, float]]:
    """(share of the integral below the segment, its start, its first weight, its slope), scaled to integral 1."""
    all_, below, out = integral(knots), 0.0, []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        out.append((below, t0, w0 / all_, (w1 - w0) / all_ / (t1 - t0)))
        below += (t1 - t0) * (w0 + w1) / 2 / all_
    return out


def targets(sizes: DataFrame, schedules: Sequence[Knots] = SCHEDULES, share: float = 1.5, max_passes: int = 2) -> DataFrame:
    """(source, source_size) to (source, source_size, target, sched).

    Sources in code point order, null last, take the schedules in turn.  The mix
    has share * all words; a target stops at max_passes * source_size, and what
    it leaves goes to the others by weight: with ratio = cap / weight, the level
    is the one at which sum(min(cap, level * weight)) is the mix.  A row a source.
    """
    for knots in schedules:
        _check(knots)
    weights = F.array(*(F.lit(integral(k)) for k in schedules))
    everything = Window.partitionBy()
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(schedules)
    s = sizes.withColumn("sched", place.cast("int")).withColumn("weight", F.element_at(weights, F.col("sched") + 1))
    s = s.withColumn("cap", F.lit(float(max_passes)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    s = s.withColumn("mix", F.lit(float(min(share, max_passes))) * F.sum("source_size").over(everything))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("caps", F.sum("cap").over(upto)).withColumn("free", F.sum("weight").over(everything) - F.sum("weight").over(upto))
    # the first source that isn't filled at its own ratio sets the level
    reached = F.col("caps") + F.col("ratio") * F.col("free") >= F.col("mix")
    own = F.when(reached, (F.col("mix") - (F.col("caps") - F.col("cap"))) / (F.col("free") + F.col("weight")))
    s = s.withColumn("own", own).withColumn("level", F.first("own", ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"), "sched")


def mix(docs: DataFrame, schedules: Sequence[Knots] = SCHEDULES, share: float = 1.5, max_passes: int = 2, carry: bool = False) -> DataFrame:
    """Takes columns doc_id, text and source; others are ignored.

    Returns a row per row of docs: doc_id, size, source, source_size, target,
    taken, position, pieces, and with `carry` the whole row as `row`.  `pieces` has (pass, words, position) for every
    time the document is taken; `position` is the first of these, null where
    nothing is taken.  Within a source, documents come in the order of the md5
    of their id, pass after pass, until the target is met; the document at the
    end of the target is taken as far as words are still owed.

    Null or empty text: size 0, nothing taken.  Null source: a source of its
    own, last.  Null id: ordered as the empty string.  Repeated rows are rows
    of their own; ties are ordered by size.  No rows: no rows.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    # `held` stands for the source in keys: it is never null
    held = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    row = [F.struct(*(docs[c] for c in docs.columns)).alias("row")] if carry else []
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"), held.alias("held"), *row)
    if not carry:
        sized = stash(sized, "sized")  # texts are read once
    sized = sized.withColumn("cell", F.substring("key", 1, 3)).repartition("held", "cell")
    cells = stash(sized.groupBy("held", "cell").agg(F.max("source").alias("cell_source"), F.sum("size").alias("cell_size")), "cells")
    offset = F.sum("cell_size").over(Window.partitionBy("held").orderBy("cell")) - F.col("cell_size")
    goals = targets(cells.groupBy("held").agg(F.max("cell_source").alias("source"), F.sum("cell_size").alias("source_size")).drop("held"), schedules, share, max_passes)
    goals = goals.withColumn("held", held).drop("source")
    plan = cells.select("held", "cell", offset.alias("offset")).join(goals, "held")
    within = Window.partitionBy("held", "cell").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    m = sized.withColumn("run", F.sum("size").over(within) - F.col("size")).join(plan, ["held", "cell"])
    m = m.withColumn("start", F.col("offset") + F.col("run")).withColumn("goal", F.floor("target").cast("long"))

    segments = F.array(*(F.array(*(F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(seg, ("below", "t0", "w0", "slope"), strict=True))) for seg in _segments(k))) for k in schedules))
    mine = F.element_at(segments, F.col("sched") + 1)

    def words(k: int):
        return F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("goal") - k * F.col("source_size") - F.col("start")))

    def position(k: int):
        share_of = (k * F.col("source_size") + F.col("start") + words(k) / 2) / F.col("target")
        seg = F.element_at(F.filter(mine, lambda x: x["below"] <= share_of), -1)
        rest = share_of - seg["below"]
        slow = seg["w0"] + F.sqrt(F.greatest(F.lit(0.0), seg["w0"] * seg["w0"] + 2 * seg["slope"] * rest))
        return seg["t0"] + F.when(slow > 0, 2 * rest / slow).otherwise(0.0)

    pieces = F.array(*(F.when(words(k) > 0, F.struct(F.lit(k).alias("pass"), words(k).alias("words"), position(k).alias("position"))) for k in range(max_passes)))
    m = m.withColumn("pieces", F.filter(pieces, lambda x: x.isNotNull()))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return m.select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"), F.get("pieces", F.lit(0))["position"].alias("position"), "pieces", *(["row"] if carry else []))


def in_order(mixed: DataFrame) -> DataFrame:
    """The mix range-sorted by first training position; what is not taken comes last."""
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def training_order(mixed: DataFrame) -> DataFrame:
    """Of mix(): (doc_id, pass, words, position), a row for every time that a document is taken, range-sorted by position."""
    each = mixed.select("doc_id", F.explode("pieces").alias("p"))
    return each.select("doc_id", "p.pass", "p.words", "p.position").orderBy("position", "doc_id", "pass")


def mixed_corpus(docs: DataFrame, schedules: Sequence[Knots] = SCHEDULES, share: float = 1.5, max_passes: int = 2) -> DataFrame:
    """The rows of docs that the mix takes words of, all columns, with mix_size,
    mix_target (its source's), mix_taken, mix_passes and mix_position, range-sorted by
    the last.  A row a document; training_order() has a row a pass.  Columns of docs that have one of
    the five names give way to them."""
    m = mix(docs, schedules, share, max_passes, carry=True).where("taken > 0")
    own = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ADDED]
    m = m.select(*own, F.col("size").alias("mix_size"), F.col("target").alias("mix_target"), F.col("taken").alias("mix_taken"), F.size("pieces").alias("mix_passes"), F.col("position").alias("mix_position"))
    return m.orderBy("mix_position", "doc_id")
