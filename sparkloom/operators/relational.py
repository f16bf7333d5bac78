"""Lookups, gaps, first-wins picks, ranks and merges over plain tables.

First-wins picks are aggregations over (order, row) structs rather than windows:
rows are reduced before the shuffle, so a hot key costs one row a task.  Every
order must be total where ties matter; none is broken at random.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stash


def missing_relation(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Rows of left without a partner (NOT EXISTS)."""
    return left.join(right, on, "left_anti")


def blank(col: Column) -> Column:
    """Null and '' are both blank."""
    return F.coalesce(col.cast("string"), F.lit("")) == ""


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row of each key that comes first in ascending `order`."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, *(F.col("_row")[c].alias(c) for c in rest))


def top_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key, with `rank`.  Spark keeps k rows a key and task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def majority(df: DataFrame, keys: Sequence[str], value: str, voter: Sequence[str]) -> DataFrame:
    """The value with most votes of each key; a voter has one vote a value; ties go to the smaller value."""
    votes = df.select(*keys, value, *voter).distinct().groupBy(*keys, value).agg(F.count("*").alias("votes"))
    return first_by(votes, keys, [-F.col("votes"), F.col(value)])


def unique_fold(vocabulary: DataFrame, key: str = "word") -> DataFrame:
    """(folded, word) where only one spelling has that lower-case form."""
    return vocabulary.groupBy(F.lower(key).alias("folded")).agg(F.min(key).alias(key), F.count_distinct(key).alias("n")).where("n = 1").drop("n")


def exact_else_folded(probe: DataFrame, table: DataFrame, value: str, key: str = "word") -> DataFrame:
    """probe with `value` of the row of table with the same key, else the sum over rows
    with the same lower-case key."""
    exact = table.groupBy(key).agg(F.sum(value).alias("exact"))
    folded = table.groupBy(F.lower(key).alias("_folded")).agg(F.sum(value).alias("folded"))
    return probe.join(exact, key, "left").join(folded, F.lower(probe[key]) == F.col("_folded"), "left").drop("_folded").withColumn(value, F.coalesce("exact", "folded"))


def one_way(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Edges (keys, a, b) whose reverse is missing."""
    back = edges.select(*keys, F.col("a").alias("b"), F.col("b").alias("a"))
    return edges.join(back, [*keys, "a", "b"], "left_anti")


def dangling(df: DataFrame, key: str, table: DataFrame, table_key: str) -> DataFrame:
    """Targets that table lacks, with how many rows name them."""
    counts = df.groupBy(F.col(key).alias("target")).agg(F.count("*").alias("n"))
    return counts.join(table.select(F.col(table_key).alias("target")).distinct(), "target", "left_anti")


def signals(df: DataFrame, rules: Sequence[tuple[str, int, Column]]) -> DataFrame:
    """df with `score`, the weights of the rules that hold, and `fired`, their names."""
    holds = [(name, weight, F.coalesce(test, F.lit(False))) for name, weight, test in rules]
    score = sum((F.when(t, F.lit(w)).otherwise(F.lit(0)) for _, w, t in holds), F.lit(0))
    fired = F.concat_ws(",", *(F.when(t, F.lit(n)) for n, _, t in holds))
    return df.withColumn("score", score.cast("long")).withColumn("fired", fired)


def first_class(rules: Sequence[tuple[str, Column]], otherwise: str) -> Column:
    """The name of the first rule that holds."""
    out = F
    for name, test in rules:
        out = out.when(test, F.lit(name))
    return out.otherwise(F.lit(otherwise))


def bands(df: DataFrame, order: Sequence[Column], size: int, buckets: int = 64) -> DataFrame:
    """df with `band`: its place in the order, from 0, divided by size.

    Range partitions are counted first, so that no task sorts everything.  They are
    written with their numbers: dealt anew, their borders could be others.
    """
    dealt = stash(df.repartitionByRange(buckets, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")
    placed = dealt.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy(*order))).join(F.broadcast(before), "_part")
    return placed.withColumn("band", F.floor((F.col("_before") + F.col("_rn") - 1) / size).cast("long")).drop("_part", "_rn", "_before")


def trimmed(df: DataFrame, keys: Sequence[str], order: Sequence[str], first: int = 44, last: int = 16) -> DataFrame:
    """Of keys with more rows than first + last, the rows at both ends; else all."""
    up = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_up", F.row_number().over(up)).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    return d.where((F.col("_n") <= first + last) | (F.col("_up") <= first) | (F.col("_up") > F.col("_n") - last)).drop("_up", "_n")


def run_starts(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before, and the last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_was", F.lag(value).over(w)).withColumn("_next", F.lead(F.lit(1)).over(w))
    return d.where(~F.col("_was").eqNullSafe(F.col(value)) | F.col("_next").isNull()).drop("_was", "_next")


def last_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, last: int = 5, least: int = 4) -> DataFrame:
    """df with `mean` of the last few values, null until there are `least`."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - last, 0)
    return df.withColumn("mean", F.when(F.count(value).over(w) >= least, F.avg(value).over(w)))


def quota(df: DataFrame, category: str, quotas: Mapping[str, int], order: Sequence[Column], most: int) -> DataFrame:
    """The first `most` rows in order, where categories with a quota give so many at most."""
    allowed = F.lit(None).cast("int")
    for name, n in quotas.items():
        allowed = F.when(F.col(category) == name, F.lit(n)).otherwise(allowed)
    held = df.withColumn("_rank", F.row_number().over(Window.partitionBy(category).orderBy(*order))).withColumn("_allowed", allowed)
    return held.where(F.col("_allowed").isNull() | (F.col("_rank") <= F.col("_allowed"))).drop("_rank", "_allowed").orderBy(*order).limit(most)


def latest(df: DataFrame, keys: Sequence[str], at: Sequence[Column], counters: Sequence[str] = ()) -> DataFrame:
    """Last writer wins: each key's latest row, with the greatest of its counters."""
    rest = [c for c in df.columns if c not in keys and c not in counters]
    merged = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("_row"), *(F.max(c).alias(c) for c in counters))
    return merged.select(*keys, *(F.col("_row")[c].alias(c) for c in rest), *counters)


def three_way(base: DataFrame, mine: DataFrame, theirs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of a list edited on two sides: what either side added stays, what either removed goes."""
    marks = [d.select(*keys).distinct().withColumn(n, F.lit(1)) for d, n in ((base, "_b"), (mine, "_m"), (theirs, "_t"))]
    j = marks[0].join(marks[1], list(keys), "full").join(marks[2], list(keys), "full")
    keep = F.when(F.col("_b").isNotNull(), F.col("_m").isNotNull() & F.col("_t").isNotNull()).otherwise(F.lit(True))
    return j.where(keep).select(*keys)


def apply_diff(base: DataFrame, diff: DataFrame, keys: Sequence[str]) -> DataFrame:
    """base with the rows of diff in place of rows with their keys: the second half of plan and apply."""
    return base.join(diff, list(keys), "left_anti").unionByName(diff)


def same_keys(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that only one side has: empty if an edit lost and invented none."""
    b, a = before.select(*keys).distinct(), after.select(*keys).distinct()
    return b.exceptAll(a).withColumn("side", F.lit("lost")).unionByName(a.exceptAll(b).withColumn("side", F.lit("new")))
