"""Seeded samples, shuffles and picks that come out alike on every run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stash
from .relational import top_by


def chance(seed: int, *cols: Column) -> Column:
    """A number in (0, 1) from the md5 of a seed and values: the same wherever it is computed."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(c.cast("string") for c in cols)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def shuffled(df: DataFrame, seed: int, *cols: Column) -> DataFrame:
    """df with `place`, a random number to order by, ties impossible to the eye."""
    return df.withColumn("place", chance(seed, *cols))


def weighted_sample(df: DataFrame, weight: Column, n: int, seed: int, ident: Column) -> DataFrame:
    """n rows without replacement, with chances by weight: the largest of U ** (1 / weight).

    Ordered by log(U) / weight, which doesn't underflow; Spark keeps n rows a task.
    """
    key = F.log(chance(seed, ident)) / weight
    return df.where(weight > 0).withColumn("_key", key).orderBy(F.desc("_key"), ident).limit(n).drop("_key")


def every(df: DataFrame, step: int, order: Sequence[Column]) -> DataFrame:
    """Rows at places 0, step, 2 * step ... of the order."""
    from .relational import bands

    placed = bands(df, order, 1)
    return placed.where(F.col("band") % step == 0).withColumnRenamed("band", "place")


def distinct_enough(ranked: DataFrame, keys: Sequence[str], word: str, most: int = 6, stem: int = 5) -> DataFrame:
    """(keys, word, rank) to each key's best words, without one that begins as a taken one
    does and contains it or is contained: a fold over the ranked list.

    The lists are top-k lists, so they are short.
    """
    lists = ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", word))), lambda x: x[word]).alias("_l"))

    def alike(a: Column, b: Column) -> Column:
        return (F.substring(a, 1, stem) == F.substring(b, 1, stem)) & (F.contains(a, b) | F.contains(b, a))

    def take(taken: Column, w: Column) -> Column:
        return F.when((F.size(taken) < most) & ~F.exists(taken, lambda t: alike(t, w)), F.concat(taken, F.array(w))).otherwise(taken)

    kept = F.aggregate("_l", F.array().cast("array<string>"), take)
    return lists.select(*keys, F.posexplode(kept).alias("place", word))


def digest(seed: int, *cols: Column) -> Column:
    """The md5 of a seed and values in hexadecimal, in the order of chance() by its first 12 digits."""
    return F.md5(F.concat(F.lit(str(seed)), *(x for c in cols for x in (F.lit("|"), c.cast("string")))).cast("binary"))


def hurdle(candidates: Column, wanted: int) -> Column:
    """The digest that about `wanted` of so many candidates stay under; null if all do."""
    return F.when(candidates > wanted, F.lower(F.lpad(F.hex(F.floor(F.lit(float(wanted * 16**12)) / candidates)), 12, "0")))


def near_in_band(probes: DataFrame, pool: DataFrame, key: str, value: str, within: float, k: int, seed: int) -> DataFrame:
    """(id, key, value) twice to k others of each probe with the same key and a value no
    farther than `within`, chosen at random: a band join on (key, floor(value / within)).

    All candidates' digests are made, but only those under a probe's hurdle, by how many it may have, are kept
    and sorted; a probe that keeps fewer than k is looked up again without one, so that the picks are those of all candidates.
    """
    cell = F.floor(F.col(value) / within)
    around = F.explode(F.array(F.col("_cell") - 1, F.col("_cell"), F.col("_cell") + 1)).alias("_cell")
    held = pool.withColumn("_cell", cell)
    counts = held.groupBy(key, "_cell").agg(F.count("*").alias("_n")).select(key, around, "_n").groupBy(key, "_cell").agg(F.sum("_n").alias("_n"))
    asked = probes.withColumn("_cell", cell).join(counts.hint("merge"), [key, "_cell"])
    asked = asked.select(F.col("id").alias("probe"), key, F.col(value).alias("_v"), "_cell", hurdle(F.col("_n"), 8 * k).alias("_h"))
    _c = digest(seed, F.col("probe"), F.col("id"))

    def met(some: DataFrame, kept: Column) -> DataFrame:
        look = some.select("probe", key, "_v", "_h", around)
        near = look.join(held.hint("merge"), [key, "_cell"]).where((F.col("probe") != F.col("id")) & (F.abs(F.col(value) - F.col("_v")) <= within) & kept)
        return near.select("probe", "id", F.substring(_c, 1, 12).alias("_c"))

    first = stash(met(asked, F.col("_h").isNull() | (_c < F.col("_h"))), "near")
    enough = first.groupBy("probe").agg(F.count("*").alias("_k")).where(F.col("_k") >= k)
    rest = met(asked.where("_h IS NOT NULL").join(enough.hint("merge"), "probe", "left_anti"), _c >= F.col("_h"))
    return top_by(first.unionByName(rest), ["probe"], [F.col("_c"), F.col("id")], k).select("probe", "id", "rank")


def due_first(df: DataFrame, user: str, due: Column, order: Sequence[Column], k: int) -> DataFrame:
    """A practice queue: what is due before the rest, then in order; k a user."""
    return top_by(df.withColumn("due", due), [user], [F.desc("due"), *order], k)


def last_seen(df: DataFrame, user: str, order: Sequence[Column], n: int) -> DataFrame:
    """The last n rows of each user."""
    w = Window.partitionBy(user).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")
