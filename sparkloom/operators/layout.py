"""Radial time layout of trees, level by level, and packing of circles, a region at a time."""

from __future__ import annotations

from functools import reduce
from math import cos, pi, sin, sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stash

MIN_GAP = 0.02


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """The nodes by their distance from the root, each level written once."""
    level = stash(nodes.where("parent IS NULL"), "level")
    out = []
    while not level.isEmpty():
        out.append(level)
        above = level.select("tree", F.col("node").alias("parent"))
        level = stash(nodes.join(above.hint("merge"), ["tree", "parent"], "left_semi").select(*nodes.columns), "level")
    return out


def radial(nodes: DataFrame, spacing: float = 1.0) -> DataFrame:
    """(tree, node, parent, year) to (tree, node, x, y): radius by elapsed time from the tree's root, growing outwards by a least gap; a node's wedge is
    its share of its parent's by leaves, the largest first, then by node.

    Level by level, from the root down and with the leaves counted back up, so that a tree isn't in one task; in as many rounds as there are levels.
    The joins are merged: a level's file is small for its rows, too small for a broadcast through the driver.
    Nodes that no root reaches, as on a cycle, have no row.
    """
    timed = nodes.select("tree", "node", "parent", (-F.log(2400 - F.least(F.col("year").cast("double"), F.lit(2000.0)))).alias("time"))
    levels = _levels(timed)
    if not levels:
        return nodes.select("tree", "node", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).limit(0)
    counted: list[DataFrame] = []
    below: DataFrame | None = None
    for level in reversed(levels):
        one = F.lit(1).cast("long")
        if below is None:
            own = level.withColumn("leaves", one)
        else:
            sums = below.groupBy("tree", F.col("parent").alias("node")).agg(F.sum("leaves").alias("leaves"))
            own = level.join(sums.hint("merge"), ["tree", "node"], "left").withColumn("leaves", F.coalesce("leaves", one))
        below = stash(own.select("tree", "node", "parent", "time", "leaves"), "leaves")
        counted.insert(0, below)
    top = counted[0].select("tree", "node", "leaves", F.lit(0.0).alias("start"), F.lit(2 * pi).alias("width"), F.lit(0.0).alias("radius"), F.col("time").alias("begun"))
    placed = [top]
    for level in counted[1:]:
        p = placed[-1].select("tree", F.col("node").alias("parent"), F.col("leaves").alias("_all"), F.col("start").alias("_start"), F.col("width").alias("_width"), F.col("radius").alias("_radius"), "begun")
        j = level.join(p.hint("merge"), ["tree", "parent"]).withColumn("width", F.col("_width") * F.col("leaves") / F.col("_all"))
        before = F.sum("width").over(Window.partitionBy("tree", "parent").orderBy(F.desc("leaves"), "node")) - F.col("width")
        j = j.withColumn("start", F.col("_start") + before).withColumn("radius", F.greatest(F.col("_radius") + MIN_GAP, F.col("time") - F.col("begun")))
        placed.append(stash(j.select("tree", "node", "leaves", "start", "width", "radius", "begun"), "placed"))
    all_ = reduce(DataFrame.unionByName, placed)
    rim = F.greatest(F.max("radius"), F.lit(1e-6))
    scale = F.greatest(F.max("leaves") * spacing / (2 * pi) / rim, F.lit(3.5), 0.8 * F.sqrt(F.count("*")) / rim)
    sized = all_.join(all_.groupBy("tree").agg(scale.alias("scale")).hint("merge"), "tree")
    angle = F.col("start") + F.col("width") / 2
    return sized.select("tree", "node", (F.col("radius") * F.col("scale") * F.cos(angle)).alias("x"), (F.col("radius") * F.col("scale") * F.sin(angle)).alias("y"))


def _packed(region: pd.DataFrame, step: float) -> pd.DataFrame:
    """Circles (id, r, tie) on a golden-angle spiral, the strongest tie first, none overlapping.

    A grid of cells as wide as the largest circle holds what has been placed.
    """
    placed: dict[tuple[int, int], list[tuple[float, float, float]]] = {}
    cell = 2 * max(region["r"].max(), 1e-9)
    rows = []
    for ident, r, _ in sorted(zip(region["id"], region["r"], region["tie"], strict=True), key=lambda x: (-x[2], -x[1], x[0])):
        k = 0
        while True:
            d, a = step * sqrt(k), k * pi * (3 - sqrt(5))
            x, y = d * cos(a), d * sin(a)
            cx, cy = int(x // cell), int(y // cell)
            near = (c for i in (-1, 0, 1) for j in (-1, 0, 1) for c in placed.get((cx + i, cy + j), ()))
            if all((x - u) ** 2 + (y - v) ** 2 >= (r + s) ** 2 for u, v, s in near):
                break
            k += 1
        placed.setdefault((cx, cy), []).append((x, y, r))
        rows.append((ident, x, y))
    return pd.DataFrame(rows, columns=["id", "x", "y"])


def packed(circles: DataFrame, step: float = 0.5) -> DataFrame:
    """(region, id, r, tie) to (region, id, x, y); each circle is placed after those with
    stronger ties, so a region is one group and of bounded size."""
    kinds = {c: circles.schema[c].dataType.simpleString() for c in ("region", "id")}

    def run(key, region):
        out = _packed(region, step)
        out.insert(0, "region", key[0])
        return out

    return circles.select("region", "id", "r", "tie").groupBy("region").applyInPandas(run, f"region {kinds['region']}, id {kinds['id']}, x double, y double")


def emphasis(size: Column, is_affix: Column, factor: float = 0.28) -> Column:
    """How large a label stands; affixes are held back."""
    return F.when(is_affix, size * factor).otherwise(size)
