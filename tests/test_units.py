"""Operators and functions on small hand-made rows."""

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import morph, scalar
from sparkloom.operators import graph, relational, series, state, text
from sparkloom.operators.components import connected_components


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_segmentation():
    assert [p.text for p in morph.decompose("biography")] == ["bio", "graph", "y"]
    assert any(p.kind == "root" for p in morph.decompose("biography"))
    last = morph.decompose("microscope")[-1]
    assert (last.text, last.kind, last.meaning) == ("e", "suffix", "silent")
    for w in ("unbelievable", "transportation", "zzz", "geothermal", "inspector"):
        assert "".join(p.text for p in morph.decompose(w)) == w
    assert morph.decompose("two words")[0].kind == "word" and morph.decompose("") == []


def test_scalars(spark):
    assert one(spark, scalar.fold(F.lit("Éßæ Ñandú"))) == "essae nandu"
    assert one(spark, scalar.djb2(F.lit("ab"))) == (5381 * 33 + 97) * 33 + 98
    assert one(spark, scalar.shard_key(F.lit("É1"))) == "__other" and one(spark, scalar.shard_key(F.lit("Co"))) == "co"
    assert one(spark, scalar.half_up(F.lit(2.5))) == 3 and one(spark, scalar.half_up(F.lit(-2.5))) == -2
    assert one(spark, scalar.jaccard(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b")))) == 0.5
    assert one(spark, scalar.clipped(F.lit("abcdef"), 5, 3)) == "abc…"
    assert one(spark, scalar.year_of(F.lit("from 1612 on"))) == 1612 and one(spark, scalar.year_of(F.lit("the 17th century"))) == 1600
    assert one(spark, scalar.norm(F.array(F.lit(0.0)))) == 1.0


def test_series(spark):
    s = F.array(*(F.lit(x).cast("long") for x in (0, 5, 10, 10)))
    assert one(spark, series.percent_of_peak(s)) == [0, 50, 100, 100]
    assert one(spark, series.peak(s)) == 2 and one(spark, series.floored(s, F.lit(3))) == [0, 0, 0, 10]
    assert one(spark, series.floored(s, F.lit(9))) == [0, 5, 10, 10]


MERGE = [("a", "b", None, ["a", "b", "c"]), ("ab", "bc", "", ["a", "b", "c"]), ("ab", "b", "ab", ["b"]), ("abx", "aby", "ab", ["a", "b", "x", "y"])]


@pytest.mark.parametrize("mine,theirs,base,want", MERGE[1:])
def test_three_way(spark, mine, theirs, base, want):
    f = lambda x: spark.createDataFrame([(c,) for c in x or ""], "k string")
    assert sorted(r.k for r in relational.three_way(f(base), f(mine), f(theirs), ["k"]).collect()) == want


def test_latest_from_either_side(spark):
    rows = [("w", 1, 5), ("w", 3, 2), ("v", 2, 9)]
    for order in (rows, rows[::-1]):
        got = relational.latest(spark.createDataFrame(order, "k string, m int, n int"), ["k"], [F.col("m")], ["n"]).collect()
        assert sorted((r.k, r.m, r.n) for r in got) == [("v", 2, 9), ("w", 3, 5)]


def test_apply_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    diff = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = relational.apply_diff(base, diff, ["k"])
    twice = relational.apply_diff(once, diff, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert relational.same_keys(base, base, ["k"]).isEmpty() and relational.same_keys(base, once, ["k"]).count() == 1


def test_words_of_any_script(spark):
    got = spark.createDataFrame([("Élan à Zürich 42, naïve!",), (None,)], "t string").select(text.tokens(F.col("t")).alias("w")).collect()
    assert got[0].w == ["élan", "à", "zürich", "42", "naïve"] and got[1].w is None


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (4, 3), (5, 6), (6, 5)], "child long, parent long")
    reach = {(r.node, r.ancestor): r.depth for r in graph.closure(e).collect()}
    assert reach[1, 3] == 2 and reach[5, 5] == 2 and (3, 1) not in reach
    assert {(r.node, r.loop) for r in graph.loops(e.unionAll(spark.createDataFrame([(3, 3)], "child long, parent long"))).collect()} == {(3, 3), (5, 5), (6, 5)}
    assert {r.node: r.root for r in graph.tree_roots(e.where("child < 5")).collect()} == {1: 3, 2: 3, 4: 3, 3: 3}
    with pytest.raises(ValueError):
        graph.tree_roots(e.where("child >= 5"), most=2)
    c = {r.node: r.component for r in connected_components(spark.createDataFrame([(k, k + 1) for k in range(1, 200)] + [(500, 400)], "a long, b long")).collect()}
    assert c[200] == 1 and c[500] == 400 and len(c) == 202


def test_folds():
    s = (2.5, 0.0, 0)
    for right, days, ease in ((True, 1, 2.5), (True, 6, 2.5), (True, 15, 2.5), (False, 1, 1.96), (False, 1, 1.42), (False, 1, 1.3)):
        s = state.sm2(s, right)
        assert s[1] == days and s[0] == pytest.approx(ease)
    for _ in range(3000):
        s = state.sm2((2.5, s[1], s[2]), True)
    assert s[1] == float("inf")
    s = (0, 0.0, 0, 1.0, False)
    s = state.ladder(s, False)
    assert s[2:4] == (1, 1.0)
    s = state.ladder(s, False)
    assert s[3] == pytest.approx(0.9)
    for k in range(1, 6):
        s = state.ladder(s, True)
        assert s[0] == k and (s[4] or s[1] == pytest.approx(state.LADDER[k] * (0.9 + 0.04 * k)))
    assert s[4] and state.ladder(s, True) == s and state.ladder(s, False)[3:] == (1.0, False)
    for first, score, want in ((72, 0.9, 62), (50, 0.9, 48), (26, 0.9, 26), (50, 0.2, 52), (50, 0.7, 50)):
        s = (first, first, "")
        for _ in range(4):
            s = state.level(s, score, 5)
        assert s[0] == want and state.level(s, 0.0, 2) == s
    assert state.level((58, 50, "0.1,0.1,0.1,0.1"), 0.1, 9)[0] == 58
