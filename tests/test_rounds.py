"""Queries that failed at size: small cases of what made them fail."""

import math
import random

from pyspark.sql import functions as F

from sparkloom.functions.scalar import dot, norm
from sparkloom.operators import graph, layout, morphemes, reader, relational, sampling, setjoin, similarity
from sparkloom.operators.components import connected_components
from sparkloom.sources.shared import stash


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_grid_counts(spark):
    r = random.Random(1)
    rows = [(k, r.choice([0.0, 1.0, 1.5, 3.0]) + r.randrange(-3, 3), r.choice([0.0, 0.5, 1.5]) - r.randrange(4)) for k in range(120)]
    odd = [(200, None, 0.0), (201, math.nan, 0.0), (202, math.inf, 0.0), (203, math.inf, 0.0), (204, math.nan, 0.0)]
    want = {a: sum(a != b and (x - u) ** 2 + (y - v) ** 2 <= 2.25 for b, u, v in rows) for a, x, y in rows} | {k: 0 for k, *_ in odd}
    out = graph.grid_counts(spark.createDataFrame([*rows, *odd], "id long, x double, y double"), 1.5)
    assert {x.id: x.n for x in out.collect()} == want
    assert "Broadcast" not in plan(out)  # small files may hold many rows


def test_morphemes_broadcast_nothing(spark):
    words = spark.createDataFrame([(w,) for w in ("rebuild", "builder", "rebuilder", "x")], "word string")
    table = spark.createDataFrame([("prefix", "re", "p:re", 1, None, None, None), ("root", "build", "r:build", 2, None, None, None), ("suffix", "er", "s:er", 3, None, None, None)], morphemes.TABLE)
    parsed = morphemes.decompose(words, table)
    assert "Broadcast" not in plan(parsed)  # words and table grow with the vocabulary, the driver doesn't
    found = morphemes.index(parsed, first=1, last=1)
    assert {(x.id, x.word, x["rank"], x.n) for x in found.collect()} == {("r:build", "builder", 1, 3), ("r:build", "rebuilder", 3, 3)}
    assert "Broadcast" not in plan(found)


def test_similar_blocks(spark, monkeypatch):
    r = random.Random(3)
    rows = [(k, k % 2, [r.gauss(0, 1) for _ in range(3)]) for k in range(60)] + [(60, 0, [0.0, 0.0, 0.0]), (61, 0, None), (62, 1, [1.0, 2.0]), (63, 1, [2.0, 4.0])]
    v = spark.createDataFrame(rows, "id long, label int, vector array<float>")
    one, two = (v.select("label", F.col("id").alias(i), F.col("vector").alias(x), norm(F.col("vector")).alias(n)) for i, x, n in (("a", "x", "n"), ("b", "y", "m")))
    cosine = F.round(dot(F.col("x"), F.col("y")) / (F.col("n") * F.col("m")), 4)
    want = {tuple(x) for x in one.join(two, "label").where("a < b AND size(x) = size(y)").select("label", "a", "b", cosine.alias("c")).where("c >= 0.9").collect()}
    assert len(want) > 20
    monkeypatch.setattr(similarity, "BLOCK", 7)  # many blocks a group: no group in one task
    got = similarity.similar_pairs(v, ["label"], 0.9)
    assert sorted(tuple(x) for x in got.collect()) == sorted(want) and got.columns == ["label", "a", "b", "cosine"]
    forest = similarity.similar_forest(v, ["label"], 0.9)
    assert {tuple(x) for x in connected_components(forest).collect()} == {tuple(x) for x in connected_components(got.select("a", "b")).collect()}
    monkeypatch.setattr(similarity, "BLOCK", 100)
    assert similarity.similar_forest(v, ["label"], -1.0).count() <= 63  # a forest, not all pairs


def test_near_in_band_keeps_few(spark, monkeypatch):
    p = spark.range(1200).select("id", F.lit("a").alias("brand"), (F.col("id") % 7).cast("double").alias("price"))
    p = p.union(spark.createDataFrame([(2000, "b", 1.0), (2001, "b", 2.0), (2002, "c", 1.0)], p.schema))
    one, two = p.select(F.col("id").alias("probe"), F.col("brand"), F.col("price").alias("v")), p
    near = one.join(two, "brand").where("probe <> id AND abs(price - v) <= 2").withColumn("c", sampling.chance(5, F.col("probe"), F.col("id")))
    want = {tuple(x) for x in relational.top_by(near, ["probe"], [F.col("c"), F.col("id")], 3).select("probe", "id", "rank").collect()}
    written = []
    monkeypatch.setattr(sampling, "stash", lambda df, name: written.append(out := stash(df, name)) or out)
    assert {tuple(x) for x in sampling.near_in_band(p, p, "brand", "price", 2.0, 3, 5).collect()} == want
    assert written[0].count() < 40 * 1200  # of some 700 candidates each
    monkeypatch.setattr(sampling, "hurdle", lambda n, wanted: F.lit("0" * 11 + "1"))  # nobody keeps enough: all are looked up again
    assert {tuple(x) for x in sampling.near_in_band(p, p, "brand", "price", 2.0, 3, 5).collect()} == want


def test_distractors_keep_few(spark, monkeypatch):
    gloss = F.concat(F.lit("the w"), F.translate((F.col("id") % 5).cast("string"), "01234", "abcde"), F.lit("xx"))
    words = spark.range(900).select(F.col("id").cast("string").alias("word"), gloss.alias("gloss"), (F.col("id") % 2).alias("band")).withColumn("gloss", F.expr("substring(gloss, 5)"))
    pool = words.withColumnRenamed("word", "other")
    related = spark.createDataFrame([("0", "7"), ("0", "3"), ("0", "5"), ("2", "2"), ("4", "1")], "word string, other string")
    alike = spark.createDataFrame([("0", "7"), ("6", "8"), ("6", "11")], "word string, other string")
    synonyms = spark.createDataFrame([("0", "3"), ("6", "8")], "word string, other string")
    c = related.withColumn("tier", F.lit(0)).union(alike.withColumn("tier", F.lit(1))).union(words.join(pool, "band").select("word", "other", F.lit(2)))
    c = c.where("word <> other").groupBy("word", "other").agg(F.min("tier").alias("tier")).join(synonyms, ["word", "other"], "left_anti")
    c = c.join(words.select("word", F.col("gloss").alias("g")), "word").join(pool.select("other", F.col("gloss").alias("o")), "other").where("g <> o")
    want = {tuple(x) for x in relational.top_by(c, ["word"], [F.col("tier"), sampling.chance(5, F.col("word"), F.col("other")), F.col("other")], 3).select("word", "other", "rank").collect()}
    written = []
    monkeypatch.setattr(reader, "stash", lambda df, name: written.append(out := stash(df, name)) or out)
    assert {tuple(x) for x in reader.distractors(words, related, alike, pool, synonyms, 3, 5).collect()} == want
    assert written[-1].count() < 40 * 900  # of some 360 candidates each
    monkeypatch.setattr(reader, "hurdle", lambda n, wanted: F.lit("0" * 11 + "1"))
    assert {tuple(x) for x in reader.distractors(words, related, alike, pool, synonyms, 3, 5).collect()} == want


def test_separable_in(spark, monkeypatch):
    verbs = spark.createDataFrame([("an", "fangen", "anfangen"), ("auf", "fangen", "auffangen"), ("an", "kommen", "ankommen"), ("an", "fangen", "Anfangen"), (None, "x", "y")], "prefix string, stem string, verb string")
    r = random.Random(2)
    s = spark.createDataFrame([(q, n, [r.choice(["an", "AUF", "fangen", "Kommen", "wir", "x"]) for _ in range(r.randrange(9))]) for q in range(40) for n in range(2)] + [(99, 0, None)], "quote long, sentence long, words array<string>")
    tokens = s.select("quote", "sentence", F.posexplode("words").alias("place", "token")).withColumn("place", F.col("place").cast("long"))
    want = {tuple(x) for x in reader.separable(tokens, verbs).collect()}
    assert len(want) > 10
    out = reader.separable_in(s, verbs)
    assert plan(out).count("Scan ExistingRDD") == 2  # words travel once (they did twice), verbs once
    assert {tuple(x) for x in out.collect()} == want and out.columns == ["quote", "sentence", "place", "verb"]
    monkeypatch.setattr(reader, "PREFIXES", 1)
    assert {tuple(x) for x in reader.separable_in(s, verbs).collect()} == want


def test_radial_broadcasts_nothing(spark):
    rows = spark.createDataFrame([(0, 0, None, 100), (0, 1, 0, 300), (0, 2, 0, 500), (0, 3, 1, 900)], "tree long, node long, parent long, year int")
    out = layout.radial(rows)
    assert out.count() == 4 and "Broadcast" not in plan(out)
    roots = graph.tree_roots(rows.where("parent IS NOT NULL").select(F.col("node").alias("child"), "parent"))
    assert {tuple(x) for x in roots.collect()} == {(0, 0), (1, 0), (2, 0), (3, 0)} and "Broadcast" not in plan(roots)


def test_link_counts(spark, monkeypatch):
    """Sets go packed to shards, whole texts only where prefixes meet: links of every text as by brute force, and few bytes shuffled."""
    r = random.Random(8)
    letters = [chr(97 + k) + chr(97 + j) for k in range(26) for j in range(26)]
    stem = [r.choice(letters) for _ in range(60)]
    rows = [(k, " ".join(stem[:40] + [r.choice(letters) for _ in range(r.choice((0, 1, 2, 6)))] + stem[40:])) for k in range(60)]  # one large group, with copies
    rows += [(k, " ".join(stem[:20] + [r.choice(letters) for _ in range(30)])) for k in range(100, 160)]  # a passage in common, no links
    for k in range(200, 260, 3):
        text = [r.choice(letters) for _ in range(r.choice((3, 5, 9, 30, 90)))]
        rows += [(k, " ".join(text)), (k + 1, " ".join(text).upper()), (k + 2, " ".join([*text, r.choice(letters)]))]
    rows += [(300, ""), (301, None), (302, "..."), (303, "one"), (304, "One!"), (305, "one two"), (306, "two one"), (-7, "a b c d"), (307, "a b c d"), (None, "one")]

    def shingles(text):
        w = (text or "").lower().replace("!", "").replace(".", "").split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {k: shingles(t) for k, t in rows if k is not None}
    want = {a: n for a, x in sets.items() if (n := sum(a != b and bool(x) and 100 * len(x & y) >= 80 * len(x | y) for b, y in sets.items()))}
    frame = spark.createDataFrame(rows, "id long, text string").repartition(3)
    assert {x.id: x.n for x in setjoin.link_counts(frame).collect()} == want
    monkeypatch.setattr(setjoin, "MEMBERS", 7)
    monkeypatch.setattr(setjoin, "BITS", 1 << 16)
    assert {x.id: x.n for x in setjoin.link_counts(frame).collect()} == want
    assert sum(want.values()) > 1000
    assert setjoin.link_counts(frame.where("id IN (300, 301)")).collect() == []
    # only what another text has comes back, and only texts of which 80 % is elsewhere have prefixes
    heads = {x.id: x.head for x in setjoin.heads(frame).collect()}
    assert set(want) <= set(heads) and not any(100 <= k < 160 for k in heads) and all(len(heads[k]) <= len(sets[k]) / 5 + 1 for k in heads)
    packed = frame.where("id IS NOT NULL AND text IS NOT NULL").select("id", setjoin.words(F.col("text")).alias("w")).where("size(w) > 0").mapInArrow(setjoin._pack(5), setjoin._PACKED)
    assert packed.where("docs IS NOT NULL").select("shard").distinct().count() == 3  # lists of a block's texts don't meet in one shard
