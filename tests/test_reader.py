"""Readings, fallbacks, difficulty, judging, distractors; packing; analyses of words."""

from math import hypot

from pyspark.sql import functions as F

from sparkloom.functions import morph
from sparkloom.operators import reader
from sparkloom.operators.layout import packed


def test_parts(spark):
    d = spark.createDataFrame([("L'été",), ("du",), ("porte-clé",), ("mot",)], "t string")
    assert [r.p for r in d.select(reader.parts_of(F.col("t"), "fr").alias("p")).collect()] == [["le", "été"], ["de", "le"], ["porte", "clé"], ["mot"]]
    assert d.limit(1).select(reader.parts_of(F.lit("Zum"), "de").alias("p")).first().p == ["zu", "dem"]


def test_readings(spark):
    forms = spark.createDataFrame([("est", "être", 7.0, True, False, 0), ("est", "est", 4.0, False, False, 1), ("son", "son (his)", 6.5, False, False, 0), ("son", "son (sound)", 5.5, False, False, 1), ("son", "son (bran)", 2.0, False, False, 2)], "surface string, entry string, zipf double, closed boolean, demoted boolean, ord int")
    r = reader.readings(spark.createDataFrame([("est",), ("son",), ("x",)], "surface string"), forms)
    assert sorted((x.surface, x.entry, x["rank"]) for x in r.collect()) == [("est", "être", 1), ("son", "son (his)", 1), ("son", "son (sound)", 2)]
    assert [tuple(x) for x in reader.runner_up(r).collect()] == [("son", "son (sound)")]
    lex = spark.createDataFrame([("cheval",), ("petit",)], "word string")
    f = reader.fallbacks(spark.createDataFrame([("chevaux",), ("petites",), ("petit",), ("zut",)], "word string"), lex, "fr")
    assert sorted((x.word, x.base) for x in f.collect()) == [("chevaux", "cheval"), ("petites", "petit")]


def test_difficulty(spark):
    t = spark.createDataFrame([(1, "a", 6.0, False, False), (1, "b", 3.0, False, False), (1, "c", 3.0, True, False), (1, None, None, None, None), (1, "n", 1.0, False, True)], "quote int, entry string, zipf double, transparent boolean, name boolean")
    assert [tuple(x) for x in reader.difficulty(t).collect()] == [(1, 4, 2, 1, 0.5)]
    c = spark.createDataFrame([("u", 1, 2, 40), ("u", 2, 2, 40), ("u", 3, 9, 20), ("u", 4, 5, 20)], "user string, quote int, unknown int, n int")
    got = reader.excerpts(c, spark.createDataFrame([("u", 2)], "user string, quote int"), 3, 1).orderBy("rank").collect()
    assert [x.quote for x in got] == [2, 1, 4]


def test_judging(spark):
    g = spark.createDataFrame([(1, "a large house"), (1, "to run quickly")], "quote int, gloss string")
    assert [tuple(x) for x in reader.judged(g, spark.createDataFrame([(1, "He runs to the houses")], "quote int, answer string")).collect()] == [(1, 2, 1)]
    tokens = spark.createDataFrame([(1, 0, 0, "er"), (1, 0, 1, "fängt"), (1, 0, 2, "heute"), (1, 0, 3, "an"), (1, 1, 4, "auf")], "quote int, sentence int, place int, token string")
    verbs = spark.createDataFrame([("an", "fängt", "anfangen"), ("auf", "fängt", "auffangen")], "prefix string, stem string, verb string")
    assert [tuple(x) for x in reader.separable(tokens, verbs).collect()] == [(1, 0, 1, "anfangen")]


def test_distractors(spark):
    words = spark.createDataFrame([("calm", "free from disturbance", 1)], "word string, gloss string, band int")
    pool = spark.createDataFrame([("quiet", "with little noise", 1), ("clam", "a sea animal", 1), ("still", "not moving, without disturbance", 1), ("storm", "bad weather", 1), ("far", "distant", 2)], "other string, gloss string, band int")
    pair = lambda *x: spark.createDataFrame([("calm", k) for k in x], "word string, other string")
    got = reader.distractors(words, pair("storm", "quiet"), pair("clam"), pool, pair("quiet"), 3, 1).orderBy("rank").collect()
    assert [x.other for x in got] == ["storm", "clam"]
    senses = spark.createDataFrame([("w", 0, "first"), ("w", 1, "about other things")], "word string, ord int, gloss string")
    links = spark.createDataFrame([("w", "other", "gone"), ("w", "x", "first")], "word string, other string, gloss string")
    assert sorted((r.other, r.ord) for r in reader.sense_link(senses, links).collect()) == [("other", 1), ("x", 0)]


def test_analyses():
    assert morph.align("biology", ["bio", "logy"]) == ["bio", "logy"] and morph.align("psychology", ["psycho", "-logy"]) == ["psycho", "logy"]
    assert morph.align("illegal", ["in-", "legal"], {"in": ("il", "im")}) == ["il", "legal"] and morph.align("word", ["x"]) is None
    whole = morph.chosen(None, [morph.Piece("x", "root", "")], "zzz")
    assert [p.kind for p in whole] == ["word"] and [p.text for p in morph.chosen(None, None, "biography")] == ["bio", "graph", "y"]
    new = morph.Morpheme("root", "hydr", "water")
    assert morph.rescued("hydric", morph.DEFAULT, (new,)) is not None and morph.rescued("biography", morph.DEFAULT, (new,)) is None
    assert [c[0] for c in morph.collisions("hydr", ["hydric", "biology"], morph.DEFAULT, new)] == ["hydric"]
    assert morph.quoted_reading("Initialism of “as soon as possible”.") == "as soon as possible"


def test_packing(spark):
    rows = [(1, k, 1.0 + k % 3, float(k)) for k in range(30)]
    got = packed(spark.createDataFrame(rows, "region int, id int, r double, tie double")).collect()
    r = {k: 1.0 + k % 3 for k in range(30)}
    assert len(got) == 30
    assert all(hypot(a.x - b.x, a.y - b.y) >= r[a.id] + r[b.id] - 1e-9 for k, a in enumerate(got) for b in got[k + 1 :])
