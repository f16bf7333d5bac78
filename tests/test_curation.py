"""Plans of entity resolution; planning after applying finds nothing."""

from pyspark.sql import functions as F

from sparkloom.functions.language import american
from sparkloom.functions.predicates import pointer
from sparkloom.operators import curation
from sparkloom.operators.relational import apply_diff


def test_pointers(spark):
    p = spark.createDataFrame([("colour", "color"), ("coloure", "colour"), ("x", "y")], "word string, target string")
    got = curation.resolve_pointers(p, [-american(F.col("word")), F.length("word")])
    assert sorted(map(tuple, got.collect())) == [("colour", "color"), ("coloure", "color"), ("y", "x")]
    glosses = spark.createDataFrame([("a", "b", "plural of b"), ("c", "d", "plural of e"), ("f", "g", "a thing")], "word string, target string, gloss string")
    words = spark.createDataFrame([("b",), ("e",)], "word string")
    fixed = curation.repair_pointers(glosses, words, F.contains("gloss", F.col("target")) & pointer(F.col("gloss")).isNotNull(), pointer(F.col("gloss"))["target"])
    assert sorted((r.word, r.target, r.verdict) for r in fixed.collect()) == [("a", "b", "keep"), ("c", "e", "retarget"), ("f", "g", "remove")]


def test_clusters(spark):
    pairs = spark.createDataFrame([("w", 0, 1), ("w", 1, 3), ("v", 0, 2)], "word string, a int, b int")
    assert sorted((r.word, r.ord, r.cluster) for r in curation.sense_clusters(pairs, ["word"]).collect()) == [("v", 0, 0), ("v", 2, 0), ("w", 0, 0), ("w", 1, 0), ("w", 3, 0)]


def test_plans_settle(spark):
    base = spark.createDataFrame([("a", "", 1), ("b", "kept", 2), ("c", None, 3)], "w string, e string, n int")
    donor = spark.createDataFrame([("a", "filled"), ("b", "other"), ("c", "")], "w string, e string")
    diff = curation.backfill(base, donor, "w", ["e"])
    assert [(r.w, r.e, r.n) for r in diff.collect()] == [("a", "filled", 1)]
    assert curation.backfill(apply_diff(base, diff, ["w"]), donor, "w", ["e"]).isEmpty()
    patch = spark.createDataFrame([("a", "x", None), ("z", "new", 9), ("b", None, None)], "w string, e string, n int")
    plan = curation.upsert(base, patch, ["w"])
    assert sorted((r.w, r.e, r.n, r.change) for r in plan.collect()) == [("a", "x", 1, "changed"), ("z", "new", 9, "new")]
    assert curation.upsert(apply_diff(base, plan.drop("change"), ["w"]), patch, ["w"]).isEmpty()
    cut = spark.createDataFrame([("a", "From Latin verbum and…"), ("b", "Whole.")], "w string, e string")
    long_ = spark.createDataFrame([("a", "From Latin verbum and more."), ("b", "Whole and longer.")], "w string, e string")
    fix = curation.untruncated(cut, long_, "w", "e")
    assert [(r.w, r.e) for r in fix.collect()] == [("a", "From Latin verbum and more.")]
    assert curation.untruncated(apply_diff(cut, fix, ["w"]), long_, "w", "e").isEmpty()


def test_analyses(spark):
    kind = "word string, pieces array<struct<s:string>>"
    there = spark.createDataFrame([("ab", [("a",), ("b",)]), ("cd", [("cd",)])], kind)
    curated = spark.createDataFrame([("ab", [("a",), ("b",)]), ("cd", [("c",), ("d",)]), ("ef", [("e",), ("x",)])], kind)
    diff = curation.override(there, curated)
    assert [r.word for r in diff.collect()] == ["cd"] and curation.override(apply_diff(there, diff, ["word"]), curated).isEmpty()
    parts = "word string, parts array<string>"
    b = spark.createDataFrame([("ab", ["ab"]), ("cd", ["c", "d"]), ("ef", None)], parts)
    p = spark.createDataFrame([("ab", ["a", "b"]), ("cd", ["cd"]), ("ef", ["ef"])], parts)
    assert sorted((r.word, r.parts) for r in curation.split_merge(b, p).collect()) == [("ab", ["a", "b"]), ("ef", ["ef"])]
    t = spark.createDataFrame([("Haustür", "name"), ("Anna", "name"), ("haustür", "word")], "token string, kind string")
    assert sorted(map(tuple, curation.relabelled(t, spark.createDataFrame([("haustür",)], "word string")).collect())) == [("Anna", "name"), ("Haustür", "compound"), ("haustür", "word")]
    words = spark.createDataFrame([("a", "g1"), ("b", "g1"), ("c", "g2"), ("d", "g3")], "word string, gloss string")
    cached = spark.createDataFrame([("g2",)], "gloss string").select(F.sha1(F.col("gloss").cast("binary")).alias("hash"))
    assert [r.gloss for r in curation.to_embed(words, spark.createDataFrame([("d",)], "word string"), cached).collect()] == ["g1"]
