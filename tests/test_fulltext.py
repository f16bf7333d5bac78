"""The stored index against searches of all texts."""

import math
import random
import re

import pytest

from sparkloom.operators import fulltext
from sparkloom.sources.shared import new_path

DOCS = "id long, text string"


def plain(docs, units):
    """id to score, by looking at every word of every text."""
    texts = {i: [w.lower() for w in re.findall(r"[^\W_]+", t or "")] for i, t in docs}

    def times(words, unit):
        fits = lambda w, u: w.startswith(u[:-1]) if u.endswith("*") else w == u
        return sum(all(fits(words[k + j], u) for j, u in enumerate(unit)) for k in range(len(words) - len(unit) + 1))

    n = {i: [times(w, u) for u in units] for i, w in texts.items()}
    mean = sum(map(len, texts.values())) / len(texts)
    out = {}
    for i, t in n.items():
        if units and all(t):
            have = [sum(x[u] > 0 for x in n.values()) for u in range(len(units))]
            out[i] = sum(math.log((len(texts) - h + 0.5) / (h + 0.5) + 1) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(texts[i]) / mean)) for h, c in zip(have, t, strict=True))
    return out


def some(seed, n):
    r = random.Random(seed)
    words = [a + b for a in "abcde" for b in ("", "ng", "nt", "st", "é")]
    return [(k, " ".join(r.choice(words) for _ in range(r.randrange(1, 40)))) for k in range(n)]


UNITS = [[("a",)], [("ang",), ("b",)], [("a", "b")], [("a", "b*")], [("a*", "c", "d*")], [("an*",), ("st",)], [("st", "st")], [("a", "a")], [("b*",), ("a", "c"), ("d",)], [("nowhere",)], [("a", "nowhere")], []]


def check(index, docs):
    for units in UNITS:
        got = {r.id: r.score for r in index.match(units).collect()}
        want = plain(docs, units)
        assert set(got) == set(want) and all(got[i] == pytest.approx(want[i]) for i in want), units


@pytest.fixture(autouse=True)
def small_files(monkeypatch):
    monkeypatch.setattr(fulltext, "FILE_BYTES", 300)


def test_searches(spark):
    docs = [*some(1, 120), (500, None), (501, ""), (502, "a a a, a b"), (503, "A ang " * 2000)]
    index = fulltext.Index(spark, new_path(spark, "index"))
    assert index.match([("a",)]).count() == 0 and index.terms().count() == 0 and index.documents() is None
    for k in range(3):
        index.append(spark.createDataFrame(docs[k * 50 : (k + 1) * 50], DOCS))
    check(index, docs)
    files = index.manifest().where("file IS NOT NULL").count()
    assert files > 10
    # a search opens the files of its terms, and reads nothing else
    for units in ([("eng",)], [("ce*",)], [("bst",), ("d", "est")]):
        opened = index.files(units)
        assert 0 < len(opened) < files / 2
        read = index.postings(units)
        assert sorted(x.rsplit("/", 1)[1] for x in read.inputFiles()) == sorted(x.rsplit("/", 1)[1] for x in opened)
        assert "PushedFilters: [" in read._jdf.queryExecution().toString()
    index.merge()
    assert len(index._segments()) == 1
    check(index, docs)
    words = [w.lower() for _, t in docs for w in re.findall(r"[^\W_]+", t or "")]
    assert {r.term: r.occurrences for r in index.terms().collect()} == {w: words.count(w) for w in set(words)}


def test_hot_term(spark):
    """A term of all documents fills many files."""
    index = fulltext.Index(spark, new_path(spark, "index"))
    index.append(spark.createDataFrame([(k, "word word") for k in range(600)], DOCS))
    assert len(index.files([("word",)])) > 5 and index.match([("word", "word")]).count() == 600


def test_refused(spark):
    index = fulltext.Index(spark, new_path(spark, "index"))
    index.append(spark.createDataFrame([(1, "one word"), (2, "two")], DOCS))
    before = {r.id: r.score for r in index.match([("two",)]).collect()}
    for bad in ([(2, "two two")], [(3, "x"), (3, "two")], [(None, "two")]):
        with pytest.raises(ValueError):
            index.append(spark.createDataFrame(bad, DOCS))
    assert {r.id: r.score for r in index.match([("two",)]).collect()} == before
    assert index.manifest().where("file IS NULL").agg({"documents": "sum"}).first()[0] == 2
    index.append(spark.createDataFrame([], DOCS))
    assert {r.id: r.score for r in index.match([("two",)]).collect()} == before


def test_other_ids(spark):
    """Ids of another type, and columns of our own names."""
    words = spark.createDataFrame([(1, "a b")], DOCS)
    index = fulltext.Index(spark, new_path(spark, "index"))
    index.append(words.selectExpr("cast(id AS string) AS id", "text", "'x' AS term", "1 AS len"))
    assert [r.id for r in index.match([("b",)]).collect()] == ["1"]
