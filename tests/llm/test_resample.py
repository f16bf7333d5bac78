"""Importance resampling against a plain re-computation, and what is drawn."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import resample

DOCS, TARGET = "doc_id long, text string", "text string"
CLASS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return CLASS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, target, percent=10, buckets=10_000, run=1, least=20):
    """(doc_id, n_features, weight, score, rank) of every row."""

    def places(words):
        grams = [" ".join(words[k : k + n]) for n in range(1, run + 1) for k in range(len(words) - n + 1)]
        return [zlib.crc32(g.encode()) % buckets for g in grams]

    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(places(plain_words(x)))
    for x in target:
        t.update(places(plain_words(x)))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets))))
    rows = []
    for i, x in docs:
        at = places(plain_words(x))
        weight = sum(map(gain, at)) // len(at) if at else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(at), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(plain_words(x)) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], -(2**63) if r[0] is None else r[0], r[1]))
    quota = percent * len(able) // 100
    return sorted([(*r[:4], k + 1 if k < quota else None) for k, r in enumerate(able)] + [(*r[:4], None) for r in rows if not r[4]], key=str)


def frames(spark, docs, target):
    return spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame([(x,) for x in target], TARGET)


def rows(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def some(r, n, of):
    return " ".join(r.choice(of) for _ in range(n))


@pytest.mark.parametrize(("run", "buckets", "percent"), [(1, 10_000, 10), (2, 97, 35), (3, 1, 100)])
def test_against_plain(spark, run, buckets, percent):
    r = random.Random(run)
    words = [f"W{k}é" if k % 7 == 0 else f"w{k}_x" for k in range(300)]
    docs = [(k, some(r, r.randrange(0, 80), words[: 60 + k])) for k in range(200)]
    docs += [(None, some(r, 30, words)), (None, some(r, 30, words)), (500, None), (501, ""), (502, "?! .."), (7, docs[7][1]), (8, some(r, 40, words)), (900, some(r, 30_000, words))]
    target = [some(r, 40, words[:90]), None, "", "日本 語"]
    d, t = frames(spark, docs, target)
    assert rows(resample.resample(d, t, percent, buckets, run)) == plain(docs, target, percent, buckets, run)


def test_one_score(spark):
    """All documents of one score: numbered by id over ranges of ids, whatever their size."""
    scores = spark.createDataFrame([(None if k == 0 else k * k, 20, k % 3, 0, 5 if k < 400 else 4) for k in range(500)], "doc_id long, n_words long, n_features long, weight long, score long").repartition(3)
    want = {(None if k == 0 else k * k, k + 1 if k < 250 else None) for k in range(500)}
    for group in (1_000_000, 60, 7):
        got = resample.drawn(scores, 50, group=group).collect()
        assert {(r.doc_id, r["rank"]) for r in got} == want and len(got) == 500


def test_histogram(spark):
    """Suffix sums over scores far apart and of both signs."""
    r = random.Random(2)
    n = {r.randrange(-40_000, 60_000): r.randrange(1, 50) for _ in range(500)} | {-1: 2, 0: 3, 255: 1, 256: 4, -256: 5, -257: 6}
    got = {x.score: (x.n, x.above) for x in resample.above(spark.createDataFrame(list(n.items()), "score long, n long")).collect()}
    assert got == {s: (c, sum(y for x, y in n.items() if x > s)) for s, c in n.items()}


def test_edges(spark):
    r = random.Random(9)
    words = [f"w{k}" for k in range(50)]
    docs = [(k, some(r, 25, words)) for k in range(40)]
    d, t = frames(spark, docs, ["w1 w2"])
    none_d, none_t = d.limit(0), t.limit(0)
    assert resample.resample(none_d, t).count() == 0 and resample.resample(none_d, none_t).count() == 0
    assert rows(resample.resample(d, none_t)) == plain(docs, [])
    clash = d.selectExpr("*", "'x' AS score", "1 AS rank", "2 AS above", "3 AS n_words", "'b' AS bucket", "'i' AS id", "4 AS __id")
    assert rows(resample.resample(clash, t)) == plain(docs, ["w1 w2"])
    kept = resample.draw(clash.drop("__id"), t)
    assert kept.columns == clash.drop("__id").columns and {x.doc_id for x in kept.collect()} == {x[0] for x in plain(docs, ["w1 w2"]) if x[4]}
    short = d.withColumn("text", F.lit("few words"))
    assert all(x["rank"] is None for x in resample.resample(short, t).collect())
    for bad in (0, resample.MOST_BUCKETS + 1):
        with pytest.raises(ValueError):
            resample.resample(d, t, buckets=bad)


def test_target_is_favoured(spark):
    """Of two sources of texts, the draw holds mostly the one that is like the target."""
    r = random.Random(4)
    ours, other = [f"near{k}" for k in range(200)], [f"far{k}" for k in range(200)]
    docs = [(k, some(r, 60, ours if k % 2 else other)) for k in range(400)]
    d, t = frames(spark, docs, [some(r, 30_000, ours)])
    drawn = [x.doc_id for x in resample.resample(d, t).collect() if x["rank"]]
    assert len(drawn) == 40 and sum(k % 2 for k in drawn) >= 39
