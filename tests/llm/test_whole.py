"""Inputs on which less than the whole job shows."""

import hashlib
import random

import brute
import pytest

import corpus_pipeline
from sparkloom.llm import htmltext, suffixdedup

STAGES = dict(corpus_pipeline.STAGES)


def test_stage_threshold(spark):
    """The pipeline's near duplicates are pairs at 80 % or more: against all pairs, and on both sides of the threshold."""
    docs = []
    for at, changed in ((0, 10), (10, 11), (20, 16), (30, 7)):  # of 96 shingles: 81.1 %, 79.4 %, 71.4 %, 86.4 %
        words = [f"a{at}x{k}" for k in range(100)]
        docs += [(at, " ".join(words)), (at + 1, " ".join(words[: 100 - changed] + [f"b{at}x{k}" for k in range(changed)]))]
    sets = {i: brute.shingle_set(t) for i, t in docs}
    gone = {b for a, _ in docs for b, _ in docs if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert gone == {1, 31}
    got = STAGES["near duplicates"](spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    assert {r.doc_id for r in got.collect()} == {i for i, _ in docs} - gone


def test_rows_of_one_id(spark):
    """Rows without ids, rows with different texts under one id and equal rows keep to their own texts."""
    r = random.Random(4)
    some = lambda n: " ".join(f"w{r.randrange(10_000)}" for _ in range(n))
    passage, base, twice = some(40), some(80), some(60)
    docs = [(None, some(30)), (None, f"{some(20)} {passage} {some(20)}"), (None, f"{passage} {some(10)}"), (None, None), (1, base), (1, f"{some(30)} {base[50:300]}"), (2, some(90)), (3, twice), (3, twice), (3, some(25)), (4, passage)]
    key = lambda i, t, k: (-(2**63) if i is None else i, hashlib.sha256(t.encode()).hexdigest() if t is not None else "", k)
    keyed = [(key(i, t, k), t) for k, (i, t) in enumerate(docs)]
    want = brute.remove_repeats(keyed)
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, row string").repartition(3)
    got = suffixdedup.remove(frame, block_bytes=500, shard_bytes=500, piece_bytes=200).collect()
    assert sorted((x.doc, x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(x.kept).hexdigest()) for x in got) == sorted((k[0], *w) for k, w in want.items())
    out = STAGES["suffix array"](spark, frame, "").collect()
    assert sorted((x.doc_id or 0, hashlib.sha256((x.text or "").encode()).hexdigest()) for x in out) == sorted((docs[k[2]][0] or 0, w[3]) for k, w in want.items())


def test_skewed_paragraphs():
    """Pages without <article>: nothing of the article goes because another part of it is long."""
    long_, short = "A long sentence, of some words; it goes on. " * 200, "A short sentence, of few words. " * 15
    long_, short = long_.strip(), short.strip()
    nav = "<nav><a href=x>Home</a></nav>"
    for page in (
        f"<body>{nav}<div><p>{long_}</p><p>{short}</p></div></body>",
        f"<body>{nav}<div class='w-1/2'><section class=a><p>{long_}</p></section><section class=b><p>{short}</p></section></div></body>",
        f"<body>{nav}<div><ul><li>{long_}</li></ul><p>{short}</p></div></body>",
        f"{nav}<p>{long_}</p><p>{short}</p>",
    ):
        assert htmltext.main_text(page) == f"{long_}\n\n{short}"
    assert htmltext.main_text(f"<body>{nav}<div><h2>Head</h2><p>{long_}</p></div><footer>Imprint</footer></body>") == f"Head\n\n{long_}"


@pytest.mark.parametrize("length", [33, 64, 400])
def test_lengths(spark, length):
    """Other lengths than 100, against brute force; others are refused."""
    r = random.Random(length)
    some = lambda n: " ".join(f"w{r.randrange(10_000)}" for _ in range(n))
    passage, other = some(400), some(20)
    docs = [(1, passage), (2, f"{some(9)} {passage} {some(9)}"), (3, f"{some(9)} {passage[300:1200]} {other}"), (4, other), (5, "ab" * 900), (6, passage[:500] + other)]
    want = brute.remove_repeats(docs, length)
    got = suffixdedup.remove(spark.createDataFrame(docs, "doc_id long, text string"), length, block_bytes=2_000, shard_bytes=2_000, piece_bytes=500).collect()
    assert {x.doc: (x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(x.kept).hexdigest()) for x in got} == want
    for bad in (32, 16_001):
        with pytest.raises(ValueError):
            suffixdedup.repeats(suffixdedup.rowed(spark.createDataFrame(docs, "doc_id long, text string")), bad)
