"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import spelling

WORDS, DOCS = "word string, n long", "doc_id long, text string"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    s, t = sorted((a, b), key=len)
    return any(t[:k] + t[k + 1 :] == s for k in range(len(t)))


def plain(words, ratio=10):
    """(word, n, n_near, form, form_n, root) by comparing all pairs."""
    forms, rows = {}, {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best and words[best] >= ratio * n else None
        rows[w] = [w, n, len(near), forms[w], words[best] if forms[w] else None]
    for w, row in rows.items():
        root = w
        while forms[root]:
            root = forms[root]
        row.append(root)
    return sorted(map(tuple, rows.values()))


def got(df):
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect())


def vocabulary(seed, letters, n, longest=9):
    r = random.Random(seed)
    return {"".join(r.choice(letters) for _ in range(r.randint(1, longest))): int(2 ** r.uniform(0, 20)) + 1 for _ in range(n)}


@pytest.mark.parametrize(("letters", "shard", "room"), [("ab", 50_000, 10**8), ("abé", 40, 10**8), ("abcÿ", 25, 0), ("abcdef", 100, 0)])
def test_against_pairs(spark, letters, shard, room):
    """One shard and many, broadcast and dealt."""
    words = vocabulary(len(letters), letters, 300)
    frame = spark.createDataFrame(list(words.items()), WORDS).repartition(3)
    assert got(spelling.variants(frame, shard_words=shard, broadcast_bytes=room)) == plain(words)


def test_one_beginning(spark):
    """All words begin alike, or end alike, over many shards."""
    tails = vocabulary(7, "abc", 120, 6)
    words = {f"{'common' * 20}{w}": n for w, n in tails.items()} | {f"{w}{'common' * 20}": n for w, n in tails.items()}
    frame = spark.createDataFrame(list(words.items()), WORDS)
    for room in (10**8, 0):
        assert got(spelling.variants(frame, shard_words=15, broadcast_bytes=room)) == plain(words)


def test_chains_and_ties(spark):
    """Forms of forms to the end; of two equally frequent neighbours the first by code points."""
    words = {"a" * k + "b" * (30 - k): 2 * 10**k for k in range(8)} | {"formeda": 500, "formedz": 500, "formedé": 500, "formed": 3}
    want = plain(words)
    assert len({r[5] for r in want if set(r[0]) <= {"a", "b"}}) == 1
    frame = spark.createDataFrame(list(words.items()), WORDS)
    assert got(spelling.variants(frame)) == want


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=7), min_size=1, max_size=60))
def test_trie(words):
    """Every neighbour once: from the front those behind the first half, from the back the others."""
    held = sorted(x.encode() for x in words)
    back = sorted(x[::-1] for x in held)
    front = spelling.Trie.unpacked(spelling.Trie(held, range(len(held))).packed())
    behind = spelling.Trie.unpacked(spelling.Trie(back, range(len(back))).packed())
    for w in held:
        half = len(w) // 2
        found = [front.text(k) for k in front.near(w, half)]
        ends = [behind.text(k)[::-1] for k in behind.near(w[::-1], len(w) - half)]
        found += [x for x in ends if x[:half] != w[:half]]
        assert sorted(found) == [x for x in held if one_edit(w, x)]
        assert [front.text(k) for k in sorted(front.near(w, 0))] == [x for x in held if one_edit(w, x)]
        n = [spelling.searched(t, w, 1, b)[0] for t, b in ((front, False), (behind, True))]
        assert sum(n) == len(found)


def test_bounds():
    """No shard that could hold a prefix's words is passed by, also where bounds are cut off."""
    r = random.Random(6)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randint(1, 12))) + "z" * r.choice([0, 0, 70]) for _ in range(400)} | {"a" * k for k in range(60, 90)})
    parts = [words[k : k + 9] for k in range(0, len(words), 9)]
    bounds = spelling.Bounds([(p[0][: spelling.BOUND], p[-1][: spelling.BOUND], k) for k, p in enumerate(parts)])
    for w in words:
        for size in range(len(w) + 1):
            need = {k for k, p in enumerate(parts) if any(x.startswith(w[:size]) for x in p)}
            assert need <= set(bounds.of(w[:size]))


def plain_counts(docs, least_length=7, least_count=2, slips=31):
    n = Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if slips and h % slips == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= least_length
    return {w: c for w, c in n.items() if c >= least_count}


def odd_docs():
    r = random.Random(1)
    words = ["".join(r.choice("etaoinÉéßÿ×") for _ in range(r.randint(5, 10))) for _ in range(150)]
    docs = [(k, " ".join(r.choice(words) for _ in range(60))) for k in range(60)]
    return [*docs, (None, docs[0][1]), (None, docs[0][1]), (5, docs[5][1]), (70, None), (71, ""), (72, "a" * 3000 + " " + "A" * 3000), (73, "Ünïcödé-wördş, ŁÓDŹword wordword Wordword日wordword\0wordword"), (74, " ".join(words * 60))]


@pytest.mark.parametrize("slips", [0, 31])
def test_documents(spark, slips, monkeypatch):
    monkeypatch.setattr(spelling, "COUNTED", 50)  # tasks send counts on often
    docs = odd_docs()
    frame = spark.createDataFrame(docs, DOCS).repartition(3)
    assert got(spelling.spelling_variants(frame, slips=slips)) == plain(plain_counts(docs, slips=slips))


def test_edges(spark):
    """No rows, nulls, repeated rows, columns of our own names, ratios that wouldn't end."""
    frame = spark.createDataFrame(odd_docs()[:20], DOCS)
    clash = frame.selectExpr("*", "'x' AS word", "1 AS n", "2 AS ident", "'f' AS form")
    assert got(spelling.spelling_variants(clash)) == got(spelling.spelling_variants(frame))
    for room in (10**8, 0):
        assert spelling.spelling_variants(frame.limit(0), broadcast_bytes=room).count() == 0
    rows = spark.createDataFrame([("worded", 3), ("worded", 4), ("word", 1), (None, 5), ("", 6), ("words", 80)], WORDS)
    assert got(spelling.variants(rows)) == plain({"worded": 7, "word": 1, "words": 80})
    with pytest.raises(ValueError):
        spelling.variants(rows, ratio=1)
