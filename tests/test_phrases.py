"""Phrases with gaps against a plain search, text by text."""

import random
import re

import pytest

from sparkloom.operators import phrases

GAPS = ("the", "a", "of")
TOKEN = re.compile(r"[^\W_]+|[,.;:!?()«»\"—–\n]")


def plain(text, index, most=2):
    """[(phrase, start, places, gaps)] that stand; index is phrase to words."""
    w = [x.lower() for x in TOKEN.findall(text or "")]

    def walk(at, words, left):
        if not words:
            return []
        for g in range(left + 1):
            if at + g < len(w) and w[at + g] == words[0] and (rest := walk(at + g + 1, words[1:], left - g)) is not None:
                return [at + g, *rest]
            if at + g >= len(w) or w[at + g] not in GAPS:
                return None
        return None

    found = []
    for start, first in enumerate(w):
        for name, words in index.items():
            if len(words) > 1 and words[0] == first and (rest := walk(start + 1, words[1:], most)) is not None:
                places = [start, *rest]
                found.append((places[-1] - start + 1 - len(places), -len(places), start, name, places))
    taken, kept = set(), []
    for gaps, _, start, name, places in sorted(found):
        if not taken & set(places):
            taken |= set(places)
            kept.append((name, start, tuple(places), gaps))
    return kept


def frames(spark, texts, index):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string"), spark.createDataFrame([(k, v) for k, v in index.items()], "phrase string, words array<string>")


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_against_plain(spark, most):
    r = random.Random(most)
    vocabulary = ["the", "a", "of", "go", "way", "long", ",", ".", "é"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 60))) for _ in range(60)]
    index = {}
    for _ in range(40):
        words = [r.choice([v for v in vocabulary if v not in ",."]) for _ in range(r.randrange(1, 6))]
        index[" ".join(words)] = words
    got = [(x.id, x.phrase, x.start, tuple(x.places), x.gaps) for x in phrases.match(*frames(spark, texts, index), GAPS, most).collect()]
    want = [(k, *x) for k, t in enumerate(texts) for x in plain(t, index, most)]
    assert sorted(got) == sorted(want) and len(want) > 100


def test_choice(spark):
    """Fewest gaps before longest before first; signs aren't crossed; words between stay free for others."""
    index = {"go way": ["go", "way"], "go long way": ["go", "long", "way"], "long way": ["long", "way"], "the of": ["the", "of"], "way": ["way"]}
    texts = ["go long way", "go the long way", "go the of way", "go, way", "Go THE way", "go (the) way", "go way way", None, "", "way"]
    got = {}
    for x in phrases.match(*frames(spark, texts, index), GAPS).collect():
        got.setdefault(x.id, []).append((x.phrase, x.start, x.gaps))
    assert {k: sorted(v) for k, v in got.items()} == {0: [("go long way", 0, 0)], 1: [("long way", 2, 0)], 2: [("go way", 0, 2), ("the of", 1, 0)], 4: [("go way", 0, 1)], 6: [("go way", 0, 0)]}
    assert phrases.match(*frames(spark, texts[:0] or [None], index), GAPS).count() == 0
    assert phrases.match(*frames(spark, texts, {"way": ["way"]}), GAPS).count() == 0


def test_long_text(spark):
    """One text of many stretches: each is settled by itself."""
    index = {"go way": ["go", "way"], "way go": ["way", "go"]}
    text = "go way go . " * 3000
    got = phrases.match(*frames(spark, [text], index), GAPS).collect()
    assert len(got) == 3000 and {x.phrase for x in got} == {"go way"}
