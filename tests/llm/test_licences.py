"""Licence scans: lines without words, wrapped notices, and Dice by brute force."""

import random
import re
import textwrap
from collections import Counter

from compare import DATA

from sparkloom.llm import licences
from sparkloom.llm.shared import table

MIT = licences.TEMPLATES["MIT"][2]
TEXTS = [
    "The software license\n\nis here granted", "Released under the MIT License.\n", "some software license\n-----\nmore", "license", "", None, "\n", "MIT License",
    "int main() {}\n/*\n" + "\n".join(" * " + x for x in textwrap.wrap(MIT, 60)) + "\n*/\nreturn 0;",
    "Copyright 2024 Some Body. Released under the MIT License. Enjoy", "x Released under the MIT License. y\n" * 5,
    MIT.replace(" to deal ", " to deal well ").replace("sublicense", "sub license"), "word " * 30_000 + MIT + " word" * 30_000, MIT[: len(MIT) // 2], MIT.upper() + "\n\n" + licences.TEMPLATES["ISC"][0], f"{MIT} " * 3,
]


def plain_words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def pairs(words):
    return list(zip(words, words[1:], strict=False))


def brute(text, templates=None):
    """(licences, units, best Dice) over every window of every length, for every template."""
    doc, found = pairs(plain_words(text)), []
    for name, of in (templates or licences.TEMPLATES).items():
        for template in of:
            known, size = Counter(pairs(plain_words(template))), len(pairs(plain_words(template)))
            for first, p in enumerate(doc):
                if p not in known:
                    continue
                best, both, seen = (0.0, -1), 0, Counter()
                for last in range(first, min(len(doc), first + 2 * size)):  # beyond the size bounds, too
                    seen[doc[last]] += 1
                    both += seen[doc[last]] <= known[doc[last]]
                    if doc[last] in known:
                        best = max(best, (2 * both / (last - first + 1 + size), last))
                if best[0] >= licences.LEAST:
                    found.append((first, best[1], name, best[0]))
    taken = []
    for first, last, name, dice in sorted(found, key=lambda x: (-x[3], x[0] - x[1], x[2], x[0])):
        if all(last < f or first > l for f, l, _, _ in taken):
            taken.append((first, last, name, dice))
    return ",".join(sorted({x[2] for x in taken})), len(taken), max((x[3] for x in taken), default=0.0)


def test_brute_force(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in licences.scan(rows).collect()}
    want = {k: brute(t) for k, t in enumerate(TEXTS)}
    assert got == want
    assert want[8][:2] == ("MIT", 1) and want[10][:2] == ("MIT", 5) and want[14][:2] == ("ISC,MIT", 2) and want[15][:2] == ("MIT", 3) and want[0][1] == want[2][1] == 0


def test_insertions(spark):
    """Clauses and words put into a notice, and left out: every length that the bounds allow."""
    long_ = max((x for of in licences.TEMPLATES.values() for x in of), key=len)
    words, r = long_.split(), random.Random(3)
    name = next(k for k, of in licences.TEMPLATES.items() if long_ in of)
    texts = [" ".join([*words[: len(words) // 2], *(f"extra{k}" for k in range(n)), *words[len(words) // 2 :]]) for n in (1, 9, 16, 22, 29, 40)]
    texts += [" ".join(x for k, w in enumerate(words) for x in ([w, "noise"] if k % 24 == 23 else [w])), " ".join(words[: -len(words) // 8]), " ".join(words[20:]), " ".join(w for w in words if r.random() > 0.04)]
    texts = [f"before the notice {t} and behind it" for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    only = {name: (long_,)}
    got = {r.doc_id: tuple(r)[1:] for r in licences.scan(rows, only).collect()}
    want = {k: brute(t, only) for k, t in enumerate(texts)}
    assert got == want
    assert [got[k][1] for k in range(5)] == [1] * 5 and got[6][1] == 1 and got[5][2] in (0.0, want[5][2])
    assert got[2][2] > 0.93 and got[3][2] > 0.91 and got[1][2] > 0.95


def test_fixture(spark):
    docs = table(spark, DATA, "documents")
    got = {r.doc_id: tuple(r)[1:] for r in licences.scan(docs).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == brute(r.text)


def test_no_templates(spark):
    rows = spark.createDataFrame([(1, "license"), (1, "license")], "doc_id long, text string")
    assert [r.n_units for r in licences.scan(rows, {}).collect()] == [0, 0]
    assert licences.scan(rows, {"X": ("one",)}).count() == 2
