"""Segmentation against a search of all parses, and the index of morphemes."""

import random
import re
from functools import lru_cache

import pytest

from sparkloom.operators import morphemes as m


def plain(word, table):
    """Best parse by recursion, options in order, only better ones replacing."""
    if not re.fullmatch("[a-z]+", word):
        return 0, [("word", word, None)]
    n = len(word)

    def forms(kind, at):
        found = [t for t in table if t[0] == kind and t[1] and word.startswith(t[1], at)]
        found = [t for t in found if (not t[4] or re.search(t[4], word[at + len(t[1]) :])) and (not t[5] or re.search(t[5], word)) and not (t[6] and re.search(t[6], word))]
        return sorted(found, key=lambda t: (-len(t[1]), t[3], t[2]))

    @lru_cache(None)
    def best(at, zone):
        if at == n:
            return 0, ()
        options = []
        kind = ("prefix", "root", "suffix")[zone]
        for t in forms(kind, at):
            if zone or n - at - len(t[1]) >= 2:
                s, rest = best(at + len(t[1]), zone)
                options.append((s + 100 * len(t[1]) - 12 + 100 * (zone == 1), ((kind, t[1], t[2]), *rest)))
        if zone == 1 and word[at] in "aeiouy" and forms("root", at + 1):
            s, rest = best(at + 1, 1)
            options.append((s + 5 - 12, (("linker", word[at], None), *rest)))
        if zone == 2:
            if at == n - 1 and word[at] == "e":
                options.append((5 - 12, (("silent", "e", None),)))
            if not forms("suffix", at):
                end = next((k for k in range(at + 1, n) if forms("suffix", k)), n)
                s, rest = best(end, 2)
                options.append((s - 70 * (end - at) - 12, (("unknown", word[at:end], None), *rest)))
        else:
            options.append(best(at, zone + 1))
        return max(options, key=lambda o: o[0])

    score, parts = best(0, 0)
    parts = list(parts)
    for k in range(len(parts) - 1, 0, -1):
        if parts[k][0] == parts[k - 1][0] == "unknown":
            parts[k - 1 : k + 1] = [("unknown", parts[k - 1][1] + parts[k][1], None)]
    kind, text, ident = parts[-1]
    if kind == "root" and len(text) >= 4 and text[-1] == "e" and any(t[0] == "root" and t[2] == ident and t[1] == text[:-1] for t in table):
        parts[-1:] = [("root", text[:-1], ident), ("silent", "e", None)]
    return score, parts


def got(spark, words, table):
    frame = spark.createDataFrame([(w,) for w in words], "word string").repartition(3)
    return {r.word: (r.score, [tuple(p) for p in r.parts]) for r in m.decompose(frame, spark.createDataFrame(table, m.TABLE)).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_recursion(spark, seed):
    r = random.Random(seed)
    letters = "abce"[: seed + 1] + "t"
    word = lambda a, b: "".join(r.choice(letters) for _ in range(r.randint(a, b)))
    table = [(r.choice(["prefix", "root", "suffix"]), word(1, 4), f"m{r.randrange(15)}", k, r.choice([None, None, "^a", "t$"]), r.choice([None, None, "e$"]), r.choice([None, None, "^t"])) for k in range(30)]
    words = {word(1, 12) for _ in range(300)} | {"é" + word(1, 3), "A", "two words", "x-y"}
    assert got(spark, [*words, "", None, *list(words)[:5]], table) == {w: plain(w, table) for w in words}


def test_known_words(spark):
    table = [tuple(r) for r in m.default_table(spark).collect()]
    table += [("root", "scope", "root:scop", 900, None, None, None), ("prefix", "a", "ad", 901, "^s[^aeiouy]", None, None), ("prefix", "a", "not", 902, "^(s[aeiouy]|[^s])", None, None), ("prefix", "in", "into", 903, None, None, "(?:ible|able)$")]
    words = ["biography", "microscope", "ascribe", "avocal", "inscribe", "invisible", "chronometer", "zzz", "unbelievable"]
    parsed = got(spark, words, table)
    assert parsed == {w: plain(w, table) for w in words}
    texts = {w: [t for _, t, _ in parts] for w, (_, parts) in parsed.items()}
    assert texts["biography"] == ["bio", "graph", "y"] and texts["microscope"] == ["micro", "scop", "e"] and texts["chronometer"] == ["chron", "o", "meter"]
    assert parsed["ascribe"][1][0] == ("prefix", "a", "ad") and parsed["avocal"][1][0] == ("prefix", "a", "not")
    assert got(spark, ["word"], []) == {"word": (4 * -70 - 12, [("unknown", "word", None)])}


def test_index(spark):
    """Both ends of a morpheme's words, through the gates."""
    table = [("root", "port", "carry", 0, None, None, None), ("suffix", "s", "many", 1, None, None, None), ("prefix", "re", "again", 2, None, None, None), ("prefix", "trans", "across", 3, None, None, None)]
    table += [("suffix", f"{'a' * k}b", f"s{k}", 10 + k, None, None, None) for k in range(1, 9)]
    words = ["port", "ports", "report", "reports", "transport", "transports", "portx", "res", *(f"port{'a' * k}b" for k in range(1, 9))]
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    parsed = m.decompose(frame, spark.createDataFrame(table, m.TABLE))
    got = sorted((r.id, r["rank"], r.word, r.n) for r in m.index(parsed, 3, 2).collect())
    carry = sorted((w for w in words if "port" in w and not w.endswith("x")), key=lambda w: (len(w), w))
    want = [("across", 1, "transport", 2), ("across", 2, "transports", 2)]
    want += [("carry", k + 1, w, len(carry)) for k, w in enumerate(carry) if k < 3 or k >= len(carry) - 2]
    want += [(f"s{k}", 1, f"port{'a' * k}b", 1) for k in range(2, 9)]
    assert got == sorted(want)
