"""Segmentation of words into prefixes, roots and suffixes, and related text functions."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple


class Morpheme(NamedTuple):
    kind: str  # prefix, root or suffix
    form: str
    meaning: str


#: A small default table; callers pass their own.
DEFAULT: tuple[Morpheme, ...] = tuple(
    Morpheme(kind, form, meaning)
    for kind, rows in {
        "prefix": "anti against|auto self|bi two|co with|de down|dis apart|en in|ex out|hyper over|in not|inter between|micro small|mono one|non not|over above|post after|pre before|re again|sub under|tele far|trans across|un not",
        "root": "bio life|chron time|cred believe|dict say|duct lead|geo earth|graph write|log word|meter measure|mit send|phon sound|photo light|port carry|scop see|scrib write|script write|spect look|struct build|therm heat|vis see|voc call",
        "suffix": "able able|al of|ation act|ed past|er one|est most|ful full|ible able|ic of|ing act|ion act|ism belief|ist one|ity state|ive tending|less without|ly like|ment result|ness state|ous full|y state",
    }.items()
    for form, meaning in (x.split(" ", 1) for x in rows.split("|"))
)


class Piece(NamedTuple):
    text: str
    kind: str
    meaning: str


#: Scores: a letter covered, a root, a piece, a linking vowel, a letter left over.
LETTER, ROOT, PIECE, LINK, LOST = 1.0, 1.0, -0.12, 0.05, -0.7


@lru_cache(maxsize=32)
def _by_start(table: tuple[Morpheme, ...]) -> dict[str, list[Morpheme]]:
    found: dict[str, list[Morpheme]] = {}
    for m in sorted(table, key=lambda m: -len(m.form)):
        found.setdefault(m.form[0], []).append(m)
    return found


def decompose(word: str, table: tuple[Morpheme, ...] = DEFAULT) -> list[Piece]:
    """Best parse as prefixes, then roots with linking vowels, then suffixes.

    Best-first over (place, stage) from the end: each state's best score is final
    once found; among equal scores the longer form stands.  A final e behind a
    root is a silent suffix.  Letters that no form covers are pieces of kind
    unknown.  Pieces join to the word.
    """
    w = word.lower()
    n = len(w)
    if not w.isascii() or not w.isalpha():
        return [Piece(w, "word", "")] if w else []
    starts = _by_start(table)
    stages = {"prefix": 0, "root": 1, "suffix": 2}
    best: dict[tuple[int, int], tuple[float, tuple[Piece, ...]]] = {(n, s): (0.0, ()) for s in range(3)}
    for at in range(n - 1, -1, -1):
        for stage in range(2, -1, -1):
            options = []
            for m in starts.get(w[at], ()):
                to = stages[m.kind]
                if to >= stage and w.startswith(m.form, at):
                    score, rest = best[at + len(m.form), to]
                    options.append((score + len(m.form) * LETTER + PIECE + (ROOT if m.kind == "root" else 0), (Piece(m.form, m.kind, m.meaning), *rest)))
            if stage == 1 and w[at] in "aeiou" and at + 1 < n:
                score, rest = best[at + 1, 1]
                if rest and rest[0].kind == "root":
                    options.append((score + LINK, (Piece(w[at], "linker", ""), *rest)))
            if at == n - 1 and w[at] == "e" and stage >= 1:
                options.append((LINK, (Piece("e", "suffix", "silent"),)))
            score, rest = best[at + 1, stage]
            joined = (Piece(w[at] + rest[0].text, "unknown", ""), *rest[1:]) if rest and rest[0].kind == "unknown" else (Piece(w[at], "unknown", ""), *rest)
            options.append((score + LOST, joined))
            best[at, stage] = max(options, key=lambda o: o[0])
    return list(best[0, 0][1])


def literal(pieces: list[Piece]) -> str:
    """A reading from the pieces' meanings."""
    return " + ".join(p.meaning for p in pieces if p.meaning and p.kind in ("prefix", "root", "suffix"))


_TOKEN = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")


def tokens(text: str) -> list[tuple[int, int, str]]:
    """(start, length, token) of words, with inner apostrophes and hyphens."""
    return [(m.start(), m.end() - m.start(), m[0]) for m in _TOKEN.finditer(text)]


def similar_prefix(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def split_depth(text: str, separator: str = ",") -> list[str]:
    """Parts of a text at separators outside brackets of any kind."""
    out, depth, part = [], 0, ""
    for c in text:
        depth += (c in "([{<") - (c in ")]}>")
        if c == separator and depth <= 0:
            out.append(part.strip())
            part = ""
        else:
            part += c
    return [*out, part.strip()]


def align(word: str, parts: list[str], joins: dict[str, tuple[str, ...]] | None = None) -> list[str] | None:
    """The stretches of a word that stand for its parts in order; a part may lose a final
    vowel or stand in one of its other forms.  None if they don't fit."""

    def forms(p: str) -> list[str]:
        plain = p.strip("-")
        return sorted({plain, *((joins or {}).get(plain, ())), *([plain[:-1]] if len(plain) > 2 and plain[-1] in "aeiouy" else [])}, key=lambda f: (-len(f), f))

    def rest(at: int, k: int) -> list[str] | None:
        if k == len(parts):
            return [] if at == len(word) else None
        for f in forms(parts[k]):
            if word.startswith(f, at):
                found = rest(at + len(f), k + 1)
                if found is not None:
                    return [word[at : at + len(f)], *found]
        return None

    return rest(0, 0)


def chosen(own: list[Piece] | None, curated: list[Piece] | None, word: str, table: tuple[Morpheme, ...] = DEFAULT) -> list[Piece]:
    """An entry's own analysis, else a curated one that tiles the word, else the engine's if it
    has a root and nothing unknown, else the whole word."""
    if own:
        return own
    if curated and "".join(p.text for p in curated) == word:
        return curated
    parsed = decompose(word, table)
    good = any(p.kind == "root" for p in parsed) and all(p.kind != "unknown" for p in parsed)
    return parsed if good else [Piece(word, "word", "")]


def rescued(word: str, table: tuple[Morpheme, ...], more: tuple[Morpheme, ...]) -> list[Piece] | None:
    """A parse with further morphemes where the one without has unknown letters and the one with has none."""
    bad = any(p.kind == "unknown" for p in decompose(word, table))
    new = decompose(word, (*table, *more))
    return new if bad and all(p.kind != "unknown" for p in new) else None


def collisions(form: str, words: list[str], table: tuple[Morpheme, ...], added: Morpheme) -> list[tuple[str, str, str]]:
    """(word, parse before, parse after) of words that a new morpheme would change."""
    out = []
    for w in words:
        if form in w:
            a, b = ("+".join(p.text for p in decompose(w, t)) for t in (table, (*table, added)))
            if a != b:
                out.append((w, a, b))
    return out


def quoted_reading(gloss: str) -> str | None:
    """What an abbreviation stands for, where the gloss quotes it."""
    m = re.search(r"[“\"‘]([^”\"’]{3,})[”\"’]", gloss)
    return m[1] if m else None


#: Parts of speech as they are shown.
PARTS_OF_SPEECH = {"noun": "noun", "verb": "verb", "adj": "adjective", "adv": "adverb", "prep": "preposition", "pron": "pronoun", "conj": "conjunction", "intj": "interjection", "det": "determiner", "num": "numeral", "name": "name", "phrase": "phrase"}
