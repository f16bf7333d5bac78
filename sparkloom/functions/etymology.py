"""Reading etymology templates and prose: terms with modifiers, steps, parts, facts."""

from __future__ import annotations

import re
from typing import NamedTuple

#: Template names by the relation that they state.
KINDS = {
    **dict.fromkeys("inh inherited inh+".split(), "inh"), **dict.fromkeys("bor borrowed bor+ slbor ubor".split(), "bor"), **dict.fromkeys("lbor learned obor".split(), "lbor"),
    **dict.fromkeys("der derived der+ from uder".split(), "der"), **dict.fromkeys("cal calque clq pcal sl psm".split(), "cal"),
}
PARTS = frozenset("af affix afeq compound com prefix pre suffix suf confix con surf blend univ univerbation".split()) | {"surface analysis"}
SINGLE = frozenset("clipping clip back-formation bf backform deverbal abbrev ellipsis short".split())


class Term(NamedTuple):
    language: str
    text: str
    gloss: str = ""
    ident: str = ""


class Step(NamedTuple):
    child: Term | None  # None is the entry itself
    parent: Term
    kind: str
    inferred: bool


def bracketed(text: str) -> tuple[str, list[str]]:
    """Text before the first < and the contents of <...> at the outermost depth; brackets nest."""
    head, out, depth, start = "", [], 0, 0
    for k, c in enumerate(text):
        if c == "<":
            if not depth:
                start = k + 1
            depth += 1
        elif c == ">" and depth:
            depth -= 1
            if not depth:
                out.append(text[start:k])
        elif not depth and not out:
            head += c
    if depth:
        out.append(text[start:])
    return head.strip(), out


#: Fixed value: a language's code before a term, of two or three letters and up to three parts more.
_CODED = re.compile(r"([a-z]{2,3}(?:-[a-z]{2,4}){0,3}):(.+)")


def term(text: str, language: str) -> Term:
    """A term such as `fr:mot<t:word><id:x>`; without a code it is of `language`."""
    head, mods = bracketed(text or "")
    coded = _CODED.fullmatch(head)
    named: dict[str, str] = {}
    for m in mods:
        key, _, value = m.partition(":")
        named.setdefault({"gloss": "t"}.get(key, key), value)
    shown = coded[2] if coded else head
    return Term(coded[1] if coded else language, (shown or named.get("alt", "")).strip(), named.get("t", ""), named.get("id", ""))


#: What markup begins with, and what asks for a term in its script.
MARKUP, WANTED = ("[", "⇒", ">"), "script needed"


def is_word(text: str) -> bool:
    """Has a letter and is no markup, bare code (a colon with nothing close behind it) or request for a script."""
    if text.startswith(MARKUP) or WANTED in text:
        return False
    behind = [rest[:1] for rest in text.split(":")[1:]]
    return all(c and not c.isspace() for c in behind) and any(c.isalpha() for c in text)


def connection(prose: str) -> str:
    """How the template after some prose goes on: "+" a further part, "&" beside the one
    before, "." another sentence, "" the next step back."""
    if prose.rstrip().endswith("+"):
        return "+"
    stop = re.search(r"[.;](?:\s|$)", prose)
    if stop:
        rest = prose[stop.start() + 1 :]
        goes_on = re.search(r"\bfrom\s+(?:the\s+)?$", rest, re.I) and not re.search(r"\b(?:or|alternatively|compare|cognate|perhaps|possibly)\b", rest, re.I)
        return "" if goes_on else "."
    if re.search(r"\b(?:further|ultimately|in turn|itself|which is)\b[^,]*$", prose, re.I):
        return ""
    return "&" if re.search(r"\b(?:or|and|alternatively|either|influenced|compare|cognate|akin)\b", prose, re.I) else ""


def steps(language: str, templates: list[tuple[str, list[str], str]]) -> list[Step]:
    """Relations that templates (name, arguments, connection) state of an entry of `language`.

    Chain templates follow one another back in time; a "+" hangs a part and a "&" a
    second source on the child of the step before; an affix is a part of where the
    chain stands; "." ends the chain.
    """
    out: list[Step] = []
    here: Term | None = None
    below: list[Term | None] = []  # the child of the last step, once there is one
    ended = False
    for name, args, link in templates:
        if name in KINDS:
            ended = ended or link == "."
            if ended or len(args) < 3:
                continue
            parent = term(args[2], args[1])
            if not is_word(parent.text):
                continue
            affix = parent.text.lstrip("*").startswith("-") or parent.text.endswith("-")
            if below and (link in ("+", "&") or affix and here is not None):
                out.append(Step(below[0], parent, "part" if link == "+" or affix else KINDS[name], below[0] is not None))
            elif affix:
                out.append(Step(here, parent, "part", here is not None))
            else:
                out.append(Step(here, parent, KINDS[name], here is not None))
                below, here = [here], parent
        elif name in PARTS and args[:1] == [language]:
            found = [t for t in (term(a, language) for a in args[1:]) if is_word(t.text)]
            for k, t in enumerate(found):
                text = t.text
                if name in ("prefix", "pre") and k < len(found) - 1 or name in ("confix", "con") and k == 0:
                    text = text.rstrip("-") + "-"
                if name in ("suffix", "suf") and k or name in ("confix", "con") and k and k == len(found) - 1:
                    text = "-" + text.lstrip("-")
                out.append(Step(None, t._replace(text=text), "part", False))
        elif name in SINGLE and args[:1] == [language] and len(args) > 1:
            out.append(Step(None, term(args[1], language), "der", False))
        elif name == "root" and len(args) > 2:
            out += [Step(None, Term(args[1], bracketed(a)[0]), "root", False) for a in args[2:] if is_word(bracketed(a)[0])]
    return out


def sentences(text: str, short: frozenset[str] = frozenset("c. ca. cf. e.g. i.e. etc. v. n. adj. Lat. Gk. Fr. Ger. lit. orig. prob.".split())) -> list[str]:
    """Sentences of prose; not cut inside brackets or quotes, nor after an abbreviation."""
    out, part, depth = [], "", 0
    for word in re.findall(r"\S+\s*", text):
        part += word
        depth += sum(word.count(c) for c in "([“") - sum(word.count(c) for c in ")]”")
        w = word.strip()
        if depth <= 0 and re.search(r"[.!?][\"”')\]]*$", w) and w not in short:
            out.append(part.strip())
            part, depth = "", 0
    return [*out, part.strip()] if part.strip() else out


def shortened(text: str, budget: int) -> str:
    """Whole sentences within a budget; the first one in any case."""
    kept = ""
    for s in sentences(text):
        if kept and len(kept) + 1 + len(s) > budget:
            break
        kept = f"{kept} {s}".strip()
    return kept


def source_words(prose: str, languages: tuple[str, ...]) -> list[Term]:
    """Terms named after a language in prose, with a gloss in quotes or brackets if one follows."""
    names = "|".join(sorted(map(re.escape, languages), key=len, reverse=True))
    found = re.finditer(rf"\b({names})\s+(\*?[^\W\d_][\w’'\-]*)(?:\s*\(?[“\"‘]([^”\"’]+)[”\"’]\)?)?", prose)
    return [Term(m[1], m[2], m[3] or "") for m in found]


def with_fact(text: str, fact: str, most: int = 850) -> str:
    """Text with a sentence added, unless it says so already or would grow too long."""
    if fact.casefold() in text.casefold() or len(text) + 1 + len(fact) > most:
        return text
    return f"{text} {fact}".strip()


def parents_of(depths: list[int]) -> list[int | None]:
    """For a list of nested rows given by depth, the place of each row's parent."""
    open_: list[tuple[int, int]] = []
    out: list[int | None] = []
    for k, d in enumerate(depths):
        while open_ and open_[-1][0] >= d:
            open_.pop()
        out.append(open_[-1][1] if open_ else None)
        open_.append((d, k))
    return out


def tile(word: str, pieces: list[str], least: int = 2, most: int = 4) -> list[str] | None:
    """The word as two to four of the pieces, longest first at each place; None if they don't fit."""
    options = sorted(set(pieces), key=lambda p: (-len(p), p))

    def rest(at: int, taken: list[str]) -> list[str] | None:
        if at == len(word):
            return taken if least <= len(taken) <= most else None
        if len(taken) == most:
            return None
        for p in options:
            if p and word.startswith(p, at):
                found = rest(at + len(p), [*taken, p])
                if found:
                    return found
        return None

    return rest(0, [])


def corroboration(pieces: list[tuple[str, str]], prose: str) -> str:
    """ok if the prose names every piece's form or meaning, suspect if none, else unverified."""
    named = [any(x and x.casefold() in prose.casefold() for x in p) for p in pieces]
    return "ok" if named and all(named) else "unverified" if any(named) or not prose else "suspect"


def roman(n: int) -> str:
    """Roman numerals."""
    out = ""
    for value, sign in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "M CM D CD C XC L XL X IX V IV I".split(), strict=True):
        out += sign * (n // value)
        n %= value
    return out
