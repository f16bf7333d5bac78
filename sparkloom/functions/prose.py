"""A pushdown parser for etymologies in prose.

Tokens are words, signs and whole quotations.  Brackets are the stack: what stands in a bracket explains the step before it, so that a
"from" in there goes back from that step, and the closing bracket returns to where the text was.  The tables below say what words
open a sentence or lead to a next step; no sentence is matched as a whole.
"""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

#: Words that lead one step back, and the kind of step.
LEADS = {
    ("inherited", "from"): "inh", ("borrowed", "from"): "bor", ("borrowing", "from"): "bor", ("learned", "borrowing", "from"): "lbor", ("semi-learned", "borrowing", "from"): "lbor",
    ("calque", "of"): "cal", ("derived", "from"): "der", ("coined", "from"): "der", ("from",): "der", ("via",): "via",
}
#: Words that open a list of something else.
LISTS = {
    ("doublet", "of"): "doublet", ("cognate", "with"): "cognate", ("cognate", "to"): "cognate", ("see",): "see", ("see", "also"): "see", ("more", "at"): "see", ("compare",): "see", ("related", "to"): "see",
    ("equivalent", "to"): "part", ("by", "surface", "analysis"): "part",
}
HEDGES = frozenset("probably possibly perhaps ultimately likely apparently partly presumably".split())
#: Words before a lead or a term that say nothing of either.
FILLERS = frozenset("itself in turn originally and or the a an same source as root of also piecewise orthographic unadapted direct partial".split())
#: A form of a word, named before it with "of".
FORMS = frozenset("participle infinitive stem genitive accusative ablative nominative plural singular diminutive feminine masculine neuter adjective noun verb variant form present past perfect passive active".split())
#: What stands before a language's name and belongs to it.
MODIFIERS = frozenset("Old Middle Late Early Medieval Ecclesiastical New Vulgar Classical Ancient Modern Koine Byzantine Biblical Northern Southern Western Eastern West East North South Low High Proto".split())
#: Abbreviations whose full stop ends no sentence.
SHORT = frozenset("c ca cf e.g i.e lit vs viz no p pp fl St Mr Dr".split())
_TOKEN = re.compile(r"“[^”]*”?|[()\[\],;+…]|\.(?=\s|$)|(?:[^\s()\[\],;+…“.]|\.(?!\s|$))+")


def folded_text(text: str) -> str:
    """Lower case, without marks and reconstruction stars."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)).lower().replace("*", "").strip()


class Item(NamedTuple):
    """Something that the prose names.  kind is that of the step, part, doublet, cognate or see; of is the place, in the parser's result, of the
    step that this one explains, -1 for the entry itself."""

    kind: str
    language: str
    term: str
    gloss: str
    hedge: str
    of: int


class _Parser:
    def __init__(self, word: str, prose: str, languages: frozenset[str], own: str):
        self.word, self.languages, self.own = folded_text(word), languages, own
        self.tokens = _TOKEN.findall(prose or "")
        self.low = [t.lower() for t in self.tokens]
        self.out: list[Item] = []
        self.at = 0
        self.most = max((len(x.split()) for x in languages), default=0)
        self.chained = False

    def phrase(self, table: dict) -> str | None:
        """What the longest entry of a table that stands here means; goes behind it."""
        for n in range(3, 0, -1):
            found = table.get(tuple(self.low[self.at : self.at + n]))
            if found and self.at + n <= len(self.tokens):
                self.at += n
                return found
        return None

    def language(self) -> str:
        """A language's name here, with its modifiers; goes behind it."""
        k = self.at
        while k < len(self.tokens) and self.tokens[k].removesuffix("-") in MODIFIERS:
            k += 1
        for start in range(k, self.at - 1, -1):  # a modifier can be part of a listed name
            for n in range(self.most, 0, -1):
                name = " ".join(self.tokens[start : start + n])
                base = name.split("-", 1)[1] if name.split("-")[0] in MODIFIERS and "-" in name else name
                if start + n <= len(self.tokens) and (name in self.languages or base in self.languages):
                    found = " ".join(self.tokens[self.at : start + n])
                    self.at = start + n
                    return found
        return ""

    def stops(self) -> bool:
        """The sentence is over, or a sign ends what is being read."""
        return self.at >= len(self.tokens) or self.tokens[self.at] in (".", ";", "…")

    def over(self) -> bool:
        """The sentence ends here."""
        if self.at >= len(self.tokens) or self.tokens[self.at] in (";", "…"):
            return True
        before = self.tokens[self.at - 1] if self.at else ""
        return self.tokens[self.at] == "." and before not in SHORT and not re.fullmatch("[A-Z]", before)

    def bracket(self, here: int, place: int) -> None:
        """From an opening bracket to its end: a gloss for the item at `place`, or a chain that goes on from `here`."""
        self.at += 1
        while self.at < len(self.tokens) and self.tokens[self.at] not in (")", "]"):
            t = self.tokens[self.at]
            if t in ("(", "["):
                self.bracket(-2, -1)
            elif t.startswith("“") and place >= 0 and not self.out[place].gloss:
                self.out[place] = self.out[place]._replace(gloss=t.strip("“”").strip())
                self.at += 1
            elif here >= -1 and self.lead(ahead=True):
                self.chain(here, nested=True)
                here = -2  # one chain explains a step
            else:
                self.at += 1
        self.at += 1

    def lead(self, ahead: bool = False) -> tuple[str, str] | None:
        """(kind, hedge) if words that lead to a step stand here, perhaps after hedges and fillers; goes behind them unless `ahead`."""
        start, hedge, kind = self.at, "", None
        while self.at < len(self.tokens):
            kind = self.phrase(LEADS)
            if kind:
                break
            if self.low[self.at] in HEDGES:
                hedge = hedge or self.low[self.at]
            elif self.low[self.at] not in FILLERS and self.tokens[self.at] != ",":
                break
            self.at += 1
        if not kind or ahead:
            self.at = start
        return (kind, hedge) if kind else None

    def term(self, kind: str, of: int, hedge: str = "", language: str | None = None) -> int:
        """Reads a language, a term and brackets behind it; the item's place, -1 if there is no term."""
        while self.at < len(self.tokens) and (self.low[self.at] in FILLERS or self.low[self.at] in HEDGES):
            hedge = hedge or (self.low[self.at] if self.low[self.at] in HEDGES else "")
            self.at += 1
        name = self.language()
        k = self.at
        while k < len(self.tokens) and self.low[k] in FORMS:
            k += 1
        if k > self.at and k < len(self.tokens) and self.low[k] == "of":
            self.at = k + 1
            name = self.language() or name
        words: list[str] = []
        while not self.stops() and self.tokens[self.at] not in ("(", ")", "[", "]", ",", "+") and not self.tokens[self.at].startswith("“"):
            if words and (self.low[self.at] in ("and", "or") or self.lead(ahead=True)):
                break
            words.append(self.tokens[self.at])
            self.at += 1
        place = -1
        if 0 < len(words) <= 3:
            place = len(self.out)
            self.out.append(Item(kind, name or language or "", " ".join(words), "", hedge, of))
        while self.at < len(self.tokens) and (self.tokens[self.at] in ("(", "[") or self.tokens[self.at].startswith("“")):
            if self.tokens[self.at].startswith("“"):
                if place >= 0 and not self.out[place].gloss:
                    self.out[place] = self.out[place]._replace(gloss=self.tokens[self.at].strip("“”").strip())
                self.at += 1
            else:
                self.bracket(place if kind not in ("doublet", "cognate", "see") else -2, place)
        return place

    def chain(self, here: int, nested: bool = False) -> None:
        """Steps back from `here`, as long as words lead to one."""
        language = self.own if here < 0 else self.out[here].language
        while True:
            found = self.lead()
            if not found:
                return
            place = self.term(found[0], here, found[1], language)
            parts = [place]
            while place >= 0 and self.at < len(self.tokens) and self.tokens[self.at] == "+":
                self.at += 1
                place = self.term("part", here, "", self.out[parts[0]].language)
                parts.append(place)
            if len(parts) > 1:
                self.out[parts[0]] = self.out[parts[0]]._replace(kind="part")
            if parts[0] < 0:
                return
            here, language = parts[0], self.out[parts[0]].language
            # other forms of the term, and words that lead nowhere, up to the next step
            while not self.over() and not self.another_origin() and not self.lead(ahead=True):
                if self.tokens[self.at] in (")", "]") and nested or self.tokens[self.at] == "," and self.lists(ahead=True):
                    return
                self.at += 1
            if self.over() or self.another_origin():
                return

    def another_origin(self) -> bool:
        """An "or" here names another origin, which isn't a further step."""
        start = self.at
        self.at += self.at < len(self.tokens) and self.tokens[self.at] == ","
        found = self.at < len(self.tokens) and self.low[self.at] == "or"
        self.at += 1
        found = found and bool(self.lead(ahead=True))
        self.at = start
        return found

    def lists(self, ahead: bool = False) -> str | None:
        start = self.at
        while self.at < len(self.tokens) and (self.low[self.at] in FILLERS or self.tokens[self.at] == ","):
            self.at += 1
        kind = self.phrase(LISTS)
        if ahead or not kind:
            self.at = start
        return kind

    def listed(self, kind: str) -> None:
        """Terms between commas, ands and plus signs to the sentence's end."""
        language = self.own
        while not self.over():
            if self.tokens[self.at] in (",", "+", ")", "]") or self.low[self.at] in ("and", "or"):
                self.at += 1
                if self.lists(ahead=True):
                    return
                continue
            before = self.at
            place = self.term(kind, -1, "", language)
            if place >= 0:
                language = self.out[place].language
            self.at += self.at == before

    def parse(self) -> list[Item]:
        while self.at < len(self.tokens):
            kind = self.lists()
            if kind:
                self.listed(kind)
            elif not self.chained and self.lead(ahead=True):
                before = len(self.out)
                self.chain(-1)
                self.chained = len(self.out) > before
            else:
                self.at += 1
        return self.settled()

    def settled(self) -> list[Item]:
        """Without the entry itself among its doublets, and each word once a list; a cognate in the entry's own language is one to see."""
        out: list[Item] = []
        moved: dict[int, int] = {-1: -1}
        for k, x in enumerate(self.out):
            if x.kind == "cognate" and x.language == self.own:
                x = x._replace(kind="see")
            alike = x.kind in ("doublet", "see") and (folded_text(x.term) == self.word or any(y.kind == x.kind and y.term == x.term for y in out))
            if not alike:
                moved[k] = len(out)
                out.append(x._replace(of=moved.get(x.of, -1)))
        return out


def parse(word: str, prose: str | None, languages: frozenset[str], own: str = "English") -> list[Item]:
    """What the prose says of a word's origin, in the order in which it says so.  Null or empty prose: nothing."""
    return _Parser(word, prose or "", languages, own).parse()
