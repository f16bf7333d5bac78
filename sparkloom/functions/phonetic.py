"""Pronunciations: phoneme codes to IPA and respellings, and comparisons of the two."""

from __future__ import annotations

import re
from collections import Counter

# Phoneme codes with their IPA and respelling; vowels first.
VOWELS = {
    "AA": ("ɑ", "ah"), "AE": ("æ", "a"), "AH": ("ʌ", "uh"), "AO": ("ɔ", "aw"), "AW": ("aʊ", "ow"), "AY": ("aɪ", "y"), "EH": ("ɛ", "eh"), "ER": ("ɝ", "ur"),
    "EY": ("eɪ", "ay"), "IH": ("ɪ", "i"), "IY": ("i", "ee"), "OW": ("oʊ", "oh"), "OY": ("ɔɪ", "oy"), "UH": ("ʊ", "uu"), "UW": ("u", "oo"),
}
CONSONANTS = {
    "B": ("b", "b"), "CH": ("tʃ", "ch"), "D": ("d", "d"), "DH": ("ð", "th"), "F": ("f", "f"), "G": ("g", "g"), "HH": ("h", "h"), "JH": ("dʒ", "j"), "K": ("k", "k"),
    "L": ("l", "l"), "M": ("m", "m"), "N": ("n", "n"), "NG": ("ŋ", "ng"), "P": ("p", "p"), "R": ("r", "r"), "S": ("s", "s"), "SH": ("ʃ", "sh"), "T": ("t", "t"),
    "TH": ("θ", "th"), "V": ("v", "v"), "W": ("w", "w"), "Y": ("j", "y"), "Z": ("z", "z"), "ZH": ("ʒ", "zh"),
}
#: Vowels without stress that have a sign of their own.
WEAK = {"AH": "ə", "ER": "ɚ"}
#: Clusters that can begin a syllable. THR isn't one of them: it is cut before the R, as in bath-room.
ONSETS = frozenset(
    "PR PL BR BL TR DR KR KL GR GL FR FL SHR SP ST SK SL SM SN SW SF TW KW DW GW HW PY BY KY FY GY MY VY HY STR SPR SKR SPL SKW SKL".split()
)
#: IPA signs and their respelling, longer signs before shorter.
SIGNS = (
    "tʃ ch|dʒ j|aʊ ow|aɪ y|eɪ ay|oʊ oh|əʊ oh|ɔɪ oy|ɪə eer|eə air|ɛə air|ʊə oor|ʃ sh|ʒ zh|θ th|ð th|ŋ ng|ɡ g|ɹ r|ɚ ur|ɝ ur|ɜ ur|ʔ |ɑ ah|æ a|ʌ uh|ɔ aw|ɒ o|ɛ eh|ɪ ih|i ee|ʊ uu|u oo|ə uh|y ee|a ah|e eh|o oh|"
    "p p|b b|t t|d d|k k|g g|f f|v v|s s|z z|h h|m m|n n|l l|r r|w w|j y|x kh|c k|q k"
)
_SPELL = dict(x.split(" ", 1) for x in SIGNS.split("|"))
_SIGN = re.compile("|".join(map(re.escape, sorted(_SPELL, key=len, reverse=True))))
_CODE = re.compile(r"([A-Z]+)([0-2]?)$")


def _can_begin(cluster: list[str]) -> bool:
    if len(cluster) < 2:
        return cluster != ["NG"]
    return "".join(cluster) in ONSETS and len(cluster) <= 3


def syllables(codes: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """Codes cut before the largest cluster that can begin the next syllable."""
    nuclei = [k for k, (c, _) in enumerate(codes) if c in VOWELS]
    borders = []
    for a, b in zip(nuclei, nuclei[1:], strict=False):
        borders.append(next(k for k in range(a + 1, b + 1) if _can_begin([c for c, _ in codes[k:b]])))
    edges = [0, *borders, len(codes)]
    return [codes[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def pronounce(codes: str) -> tuple[str, str] | None:
    """(IPA, respelling) of codes with stress digits; None if there is none."""
    read = [(m[1], m[2]) for m in map(_CODE.match, codes.split()) if m]
    if not read:
        return None
    parts = syllables(read)
    ipa, plain = "", []
    for part in parts:
        stress = next((s for c, s in part if c in VOWELS and s in ("1", "2")), "") if len(parts) > 1 else ""
        ipa += {"1": "ˈ", "2": "ˌ"}.get(stress, "")
        ipa += "".join(WEAK[c] if s == "0" and c in WEAK else (VOWELS | CONSONANTS).get(c, ("", ""))[0] for c, s in part)
        text = "".join((VOWELS | CONSONANTS).get(c, ("", ""))[1] for c, _ in part)
        loud = len(parts) > 1 and any(c in VOWELS and s == "1" for c, s in part)
        plain.append(text.upper() if loud else text)
    return f"/{ipa}/", "-".join(plain)


def respell(ipa: str | None) -> str:
    """A respelling of IPA: syllables at stress marks and dots, the stressed one in capitals."""
    text = (ipa or "").split(",")[0].strip()
    inner = re.search(r"[/\[]([^/\]]+)[/\]]", text)
    text = re.sub(r"[()ː]", "", inner[1] if inner else text)
    marked = [(m[1], m[2]) for m in re.finditer(r"([ˈˌ.]?)([^ˈˌ.]+)", text)]
    loud = next((k for k, (mark, _) in enumerate(marked) if mark == "ˈ"), 0)
    spelled = ("".join(_SPELL[s] for s in _SIGN.findall(part)) for _, part in marked)
    return "-".join(p.upper() if k == loud else p for k, p in enumerate(spelled) if p)


def signs(ipa: str) -> list[str]:
    """Distinct IPA signs in order; two-character signs are one."""
    return list(dict.fromkeys(_SIGN.findall(ipa)))


def consonant_difference(a: str, b: str) -> int:
    """How many consonants of two respellings have no partner in the other."""
    x, y = (Counter(re.findall(r"ch|sh|th|zh|ng|kh|[bdfghjklmnprstvwyz]", s.lower())) for s in (a, b))
    return sum(((x - y) + (y - x)).values())
