"""Column predicates over words, glosses and examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a gloss's head noun says it names: with a capitalised word behind it, or by itself.
KINDS_OF_PLACE = "city town village township hamlet suburb municipality settlement borough port capital county district province prefecture region state republic country kingdom territory island archipelago peninsula continent river lake sea bay strait mountain volcano desert".split()
KINDS_OF_PEOPLE = "people tribe clan nation dynasty inhabitant native citizen resident member language dialect".split()
KINDS_OF_BEING = "god goddess deity saint prophet apostle emperor king queen poet painter composer philosopher".split()
NAMED_BY_THEMSELVES = "surname nickname patronymic matronymic trademark genus constellation asteroid zodiac".split()
NAMED_BY_TWO = ("given name", "brand name", "trade name", "family name", "pet name")
#: Words after which the head of a gloss is over.
AFTER_HEAD = "of in on at from to for near between among by with who which that whose where also".split()
REGISTERS = "alternative obsolete archaic dated nonstandard informal rare standard superseded common formal british american chiefly".split()
INFLECTED = ["plural", "singular", "gerund", "simple past", "past tense", "past participle", "present participle", "third-person singular", "comparative", "superlative"]


def _any(words: Sequence[str]) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


def word_shape(word: Column, least: int = 4, most: int = 12) -> Column:
    """Letters a-z, so many, with a vowel, no Roman numeral."""
    return word.rlike(rf"^[a-z]{{{least},{most}}}$") & word.rlike("[aeiouy]") & ~word.rlike("^[ivxlcdm]+$")


def head_words(gloss: Column) -> Column:
    """The lower-case words of a gloss before its first preposition, relative or comma."""
    first = F.element_at(F.split(F.lower(gloss), "[,;:.(]"), 1)
    words = F.filter(F.split(first, r"[^\p{L}]+"), lambda w: w != "")
    stop = F.array_position(F.transform(words, lambda w: w.isin(*AFTER_HEAD)), F.lit(True))
    return F.when(stop > 0, F.slice(words, F.lit(1), stop.cast("int") - 1)).otherwise(words)


def proper_gloss(gloss: Column) -> Column:
    """A gloss of a proper noun.

    Its head names a kind of place, people or being and a capitalised word or a span of years comes after the first word; or its
    head is a name of its own kind (surname, given name ...); or two words after the first are capitalised.
    """
    head = head_words(gloss)
    of_kind = F.arrays_overlap(head, F.array(*map(F.lit, KINDS_OF_PLACE + KINDS_OF_PEOPLE + KINDS_OF_BEING)))
    alone = F.arrays_overlap(head, F.array(*map(F.lit, NAMED_BY_THEMSELVES))) | F.array_join(head, " ").rlike(rf"\b({_any(NAMED_BY_TWO)})$")
    rest = F.regexp_replace(gloss, r"^\s*\S+", "")
    capitals = F.regexp_count(rest, F.lit(r"\b\p{Lu}\p{Ll}{2,}"))
    years = gloss.rlike(r"\d{3,4}\s*[-–—]\s*\d{3,4}|\bborn\b.*\d{4}")
    return F.coalesce(of_kind & ((capitals >= 1) | years) | alone | (capitals >= 2), F.lit(False))


# Months, weekdays and feasts are no names of anybody or any place.
CALENDAR = "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday month weekday day feast festival holiday".split()


def only_name(kinds: Column, gloss: Column) -> Column:
    """Every part of speech is `name`, and the gloss is of no date, feast or language."""
    other = F.arrays_overlap(head_words(gloss), F.array(*map(F.lit, [*CALENDAR, "language"])))
    return (F.size(kinds) > 0) & F.forall(kinds, lambda k: k == "name") & ~F.coalesce(other, F.lit(False))


def author(text: Column) -> Column:
    """A person as a quotation's source names one: two to five words, capitalised but for particles and initials, no digits."""
    words = F.split(F.trim(text), r"\s+")
    good = F.forall(words, lambda w: w.rlike(r"^(\p{Lu}[\p{L}'’.-]*|(?i:de|du|des|la|le|von|van|der|den|zu|of|da|di))$"))
    return F.size(words).between(2, 5) & good & ~publisher(text) & ~press(text)


def publisher(text: Column) -> Column:
    """A publishing house: a word for one, or a company's form at the end."""
    return text.rlike(r"(?i)\b(verlag|éditions?|editions?|publish(er|ers|ing)|books|imprimerie|librairie|university press|hachette|gallimard|suhrkamp)\b|(?i)\b(ltd|inc|gmbh|& co)\.?$")


def press(text: Column) -> Column:
    """A newspaper or magazine: a word for one."""
    return text.rlike(r"(?i)\b(times|post|herald|tribune|journal|gazette|zeitung|magazin|magazine|le monde|figaro|libération|spiegel|guardian|review|news)\b")


def pointer(gloss: Column) -> Column:
    """(type, target) of a gloss that only points to another word; null of others."""
    g = F.trim(gloss)
    kind = (
        F.when(g.rlike(rf"(?i)\bspelling of\b|^({_any(REGISTERS)})\b.{{0,30}}\bform of\b"), "spelling")
        .when(g.rlike(r"(?i)^(synonym|antonym) of\b"), "synonym").when(g.rlike(r"(?i)^(initialism|abbreviation|acronym|clipping|ellipsis|contraction|short for) of\b"), "abbreviation")
        .when(g.rlike(rf"(?i)^({_any(INFLECTED)})( form)? of\b"), "inflection")
    )
    target = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(g, r"(?i)\bof\s+(.+)$", 1), r"\s*\(.*$", ""), "[.,;:”\"’']+$", ""))
    return F.when(kind.isNotNull() & (target != ""), F.struct(kind.alias("type"), target.alias("target")))


def only_pointers(glosses: Column) -> Column:
    """The one target to which every gloss of an array points; null if there are others or none."""
    targets = F.array_distinct(F.transform(glosses, lambda g: pointer(g)["target"]))
    return F.when((F.size(glosses) > 0) & F.forall(glosses, lambda g: pointer(g).isNotNull()) & (F.size(targets) == 1), F.get(targets, F.lit(0)))


def affix(word: Column) -> Column:
    """Begins or ends with a hyphen, an asterisk aside."""
    return word.rlike(r"^\*?-|-$")


def usable_example(text: Column) -> Column:
    """15 to 300 characters, no year first, nothing left out, no long s, Latin script."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    bad = t.rlike(r"^\d{4}|^c\.\s*\d|\[(…|\.\.\.)\]|ſ|[Ͱ-ϿЀ-ӿ֐-׿؀-ۿऀ-ൿ぀-ヿ一-鿿가-힯]")
    return F.length(t).between(15, 300) & ~bad


def best_example(examples: Column) -> Column:
    """Of an array of (text, type, ref): the first usable that is no quotation, else the first usable."""
    usable = F.filter(examples, lambda x: usable_example(x["text"]))
    own = F.filter(usable, lambda x: (F.coalesce(x["type"], F.lit("")) != "quotation") & x["ref"].isNull())
    return F.coalesce(F.get(own, F.lit(0))["text"], F.get(usable, F.lit(0))["text"])


#: Words of which one of each list in a row says that a gloss refers to another sense.
BACK_TO = ("in of with like on for to", "this|that|the same|the aforementioned|the above", "style kind sense manner fashion way sort type form context regard")


def refers_back(gloss: Column) -> Column:
    """The gloss is to be understood only beside another sense."""
    before, which, what = (x.split("|") if "|" in x else x.split() for x in BACK_TO)
    return F.lower(gloss).rlike(r"\b" + " ".join(f"({'|'.join(x)})" for x in (before, which, what)) + r"\b")


def quizzable(word: Column, gloss: Column) -> Column:
    """8 to 140 characters, no pointer, no reference back, and the word isn't in it."""
    return F.length(gloss).between(8, 140) & pointer(gloss).isNull() & ~refers_back(gloss) & ~F.contains(F.lower(gloss), F.lower(word))


def chosen(tags: Column, groups: Sequence[str], topics: Column, wanted: Sequence[str]) -> Column:
    """Some tag is of a requested group or some topic is wanted."""
    return F.arrays_overlap(tags, F.array(*map(F.lit, groups))) | F.arrays_overlap(topics, F.array(*map(F.lit, wanted)))


def quotation_ok(text: Column, tokens: Column, unknown: Column, counted: Column) -> Column:
    """6 to 45 tokens, few unknown ones, no citation line."""
    cites = text.rlike(r"^\s*(Translation|Übersetzung|Traduction)\s*:|^\W*\d{4},\s+\p{Lu}|\bISBN\b")
    return tokens.between(6, 45) & (counted > 0) & (unknown <= F.greatest(F.lit(2), F.floor(counted / 6))) & ~cites


def entry_type(word: Column, gloss: Column, has_pointer: Column) -> Column:
    """name, phrase, inflection or established, in this order."""
    capital = word.rlike(r"^\p{Lu}")
    return F.when(capital & proper_gloss(gloss), "name").when(word.rlike(r"\s"), "phrase").when(has_pointer & pointer(gloss).isNotNull(), "inflection").otherwise("established")
