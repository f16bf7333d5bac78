"""Column functions: string folding, similarity, vectors, hashes, text tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and what they fold to.
MARKED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįıĵķĺļľłńņňōŏőŕŗřśŝşšţťŧũūŭůűųŵŷźżž"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyyaaaccccddeeeeegggghhiiiiijklllnnnooorrrsssstttuuuuuuwyzzz"


def fold(text: Column) -> Column:
    """Lower case without marks; ß, œ and æ as two letters."""
    t = F.translate(F.lower(text), MARKED, PLAIN)
    for a, b in (("ß", "ss"), ("œ", "oe"), ("æ", "ae")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def normal_gloss(text: Column) -> Column:
    """Letters a-z and single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z]+", " "))


def content_words(text: Column, stop: tuple[str, ...] = (), least: int = 3) -> Column:
    """Distinct normalised words of at least so many letters, without stop words."""
    words = F.array_distinct(F.split(normal_gloss(text), " "))
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*stop)) if stop else F.filter(words, lambda w: F.length(w) >= least)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Common elements over the smaller set."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(F.lit(0.0))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance over the longer length."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def letter_pairs(word: Column) -> Column:
    """Neighbouring letters, each numbered by how often it came before, so that a set holds a multiset."""
    n = F.length(word) - 1
    pairs = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(word, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.transform(pairs, lambda p, i: F.concat(p, F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda q: q == p)).cast("string")))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length; 1 for the zero vector, so that it can divide."""
    n = F.sqrt(dot(a, a))
    return F.when(n > 0, n).otherwise(F.lit(1.0))


def half_up(x: Column) -> Column:
    """Rounded to whole numbers, halves up."""
    return F.floor(x + 0.5).cast("long")


def shard_key(word: Column) -> Column:
    """The first two letters if both are a-z in either case, else __other."""
    two = F.substring(word, 1, 2)
    return F.when(two.rlike("^[A-Za-z]{2}$"), F.lower(two)).otherwise(F.lit("__other"))


def djb2(text: Column) -> Column:
    """hash = hash * 33 + code, in unsigned 32 bits."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(5381).cast("long"), lambda h, c: (h * 33 + F.ascii(c)) % 4294967296)


def clipped(text: Column, most: int, kept: int) -> Column:
    """Texts longer than `most` cut to `kept` characters and an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, kept), F.lit("…"))).otherwise(text)


def year_of(text: Column) -> Column:
    """The first year of four digits, else the start of a named century."""
    year = F.regexp_extract(text, r"\b(1[0-9]{3}|20[0-9]{2})\b", 1)
    century = F.regexp_extract(text, r"\b([0-9]{1,2})(?:st|nd|rd|th) century", 1)
    return F.when(year != "", F.try_to_number(year, F.lit("9999")).cast("int")).when(century != "", (century.try_cast("int") - 1) * 100)


def log_radius(year: Column) -> Column:
    """Distance from the centre of a time layout."""
    return -F.log(2400 - F.least(year, F.lit(2000)))


def bucket_bounds(start: int, width: int, n: int) -> list[tuple[int, int]]:
    """First and last unit of each of n buckets."""
    return [(start + width * k, start + width * (k + 1) - 1) for k in range(n)]
