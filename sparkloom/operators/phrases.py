"""Phrases in texts, with gaps: an index by a phrase's first two words, joined to the tokens of texts.

A phrase's words stand in order, with at most a few words of a closed class in between and no punctuation. Of
phrases that share words of a text, the one with the fewest gaps stands, then the longest, then the first.

Scale: tokens are made where texts lie and only starts that the index has survive the join, which is on two words and
their distance; a frequent first word alone joins nothing.  Matches that touch are settled among themselves: a long text is as many
small groups as it has stretches without a match.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words, and the signs that no phrase crosses, each a token.
TOKEN = r"""[\p{L}\p{M}\p{N}]+|[,.;:!?()«»"—–\n]"""


def stream(text: Column) -> Column:
    """Lower-case words and signs of a text in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda w: F.lower(w))


def patterns(phrases: DataFrame, most: int) -> DataFrame:
    """(phrase, words) to (phrase, size, first, second, apart, rest, spread): a row for every way to deal out up to `most` gaps.

    apart is how far the second word stands from the first; rest what follows it, '' for a gap; spread the gaps before each
    word, whose order is that in which a reader who takes each word where it first comes would find them.
    """
    p = phrases.where(F.size("words") >= 2).select("phrase", "words", F.size("words").alias("size"), F.explode(F.sequence(F.lit(0), F.lit(most))).alias("g"))
    p = p.select("phrase", "words", "size", (F.lit(most) - F.col("g")).alias("left"), F.array("g").alias("spread"), F.lit(None).cast("array<string>").alias("rest"))
    p = p.withColumn("rest", F.array().cast("array<string>"))
    longest = phrases.agg(F.max(F.size("words"))).first()[0] or 0
    for k in range(3, longest + 1):
        more = F.when(F.col("size") >= k, F.sequence(F.lit(0), F.col("left"))).otherwise(F.array(F.lit(-1)))
        p = p.withColumn("g", F.explode(more))
        there = F.col("g") >= 0
        rest = F.concat("rest", F.array_repeat(F.lit(""), F.col("g")), F.array(F.element_at("words", F.least(F.lit(k), F.col("size")))))
        p = p.select("phrase", "words", "size", F.when(there, F.col("left") - F.col("g")).otherwise(F.col("left")).alias("left"), F.when(there, F.concat("spread", F.array("g"))).otherwise(F.col("spread")).alias("spread"), F.when(there, rest).otherwise(F.col("rest")).alias("rest"))
    return p.select("phrase", "size", F.element_at("words", 1).alias("first"), F.element_at("words", 2).alias("second"), (F.element_at("spread", 1) + 1).alias("apart"), "rest", "spread")


def candidates(texts: DataFrame, phrases: DataFrame, gap_words: Sequence[str], most: int = 2) -> DataFrame:
    """(id, phrase, start, places, gaps): every start of every phrase, places counted in tokens from 0."""
    index = patterns(phrases, most)
    width = (index.agg(F.max(F.size("rest"))).first()[0] or 0) + most
    closed = F.array(*(F.lit(w) for w in gap_words)).cast("array<string>")
    words = texts.select("id", stream(F.col("text")).alias("w"))

    def ahead(apart: int) -> Column:
        """The pairs of words so far apart with only gap words between, and what follows them."""
        at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: _between(i, apart))
        return F.transform(at, lambda i: F.struct(i.alias("start"), F.get("w", i).alias("first"), F.get("w", i + apart).alias("second"), F.lit(apart).alias("apart"), F.slice("w", i + apart + 2, F.lit(width)).alias("next")))

    def _between(i: Column, apart: int) -> Column:
        ok = i + apart < F.size("w")
        for k in range(1, apart):
            ok = ok & F.array_contains(closed, F.get("w", i + k))
        return ok

    pairs = words.where(F.size("w") > 1).select("id", F.inline(F.concat(*(ahead(a) for a in range(1, most + 2)))))
    joined = pairs.join(index, ["first", "second", "apart"])
    follows = F.forall(
        F.sequence(F.lit(0), F.size("rest") - 1),
        lambda k: (F.get("rest", k) == F.get("next", k)) | ((F.get("rest", k) == "") & F.array_contains(closed, F.get("next", k))),
    )
    fits = F.when(F.size("rest") == 0, True).otherwise((F.size("next") >= F.size("rest")) & follows)
    # where each word stands: one behind the last, and the gaps before it
    places = F.aggregate("spread", F.array("start"), lambda a, g: F.concat(a, F.array(F.element_at(a, -1) + g + 1)))
    gaps = F.aggregate("spread", F.lit(0), lambda a, g: a + g)
    found = joined.where(fits).select("id", "phrase", "start", "spread", F.struct(places.alias("places"), gaps.alias("gaps")).alias("m"))
    return found.groupBy("id", "phrase", "start").agg(F.min_by("m", "spread").alias("m")).select("id", "phrase", "start", "m.places", "m.gaps")


def settled(found: DataFrame) -> DataFrame:
    """The candidates that stand: taken by fewest gaps, then most words, then first start and phrase, each if none of its words is
    taken yet.  Rows of one id are settled stretch by stretch."""
    w = Window.partitionBy("id").orderBy("start", "phrase")
    before = F.max(F.element_at("places", -1)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    stretch = F.sum(F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)).over(w)
    rank = F.struct("gaps", (-F.size("places")).alias("fewer"), "start", "phrase", "places")
    groups = found.select("*", before.alias("_b")).withColumn("stretch", stretch).groupBy("id", "stretch").agg(F.array_sort(F.collect_list(rank)).alias("all"))
    kind = groups.schema["all"].dataType
    none = F.struct(F.array().cast("array<int>").alias("taken"), F.array().cast(kind).alias("kept"))
    take = lambda a, x: F.when(F.arrays_overlap(a["taken"], x["places"]), a).otherwise(F.struct(F.concat(a["taken"], x["places"]).alias("taken"), F.concat(a["kept"], F.array(x)).alias("kept")))
    kept = groups.select("id", F.explode(F.aggregate("all", none, take)["kept"]).alias("x"))
    return kept.select("id", "x.phrase", "x.start", "x.places", "x.gaps")


def match(texts: DataFrame, phrases: DataFrame, gap_words: Sequence[str], most: int = 2) -> DataFrame:
    """Takes texts (id, text), phrases (phrase, words: two or more lower-case words) and the words that may stand in gaps, at most
    `most` in a phrase; returns the phrases that stand: (id, phrase, start, places, gaps), places counted in words and signs from 0.

    Ids are taken to be distinct.  Null texts and phrases of one word match nothing; equal phrases count once.
    """
    return settled(candidates(texts, phrases.where("phrase IS NOT NULL").dropDuplicates(["phrase"]), gap_words, most))
