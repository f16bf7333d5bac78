"""Words cut into morphemes: the best path through a lattice of pieces, and the index from morphemes back to words.

The lattice is a join: every stretch of a word that is a form of the morpheme table is an edge. The best path of a
word is a fold over its places from the end, in three zones: prefixes, then roots and linking vowels, then suffixes, where alone
letters may stay unknown. Scores are whole hundredths, so that ties are ties; among equals the longer form stands, then
the earlier in the table, then going on to the next zone.

Scale: words and table meet by form in merged joins: both grow with the vocabulary, and the size of their files says too little of
their rows for a broadcast through the driver.  A word's edges are bounded by its length and the table's longest form. The index keeps, for each morpheme, words from both ends of an order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.morph import DEFAULT
from ..sources.shared import stash

#: Fixed values, in hundredths: a letter covered, a root, a piece, a linking vowel or silent e, an unknown letter.
LETTER, ROOT, PIECE, LINK, UNKNOWN = 100, 100, -12, 5, -70
#: Vowels that link roots; letters that a prefix leaves; the shortest root that may end in a silent e.
LINKERS, LEFT, SILENT = "aeiouy", 2, 4
#: Fixed values of the index: the least length of a word and of a piece; words kept from either end.
LEAST_WORD, LEAST_PIECE, FIRST, LAST = 4, 3, 44, 16
_PART = "struct<kind:string,text:string,id:string>"
_BEST = f"struct<score:int,parts:array<{_PART}>>"
#: kind (prefix, root or suffix), form, id, place; and conditions, null for none: regular expressions that what follows the form must
#: match (ahead), that the word must (whole) and that it must not (unless).
TABLE = "kind string, form string, id string, place int, ahead string, whole string, unless string"


def default_table(spark: SparkSession) -> DataFrame:
    """The small table of functions.morph in this shape."""
    return spark.createDataFrame([(m.kind, m.form, f"{m.kind}:{m.form}", k, None, None, None) for k, m in enumerate(DEFAULT)], TABLE)


def lattice(words: DataFrame, table: DataFrame) -> DataFrame:
    """(word) to (word, pre, root, suf): the forms of each kind that stand in the word, longest first at each place."""
    t = table.where("form <> ''").select("kind", "form", "id", "place", *(F.col(c).alias(f"_{c}") for c in ("ahead", "whole", "unless")))
    longest = table.agg(F.max(F.length("form"))).first()[0] or 0
    size = F.length("word")
    starts = F.sequence(F.lit(1), size)
    stretches = F.flatten(F.transform(starts, lambda a: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), size - a + 1)), lambda n: F.struct((a - 1).alias("at"), F.substring(F.col("word"), a, n).alias("form")))))
    cut = words.select("word", F.explode(stretches).alias("s")).select("word", "s.at", "s.form") if longest else words.select("word", F.lit(0).alias("at"), F.lit("").alias("form"))
    follows = F.expr("substring(word, at + length(form) + 1)")
    ok = (F.col("_ahead").isNull() | F.expr("substring(word, at + length(form) + 1) RLIKE _ahead")) & (F.col("_whole").isNull() | F.expr("word RLIKE _whole")) & (F.col("_unless").isNull() | ~F.expr("word RLIKE _unless"))
    room = (F.col("kind") != "prefix") | (F.length(follows) >= LEFT)
    edges = cut.join(t.hint("merge"), "form").where(ok & room)
    edge = F.struct("at", (-F.length("form")).alias("shorter"), "place", "id", "form")
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, edge)))
    grouped = edges.groupBy("word").agg(of("prefix").alias("pre"), of("root").alias("root"), of("suffix").alias("suf"))
    none = F.array().cast(grouped.schema["pre"].dataType)
    # words without any edge come too: they are unknown as a whole
    return words.select("word").join(grouped.hint("merge"), "word", "left").select("word", *(F.coalesce(c, none).alias(c) for c in ("pre", "root", "suf")))


def _part(kind: str, text: Column, ident: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"), (ident if ident is not None else F.lit(None).cast("string")).alias("id"))


def _option(score: Column, order: Column, part: Column, rest: Column) -> Column:
    """A way on from a place: its score, its place among equals (greater first), the piece and what follows."""
    return F.struct((score + F.lit(PIECE) + rest["score"]).cast("int").alias("score"), order.cast("int").alias("order"), F.concat(F.array(part), rest["parts"]).alias("parts"))


def _stay(best: Column) -> Column:
    """Going on to the next zone, after all other options."""
    return F.array(F.struct(best["score"].alias("score"), F.lit(-10_000).alias("order"), best["parts"].alias("parts")))


def _top(options: Column) -> Column:
    """The option with the most points, the first of equals; parts never decide, since no two orders are the same."""
    best = F.array_max(options)
    return F.struct(best["score"].alias("score"), best["parts"].alias("parts")).cast(_BEST)


def _best(size: Column) -> Column:
    """Over lattice(): the best parse of the word, a fold over places from the last to the first.  The fold's state is an array
    of what was found for each later place, nearest first: the best from there on in each zone."""
    start = F.struct(*(F.struct(F.lit(0).alias("score"), F.array().cast(f"array<{_PART}>").alias("parts")).cast(_BEST).alias(z) for z in ("pre", "root", "suf")))
    kind = f"array<struct<pre:{_BEST},root:{_BEST},suf:{_BEST}>>"

    def step(found: Column, at: Column) -> Column:
        letter = F.substring(F.col("word"), at + 1, F.lit(1))
        here = lambda edges: F.filter(edges, lambda e: e["at"] == at)
        rest = lambda length, zone: F.get(found, length - 1)[zone]

        def taken(edges: str, name: str, zone: str, bonus: int) -> Column:
            return F.transform(here(edges), lambda e, k: _option(-e["shorter"] * LETTER + F.lit(bonus), -k, _part(name, e["form"], e["id"]), rest(-e["shorter"], zone)))

        last = at == size - 1
        silent = F.when(last & (letter == "e"), F.array(_option(F.lit(LINK), F.lit(-5_000), _part("silent", letter), rest(F.lit(1), "suf"))))
        later = F.array_min(F.filter(F.transform("suf", lambda e: e["at"]), lambda a: a > at))
        run = F.coalesce(later, size) - at
        lost = F.when(F.size(here("suf")) == 0, F.array(_option(run * UNKNOWN, F.lit(-6_000), _part("unknown", F.substring(F.col("word"), at + 1, run)), rest(run, "suf"))))
        of_suf = taken("suf", "suffix", "suf", 0)
        none = F.slice(of_suf, F.lit(1), F.lit(0))
        suffix = _top(F.concat(of_suf, F.coalesce(silent, none), F.coalesce(lost, none)))
        links = F.lit(LINKERS).contains(letter) & F.exists("root", lambda e: e["at"] == at + 1)
        link = F.when(links, F.array(_option(F.lit(LINK), F.lit(-5_000), _part("linker", letter), rest(F.lit(1), "root"))))
        return suffix, taken("root", "root", "root", ROOT), F.coalesce(link, none), taken("pre", "prefix", "pre", 0)

    def merged(found: Column, at: Column) -> Column:
        suffix, roots, link, prefixes = step(found, at)
        # zones build on each other: nested so that each best is worked out once
        with_root = F.transform(F.array(suffix), lambda s: F.struct(s.alias("suf"), _top(F.concat(roots, link, _stay(s))).alias("root")))
        both = F.transform(with_root, lambda r: F.struct(_top(F.concat(prefixes, _stay(r["root"]))).alias("pre"), r["root"].alias("root"), r["suf"].alias("suf")))
        return F.concat(both, found).cast(kind)

    places = F.sequence(size - 1, F.lit(0), F.lit(-1))
    return F.get(F.aggregate(places, F.array(start).cast(kind), merged), F.lit(0))["pre"]


def _joined(parts: Column) -> Column:
    """Neighbouring unknown pieces as one."""
    unknown = lambda a, x: (F.size(a) > 0) & (x["kind"] == "unknown") & (F.element_at(a, -1)["kind"] == "unknown")
    longer = lambda a, x: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.lit("unknown").alias("kind"), F.concat(F.element_at(a, -1)["text"], x["text"]).alias("text"), F.lit(None).cast("string").alias("id"))))
    return F.aggregate(parts, F.array().cast(f"array<{_PART}>"), lambda a, x: F.when(unknown(a, x), longer(a, x)).otherwise(F.concat(a, F.array(x))))


def decompose(words: DataFrame, table: DataFrame) -> DataFrame:
    """Takes words (word) and a morpheme table (TABLE); returns a row a distinct word: word, parts (kind, text, id) and score.

    Kinds are prefix, root, linker, suffix, silent (a final e), unknown, and word for what isn't lower-case a to z throughout, which stands whole
    with score 0.  Texts join to the word. A final e of a last root that is a form without it, too, is silent. Null and empty words are left
    out; with an empty table all letters are unknown.  Rows of the table that say the same count once.
    """
    table = table.dropDuplicates([f.split()[0] for f in TABLE.split(", ")])
    one = words.where("word <> ''").select("word").distinct()
    plain = F.col("word").rlike("^[a-z]+$")
    size = F.length("word")
    parsed = lattice(one.where(plain), table).select("word", _best(size).alias("b")).select("word", "b.score", _joined(F.col("b.parts")).alias("parts"))
    # a root that ends in e and has a form without: the e is silent
    last = F.element_at("parts", -1)
    shorter = table.where("kind = 'root'").select(F.col("id").alias("_id"), F.col("form").alias("_form")).distinct()
    stem = F.expr("substring(_last.text, 1, length(_last.text) - 1)")
    may = (F.col("_last.kind") == "root") & (F.length("_last.text") >= SILENT) & F.col("_last.text").endswith("e")
    ends = parsed.withColumn("_last", last).withColumn("_stem", F.when(may, stem))
    ends = ends.join(shorter.hint("merge"), (F.col("_stem") == F.col("_form")) & (F.col("_last.id") == F.col("_id")), "left")
    peeled = F.concat(F.slice("parts", F.lit(1), F.size("parts") - 1), F.array(_part("root", F.col("_stem"), F.col("_id")), _part("silent", F.lit("e"))))
    ends = ends.select("word", F.when(F.col("_id").isNotNull(), peeled).otherwise(F.col("parts")).alias("parts"), "score")
    whole = one.where(~plain).select("word", F.array(_part("word", F.col("word"))).alias("parts"), F.lit(0).alias("score"))
    return ends.unionByName(whole)


def index(parsed: DataFrame, first: int = FIRST, last: int = LAST) -> DataFrame:
    """decompose() to (id, word, rank, n): the words of each morpheme, by length, then letters; of n words, where these are more than
    first + last, the first and the last ones.

    Words count that have four letters, a root and nothing unknown, by pieces of three letters or more.
    """
    good = (F.length("word") >= LEAST_WORD) & F.exists("parts", lambda p: p["kind"] == "root") & ~F.exists("parts", lambda p: p["kind"].isin("unknown", "word"))
    pieces = F.array_distinct(F.transform(F.filter("parts", lambda p: p["id"].isNotNull() & (F.length(p["text"]) >= LEAST_PIECE)), lambda p: p["id"]))
    postings = stash(parsed.where(good).select("word", F.explode(pieces).alias("id")), "postings")
    counts = postings.groupBy("id").agg(F.count("*").alias("n"))
    order, back = [F.length("word"), F.col("word")], [F.desc(F.length("word")), F.desc("word")]
    # each end by itself: a task keeps that many words of a morpheme before anything is shuffled
    head = postings.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where(F.col("rank") <= first + last)
    tail = postings.withColumn("behind", F.row_number().over(Window.partitionBy("id").orderBy(*back))).where(F.col("behind") <= last)
    heads = head.join(counts.hint("merge"), "id").where((F.col("n") <= first + last) | (F.col("rank") <= first)).select("id", "word", F.col("rank").cast("long").alias("rank"), "n")
    tails = tail.join(counts.hint("merge"), "id").where(F.col("n") > first + last).select("id", "word", (F.col("n") - F.col("behind") + 1).cast("long").alias("rank"), "n")
    return heads.unionByName(tails)
