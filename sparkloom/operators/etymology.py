"""Etymologies as rows and as prose: written from relation rows, read back by a parser, derivations guarded by the headwords.

Scale: a word's rows meet by word, and of them only those that its text can hold; prose is parsed where it lies; the guard is a join of
the candidates' words with the headwords.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prose as parser

#: Relations of ancestry, those that one formula states, those of a word's structure; steps and characters of a text.
ANCESTRY = ("inherited_from", "derived_from", "borrowed_from", "learned_borrowing_from", "unadapted_borrowing_from", "orthographic_borrowing_from", "semi_learned_borrowing_from")
SIMPLE = {"clipping_of": "Clipping of", "abbreviation_of": "Abbreviation of", "initialism_of": "Initialism of", "back-formation_from": "Back-formation from", "calque_of": "Calque of", "named_after": "Named after"}
STRUCTURE = ("has_prefix", "has_suffix", "has_affix", "has_confix", "compound_of", "blend_of", "has_prefix_with_root")
HOPS, LONGEST = 5, 400


def _in_order(rows: DataFrame, text: str, most: int) -> DataFrame:
    """(word, texts): each word's first `most` texts in the order of `rank`, each once."""
    one = rows.groupBy("word", text).agg(F.min("rank").alias("rank"))
    first = one.withColumn("_k", F.row_number().over(Window.partitionBy("word").orderBy("rank"))).where(F.col("_k") <= most)
    return first.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", text))), lambda x: x[text]).alias("texts"))


def assembled(relations: DataFrame, glosses: DataFrame, own: str = "English", hops: int = HOPS, longest: int = LONGEST) -> DataFrame:
    """Takes relations (word, row, reltype, language, term, position) and glosses (language, term, gloss); returns (word, prose) of words
    about which there is something to say.

    First the chain: ancestry rows in their order, each language and term once, rows without a term left out, up to `hops`, with the
    gloss of the last. Without a chain, the first row that a formula states. Then, of two parts or more, the surface analysis in the order of
    positions. Cut off at `longest` characters. Equal rows count once; of several glosses the first by letters.
    """
    r = relations.select("word", "row", "reltype", F.coalesce("language", F.lit("")).alias("language"), F.trim(F.coalesce("term", F.lit(""))).alias("term"), "position").where("term <> '' AND word IS NOT NULL")
    up = r.where(F.col("reltype").isin(*ANCESTRY))
    first = up.groupBy("word", "language", "term").agg(F.min(F.struct("row", "reltype")).alias("r"))
    hop = first.withColumn("k", F.row_number().over(Window.partitionBy("word").orderBy("r.row", "language", "term"))).where(F.col("k") <= hops)
    last = hop.groupBy("word").agg(F.max("k").alias("last"))
    known = glosses.where("gloss <> ''").groupBy("language", "term").agg(F.min("gloss").alias("gloss"))
    hop = hop.join(last, "word").join(known, ["language", "term"], "left")
    verb = F.when(F.col("k") > 1, "from").when(F.contains(F.col("r.reltype"), F.lit("borrow")), "Borrowed from").otherwise("From")
    meaning = F.when((F.col("k") == F.col("last")) & F.col("gloss").isNotNull(), F.concat(F.lit(" (“"), "gloss", F.lit("”)"))).otherwise("")
    said = hop.select("word", "k", F.concat(verb, F.lit(" "), "language", F.lit(" "), "term", meaning).alias("t"))
    chain = said.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("k", "t"))).alias("all"))
    chain = chain.select("word", F.concat(F.array_join(F.transform("all", lambda x: x["t"]), ", "), F.lit(".")).alias("chain"))

    foreign = F.when((F.col("language") != "") & (F.col("language") != own), F.concat("language", F.lit(" "))).otherwise("")
    label = F.coalesce(*(F.when(F.col("reltype") == k, v) for k, v in SIMPLE.items()))
    simple = r.where(F.col("reltype").isin(*SIMPLE)).withColumn("t", F.concat(label, F.lit(" "), foreign, "term", F.lit(".")))
    simple = simple.groupBy("word").agg(F.min_by("t", F.struct("row", "t")).alias("simple"))

    affix = F.col("reltype").isin("has_suffix", "has_prefix")
    piece = F.when(F.col("reltype") == "has_suffix", F.concat(F.lit("-"), F.regexp_replace("term", "^-", ""))).when(F.col("reltype") == "has_prefix", F.concat(F.regexp_replace("term", "-$", ""), F.lit("-")))
    of = r.where(F.col("reltype").isin(*STRUCTURE)).withColumn("t", F.when(affix, piece).otherwise(F.concat(foreign, "term"))).withColumn("rank", F.struct("position", "row"))
    # no text of `longest` characters holds more parts than that
    parts = _in_order(of, "t", longest).where(F.size("texts") >= 2).select("word", F.concat(F.lit("By surface analysis, "), F.array_join("texts", " + "), F.lit(".")).alias("parts"))
    each = chain.join(simple, "word", "full").join(parts, "word", "full")
    return each.select("word", F.substring(F.concat_ws(" ", F.coalesce("chain", "simple"), "parts"), 1, longest).alias("prose"))


def parsed(entries: DataFrame, languages: Sequence[str], own: str = "English") -> DataFrame:
    """Takes entries (word, prose); returns a row for each thing that the prose names: word, place, kind (inh, bor, lbor, cal, der, via, part,
    doublet, cognate, see), language, term, gloss, hedge and of, the place of the step that it explains (-1: the entry).

    Null or empty prose has no rows. Entries of one word are read each by itself.
    """
    names = frozenset(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
        columns = ["word", "place", "kind", "language", "term", "gloss", "hedge", "of"]
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                rows = [(w, k, *x) for w, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, x in enumerate(parser.parse(w or "", t, names, own))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], columns)

    return entries.select(F.col("word").cast("string"), F.col("prose").cast("string")).mapInArrow(run, "word string, place long, kind string, language string, term string, gloss string, hedge string, of long")


#: Words that say that an entry was made from one other of its language.
FROM_ONE = (
    "from", "deverbal from", "deverbal of", "clipping of", "clipped from", "shortening of", "short for", "back-formation from", "abbreviation of", "ellipsis of", "contraction of", "alteration of", "variant of",
    "diminutive of", "augmentative of", "nominalization of", "substantivization of", "verbal noun of", "agent noun of", "derived from", "conversion of", "frequentative of", "respelling of", "form of",
)
#: Words that may open an entry made of parts.
FROM_PARTS = ("from", "compound of", "blend of", "univerbation of", "equivalent to", "by surface analysis,", "surface analysis", "formed from", "composed of", "derived from")
_WORD = r"^[\p{L}\p{M}'’-]+$"


def _opening(texts: Sequence[str]) -> str:
    return r"(?i)^(?:" + "|".join(x.replace(" ", r"\s+") for x in sorted(texts, key=len, reverse=True)) + r")\s+"


def first_sentence(text: Column) -> Column:
    """The first sentence of prose, without brackets, quotations and years."""
    s = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), r"\(\s*\d{3,4}\s*\)\s*", "")
    s = F.get(F.split(s, r"(?<=[.;])\s"), F.lit(0))
    s = F.regexp_replace(F.regexp_replace(s, r"\([^()]*\)|“[^”]*”|\"[^\"]*\"", " "), r"\s+", " ")
    return F.trim(F.regexp_replace(F.trim(s), r"[.;:,]+$", ""))


def derived(entries: DataFrame, headwords: DataFrame, own: str = "English", languages: Sequence[str] = ()) -> DataFrame:
    """Takes entries (word, prose) and headwords (word); returns (word, place, language, term, kind) of entries whose prose derives them within
    their language: from two to four parts (kind part, or affix), or from one word (der).

    Every part in the language itself that isn't an affix must be a headword, as it stands or with another first letter's case or in lower
    case, and so must the one word; an entry of which one isn't has no rows at all. Parts of the languages named are taken as they are.
    Rows with one word and prose count once.
    """
    s = entries.where("word IS NOT NULL").select("word", first_sentence(F.col("prose")).alias("s")).where("s <> ''").distinct()
    several = F.col("s").rlike(r"\s\+\s")
    body = F.get(F.split(F.regexp_replace("s", _opening(FROM_PARTS), ""), r",|\bor\b|\bwith\b"), F.lit(0))
    pieces = F.transform(F.split(body, r"\s\+\s"), lambda x: F.regexp_replace(F.trim(x), r"(?i)^(?:the|an?)\s+", ""))
    rest = F.regexp_replace("s", _opening(FROM_ONE) + r"(?:the\s+)?(?:(?:verb|noun|adjective|adverb|stem|word)\s+)?", "")
    one = F.when(F.col("s").rlike(_opening(FROM_ONE)) & rest.rlike(r"^[^\s,]+(?:\s*,.*)?$"), F.array(F.regexp_extract(rest, r"^([^\s,]+)", 1)))
    found = s.select("word", several.alias("several"), F.when(several, pieces).otherwise(one).alias("pieces")).where(F.size("pieces").between(1, 4)).where(~F.col("several") | (F.size("pieces") >= 2))
    named = "^(" + "|".join(sorted(languages, key=len, reverse=True)) + r")\s+(\S+)$" if languages else r"^(?!)()()$"
    each = found.select("word", "several", "pieces", F.posexplode("pieces").alias("place", "piece"))
    each = each.withColumn("language", F.when(F.col("piece").rlike(named), F.regexp_extract("piece", named, 1)).otherwise(own))
    each = each.withColumn("term", F.when(F.col("language") != own, F.regexp_extract("piece", named, 2)).otherwise(F.col("piece")))
    affix = F.col("term").rlike("^-|-$")
    each = each.withColumn("kind", F.when(~F.col("several"), "der").when(affix, "affix").otherwise("part"))
    # the guard: spellings of a term that a headword may have
    t = F.col("term")
    spelt = F.array_distinct(F.array(t, F.lower(t), F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1_000))))
    own_words = each.where((F.col("language") == own) & ~affix & (t != F.col("word"))).select("term", F.explode(spelt).alias("spelling")).distinct()
    heads = headwords.select(F.col("word").alias("spelling")).distinct()
    real = own_words.join(heads, "spelling", "left_semi").select("term").distinct().withColumn("real", F.lit(True))
    judged = each.join(real, "term", "left")
    ok = F.col("term").rlike(_WORD) & ((F.col("language") != own) | (affix & F.col("several")) | F.coalesce("real", F.lit(False)))
    whole = judged.groupBy("word", "pieces").agg(F.bool_and(ok).alias("ok"), F.bool_or(F.col("kind") != "affix").alias("some")).where("ok AND some")
    return judged.join(whole.select("word", "pieces"), ["word", "pieces"], "left_semi").select("word", F.col("place").cast("long").alias("place"), "language", "term", "kind")
