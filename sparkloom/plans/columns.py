"""Column functions and predicates over the fixture's words, names and numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import language as lang
from ..functions import predicates as pred
from ..functions import scalar
from .registry import Registry, Tables
from .relational import _VOCABULARY, vocabulary

query = Registry()

#: Beginnings of glosses that part names follow, by key.
GLOSSES = (
    "A city in ", "A male given name of ", "plural of ", "Alternative spelling of ", "Synonym of ", "Abbreviation of ", "A large river near Old ", "A piece of ", "An inhabitant of North ", "Obsolete form of ", "Something with a ", "A language of South ", "The month of ",
)


def _texts(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _among(list_: str, words: list[str]) -> str:
    return f"list_has_any({list_}, {_texts(tuple(words))})"


_NAMES = sorted({*lang.ERAS, *(x for v in lang.FAMILIES.values() for x in v.split("|")), "Klingon"})
#: Languages that parts stand for, by key: each as it is and with what may stand before it.
LANGUAGES = tuple(x for k, n in enumerate(_NAMES) for x in (n, ("Old ", "Middle ", "Proto-", "Late Middle ", "Classical ")[k % 5] + n))

_BASES = {
    "words": f"(WITH {_VOCABULARY} SELECT DISTINCT lower(word) AS word FROM vocabulary)",
    "documents": "documents",
    "orders": "orders",
    "lineitem": "lineitem",
    "glosses": f"(SELECT p_partkey, p_name, {_texts(GLOSSES)}[(p_partkey % {len(GLOSSES)} + 1)::INT] || p_name AS gloss FROM part)",
    "languages": f"(SELECT p_partkey, {_texts(LANGUAGES)}[(p_partkey % {len(LANGUAGES)} + 1)::INT] AS language FROM part)",
}


def _base(spark, sf_dir: str, name: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    if name == "words":
        return vocabulary(t.documents).select(F.lower("word").alias("word")).distinct()
    if name == "glosses":
        start = F.element_at(F.array(*map(F.lit, GLOSSES)), (F.col("p_partkey") % len(GLOSSES) + 1).cast("int"))
        return t.part.select("p_partkey", "p_name", F.concat(start, F.col("p_name")).alias("gloss"))
    if name == "languages":
        names = F.array(*map(F.lit, LANGUAGES))
        return t.part.select("p_partkey", F.element_at(names, (F.col("p_partkey") % len(LANGUAGES) + 1).cast("int")).alias("language"))
    return getattr(t, name)


def _column(name: str, base: str, key: str, value: Callable[[], Column], sql: str) -> None:
    """Registers `name`: key and value() (as `value`) of every row of a base, beside the same in SQL."""

    def run(spark, sf_dir):
        return _base(spark, sf_dir, base).select(*key.split(", "), value().alias("value"))

    run.__name__ = name
    query(f"SELECT {key}, {sql} AS value FROM {_BASES[base]} AS base")(run)


c = F.col  # columns need a session, so the values below are made when a query runs

# predicates
_column("word_shapes", "words", "word", lambda: pred.word_shape(c("word")), "regexp_full_match(word, '[a-z]{4,12}') AND regexp_matches(word, '[aeiouy]') AND NOT regexp_full_match(word, '[ivxlcdm]+')")
_column("affixes", "words", "word", lambda: pred.affix(F.when(F.length(c("word")) % 3 == 0, F.concat(F.lit("-"), c("word"))).when(F.length(c("word")) % 3 == 1, F.concat(c("word"), F.lit("-"))).otherwise(c("word"))), "length(word) % 3 < 2")
_column("usable_examples", "documents", "doc_id", lambda: pred.usable_example(c("text")), r"""length(trim(regexp_replace(text, '\s+', ' ', 'g'))) BETWEEN 15 AND 300
  AND NOT regexp_matches(trim(regexp_replace(text, '\s+', ' ', 'g')), '^\d{4}|^c\.\s*\d|\[(…|\.\.\.)\]|ſ|[\x{370}-\x{3FF}\x{400}-\x{4FF}\x{590}-\x{5FF}\x{600}-\x{6FF}\x{900}-\x{97F}\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}]')""")  # fmt: skip
_HEAD = r"""(SELECT CASE WHEN list_position(s, true) > 0 THEN ws[: list_position(s, true) - 1] ELSE ws END FROM (
  SELECT ws, list_transform(ws, lambda x: list_contains(""" + _texts(tuple(pred.AFTER_HEAD)) + r""", x)) AS s FROM (SELECT list_filter(string_split_regex(regexp_extract(lower(gloss), '^[^,;:.(]*'), '[^\p{L}]+'), lambda x: x <> '') AS ws)))"""  # fmt: skip
_PROPER = f"""({_among(_HEAD, pred.KINDS_OF_PLACE + pred.KINDS_OF_PEOPLE + pred.KINDS_OF_BEING)} AND len(regexp_extract_all(regexp_replace(gloss, '^\\s*\\S+', ''), '\\p{{Lu}}\\p{{Ll}}{{2,}}')) >= 1
  OR {_among(_HEAD, pred.NAMED_BY_THEMSELVES)} OR regexp_matches(array_to_string({_HEAD}, ' '), '\\b(given name|brand name|trade name|family name|pet name)$')
  OR len(regexp_extract_all(regexp_replace(gloss, '^\\s*\\S+', ''), '\\p{{Lu}}\\p{{Ll}}{{2,}}')) >= 2)"""
_column("proper_glosses", "glosses", "p_partkey", lambda: pred.proper_gloss(c("gloss")), _PROPER)
_column("only_names", "glosses", "p_partkey", lambda: pred.only_name(F.array(F.when(c("p_partkey") % 2 == 0, "name").otherwise("noun")), c("gloss")), f"p_partkey % 2 = 0 AND NOT {_among(_HEAD, [*pred.CALENDAR, 'language'])}")
_POINTS = """CASE WHEN regexp_matches(gloss, '^(plural) of ') THEN 'inflection' WHEN regexp_matches(gloss, 'spelling of |^Obsolete form of ') THEN 'spelling'
  WHEN starts_with(gloss, 'Synonym of') THEN 'synonym' WHEN starts_with(gloss, 'Abbreviation of') THEN 'abbreviation' END"""
_column("pointer_types", "glosses", "p_partkey", lambda: pred.pointer(c("gloss"))["type"], _POINTS)
_column("pointer_targets", "glosses", "p_partkey", lambda: pred.pointer(c("gloss"))["target"], f"CASE WHEN {_POINTS} IS NOT NULL THEN p_name END")
_column("only_pointing", "glosses", "p_partkey", lambda: pred.only_pointers(F.array(c("gloss"), F.concat(F.lit("plural of "), c("p_name")))), f"CASE WHEN {_POINTS} IS NOT NULL THEN p_name END")
_column("quizzable_glosses", "glosses", "p_partkey", lambda: pred.quizzable(F.split("p_name", " ")[0], F.concat(F.lit("Of the colour "), F.when(c("p_partkey") % 2 == 0, c("gloss")).otherwise("in this style"))),
        f"p_partkey % 2 = 0 AND length('Of the colour ' || gloss) BETWEEN 8 AND 140 AND NOT contains(lower(gloss), split_part(p_name, ' ', 1)) AND NOT regexp_matches(gloss, 'spelling of ')")
_column("entry_types", "glosses", "p_partkey", lambda: pred.entry_type(F.when(c("p_partkey") % 3 == 0, F.initcap("p_name")).when(c("p_partkey") % 3 == 1, c("p_name")).otherwise(F.lit("word")), c("gloss"), c("p_partkey") % 2 == 0),
        f"CASE WHEN p_partkey % 3 = 0 AND {_PROPER} THEN 'name' WHEN p_partkey % 3 < 2 AND contains(p_name, ' ') THEN 'phrase' WHEN p_partkey % 2 = 0 AND {_POINTS} IS NOT NULL THEN 'inflection' ELSE 'established' END")
_column("chosen_topics", "orders", "o_orderkey", lambda: pred.chosen(F.array("o_orderstatus"), ["F"], F.array("o_orderpriority"), ["1-URGENT"]), "o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'")
_column("quotation_gate", "documents", "doc_id", lambda: pred.quotation_ok(c("text"), F.size(F.split("text", " ")), c("doc_id") % 9, c("doc_id") % 31),
        r"len(string_split(text, ' ')) BETWEEN 6 AND 45 AND doc_id % 31 > 0 AND doc_id % 9 <= greatest(2, floor((doc_id % 31) / 6)) AND NOT regexp_matches(text, '^\s*(Translation|Übersetzung|Traduction)\s*:|^[^a-zA-Z0-9_]*\d{4},\s+\p{Lu}|\bISBN\b')")
def _name() -> Column:
    return F.concat(F.initcap("p_name"), F.element_at(F.array(*map(F.lit, ("", " Books", " Times", " 1990", " Verlag", " von Ost"))), (c("p_partkey") % 6 + 1).cast("int")))


for _k, (_n, _f, _keys) in enumerate((("authors", pred.author, "0, 5"), ("publishers", pred.publisher, "1, 4"), ("presses", pred.press, "2"))):
    _column(_n, "glosses", "p_partkey", lambda f=_f: f(_name()), f"p_partkey % 6 IN ({_keys})")

# text
_column("truncated", "documents", "doc_id", lambda: scalar.clipped(c("text"), 100, 99), "CASE WHEN length(text) > 100 THEN text[:99] || '…' ELSE text END")
_column("folded_words", "words", "word", lambda: scalar.fold(c("word")), "replace(replace(replace(strip_accents(word), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae')")
_column("folded_marks", "words", "word", lambda: lang.folded(c("word")), "trim(replace(lower(strip_accents(word)), '*', ''))")
_column("normal_glosses", "documents", "doc_id", lambda: scalar.normal_gloss(c("text")), "trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'))")
_column("content_sets", "documents", "doc_id", lambda: F.array_join(F.array_sort(scalar.content_words(c("text"), ("the", "and"))), " "),
        "array_to_string(list_sort(list_filter(list_distinct(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ')), lambda x: length(x) >= 3 AND x NOT IN ('the', 'and'))), ' ')")
_STEM = r"regexp_replace({}, '(isation|ization|ical|ness|ity|ise|ize|ous|our|ic|al|ly|or|re|er|e)$', '')"
_column("stems", "words", "word", lambda: lang.stem(c("word")), _STEM.format("word"))
_column("kindred", "words", "word", lambda: lang.kin(c("word"), F.concat(F.expr("left(word, length(word) - 1)"), F.lit("ical"))),
        "length({0}) >= 4 AND length({1}) >= 4 AND (starts_with({0}, {1}) OR starts_with({1}, {0}))".format(_STEM.format("word"), _STEM.format("word[:-2] || 'ical'")))
_column("variant_guard", "words", "word", lambda: lang.variants(c("word"), F.concat(F.expr("left(word, 6)"), F.lit("s"))), "word[:5] = (word[:6] || 's')[:5] AND (contains(word, word[:6] || 's') OR contains(word[:6] || 's', word))")
_column("citation_rule", "words", "word", lambda: lang.nominative(F.concat(c("word"), F.when(F.length(c("word")) % 2 == 0, "tatem").otherwise("tionem"))), "word || CASE WHEN length(word) % 2 = 0 THEN 'tas' ELSE 'tio' END")
_column("string_hash", "words", "word", lambda: scalar.djb2(c("word")), "list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(word, ''), lambda x: unicode(x)::BIGINT)), lambda h, x: (h * 33 + x) % 4294967296)")
_column("context_snippets", "documents", "doc_id", lambda: lang.snippet(c("text"), F.lit(200)), "CASE WHEN length(text) <= 160 THEN text ELSE '…' || trim(substring(text, 130, 140), ' ') || CASE WHEN 270 <= length(text) THEN '…' ELSE '' END END")
_column("canonical_hash", "orders", "o_orderkey", lambda: lang.canonical(F.struct(c("o_orderstatus").alias("z"), F.when(c("o_orderkey") % 2 == 0, F.create_map(F.lit("b"), c("o_orderpriority"), F.lit("a"), c("o_orderstatus"))).otherwise(F.create_map(F.lit("a"), c("o_orderstatus"), F.lit("b"), c("o_orderpriority"))).alias("tags"), c("o_custkey"))),
        "sha256('{\"o_custkey\":' || o_custkey || ',\"tags\":{\"a\":\"' || o_orderstatus || '\",\"b\":\"' || o_orderpriority || '\"},\"z\":\"' || o_orderstatus || '\"}')")
_column("edge_sentences", "orders", "o_orderkey", lambda: lang.edge_sentence(F.element_at(F.array(*map(F.lit, ("inh", "bor", "cmp", "zzz"))), (c("o_orderkey") % 4 + 1).cast("int")), c("o_orderpriority"), c("o_orderstatus")),
        "['inherited from', 'borrowed from', 'made with', 'from'][(o_orderkey % 4 + 1)::INT] || ' ' || o_orderstatus || ' ' || o_orderpriority")
_column("shown_forms", "words", "word", lambda: lang.shown_form(F.length(c("word")), c("word")), "length(word) * 10 + length(regexp_replace(word, '[\\x00-\\x7F]', '', 'g'))")
_column("years_named", "orders", "o_orderkey", lambda: scalar.year_of(F.when(c("o_orderkey") % 3 == 0, F.concat(F.lit("printed in "), F.date_format("o_orderdate", "yyyy"))).when(c("o_orderkey") % 3 == 1, F.lit("in the 12th century")).otherwise("long ago")),
        "CASE o_orderkey % 3 WHEN 0 THEN year(o_orderdate) WHEN 1 THEN 1100 END")
_column("first_domain", "orders", "o_orderkey", lambda: lang.domain(F.array(F.when(c("o_orderkey") % 2 == 0, "sciences").otherwise("society"), c("o_orderpriority"))), "o_orderpriority")
_column("spelling_score", "words", "word", lambda: lang.american(F.concat(F.expr("left(word, 3)"), F.element_at(F.array(*map(F.lit, ("our", "ise", "ize", "t"))), (F.length(c("word")) % 4 + 1).cast("int")))), "[-1, -1, 1, 0][length(word) % 4 + 1]")

# numbers and languages
_column("log_radii", "orders", "o_orderkey", lambda: scalar.log_radius(F.year("o_orderdate") - c("o_orderkey") % 3000), "-ln(2400 - least(year(o_orderdate) - o_orderkey % 3000, 2000))")
_column("rounded", "lineitem", "l_orderkey, l_linenumber", lambda: scalar.half_up(c("l_extendedprice") / 7), "floor(l_extendedprice / 7 + 0.5)::BIGINT")
_column("size_bytes", "orders", "o_orderkey", lambda: lang.size_byte(c("o_orderkey")), "least(255, floor(log2(1 + o_orderkey) * 18 + 0.5))::INT")
def _kinds() -> Column:
    return F.element_at(F.array(*map(F.lit, lang.KIND_BITS)), (c("o_orderkey") % 7 + 1).cast("int"))


def _source() -> Column:
    return F.element_at(F.array(*map(F.lit, ("x", "d", "r"))), (c("o_orderkey") % 3 + 1).cast("int"))


_column("edge_fields", "orders", "o_orderkey", lambda: lang.edge_bits(_kinds(), _source()), "(o_orderkey % 7 + [0, 8, 16][(o_orderkey % 3 + 1)::INT])::INT")
_column("edge_kinds", "orders", "o_orderkey", lambda: lang.edge_of_bits(lang.edge_bits(_kinds(), _source()))["kind"], f"{_texts(lang.KIND_BITS)}[(o_orderkey % 7 + 1)::INT]")
_ERA = " ".join(f"WHEN language = '{k}' THEN {v}" for k, v in lang.ERAS.items()) + " " + " ".join(f"WHEN regexp_matches(language, '{p}') THEN {y}" for p, y in lang.ERA_RULES)
_column("eras", "languages", "p_partkey, language", lambda: lang.era(c("language")), f"CASE {_ERA} ELSE {lang.MODERN} END")
_FAMILY = " ".join(f"WHEN regexp_matches(language, '^({v})$') THEN '{k}'" for k, v in lang.ENGLISH.items()) + " " + " ".join("WHEN regexp_matches(language, '{}') THEN '{}'".format(v.replace("'", "''"), k) for k, v in lang.FAMILIES.items())
_column("families", "languages", "p_partkey, language", lambda: lang.family(c("language")), f"CASE {_FAMILY} ELSE 'Other' END")
_column("day_keys", "orders", "o_orderkey", lambda: F.concat_ws("-", F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate")), "year(o_orderdate) || '-' || month(o_orderdate) || '-' || day(o_orderdate)")
