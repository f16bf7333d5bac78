"""Running text to dictionary entries: readings, fallbacks, difficulty, judging, distractors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import content_words
from ..sources.shared import stash
from .curation import by_rules
from .relational import top_by
from .sampling import chance, digest, hurdle

#: So many separable prefixes are parameters of a plan; more are joined.
PREFIXES = 200

# Words that stand for two, and particles that lose their vowel.
CONTRACTIONS = {
    "fr": {"du": ("de", "le"), "des": ("de", "les"), "au": ("à", "le"), "aux": ("à", "les")},
    "de": {"zum": ("zu", "dem"), "zur": ("zu", "der"), "im": ("in", "dem"), "am": ("an", "dem"), "vom": ("von", "dem"), "beim": ("bei", "dem"), "ins": ("in", "das"), "ans": ("an", "das")},
}
ELISIONS = {"l": "le", "d": "de", "j": "je", "m": "me", "t": "te", "s": "se", "n": "ne", "c": "ce", "qu": "que", "jusqu": "jusque", "lorsqu": "lorsque", "puisqu": "puisque"}
#: Endings of inflected forms, tried in order.
FALLBACKS = {"fr": [("s", "", "plural"), ("x", "", "plural"), ("e", "", "feminine"), ("es", "", "feminine plural"), ("aux", "al", "plural")], "de": [("en", "", "ending"), ("em", "", "ending"), ("er", "", "ending"), ("es", "", "ending"), ("e", "", "ending"), ("n", "", "ending"), ("s", "", "ending")]}


def parts_of(token: Column, language: str) -> Column:
    """The words in a token: contractions and elisions taken apart, hyphenated ones split."""
    t = F.lower(token)
    out = F.split(t, "-")
    head = F.regexp_extract(t, "^([a-z]+)['’](.+)$", 1)
    full = F.lit(None).cast("string")
    for short, word in ELISIONS.items():
        full = F.when(head == short, F.lit(word)).otherwise(full)
    if language == "fr":
        out = F.when(full.isNotNull(), F.array(full, F.regexp_extract(t, "^([a-z]+)['’](.+)$", 2))).otherwise(out)
    for word, pair in CONTRACTIONS.get(language, {}).items():
        out = F.when(t == word, F.array(*map(F.lit, pair))).otherwise(out)
    return out


def readings(surfaces: DataFrame, forms: DataFrame, most: int = 4, ratio: float = 0.8) -> DataFrame:
    """(surface) and (surface, entry, zipf, closed, demoted, ord) to (surface, entry, rank), best first.

    Demoted readings come last and closed-class words first; a rarer reading stands only
    if its frequency is at least `ratio` of the best one's.
    """
    c = surfaces.select("surface").distinct().join(forms, "surface")
    best = c.groupBy("surface").agg(F.max("zipf").alias("_best"))
    ok = c.join(best, "surface").where((F.col("zipf") >= F.lit(ratio) * F.col("_best")) | F.col("closed"))
    return top_by(ok, ["surface"], [F.col("demoted"), ~F.col("closed"), F.desc("zipf"), F.col("ord"), F.col("entry")], most).select("surface", "entry", "rank")


#: Fixed values, in thousandths: what a reading costs by how it is reached (closed-class title, title, demoted title, closed-class form, strong form, weak
#: form, another spelling, override, name), by the variant of the surface it is reached from, and what counts as strong, and as a strong common reading.
COSTS = {"closed": 500, "title": 2000, "demoted": 5000, "closed form": 600, "strong form": 1000, "form": 3000, "spelling": 2500, "override": -1000, "name": -500}
VARIANT, LAST_RESORT, STRONG, COMMON = 500, 4000, 0.8, 1100
#: Links of spellings, and of forms of forms, that are followed; readings that another spelling passes on.
SPELLINGS, FORMS_OF_FORMS, PASSED_ON = 3, 3, 2


def spelled(surfaces: DataFrame, german: bool) -> DataFrame:
    """(surface, initial) with the spellings that are tried, v, in order k from 0, and what each costs: the surface, in lower case (first, if it begins
    a sentence), and in German with a capital."""
    s, low = F.col("surface"), F.lower("surface")
    cased = low != s
    order = F.when(cased & F.col("initial"), F.array(low, s)).when(cased, F.array(s, low)).otherwise(F.array(s))
    lower_first = F.substring(s, 1, 1).rlike(r"^\p{Ll}")
    if german:
        order = F.when(lower_first, F.concat(order, F.array(F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1_000))))).otherwise(order)
    each = surfaces.select("surface", "initial", F.posexplode(order).alias("k", "v"))
    last = (F.col("v") != s) & lower_first
    if german:
        last = last | ((F.col("v") != s) & F.substring(s, 1, 1).rlike(r"^\p{Lu}") & ~F.col("initial"))
    return each.withColumn("cost", F.when(last, LAST_RESORT).otherwise(F.col("k") * VARIANT))


def lemmas_of(forms: DataFrame, entries: DataFrame) -> DataFrame:
    """(form, lemma, ord): what a form is a form of, in the order of ord; a lemma without an entry that is itself a form is followed to its first lemma."""
    titles = entries.select(F.col("title").alias("lemma"), F.lit(True).alias("_there")).distinct()
    first = forms.groupBy("form").agg(F.min_by("lemma", F.struct("ord", "lemma")).alias("_next")).select(F.col("form").alias("lemma"), "_next")
    out = forms.select("form", "lemma", "ord")
    for _ in range(FORMS_OF_FORMS):
        j = out.join(titles, "lemma", "left").join(first, "lemma", "left")
        out = j.select("form", F.when(F.col("_there").isNull() & F.col("_next").isNotNull(), F.col("_next")).otherwise(F.col("lemma")).alias("lemma"), "ord")
    return out.groupBy("form", "lemma").agg(F.min("ord").alias("ord"))


def strengths(asked: DataFrame, forms: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(v, lemma) to (v, lemma, alone, all): the frequency of the lemma and its forms other than v, over that of v; `alone` without those
    that another lemma of v has too (the lemma itself counts always). v of no frequency: 1 for each."""
    members = forms.select("lemma", F.col("form").alias("f")).unionByName(asked.select("lemma", F.col("lemma").alias("f"))).distinct()
    of = asked.join(members, "lemma").join(frequencies.select(F.col("word").alias("f"), "n"), "f", "left")
    shared = of.groupBy("v", "f").agg(F.count_distinct("lemma").alias("_lemmas"))
    other = F.lower("f") != F.lower("v")
    own = (F.col("_lemmas") == 1) | (F.col("f") == F.col("lemma"))
    n = F.coalesce("n", F.lit(0))
    sums = of.join(shared, ["v", "f"]).groupBy("v", "lemma").agg(F.sum(F.when(other & own, n).otherwise(0)).alias("a"), F.sum(F.when(other, n).otherwise(0)).alias("b"))
    fs = frequencies.select(F.col("word").alias("v"), F.col("n").alias("_fs")).where("n > 0")
    return sums.join(fs, "v", "left").select("v", "lemma", F.coalesce(F.col("a") / F.col("_fs"), F.lit(1.0)).alias("alone"), F.coalesce(F.col("b") / F.col("_fs"), F.lit(1.0)).alias("all"))


def ranked_readings(surfaces: DataFrame, entries: DataFrame, forms: DataFrame, frequencies: DataFrame, overrides: DataFrame | None = None, german: bool = False) -> DataFrame:
    """The entries that a written word can be, best first: (surface, initial, entry, how, cost, rank).

    Takes surfaces (surface, initial: it begins a sentence), entries (entry, title, ord, name, closed, demoted, spelling_of: the title that a
    demoted entry is another spelling of, null for none), forms (form, lemma, ord), frequencies (word, n) and overrides (surface, entry).

    A title costs less if closed-class, more if demoted; a form less if its lemma's other forms are common and commoner than
    those of the same title, by their share of the surface's frequency; each spelling tried after the first costs more. A demoted entry that is another spelling
    passes on the best two readings of the title it names, whose readings may be passed on in turn, three links far: all titles
    so named are ranked at once, in as many rounds, so that links that loop end. A capitalised word that has a name is the name, unless a common
    reading is strong (not in German). Equal surfaces count once; a surface without a reading has no row.
    """
    e = stash(entries.select("entry", "title", "ord", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("name", "closed", "demoted")), "spelling_of"), "entries")
    lemmas = stash(lemmas_of(forms.select("form", "lemma", "ord").distinct(), e), "lemmas")
    known = e.select(F.col("title").alias("t")).union(forms.select("form")).distinct()
    links = e.where("demoted AND NOT name AND spelling_of IS NOT NULL AND spelling_of <> title").join(known, F.col("spelling_of") == F.col("t"), "left_semi").select("entry", F.col("spelling_of").alias("to"))
    asked = surfaces.select("surface", "initial").where("surface <> ''").unionByName(links.select(F.col("to").alias("surface"), F.lit(False).alias("initial"))).distinct()
    tried = stash(spelled(asked, german), "spellings")
    vs = tried.select("v").distinct()

    # how strong lemmas are, and titles in their own right
    titles = e.join(vs, F.col("title") == F.col("v"), "left_semi").groupBy(F.col("title").alias("v")).agg(F.bool_or(~F.col("demoted")).alias("_plain"))
    of = lemmas.join(vs, F.col("form") == F.col("v"), "left_semi").select(F.col("form").alias("v"), "lemma", "ord")
    rated = stash(strengths(of.select("v", "lemma").union(titles.select("v", F.col("v").alias("lemma"))).distinct(), lemmas, frequencies), "strengths")
    own = titles.join(rated.where("lemma = v"), "v").select("v", F.when(F.col("_plain"), F.greatest("all", "alone")).otherwise(F.col("alone")).alias("_title"))

    best = e.groupBy(F.col("title").alias("lemma")).agg(F.min_by(F.struct("entry", "closed"), F.struct("demoted", "ord", "entry")).alias("_e"))
    by_form = of.join(best, "lemma").join(rated, ["v", "lemma"]).join(own, "v", "left")
    strong = (F.col("alone") >= STRONG) & (F.col("alone") > F.coalesce("_title", F.lit(0.0)))
    kind = F.when(F.col("_e.closed"), COSTS["closed form"]).when(strong, COSTS["strong form"]).otherwise(COSTS["form"])
    by_form = by_form.select("v", F.col("_e.entry").alias("entry"), F.lit("form").alias("how"), (kind - F.floor(F.least("alone", F.lit(50.0)))).alias("c"), F.struct(F.lit(1).alias("s"), F.col("ord").cast("long").alias("o"), F.col("lemma").alias("t")).alias("_o"))
    linked = e.join(links.select("entry", "to"), "entry", "left")
    cost = F.when(F.col("demoted"), COSTS["demoted"]).when(F.col("closed"), COSTS["closed"]).otherwise(COSTS["title"])
    first = F.struct(F.lit(0).alias("s"), (F.when(F.col("demoted"), F.lit(1_000_000)).otherwise(0).cast("long") + F.col("ord")).alias("o"), F.col("entry").cast("string").alias("t"))
    by_title = linked.select(F.col("title").alias("v"), "entry", F.lit("title").alias("how"), cost.alias("c"), first.alias("_o"))
    base = by_title.join(vs, "v", "left_semi").union(by_form)
    if overrides is not None:
        base = base.union(overrides.select(F.col("surface").alias("v"), "entry", F.lit("override"), F.lit(None).cast("long"), F.struct(F.lit(2).alias("s"), F.lit(0).cast("long").alias("o"), F.lit("").alias("t"))))
    fixed = F.when(F.col("how") == "override", COSTS["override"]).otherwise(F.col("c") + F.col("cost"))
    reached = stash(tried.join(base, "v").select("surface", "initial", "entry", "how", fixed.cast("long").alias("c"), F.struct(F.col("k"), F.col("_o.s").alias("s"), F.col("_o.o").alias("o"), F.col("_o.t").alias("t")).alias("at")), "reached")
    names = e.where("name").select(F.col("title").alias("_s"), F.col("entry").alias("_n"))

    def ranked(passed: DataFrame | None) -> DataFrame:
        """All readings of all that was asked, given what other spellings pass on: (to, entry, place)."""
        rows = reached
        if passed is not None:
            over = tried.join(linked.where("to IS NOT NULL").select(F.col("title").alias("v"), "to", F.col("ord")), "v").join(passed, "to")
            rows = rows.unionByName(over.select("surface", "initial", "entry", F.lit("alt").alias("how"), (F.col("cost") + COSTS["spelling"]).cast("long").alias("c"), F.struct(F.col("k"), F.lit(0).alias("s"), (F.col("ord") + 1_000_000).cast("long").alias("o"), F.format_string("%02d", "place").alias("t")).alias("at")))
        one = rows.groupBy("surface", "initial", "entry").agg(F.min(F.struct("c", "how")).alias("b"), F.min("at").alias("at"))
        if not german:
            named = F.col("_n").isNotNull() & F.substring("surface", 1, 1).rlike(r"^\p{Lu}")
            n = one.join(names, (F.col("surface") == F.col("_s")) & (F.col("entry") == F.col("_n")), "left").select("surface", "initial", "entry", "b", "at", named.alias("_named"), F.col("_n").isNotNull().alias("_name"))
            common = n.where(~F.col("_name") & (F.col("b.c") <= COMMON)).select("surface", "initial").distinct().withColumn("_strong", F.lit(True))
            n = n.join(common, ["surface", "initial"], "left")
            is_name = F.col("_named") & F.col("_strong").isNull() & (F.col("b.c") > COSTS["name"])
            one = n.select("surface", "initial", "entry", F.when(is_name, F.struct(F.lit(COSTS["name"]).cast("long").alias("c"), F.lit("name").alias("how"))).otherwise(F.col("b")).alias("b"), "at")
        w = Window.partitionBy("surface", "initial").orderBy("b.c", "at", "entry")
        return one.select("surface", "initial", "entry", F.col("b.how").alias("how"), F.col("b.c").alias("cost"), F.row_number().over(w).alias("rank"))

    passed = None
    for _ in range(SPELLINGS):
        top = ranked(passed).where(~F.col("initial") & (F.col("rank") <= PASSED_ON)).select(F.col("surface").alias("to"), "entry", F.col("rank").alias("place"))
        passed = stash(top.join(links.select("to").distinct(), "to", "left_semi"), "passed")
    wanted = surfaces.select("surface", "initial").distinct()
    return ranked(passed).join(wanted, ["surface", "initial"], "left_semi")


def fallbacks(words: DataFrame, lexicon: DataFrame, language: str) -> DataFrame:
    """(word, base, rule) for words that the lexicon lacks, by the first ending whose base it has."""
    missing = words.select("word").distinct().join(lexicon.select("word"), "word", "left_anti")
    return by_rules(missing.unionByName(lexicon.select("word")), FALLBACKS[language]).join(missing, "word", "left_semi")


def runner_up(ranked: DataFrame) -> DataFrame:
    """The second reading of each surface."""
    return ranked.where("rank = 2").select("surface", "entry")


def difficulty(tokens: DataFrame, quote: str = "quote") -> DataFrame:
    """(quote, entry, zipf, transparent, name) to (quote, counted, hard, unknown, h): the share of
    counted tokens that are unknown, or rare and not transparent; names don't count."""
    t = tokens.where(~F.coalesce("name", F.lit(False)))
    unknown = F.col("entry").isNull()
    hard = unknown | ~((F.coalesce("zipf", F.lit(0.0)) >= 5) | F.coalesce("transparent", F.lit(False)))
    g = t.groupBy(quote).agg(F.count("*").alias("counted"), F.count_if(hard).alias("hard"), F.count_if(unknown).alias("unknown"))
    return g.withColumn("h", F.bround(F.col("hard") / F.col("counted"), 2))


def excerpts(coverage: DataFrame, due: DataFrame, k: int, seed: int) -> DataFrame:
    """(user, quote, unknown, n) to the k to read next: 1 to 3 unknown words and 85 % known before
    6 and 70 % before the rest, those with due words (user, quote) first, then by chance."""
    share = 1 - F.col("unknown") / F.col("n")
    tier = F.when(F.col("unknown").between(1, 3) & (share >= 0.85), 0).when((F.col("unknown") <= 6) & (share >= 0.7), 1).otherwise(2)
    c = coverage.withColumn("tier", tier).join(due.select("user", "quote").distinct().withColumn("_due", F.lit(0)), ["user", "quote"], "left")
    return top_by(c, ["user"], [F.col("tier"), F.coalesce("_due", F.lit(1)), chance(seed, F.col("user"), F.col("quote")), F.col("quote")], k).drop("_due")


def judged(glosses: DataFrame, answers: DataFrame, least: int = 3, stem: int = 5) -> DataFrame:
    """(quote, gloss) and (quote, answer) to (quote, words, found): how many of the glosses'
    content words the answer has, by their first letters."""
    stems = lambda text: F.transform(content_words(text, least=least), lambda w: F.substring(w, 1, stem))
    j = glosses.join(answers, "quote")
    hit = F.exists(stems(F.col("gloss")), lambda s: F.array_contains(stems(F.col("answer")), s))
    return j.groupBy("quote").agg(F.count("*").alias("words"), F.count_if(hit).alias("found"))


def separable(tokens: DataFrame, verbs: DataFrame) -> DataFrame:
    """(quote, sentence, place, token) and (prefix, stem, verb) to (quote, sentence, verb, place): a stem
    with its prefix later in the same sentence, the nearest one."""
    s = tokens.join(verbs, F.lower("token") == F.col("stem")).select("quote", "sentence", "place", "prefix", "verb")
    p = tokens.select("quote", "sentence", F.col("place").alias("_p"), F.lower("token").alias("prefix"))
    j = s.join(p, ["quote", "sentence", "prefix"]).where("_p > place")
    return j.groupBy("quote", "sentence", "place").agg(F.min_by("verb", F.struct("_p", "verb")).alias("verb"))


def separable_in(sentences: DataFrame, verbs: DataFrame) -> DataFrame:
    """separable() over whole sentences (quote, sentence, words): only words of a stem's length with a prefix later in their sentence
    travel to the verbs, each once, with the first place of each prefix behind it.

    A language has few separable prefixes; over PREFIXES of them, sentences are cut into words for separable().
    """
    found = verbs.select("prefix").distinct().limit(PREFIXES + 1).collect()  # bounded; what goes beyond is done by joins
    if len(found) > PREFIXES:
        each = sentences.select("quote", "sentence", F.posexplode("words").alias("place", "token"))
        return separable(each.withColumn("place", F.col("place").cast("long")), verbs)
    prefixes = [r["prefix"] for r in found if r["prefix"] is not None]
    if not prefixes:
        return separable(sentences.select("quote", "sentence", F.lit(0).cast("long").alias("place"), F.lit("").alias("token")), verbs).limit(0)
    shortest = verbs.agg(F.min(F.length("stem"))).first()[0] or 0
    at = F.filter(F.transform("words", lambda w, k: F.struct(k.cast("long").alias("p"), F.lower(w).alias("prefix"))), lambda x: x["prefix"].isin(*prefixes))
    has = sentences.withColumn("_at", at).where(F.size("_at") > 0)
    # words before the last prefix
    before = F.slice("words", F.lit(1), F.element_at("_at", -1)["p"].cast("int"))
    each = has.select("quote", "sentence", "_at", F.posexplode(before).alias("place", "token")).where(F.length("token") >= shortest)
    behind = F.filter("_at", lambda x: x["p"] > F.col("place"))
    firsts = F.transform(F.array_distinct(F.transform(behind, lambda x: x["prefix"])), lambda f: F.filter(behind, lambda x: x["prefix"] == f)[0])
    asked = each.select("quote", "sentence", F.col("place").cast("long").alias("place"), F.lower("token").alias("stem"), firsts.alias("_f"))
    by_stem = verbs.groupBy("stem").agg(F.collect_set(F.struct("prefix", "verb")).alias("_v"))
    j = asked.join(by_stem.hint("merge"), "stem").select("quote", "sentence", "place", F.explode("_f").alias("_f"), "_v")
    j = j.select("quote", "sentence", "place", "_f", F.explode("_v").alias("_v")).where("_f.prefix = _v.prefix")
    return j.groupBy("quote", "sentence", "place").agg(F.min_by("_v.verb", F.struct("_f.p", "_v.verb")).alias("verb"))


def distractors(words: DataFrame, related: DataFrame, alike: DataFrame, pool: DataFrame, synonyms: DataFrame, k: int, seed: int) -> DataFrame:
    """(word, gloss) to (word, other, rank): related words, then look-alikes, then others by chance;
    no synonym, and no content word of the gloss shared.  pool has (other, gloss, band) and is
    met by band; words has the band too, else none come by chance.

    Of a band's words only those under a hurdle of chance, by the band's size, travel on; a word that keeps fewer than k
    is met with its band again without one, so that the picks are those of all candidates.
    """
    apart = ~F.arrays_overlap("_g", "_o")
    asked = words.select(*words.columns, content_words(F.col("gloss")).alias("_g")).drop("gloss")
    held = pool.withColumn("_o", content_words(F.col("gloss"))).drop("gloss")
    c = related.select("word", "other", F.lit(0).alias("tier")).unionByName(alike.select("word", "other", F.lit(1).alias("tier"))).where("word <> other")
    c = c.groupBy("word", "other").agg(F.min("tier").alias("tier")).join(synonyms.select("word", "other").hint("merge"), ["word", "other"], "left_anti")
    c = c.join(asked.select("word", "_g").hint("merge"), "word").join(held.select("other", "_o").hint("merge"), "other").where(apart)
    first = c.select("word", "other", "tier")
    if "band" in words.columns:
        drawn = digest(seed, F.col("word"), F.col("other"))
        sizes = pool.groupBy("band").agg(F.count("*").alias("_n"))
        asked = asked.join(sizes.hint("merge"), "band").withColumn("_h", hurdle(F.col("_n"), 6 * k)).drop("_n")
        known = stash(first, "known")

        def met(some: DataFrame, kept: Column) -> DataFrame:
            by_chance = some.join(held.hint("merge"), "band").where((F.col("word") != F.col("other")) & kept & apart).select("word", "other")
            by_chance = by_chance.join(synonyms.select("word", "other").hint("merge"), ["word", "other"], "left_anti")
            return by_chance.join(known.hint("merge"), ["word", "other"], "left_anti").select("word", "other", F.lit(2).alias("tier")).distinct()

        first = stash(known.unionByName(met(asked, F.col("_h").isNull() | (drawn < F.col("_h")))), "distractors")
        enough = first.groupBy("word").agg(F.count("*").alias("_k")).where(F.col("_k") >= k)
        short = asked.where("_h IS NOT NULL").join(enough.hint("merge"), "word", "left_anti")
        first = first.unionByName(met(short, drawn >= F.col("_h")))
    return top_by(first, ["word"], [F.col("tier"), F.substring(digest(seed, F.col("word"), F.col("other")), 1, 12), F.col("other")], k).select("word", "other", "rank")


def sense_link(senses: DataFrame, links: DataFrame) -> DataFrame:
    """(word, ord, gloss) and (word, other, gloss) to (word, other, ord): the sense that a link
    names, else the first that mentions the other word."""
    named = links.join(senses, ["word", "gloss"]).select("word", "other", "ord", F.lit(0).alias("tier"))
    said = links.select("word", "other").join(senses, "word").where(F.contains(F.lower("gloss"), F.lower("other"))).select("word", "other", "ord", F.lit(1).alias("tier"))
    return named.unionByName(said).groupBy("word", "other").agg(F.min_by("ord", F.struct("tier", "ord")).alias("ord"))


def bands_of(frame: DataFrame, zipf: Column, edges: Sequence[float]) -> DataFrame:
    """frame with `band`, how many of the edges a frequency reaches."""
    return frame.withColumn("band", sum((F.when(zipf >= e, 1).otherwise(0) for e in edges), F.lit(0)))
