"""Entity resolution and enrichment of dictionary-shaped tables: plans as diffs.

Every plan returns what would change; apply_diff() makes it so, and planning
again afterwards finds nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stash
from .relational import first_by


def fold_senses(senses: DataFrame, keys: Sequence[str], norm: Column, example: str, gloss: str, order: Sequence[Column]) -> DataFrame:
    """Senses alike in keys and normalised gloss as one: with an example before without,
    longer before shorter, earlier before later; `example` is carried over, `folded` counts the rest."""
    s = senses.withColumn("_norm", norm)
    groups = [*keys, "_norm"]
    rest = [c for c in senses.columns if c not in keys and c != example]
    rank = F.struct(F.col(example).isNull(), -F.length(gloss), *order)
    best = s.groupBy(*groups).agg(F.min_by(F.struct(*rest), rank).alias("_row"), F.min_by(F.col(example), rank).alias(example), (F.count("*") - 1).alias("folded"))
    return best.select(*keys, *(F.col("_row")[c].alias(c) for c in rest), example, "folded")


def backfill(base: DataFrame, donor: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """A diff: rows of base with a blank column that donor (a row a key) can fill; what is there stays."""
    d = donor.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns))
    j = base.join(d, F.col(key) == F.col("_key"))
    blank = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) == "" for c in columns}
    gains = F.lit(False)
    for c in columns:
        gains = gains | (blank[c] & F.col(f"_{c}").isNotNull() & (F.col(f"_{c}").cast("string") != ""))
    filled = [F.when(blank[c], F.coalesce(F.col(f"_{c}"), F.col(c))).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns]
    return j.where(gains).select(*filled)


def upsert(base: DataFrame, patch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A diff: rows of patch that are new or differ, with `change`; columns that patch leaves null keep their value."""
    rest = [c for c in base.columns if c not in keys]
    b = base.select(*keys, *(F.col(c).alias(f"_b_{c}") for c in rest), F.lit(True).alias("_there"))
    j = patch.select(*keys, *rest).join(b, list(keys), "left")
    j = j.select(*keys, *(F.coalesce(F.col(c), F.col(f"_b_{c}")).alias(c) for c in rest), *(f"_b_{c}" for c in rest), "_there")
    differs = F.lit(False)
    for c in rest:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    new = F.col("_there").isNull()
    return j.where(new | differs).select(*keys, *rest, F.when(new, "new").otherwise("changed").alias("change"))


def by_rules(words: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(word) to (word, base, rule): the first rule (ending, replacement, name) whose result is a word too."""
    table = F.array(*(F.struct(F.lit(k).alias("ord"), F.lit(a).alias("ending"), F.lit(b).alias("put"), F.lit(n).alias("rule")) for k, (a, b, n) in enumerate(rules)))
    made = words.select("word", F.explode(table).alias("r")).where(F.col("word").endswith(F.col("r.ending")) & (F.length("word") > F.length("r.ending") + 2))
    base = F.concat(F.substring(F.col("word"), F.lit(1), F.length("word") - F.length("r.ending")), F.col("r.put"))
    ok = made.withColumn("base", base).where("base <> word").join(words.select(F.col("word").alias("base")).distinct(), "base", "left_semi")
    return first_by(ok.select("word", "base", F.col("r.rule").alias("rule"), F.col("r.ord").alias("ord")), ["word"], [F.col("ord"), F.col("base")]).select("word", "base", "rule")


def collapse(forms: DataFrame) -> DataFrame:
    """(word, base, rule) to (base, forms): sorted; a base that is itself a form is passed on one step."""
    up = forms.select(F.col("word").alias("base"), F.col("base").alias("_top"))
    root = forms.join(up, "base", "left").select("word", F.coalesce("_top", "base").alias("base"))
    return root.where("word <> base").groupBy("base").agg(F.array_sort(F.collect_set("word")).alias("forms"))


def preferred(candidates: DataFrame, key: str, tiers: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """One candidate a key: the one in the first tier that holds, the first in order among equals."""
    tier = F.lit(len(tiers))
    for k in range(len(tiers) - 1, -1, -1):
        tier = F.when(tiers[k], F.lit(k)).otherwise(tier)
    return first_by(candidates.withColumn("tier", tier), [key], [F.col("tier"), *order])


def only_best(candidates: DataFrame, key: str, score: str) -> DataFrame:
    """Keys whose best score one candidate alone has."""
    top = candidates.groupBy(key).agg(F.max(score).alias("_max"))
    tied = candidates.join(top, key).where(F.col(score) == F.col("_max"))
    alone = tied.groupBy(key).agg(F.count("*").alias("_n")).where("_n = 1").select(key)
    return tied.join(alone, key, "left_semi").drop("_max")


def vetoed(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """First verdicts that a second opinion, where there is one, doesn't contradict."""
    no = second.select(F.col(key), F.col("verdict").alias("_second"))
    return first.join(no, key, "left").where(F.col("_second").isNull() | (F.col("_second") == F.col("verdict"))).drop("_second")


def resolve_pointers(pointers: DataFrame, order: Sequence[Column]) -> DataFrame:
    """(word, target) to (word, canonical): words that point to one another are a cluster, and
    the one that comes first in `order`, over `word`, is canonical; it isn't listed itself."""
    from .components import connected_components

    c = connected_components(pointers.select(F.col("word").alias("a"), F.col("target").alias("b"))).withColumnRenamed("node", "word")
    top = c.groupBy("component").agg(F.min_by("word", F.struct(*order, F.col("word"))).alias("canonical"))
    return c.join(top, "component").where("word <> canonical").select("word", "canonical")


def sense_clusters(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, a, b) of similar senses to (keys, ord, cluster): clusters within each key, named by
    their least member.  Components of all keys are found at once."""
    from .components import connected_components

    ident = lambda c: F.struct(*keys, F.col(c).alias("ord"))
    c = connected_components(pairs.select(ident("a").alias("a"), ident("b").alias("b")))
    return c.select(*(F.col("node")[k].alias(k) for k in keys), F.col("node")["ord"].alias("ord"), F.col("component")["ord"].alias("cluster"))


def repair_pointers(pointers: DataFrame, words: DataFrame, told: Column, named: Column) -> DataFrame:
    """(word, target, ...) with `verdict` and `target`: keep where the gloss tells of the target
    (`told`), retarget to what the gloss names where that is a word, else remove."""
    w = words.select(F.col("word").alias("_known")).distinct()
    j = pointers.withColumn("_named", named).join(w, F.col("_named") == F.col("_known"), "left")
    verdict = F.when(told, "keep").when(F.col("_known").isNotNull() & (F.col("_known") != F.col("word")), "retarget").otherwise("remove")
    j = j.withColumn("verdict", verdict)
    return j.withColumn("target", F.when(F.col("verdict") == "retarget", F.col("_known")).otherwise(F.col("target"))).drop("_named", "_known")


def override(existing: DataFrame, curated: DataFrame) -> DataFrame:
    """(word, pieces) twice, pieces an array of (s, ...): a diff of curated analyses whose pieces
    join to the word and differ from what is there."""
    joined = F.array_join(F.transform("pieces", lambda p: p["s"]), "")
    good = curated.where(joined == F.col("word"))
    there = existing.select("word", F.to_json("pieces").alias("_old"))
    return good.join(there, "word", "left").where(F.col("_old").isNull() | (F.col("_old") != F.to_json("pieces"))).drop("_old")


def untruncated(base: DataFrame, donor: DataFrame, key: str, column: str) -> DataFrame:
    """A diff: rows whose text is cut off, that is, the donor's begins with it but for an ellipsis and is longer."""
    d = donor.select(F.col(key).alias("_k"), F.col(column).alias("_new"))
    stub = F.rtrim(F.regexp_replace(F.col(column), "(…|\\.\\.\\.)$", ""))
    longer = F.startswith(F.col("_new"), stub) & (F.length("_new") > F.length(column)) & (F.length(stub) >= 10)
    j = base.join(d, F.col(key) == F.col("_k")).where(longer)
    return j.select(*(F.col("_new").alias(c) if c == column else F.col(c) for c in base.columns))


def split_merge(base: DataFrame, parsed: DataFrame) -> DataFrame:
    """(word, parts) twice, arrays: a diff in which parses of several parts replace what is
    there, and single ones only fill gaps."""
    j = parsed.join(base.select("word", F.col("parts").alias("_old")), "word", "left")
    take = ((F.size("parts") > 1) & ~F.col("parts").eqNullSafe(F.col("_old"))) | F.col("_old").isNull() | (F.size("_old") == 0)
    return j.where(take).select("word", "parts")


def relabelled(tokens: DataFrame, compounds: DataFrame) -> DataFrame:
    """(…, token, kind) with kind `compound` for names that are compounds (word) of the vocabulary."""
    c = compounds.select(F.col("word").alias("_c"), F.lit(True).alias("_is")).distinct()
    j = tokens.join(c, F.lower("token") == F.col("_c"), "left")
    return j.withColumn("kind", F.when((F.col("kind") == "name") & F.col("_is"), "compound").otherwise(F.col("kind"))).drop("_c", "_is")


def to_embed(words: DataFrame, done: DataFrame, cached: DataFrame) -> DataFrame:
    """(word, gloss) to the distinct glosses (hash, gloss) still to be embedded: of words that
    aren't done, without those whose hash is cached."""
    todo = words.join(done.select("word"), "word", "left_anti").select(F.sha1(F.col("gloss").cast("binary")).alias("hash"), "gloss").dropDuplicates(["hash"])
    return todo.join(cached.select("hash"), "hash", "left_anti")


#: The commonest words that are enriched, the candidates that are looked at, the senses that a word may have in the end, and from
#: which share of common words on two glosses say the same.
MOST_RANK, CANDIDATES, MOST_SENSES, SAME = 20_000, 8, 4, 0.6
#: What tells a sense that is a place, and words of a gloss that covers the principal place already.
PLACES = ("county seat", "unincorporated community", "census-designated place", "township", "shire of", "local government area", "borough", "civil parish")
PLACE_KINDS = ("town", "city", "village", "hamlet", "river", "suburb", "commune", "neighbourhood", "neighborhood")
GAZETTEER = ("city", "town", "capital", "county", "river", "state", "community", "village", "country", "kingdom", "monarchy", "nation", "republic", "island", "peninsula", "region", "province")


def near_gloss(a: Column, b: Column) -> Column:
    """Two normalised glosses say the same: one holds the other, or more than SAME of the smaller one's words are common; never if either is empty."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    held = F.contains(a, b) | F.contains(b, a)
    return (a != "") & (b != "") & (held | (F.size(F.array_intersect(x, y)) > SAME * F.least(F.size(x), F.size(y))))


def by_spelling(entries: DataFrame, names: DataFrame) -> DataFrame:
    """(name) to (name, word): the entry (word) so called, else the only one so called but for case; names without one are left out."""
    exact = names.select("name").distinct().join(entries.select("word").distinct().withColumn("name", F.col("word")), "name", "left")
    only = entries.select("word").distinct().groupBy(F.lower("word").alias("folded")).agg(F.min("word").alias("only"), F.count("*").alias("n")).where("n = 1").select("folded", "only")
    return exact.join(only, F.lower("name") == F.col("folded"), "left").select("name", F.coalesce("word", "only").alias("word")).where("word IS NOT NULL")


def backfill_senses(entries: DataFrame, candidates: DataFrame, most_rank: int = MOST_RANK) -> DataFrame:
    """Takes entries (word, gloss, rank), a row a sense, and candidates (word, row, gloss) in the order of row; returns the senses to add: (word,
    place, gloss), place counted from 1.

    Entries of one sense and a rank below most_rank are enriched. Of the first CANDIDATES whose gloss isn't blank, each in turn is added if it says
    nothing that the entry or those added before say, up to MOST_SENSES in all. One of them may be a place: none if the entry's gloss names
    one, nor after a place that was left out as said already. Candidates find their entry by by_spelling(). Equal rows of candidates count once.
    """
    from ..functions.scalar import normal_gloss

    one = entries.groupBy("word").agg(F.count("*").alias("n"), F.first("gloss").alias("own"), F.min("rank").alias("rank")).where((F.col("n") == 1) & (F.col("rank") < most_rank))
    held = one.select("word", F.coalesce(normal_gloss(F.col("own")), F.lit("")).alias("own"))
    c = candidates.select(F.col("word").alias("name"), "row", F.trim("gloss").alias("gloss")).where("gloss <> ''").distinct()
    found = c.join(by_spelling(held, c.select("name")), "name").select("word", "row", "gloss")
    first = found.withColumn("_k", F.row_number().over(Window.partitionBy("word").orderBy("row", "gloss"))).where(F.col("_k") <= CANDIDATES)
    place = F.lower("gloss").rlike(r"\b(" + "|".join(PLACES) + r"|a (" + "|".join(PLACE_KINDS) + r") (in|of))\b")
    tried = first.select("word", F.struct(F.col("_k").alias("k"), "gloss", normal_gloss(F.col("gloss")).alias("norm"), place.alias("place")).alias("c"))
    listed = tried.groupBy("word").agg(F.array_sort(F.collect_list("c")).alias("all")).join(held, "word")
    names_place = F.col("own").rlike(r"\b(" + "|".join(GAZETTEER) + r")\b")
    kind = "struct<said:array<string>,added:array<string>,places:int>"
    start = F.struct(F.array("own").alias("said"), F.array().cast("array<string>").alias("added"), F.when(names_place, 0).otherwise(1).alias("places")).cast(kind)

    def step(s: Column, x: Column) -> Column:
        full = F.size(s["added"]) + 1 >= MOST_SENSES
        same = F.exists(s["said"], lambda g: near_gloss(g, x["norm"]))
        without = F.struct(s["said"].alias("said"), s["added"].alias("added"), F.lit(0).alias("places")).cast(kind)
        more = F.struct(F.concat(s["said"], F.array(x["norm"])).alias("said"), F.concat(s["added"], F.array(x["gloss"])).alias("added"), F.when(x["place"], s["places"] - 1).otherwise(s["places"]).alias("places")).cast(kind)
        return F.when(full | (x["norm"] == ""), s).when(same, F.when(x["place"], without).otherwise(s)).when(x["place"] & (s["places"] <= 0), s).otherwise(more)

    added = listed.select("word", F.posexplode(F.aggregate("all", start, step)["added"]).alias("place", "gloss"))
    return added.select("word", (F.col("place") + 1).cast("long").alias("place"), "gloss")


def fold_variants(entries: DataFrame, senses: DataFrame, kin: Column, times: int = 2) -> DataFrame:
    """Takes entries (word, rank: null where unknown, pointer: it is one already, curated: its analysis is a deliberate one) and senses (word,
    pos, target: the word that the sense points to, null for a definition); returns a row for each entry all of whose senses point to one other
    entry: (word, target, verdict).

    The verdict is the first that holds of: kin (kin, over word and target, says that they aren't), pointer (the target is one), pos (parts of speech are
    known of both and none is common), rank (the target isn't `times` as common; one of known rank is commoner than one of unknown), chain (the
    target folds itself), and fold. Ranks fall by `times` along the folds, so that there are no cycles, and of each chain every other
    word folds, counted from the word that it ends in. Targets are found by by_spelling(). Rows of one word count as one entry.
    """
    own = entries.groupBy("word").agg(F.min("rank").alias("rank"), F.bool_or(F.coalesce("pointer", F.lit(False))).alias("pointer"), F.bool_or(F.coalesce("curated", F.lit(False))).alias("curated")).where("word IS NOT NULL")
    by_word = senses.groupBy("word").agg(F.bool_and(F.col("target").isNotNull()).alias("all"), F.count_distinct(F.lower("target")).alias("n"), F.min(F.lower("target")).alias("name"), F.collect_set("pos").alias("pos"))
    pointing = own.where("NOT pointer AND NOT curated").join(by_word.where("all AND n = 1"), "word").select("word", "rank", "name", "pos")
    to = by_spelling(own, pointing.select("name")).withColumnRenamed("word", "target")
    parts = by_word.select(F.col("word").alias("target"), F.col("pos").alias("target_pos"))
    target = own.select(F.col("word").alias("target"), F.col("rank").alias("target_rank"), F.col("pointer").alias("points"))
    j = pointing.join(to, "name").where(F.lower("target") != F.lower("word")).join(target, "target").join(parts, "target", "left")
    pos_ok = (F.size("pos") == 0) | F.col("target_pos").isNull() | (F.size("target_pos") == 0) | F.arrays_overlap("pos", "target_pos")
    commoner = F.col("target_rank").isNotNull() & (F.col("rank").isNull() | (F.col("target_rank") * times <= F.col("rank")))
    verdict = F.when(~F.coalesce(kin, F.lit(False)), "kin").when(F.col("points"), "pointer").when(~pos_ok, "pos").when(~commoner, "rank").otherwise("fold")
    judged = stash(j.select("word", "target", "rank", verdict.alias("verdict")), "variants")
    # how many folds lead from a word to where its chain ends, by doubling; a chain is no longer than a rank can be divided
    edges = judged.where("verdict = 'fold'")
    most = edges.agg(F.max("rank")).first()[0] or 1
    steps = int(log2(max(2, most)) / log2(times)) + 3
    up = edges.select("word", F.col("target").alias("end"), F.lit(1).alias("steps"))
    for _ in range(ceil(log2(steps))):
        more = up.select(F.col("word").alias("end"), F.col("end").alias("further"), F.col("steps").alias("more"))
        up = stash(up.join(more, "end", "left").select("word", F.coalesce("further", "end").alias("end"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "chains")
    depth = up.select("word", "steps")
    settled = judged.join(depth, "word", "left")
    return settled.select("word", "target", F.when((F.col("verdict") == "fold") & (F.col("steps") % 2 == 0), "chain").otherwise(F.col("verdict")).alias("verdict"))
