"""Queries of sampling, entity resolution and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import language, scalar
from ..operators import curation, sampling
from .registry import Registry, Tables
from .relational import _VOCABULARY, vocabulary

query = Registry()


def _chance(seed, *cols):
    return f"((('0x' || substr(md5('{seed}|' || {' || chr(124) || '.join(f'({c})::VARCHAR' for c in cols)}), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)"


@query(f"SELECT p_partkey FROM (SELECT p_partkey, ln({_chance(7, 'p_partkey')}) / p_size AS k FROM part WHERE p_size > 0) ORDER BY k DESC, p_partkey LIMIT 50")
def weighted_sample(spark, sf_dir):
    """Fifty parts, with chances by size: the sample is the feature."""
    p = Tables(spark, sf_dir).part
    return sampling.weighted_sample(p, F.col("p_size"), 50, 7, F.col("p_partkey")).select("p_partkey")


@query("SELECT doc_id, place FROM (SELECT doc_id, (row_number() OVER (ORDER BY n_chars, doc_id)) - 1 AS place FROM documents) WHERE place % 25 = 0")
def systematic_sample(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("doc_id", "n_chars")
    return sampling.every(d, 25, [F.col("n_chars"), F.col("doc_id")]).select("doc_id", "place")


@query(f"SELECT c_custkey, round({_chance(3, 'c_custkey')}, 9) AS place FROM customer")
def seeded_shuffle(spark, sf_dir):
    c = Tables(spark, sf_dir).customer.select("c_custkey")
    return sampling.shuffled(c, 3, F.col("c_custkey")).withColumn("place", F.round("place", 9))


@query(f"""WITH n AS (SELECT p.p_partkey AS probe, q.p_partkey AS id, {_chance(5, "p.p_partkey", "q.p_partkey")} AS c FROM part p JOIN part q ON p.p_brand = q.p_brand AND p.p_partkey <> q.p_partkey AND abs(p.p_retailprice - q.p_retailprice) <= 5)
SELECT probe, id, row_number() OVER (PARTITION BY probe ORDER BY c, id) AS rank FROM n QUALIFY rank <= 3""")
def multiple_choice(spark, sf_dir):
    """Three others of the same brand and about the same price."""
    p = Tables(spark, sf_dir).part.select(F.col("p_partkey").alias("id"), "p_brand", "p_retailprice")
    return sampling.near_in_band(p, p, "p_brand", "p_retailprice", 5.0, 3, 5).select("probe", "id", F.col("rank").cast("long").alias("rank"))


@query("""WITH m AS (SELECT user_id, event_type, count(*) FILTER (WHERE value < 5) AS misses, max(event_id) AS last FROM events GROUP BY 1, 2)
SELECT user_id, event_type, misses >= 3 AS due, row_number() OVER (PARTITION BY user_id ORDER BY misses >= 3 DESC, misses DESC, last) AS rank FROM m QUALIFY rank <= 3""")
def practice_queue(spark, sf_dir):
    """Three a user: due ones, then most missed, then longest unseen."""
    m = Tables(spark, sf_dir).events.groupBy("user_id", "event_type").agg(F.count_if(F.col("value") < 5).alias("misses"), F.max("event_id").alias("last"))
    q = sampling.due_first(m, "user_id", F.col("misses") >= 3, [F.desc("misses"), F.col("last")], 3)
    return q.select("user_id", "event_type", "due", F.col("rank").cast("long").alias("rank"))


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 8")
def rolling_history(spark, sf_dir):
    """The last eight of each user."""
    return sampling.last_seen(Tables(spark, sf_dir).events, "user_id", [F.desc("ts"), F.desc("event_id")], 8).select("user_id", "event_id")


@query("""WITH s AS (SELECT p_brand, p_type, p_name, p_partkey, CASE WHEN p_size > 25 THEN 'size ' || p_size END AS example FROM part)
SELECT p_brand, p_type, p_partkey, p_name, example, (count(*) OVER g - 1) AS folded FROM s
QUALIFY row_number() OVER (PARTITION BY p_brand, p_type, p_name ORDER BY example IS NULL, -length(p_name), p_partkey) = 1""".replace("count(*) OVER g", "count(*) OVER (PARTITION BY p_brand, p_type, p_name)"))
def sense_fold(spark, sf_dir):
    s = Tables(spark, sf_dir).part.select("p_brand", "p_type", "p_partkey", "p_name", F.when(F.col("p_size") > 25, F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("example"))
    f = curation.fold_senses(s, ["p_brand", "p_type"], scalar.normal_gloss(F.col("p_name")), "example", "p_name", [F.col("p_partkey")])
    return f.select("p_brand", "p_type", "p_partkey", "p_name", "example", F.col("folded").cast("long").alias("folded"))


@query("""WITH b AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 5 = 0 THEN NULL ELSE lang END AS lang FROM documents), d AS (SELECT source, min(lang) AS l FROM documents WHERE doc_id % 2 = 0 GROUP BY source)
SELECT doc_id, b.source, l AS lang FROM b JOIN d USING (source) WHERE coalesce(lang, '') = '' AND l <> ''""")
def backfill_blank(spark, sf_dir):
    """Languages taken away and filled in from the source's first."""
    docs = Tables(spark, sf_dir).documents
    base = docs.select("doc_id", "source", F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 5 == 0, None).otherwise(F.col("lang")).alias("lang"))
    donor = docs.where("doc_id % 2 = 0").groupBy("source").agg(F.min("lang").alias("lang"))
    return curation.backfill(base, donor, "source", ["lang"])


@query("""WITH b AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey % 10 <> 0), p AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 3 = 0)
SELECT p.c_custkey, coalesce(p.c_name, b.c_name) AS c_name, coalesce(p.c_acctbal, b.c_acctbal) AS c_acctbal, CASE WHEN b.c_custkey IS NULL THEN 'new' ELSE 'changed' END AS change
FROM p LEFT JOIN b USING (c_custkey) WHERE b.c_custkey IS NULL OR coalesce(p.c_name, b.c_name) IS DISTINCT FROM b.c_name OR coalesce(p.c_acctbal, b.c_acctbal) IS DISTINCT FROM b.c_acctbal""")
def upsert_plan(spark, sf_dir):
    c = Tables(spark, sf_dir).customer.select("c_custkey", "c_name", "c_acctbal")
    k = F.col("c_custkey")
    patch = c.where((k % 5 == 0) | (k % 3 == 0)).select(k, F.when(k % 4 == 0, None).otherwise(F.col("c_name")).alias("c_name"), F.when(k % 3 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")).alias("c_acctbal"))
    return curation.upsert(c.where(k % 10 != 0), patch, ["c_custkey"])


#: Endings of the fixture's invented language, in order.
RULES = [("ing", "", "ing"), ("ing", "e", "ing_e"), ("ed", "", "ed"), ("ed", "e", "ed_e"), ("ly", "", "ly"), ("es", "", "es"), ("er", "", "er")]
_RULES = "(VALUES " + ", ".join(f"({k}, '{a}', '{b}', '{n}')" for k, (a, b, n) in enumerate(RULES)) + ") r(ord, ending, put, rule)"
_FORMS = f"""w AS (SELECT DISTINCT lower(word) AS word FROM vocabulary),
f AS (SELECT w.word, w.word[1 : length(w.word) - length(ending)] || put AS base, rule, ord FROM w JOIN {_RULES} ON ends_with(w.word, ending) AND length(w.word) > length(ending) + 2),
forms AS (SELECT f.word, base, rule FROM f JOIN w b ON b.word = base WHERE base <> f.word QUALIFY row_number() OVER (PARTITION BY f.word ORDER BY ord, base) = 1)"""


def _forms(spark, sf_dir):
    words = vocabulary(Tables(spark, sf_dir).documents).select(F.lower("word").alias("word")).distinct()
    return curation.by_rules(words, RULES)


@query(f"WITH {_VOCABULARY}, {_FORMS} SELECT word, base, rule FROM forms")
def inflection_rules(spark, sf_dir):
    return _forms(spark, sf_dir)


@query(f"""WITH {_VOCABULARY}, {_FORMS}, u AS (SELECT x.word, coalesce(y.base, x.base) AS base FROM forms x LEFT JOIN forms y ON y.word = x.base)
SELECT base, string_agg(DISTINCT word, ' ' ORDER BY word) AS forms FROM u WHERE word <> base GROUP BY base""")
def inflection_collapse(spark, sf_dir):
    return curation.collapse(_forms(spark, sf_dir)).select("base", F.array_join("forms", " ").alias("forms"))


@query("""WITH c AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 2 END AS tier FROM orders)
SELECT o_custkey, o_orderkey, tier FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY tier, o_orderkey) = 1""")
def preferred_candidate(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    return curation.preferred(o, "o_custkey", [F.col("o_orderstatus") == "P", F.col("o_orderpriority") == "1-URGENT"], [F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "tier")


@query("""WITH n AS (SELECT l_orderkey, l_quantity, l_partkey, l_linenumber, max(l_quantity) OVER (PARTITION BY l_orderkey) AS most FROM lineitem), t AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS k FROM n WHERE l_quantity = most)
SELECT l_orderkey, l_partkey, l_quantity FROM t WHERE k = 1""")
def unique_best(spark, sf_dir):
    l = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_partkey", "l_quantity")  # noqa: E741
    return curation.only_best(l, "l_orderkey", "l_quantity").select("l_orderkey", "l_partkey", "l_quantity")


@query("""SELECT doc_id, quality::BIGINT AS verdict FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND (d.n_chars >= 300)::INT <> l.quality)""")
def second_opinion(spark, sf_dir):
    """Labels that the length of the text doesn't contradict."""
    t = Tables(spark, sf_dir)
    first = t.labels.select("doc_id", F.col("quality").cast("long").alias("verdict"))
    second = t.documents.select("doc_id", (F.col("n_chars") >= 300).cast("long").alias("verdict"))
    return curation.vetoed(first, second, "doc_id")




_LOWN = "trim(regexp_replace(lower({}), '[^a-z]+', ' ', 'g'))"
_WORDS_OF = "list_distinct(string_split({}, ' '))"
_GLOSS = """CASE WHEN p_size < 9 THEN 'a ' || ['town', 'river', 'village'][p_size % 3 + 1] || ' in ' || n_name || ' of ' || p_name WHEN p_size < 14 THEN 'township ' || p_name || ' ' || lower(p_type) WHEN p_size < 16 THEN '' ELSE p_name || ' ' || lower(p_type) || ' ' || lower(p_brand) END"""


@query(f"""WITH RECURSIVE e AS (
  SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'Word' ELSE 'word' END || o_orderkey AS word, CASE WHEN o_custkey % 5 = 0 THEN 'The city of ' || p_name ELSE p_name || ' ' || lower(p_type) END AS own, floor(o_totalprice / 20) AS rank
  FROM orders JOIN part ON p_partkey = o_custkey UNION ALL SELECT 'WORD' || o_orderkey, 'again', 1 FROM orders WHERE o_orderkey % 10 = 4 UNION ALL SELECT 'word' || o_orderkey, 'second', 1 FROM orders WHERE o_orderkey % 10 = 5),
one AS (SELECT word, max(own) AS own FROM e GROUP BY word HAVING count(*) = 1 AND min(rank) < 15000),
c AS (SELECT DISTINCT 'word' || l_orderkey AS name, l_linenumber * 1000000 + l_partkey AS row, trim({_GLOSS}) AS gloss FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
u AS (SELECT lower(word) AS f, min(word) AS word FROM one GROUP BY 1 HAVING count(*) = 1),
f AS (SELECT coalesce(x.word, u.word) AS word, row, gloss FROM c LEFT JOIN one x ON x.word = c.name LEFT JOIN u ON u.f = lower(c.name) WHERE gloss <> '' AND coalesce(x.word, u.word) IS NOT NULL),
k AS (
  SELECT word, gloss, {_LOWN.format("gloss")} AS norm, regexp_matches(lower(gloss), '\\b(township|a (town|river|village) in)\\b') AS place, row_number() OVER (PARTITION BY word ORDER BY row, gloss) AS k FROM f QUALIFY k <= 8),
s AS (
  SELECT word, 0::BIGINT AS k, [{_LOWN.format("own")}] AS said, []::VARCHAR[] AS added, CASE WHEN regexp_matches({_LOWN.format("own")}, '\\b(city|town|river|village)\\b') THEN 0 ELSE 1 END AS places FROM one
  UNION ALL
  SELECT word, next, CASE WHEN take THEN list_append(said, norm) ELSE said END, CASE WHEN take THEN list_append(added, gloss) ELSE added END,
    CASE WHEN len(added) >= 3 THEN places WHEN same THEN CASE WHEN place THEN 0 ELSE places END WHEN take AND place THEN places - 1 ELSE places END
  FROM (
    SELECT *, NOT same AND len(added) < 3 AND NOT (place AND places <= 0) AS take FROM (
      SELECT s.*, k.k AS next, k.gloss, k.norm, k.place, len(list_filter(s.said, lambda g: contains(g, k.norm) OR contains(k.norm, g)
        OR len(list_intersect({_WORDS_OF.format("g")}, {_WORDS_OF.format("k.norm")})) > 0.6 * least(len({_WORDS_OF.format("g")}), len({_WORDS_OF.format("k.norm")})))) > 0 AS same
      FROM s JOIN k ON k.word = s.word AND k.k = s.k + 1)))
SELECT word, unnest(range(1, len(added) + 1)) AS place, unnest(added) AS gloss FROM (SELECT word, arg_max(added, k) AS added FROM s GROUP BY word)""")
def backfill_senses(spark, sf_dir):
    """Orders as words of one sense, some of two or spelt twice; their lines as candidate senses, some of them places."""
    t = Tables(spark, sf_dir)
    case = F.when(F.col("o_orderkey") % 2 == 0, "Word").otherwise("word")
    own = F.when(F.col("o_custkey") % 5 == 0, F.concat(F.lit("The city of "), "p_name")).otherwise(F.concat("p_name", F.lit(" "), F.lower("p_type")))
    first = t.orders.join(t.part, F.col("p_partkey") == F.col("o_custkey")).select(F.concat(case, "o_orderkey").alias("word"), own.alias("gloss"), F.floor(F.col("o_totalprice") / 20).alias("rank"))
    more = [t.orders.where(f"o_orderkey % 10 = {k}").select(F.concat(F.lit(w), "o_orderkey").alias("word"), F.lit(g).alias("gloss"), F.lit(1).cast("long").alias("rank")) for k, w, g in ((4, "WORD", "again"), (5, "word", "second"))]
    named = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    lines = t.lineitem.join(named, F.col("l_suppkey") == F.col("s_suppkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    gloss = F.expr(_GLOSS.replace("['town', 'river', 'village'][p_size % 3 + 1]", "element_at(array('town', 'river', 'village'), int(p_size % 3 + 1))"))
    candidates = lines.select(F.concat(F.lit("word"), "l_orderkey").alias("word"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("row"), gloss.alias("gloss"))
    return curation.backfill_senses(first.unionByName(more[0]).unionByName(more[1]), candidates, 15_000)


_CUT = "CASE WHEN ends_with(w, 'es') AND lang = 'fr' THEN w[:-3] WHEN regexp_matches(w, '[esnrt]$') AND length(w) > 4 THEN w[:-2] END"
_KIN_STEM = r"regexp_replace({}, '(isation|ization|ical|ness|ity|ise|ize|ous|our|ic|al|ly|or|re|er|e)$', '')"


@query(f"""WITH RECURSIVE v AS (SELECT lower(w) AS w, lang, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents) GROUP BY 1, 2),
own AS (SELECT w AS word, CASE WHEN sum(n) > 1 THEN (1000000 // sum(n))::BIGINT END AS rank, sum(n) % 9 = 5 AS pointer, length(w) > 14 AS curated FROM v GROUP BY w),
s AS (SELECT w AS word, lang AS pos, lower(CASE WHEN lang = 'de' THEN upper({_CUT}) ELSE {_CUT} END) AS target FROM v),
b AS (SELECT word, bool_and(target IS NOT NULL) AS whole, count(DISTINCT target) AS n, min(target) AS name, list(DISTINCT pos) FILTER (WHERE pos IS NOT NULL) AS pos FROM s GROUP BY word),
j AS (SELECT o.word, t.word AS target, o.rank, t.rank AS rank2, t.pointer AS points, b.pos, bt.pos AS pos2 FROM own o JOIN b USING (word) JOIN own t ON t.word = b.name LEFT JOIN b bt ON bt.word = t.word WHERE b.whole AND b.n = 1 AND NOT o.pointer AND NOT o.curated),
k AS (
  SELECT word, target, CASE WHEN NOT (length({_KIN_STEM.format("word")}) >= 4 AND length({_KIN_STEM.format("target")}) >= 4 AND (starts_with({_KIN_STEM.format("word")}, {_KIN_STEM.format("target")}) OR starts_with({_KIN_STEM.format("target")}, {_KIN_STEM.format("word")}))) THEN 'kin'
    WHEN points THEN 'pointer' WHEN NOT (coalesce(len(pos), 0) = 0 OR coalesce(len(pos2), 0) = 0 OR list_has_any(pos, pos2)) THEN 'pos' WHEN NOT (rank2 IS NOT NULL AND (rank IS NULL OR rank2 * 2 <= rank)) THEN 'rank' ELSE 'fold' END AS verdict FROM j),
d AS (SELECT word, target AS last, 1 AS steps FROM k WHERE verdict = 'fold' UNION ALL SELECT d.word, k.target, steps + 1 FROM d JOIN k ON k.word = d.last AND k.verdict = 'fold'),
e AS (SELECT word, max(steps) AS steps FROM d GROUP BY word)
SELECT word, target, CASE WHEN verdict = 'fold' AND steps % 2 = 0 THEN 'chain' ELSE verdict END AS verdict FROM k LEFT JOIN e USING (word)""")
def fold_variants(spark, sf_dir):
    """Words of documents with a sense in each language, which points to the word without its ending."""
    d = Tables(spark, sf_dir).documents
    words = d.select("lang", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).groupBy(F.lower("w").alias("w"), "lang").agg(F.count("*").alias("n"))
    size = F.col("size")
    own = words.groupBy(F.col("w").alias("word")).agg(F.sum("n").alias("size")).select("word", F.when(size > 1, F.expr("1000000 DIV size")).alias("rank"), (size % 9 == 5).alias("pointer"), (F.length("word") > 14).alias("curated"))
    w = F.col("w")
    cut = F.when(w.endswith("es") & (F.col("lang") == "fr"), F.expr("left(w, length(w) - 2)")).when(w.rlike("[esnrt]$") & (F.length(w) > 4), F.expr("left(w, length(w) - 1)"))
    senses = words.select(w.alias("word"), F.col("lang").alias("pos"), F.when(F.col("lang") == "de", F.upper(cut)).otherwise(cut).alias("target"))
    return curation.fold_variants(own, senses, language.kin(F.col("word"), F.col("target")))
