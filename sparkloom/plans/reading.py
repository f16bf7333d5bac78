"""Queries that read running text: words of documents resolved to entries that their own vocabulary makes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reader
from ..sources.shared import stash
from .curation import _chance as chance_sql
from .registry import Registry, Tables

query = Registry()
_SIGNS = r"[\p{L}\p{M}]+|[.!?\n]"

_INPUT = rf"""tok AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM (SELECT doc_id, regexp_extract_all(text, '{_SIGNS}') AS w FROM documents)),
seen AS MATERIALIZED (SELECT x AS surface, coalesce(lag(x) OVER (PARTITION BY doc_id ORDER BY i) IN ('.', '!', '?', chr(10)), true) AS initial, count(*) AS n FROM tok GROUP BY x, doc_id, i QUALIFY x NOT IN ('.', '!', '?', chr(10))),
sf AS MATERIALIZED (SELECT DISTINCT surface, initial FROM seen),
freq AS MATERIALIZED (SELECT surface AS word, count(*) AS n FROM seen GROUP BY 1),
e AS MATERIALIZED (
  SELECT word || '/1' AS entry, word AS title, 1 AS ord, n % 4 = 0 AND regexp_matches(word, '^\p{{Lu}}') AS name, length(word) <= 3 AS closed, n % 3 = 0 AS demoted, CASE WHEN n % 3 = 0 AND length(word) > 1 THEN word[:-2] END AS spelling_of FROM freq WHERE n >= 3
  UNION ALL SELECT word || '/2', word, 2, false, false, n % 2 = 0, CASE WHEN n % 2 = 0 THEN word || 'e' END FROM freq WHERE n >= 3 AND n % 5 = 0),
forms AS MATERIALIZED (
  SELECT word AS form, word[:-2] AS lemma, 0 AS ord FROM freq WHERE length(word) > 4 AND regexp_matches(word, '[esnrt]$') UNION ALL SELECT word, word[:-3], 1 FROM freq WHERE length(word) > 4 AND word LIKE '%es'),
over AS (SELECT word AS surface, word || '/1' AS entry FROM freq WHERE n >= 3 AND n % 11 = 0)"""

_FIRST = "first AS (SELECT form AS f, arg_min(lemma, (ord, lemma)) AS nxt FROM forms GROUP BY 1), titles AS (SELECT DISTINCT title FROM e)"


def _hop(k: int) -> str:
    return f"h{k} AS (SELECT form, CASE WHEN title IS NULL AND nxt IS NOT NULL THEN nxt ELSE lemma END AS lemma, ord FROM {'forms' if k == 1 else f'h{k - 1}'} LEFT JOIN titles ON title = lemma LEFT JOIN first ON f = lemma)"


def _ranked(k: int) -> str:
    """The readings in the round k, given those of the round before."""
    alt = "" if k == 0 else f" UNION ALL SELECT t.surface, t.initial, p.entry, 'alt', t.cost + 2500, (t.k, 0, l.ord + 1000000, lpad(p.place::VARCHAR, 2, '0')) FROM tried t JOIN linked l ON l.title = t.v JOIN r{k - 1} p ON p.surface = l.to_ AND NOT p.initial AND p.place <= 2"
    return f"""u{k} AS (SELECT surface, initial, entry, min((c, how)) AS b, min(at_) AS at_ FROM (SELECT surface, initial, entry, how, c, at_ FROM reached{alt}) GROUP BY ALL),
n{k} AS (SELECT u.*, nm.entry IS NOT NULL AS is_name, nm.entry IS NOT NULL AND regexp_matches(u.surface, '^\\p{{Lu}}') AS named FROM u{k} u LEFT JOIN e nm ON nm.name AND nm.title = u.surface AND nm.entry = u.entry),
s{k} AS (SELECT DISTINCT surface, initial FROM n{k} WHERE NOT is_name AND b[1] <= 1100),
r{k} AS MATERIALIZED (SELECT n.surface, n.initial, entry, CASE WHEN hit THEN 'name' ELSE b[2] END AS how, CASE WHEN hit THEN -500 ELSE b[1] END AS cost, row_number() OVER (PARTITION BY n.surface, n.initial ORDER BY CASE WHEN hit THEN -500 ELSE b[1] END, at_, entry) AS place
  FROM (SELECT n.*, named AND s.surface IS NULL AND b[1] > -500 AS hit FROM n{k} n LEFT JOIN s{k} s ON s.surface = n.surface AND s.initial = n.initial) n)"""


_READINGS = f"""WITH {_INPUT}, {_FIRST}, {_hop(1)}, {_hop(2)}, {_hop(3)},
lem AS MATERIALIZED (SELECT form, lemma, min(ord) AS ord FROM h3 GROUP BY 1, 2),
known AS (SELECT title AS t FROM e UNION SELECT form FROM forms),
links AS (SELECT entry, spelling_of AS to_ FROM e WHERE demoted AND NOT name AND spelling_of IS NOT NULL AND spelling_of <> title AND spelling_of IN (SELECT t FROM known)),
asked AS (SELECT surface, initial FROM sf UNION SELECT to_, false FROM links),
tried AS MATERIALIZED (
  SELECT surface, initial, k, v, CASE WHEN v <> surface AND regexp_matches(surface, '^\\p{{Ll}}') THEN 4000 ELSE 500 * k END AS cost
  FROM (SELECT surface, initial, unnest(range(len(l))) AS k, unnest(l) AS v FROM (SELECT *, CASE WHEN lower(surface) = surface THEN [surface] WHEN initial THEN [lower(surface), surface] ELSE [surface, lower(surface)] END AS l FROM asked))),
vs AS (SELECT DISTINCT v FROM tried),
ts AS (SELECT title AS v, bool_or(NOT demoted) AS plain FROM e WHERE title IN (SELECT v FROM vs) GROUP BY 1),
of AS (SELECT form AS v, lemma, ord FROM lem WHERE form IN (SELECT v FROM vs)),
pairs AS (SELECT v, lemma FROM of UNION SELECT v, v FROM ts),
members AS (SELECT lemma, form AS f FROM lem UNION SELECT lemma, lemma FROM pairs),
m AS MATERIALIZED (SELECT v, p.lemma, f, coalesce(n, 0) AS n FROM pairs p JOIN members USING (lemma) LEFT JOIN freq ON word = f),
sh AS (SELECT v, f, count(DISTINCT lemma) AS lemmas FROM m GROUP BY 1, 2),
rated AS MATERIALIZED (
  SELECT v, lemma, coalesce(a / fs.n::DOUBLE, 1.0::DOUBLE) AS alone, coalesce(b / fs.n::DOUBLE, 1.0::DOUBLE) AS whole FROM (
    SELECT v, lemma, sum(CASE WHEN lower(f) <> lower(v) AND (lemmas = 1 OR f = lemma) THEN n ELSE 0 END)::DOUBLE AS a, sum(CASE WHEN lower(f) <> lower(v) THEN n ELSE 0 END)::DOUBLE AS b FROM m JOIN sh USING (v, f) GROUP BY 1, 2) LEFT JOIN freq fs ON fs.word = v),
own AS (SELECT v, CASE WHEN plain THEN greatest(whole, alone) ELSE alone END AS title FROM ts JOIN rated USING (v) WHERE lemma = v),
best AS (SELECT title AS lemma, arg_min(entry, (demoted, ord, entry)) AS entry, arg_min(closed, (demoted, ord, entry)) AS closed FROM e GROUP BY 1),
linked AS (SELECT e.*, to_ FROM e LEFT JOIN links USING (entry)),
base AS (
  SELECT title AS v, entry, 'title' AS how, CASE WHEN demoted THEN 5000 WHEN closed THEN 500 ELSE 2000 END AS c, 0 AS s, CASE WHEN demoted THEN 1000000 ELSE 0 END + ord AS o, entry AS t FROM e
  UNION ALL SELECT of.v, b.entry, 'form', CASE WHEN closed THEN 600 WHEN alone >= 0.8 AND alone > coalesce(own.title, 0) THEN 1000 ELSE 3000 END - floor(least(alone, 50))::INT, 1, ord, of.lemma FROM of JOIN best b USING (lemma) JOIN rated r ON r.v = of.v AND r.lemma = of.lemma LEFT JOIN own ON own.v = of.v
  UNION ALL SELECT surface, entry, 'override', NULL, 2, 0, '' FROM over),
reached AS MATERIALIZED (SELECT surface, initial, entry, how, CASE WHEN how = 'override' THEN -1000 ELSE c + cost END AS c, (k, s, o, t) AS at_ FROM tried JOIN base USING (v)),
{_ranked(0)}, {_ranked(1)}, {_ranked(2)}, {_ranked(3)}"""


def _entries(t):
    """Surfaces, entries, forms, frequencies and overrides, all of the documents' own words."""
    w = F.regexp_extract_all("text", F.lit(_SIGNS), F.lit(0))
    sign = lambda x: x.isin(".", "!", "?", "\n")
    # a generator of its own, over the words as a column: else they would be cut anew for each of them
    marked = F.inline(F.transform("w", lambda x, i: F.struct(x.alias("surface"), F.coalesce(sign(F.get("w", i - 1)), F.lit(True)).alias("initial"))))
    seen = t.documents.select(w.alias("w")).select(marked).where(~sign(F.col("surface")))
    seen = stash(seen.groupBy("surface", "initial").agg(F.count("*").alias("n")), "seen")
    freq = stash(seen.groupBy(F.col("surface").alias("word")).agg(F.sum("n").alias("n")), "frequencies")
    word, n = F.col("word"), F.col("n")
    kept = freq.where("n >= 3")
    cut = lambda k: F.expr(f"left(word, length(word) - {k})")
    first = kept.select(F.concat(word, F.lit("/1")).alias("entry"), word.alias("title"), F.lit(1).alias("ord"), ((n % 4 == 0) & word.rlike(r"^\p{Lu}")).alias("name"), (F.length(word) <= 3).alias("closed"), (n % 3 == 0).alias("demoted"), F.when((n % 3 == 0) & (F.length(word) > 1), cut(1)).alias("spelling_of"))
    second = kept.where("n % 5 = 0").select(F.concat(word, F.lit("/2")), word, F.lit(2), F.lit(False), F.lit(False), n % 2 == 0, F.when(n % 2 == 0, F.concat(word, F.lit("e"))))
    long_ = freq.where(F.length(word) > 4)
    forms = long_.where(word.rlike("[esnrt]$")).select(word.alias("form"), cut(1).alias("lemma"), F.lit(0).alias("ord")).union(long_.where(word.endswith("es")).select(word, cut(2), F.lit(1)))
    over = kept.where("n % 11 = 0").select(word.alias("surface"), F.concat(word, F.lit("/1")).alias("entry"))
    return seen.select("surface", "initial"), first.union(second), forms, freq, over


@query(f"{_READINGS} SELECT surface, initial, entry, how, cost::BIGINT AS cost, place AS rank FROM r3 JOIN sf USING (surface, initial)")
def ranked_readings(spark, sf_dir):
    """All words of documents, as they stand at the beginning of sentences and elsewhere."""
    surfaces, entries, forms, freq, over = _entries(Tables(spark, sf_dir))
    return reader.ranked_readings(surfaces, entries, forms, freq, over).withColumn("rank", F.col("rank").cast("long"))


@query(f"{_READINGS} SELECT surface, initial, entry FROM r3 JOIN sf USING (surface, initial) WHERE place = 2")
def runner_up(spark, sf_dir):
    """The second reading of each word."""
    surfaces, entries, forms, freq, over = _entries(Tables(spark, sf_dir))
    return reader.ranked_readings(surfaces, entries, forms, freq, over).where("rank = 2").select("surface", "initial", "entry")


def _vocabulary(spark, sf_dir):
    w = F.explode(F.regexp_extract_all("text", F.lit(r"[a-z]+"), F.lit(0))).alias("w")
    return Tables(spark, sf_dir).documents.select(w).groupBy("w").agg(F.count("*").alias("n"))


_WORDS = "v AS (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS w FROM documents) GROUP BY w)"
_MADE = "CASE n % 4 WHEN 0 THEN ['l', 'd', 'qu', 'x', 'jusqu', 'S'][(length(w) % 6 + 1)::INT] || '’' || w WHEN 1 THEN w || '-' || w[1:3] || '-là' ELSE w END"
_ELIDED = "CASE regexp_extract(lower(t), '^([a-z]+)[''’]', 1) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in reader.ELISIONS.items()) + " END"


@query(f"""WITH {_WORDS}, t AS (SELECT {_MADE} AS t FROM v), u AS (SELECT DISTINCT t FROM t)
SELECT t AS token, array_to_string(CASE {" ".join(f"WHEN lower(t) = '{k}' THEN ['{a}', '{b}']" for k, (a, b) in reader.CONTRACTIONS["fr"].items())} WHEN {_ELIDED} IS NOT NULL THEN [{_ELIDED}, regexp_extract(lower(t), '^[a-z]+[''’](.+)$', 1)] ELSE string_split(lower(t), '-') END, ' ') AS parts FROM u""")
def token_parts(spark, sf_dir):
    """Words of documents, a quarter each with an elided word before and with hyphens."""
    w, n = F.col("w"), F.col("n")
    elided = F.element_at(F.array(*map(F.lit, ("l", "d", "qu", "x", "jusqu", "S"))), (F.length(w) % 6 + 1).cast("int"))
    made = F.when(n % 4 == 0, F.concat(elided, F.lit("’"), w)).when(n % 4 == 1, F.concat(w, F.lit("-"), F.substring(w, 1, 3), F.lit("-là"))).otherwise(w)
    tokens = _vocabulary(spark, sf_dir).select(made.alias("token")).distinct()
    return tokens.select("token", F.array_join(reader.parts_of(F.col("token"), "fr"), " ").alias("parts"))


def _fallback_sql(language: str) -> str:
    made = " UNION ALL ".join(f"SELECT w, {k} AS k, w[: -{len(a) + 1}] || '{b}' AS base, '{r}' AS rule FROM m WHERE ends_with(w, '{a}') AND length(w) > {len(a) + 2}" for k, (a, b, r) in enumerate(reader.FALLBACKS[language]))
    return f"""WITH {_WORDS}, lex AS (SELECT w FROM v WHERE n >= 6), m AS (SELECT w FROM v WHERE n < 6), c AS ({made})
SELECT c.w AS word, base, rule FROM c JOIN (SELECT w AS base FROM v) x USING (base) WHERE base <> c.w QUALIFY row_number() OVER (PARTITION BY c.w ORDER BY k) = 1"""


@query(_fallback_sql("fr"))
def inflection_fallback(spark, sf_dir):
    """Rare words by the first ending without which they are another word."""
    v = _vocabulary(spark, sf_dir)
    lexicon = v.where("n >= 6").select(F.col("w").alias("word"))
    return reader.fallbacks(v.where("n < 6").select(F.col("w").alias("word")), lexicon, "fr").select("word", "base", "rule")


_STEMS = "list_transform(list_distinct(list_filter(string_split(trim(regexp_replace(lower({}), '[^a-z]+', ' ', 'g')), ' '), lambda w: length(w) >= 3)), lambda w: w[:5])"


@query(f"""WITH g AS (SELECT item_id AS quote, unnest(string_split(text, '. ')) AS gloss FROM benchmark), a AS (SELECT doc_id AS quote, text FROM documents)
SELECT quote, count(*) AS words, count(*) FILTER (WHERE list_has_any({_STEMS.format("gloss")}, {_STEMS.format("text")})) AS found FROM g JOIN a USING (quote) GROUP BY quote""")
def judged_answers(spark, sf_dir):
    """Sentences of benchmark items as glosses, the documents of the same number as answers."""
    t = Tables(spark, sf_dir)
    glosses = t.benchmark.select(F.col("item_id").alias("quote"), F.explode(F.split("text", r"\. ")).alias("gloss"))
    return reader.judged(glosses, t.documents.select(F.col("doc_id").alias("quote"), F.col("text").alias("answer")))


@query(f"""WITH {_WORDS}, verbs AS (SELECT p AS prefix, w AS stem, p || w AS verb FROM v, (VALUES ('an'), ('on'), ('of'), ('to')) x(p) WHERE length(w) >= 5 AND n >= 3),
s AS (SELECT doc_id AS quote, k AS sentence, regexp_extract_all(x, '\\p{{L}}+') AS w FROM (SELECT doc_id, unnest(range(len(l))) AS k, unnest(l) AS x FROM (SELECT doc_id, string_split(text, '.') AS l FROM documents))),
t AS (SELECT quote, sentence, unnest(range(len(w))) AS place, unnest(w) AS token FROM s),
j AS (SELECT t.quote, t.sentence, t.place, verb, u.place AS p FROM t JOIN verbs ON lower(t.token) = stem JOIN t u ON u.quote = t.quote AND u.sentence = t.sentence AND lower(u.token) = prefix AND u.place > t.place)
SELECT quote, sentence, place, arg_min(verb, (p, verb)) AS verb FROM j GROUP BY 1, 2, 3""")
def separable_verbs(spark, sf_dir):
    """Words of five letters with a particle later in the sentence."""
    v = _vocabulary(spark, sf_dir).where("length(w) >= 5 AND n >= 3")
    verbs = v.select(F.explode(F.array(*map(F.lit, ("an", "on", "of", "to")))).alias("prefix"), F.col("w").alias("stem")).withColumn("verb", F.concat("prefix", "stem"))
    s = Tables(spark, sf_dir).documents.select(F.col("doc_id").alias("quote"), F.posexplode(F.split("text", r"\.")).alias("sentence", "x"))
    sentences = s.select("quote", F.col("sentence").cast("long").alias("sentence"), F.regexp_extract_all("x", F.lit(r"\p{L}+"), F.lit(0)).alias("words"))
    return reader.separable_in(sentences, stash(verbs, "verbs"))


@query("""WITH s AS (SELECT p_brand AS word, p_partkey AS ord, 'a ' || p_name || ' of ' || lower(p_type) AS gloss FROM part),
l AS (SELECT DISTINCT p_brand AS word, CASE WHEN l_linenumber % 2 = 0 THEN split_part(p_name, ' ', 2) ELSE lower(p_type) END AS other, CASE WHEN l_quantity > 25 THEN 'a ' || p_name || ' of ' || lower(p_type) ELSE 'gone' END AS gloss FROM lineitem JOIN part ON p_partkey = l_partkey),
c AS (SELECT word, other, ord, 0 AS tier FROM l JOIN s USING (word, gloss) UNION ALL SELECT l.word, other, ord, 1 FROM (SELECT DISTINCT word, other FROM l) l JOIN s ON s.word = l.word AND contains(lower(s.gloss), lower(other)))
SELECT word, other, arg_min(ord, (tier, ord)) AS ord FROM c GROUP BY 1, 2""")
def sense_links(spark, sf_dir):
    """Brands as words with their parts as senses; links from lines, half of which name a sense."""
    t = Tables(spark, sf_dir)
    gloss = F.concat(F.lit("a "), "p_name", F.lit(" of "), F.lower("p_type"))
    senses = t.part.select(F.col("p_brand").alias("word"), F.col("p_partkey").alias("ord"), gloss.alias("gloss"))
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    other = F.when(F.col("l_linenumber") % 2 == 0, F.split_part("p_name", F.lit(" "), F.lit(2))).otherwise(F.lower("p_type"))
    links = lines.select(F.col("p_brand").alias("word"), other.alias("other"), F.when(F.col("l_quantity") > 25, gloss).otherwise("gone").alias("gloss")).distinct()
    return reader.sense_link(senses, links)


@query(f"""WITH {_WORDS}, t AS (SELECT doc_id AS quote, unnest(regexp_extract_all(text, '[a-z]+')) AS w FROM documents),
j AS (SELECT quote, v.w AS entry, log10(n::DOUBLE) + 3 AS zipf, n % 5 = 0 AS transparent, n % 7 = 0 AS name FROM t LEFT JOIN (SELECT * FROM v WHERE n >= 3) v USING (w))
SELECT quote, count(*) AS counted, count(*) FILTER (WHERE entry IS NULL OR NOT (coalesce(zipf, 0) >= 5 OR coalesce(transparent, false))) AS hard, count(*) FILTER (WHERE entry IS NULL) AS unknown FROM j WHERE NOT coalesce(name, false) GROUP BY quote""")
def quote_difficulty(spark, sf_dir):
    """Documents as quotations: words seen thrice have an entry, frequent or transparent ones aren't hard."""
    v = _vocabulary(spark, sf_dir).where("n >= 3")
    tokens = Tables(spark, sf_dir).documents.select(F.col("doc_id").alias("quote"), F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("w"))
    n = F.col("n")
    j = tokens.join(v.withColumn("entry", F.col("w")), "w", "left").select("quote", "entry", (F.log10(n.cast("double")) + 3).alias("zipf"), (n % 5 == 0).alias("transparent"), (n % 7 == 0).alias("name"))
    return reader.difficulty(j).select("quote", "counted", "hard", "unknown")


_PICK = chance_sql(11, "user", "quote")


@query(f"""WITH c AS (SELECT user_id % 50 AS user, event_id AS quote, (event_id % 9) AS unknown, 8 + event_id % 23 AS n FROM events),
d AS (SELECT DISTINCT user_id % 50 AS user, event_id AS quote FROM events WHERE event_type = 'error'),
t AS (SELECT c.*, CASE WHEN unknown BETWEEN 1 AND 3 AND 1 - unknown / n >= 0.85 THEN 0 WHEN unknown <= 6 AND 1 - unknown / n >= 0.7 THEN 1 ELSE 2 END AS tier, d.quote IS NULL AS other FROM c LEFT JOIN d ON d.user = c.user AND d.quote = c.quote)
SELECT user, quote, tier, row_number() OVER (PARTITION BY user ORDER BY tier, other, {_PICK}, quote) AS rank FROM t QUALIFY rank <= 12""")
def next_excerpts(spark, sf_dir):
    """Twelve events a group of users to read next: the number is the feature."""
    e = Tables(spark, sf_dir).events.select((F.col("user_id") % 50).alias("user"), F.col("event_id").alias("quote"), "event_type")
    coverage = e.select("user", "quote", (F.col("quote") % 9).alias("unknown"), (8 + F.col("quote") % 23).alias("n"))
    out = reader.excerpts(coverage, e.where("event_type = 'error'"), 12, 11)
    return out.select("user", "quote", "tier", F.col("rank").cast("long").alias("rank"))


_GLOSS = "p_name || ' ' || lower(p_type)"
_CONTENT = "list_filter(list_distinct(string_split(trim(regexp_replace(lower({}), '[^a-z]+', ' ', 'g')), ' ')), lambda x: length(x) >= 3)"
_OTHER = chance_sql(5, "word", "other")


@query(f"""WITH w AS (SELECT p_partkey::VARCHAR AS word, {_GLOSS} AS gloss, p_brand || p_size AS band FROM part),
rel AS (SELECT DISTINCT x.l_partkey::VARCHAR AS word, y.l_partkey::VARCHAR AS other FROM lineitem x JOIN lineitem y USING (l_orderkey) WHERE x.l_quantity >= 45 AND y.l_quantity >= 45),
alike AS (SELECT p_partkey::VARCHAR AS word, (p_partkey + 1)::VARCHAR AS other FROM part), syn AS (SELECT word, other FROM rel WHERE length(word) = length(other) AND right(word, 1) = right(other, 1)),
c AS (SELECT word, other, 0 AS tier FROM rel UNION ALL SELECT word, other, 1 FROM alike UNION ALL SELECT x.word, y.word, 2 FROM w x JOIN w y USING (band)),
g AS (SELECT word, other, min(tier) AS tier FROM c WHERE word <> other AND (word, other) NOT IN (SELECT word, other FROM syn) GROUP BY 1, 2),
ok AS (SELECT g.word, g.other, tier FROM g JOIN w a ON a.word = g.word JOIN w b ON b.word = g.other WHERE NOT list_has_any({_CONTENT.format("a.gloss")}, {_CONTENT.format("b.gloss")}))
SELECT word, other, row_number() OVER (PARTITION BY word ORDER BY tier, {_OTHER}, other) AS rank FROM ok QUALIFY rank <= 3""")
def quiz_distractors(spark, sf_dir):
    """Three wrong answers a part: parts of one order, its neighbour, others of its brand and size; none that is said alike."""
    t = Tables(spark, sf_dir)
    key = F.col("p_partkey")
    words = t.part.select(key.cast("string").alias("word"), F.concat_ws(" ", "p_name", F.lower("p_type")).alias("gloss"), F.concat("p_brand", "p_size").alias("band"))
    l = t.lineitem.where("l_quantity >= 45").select("l_orderkey", F.col("l_partkey").cast("string").alias("k")).distinct()  # noqa: E741
    related = l.withColumnRenamed("k", "word").join(l.withColumnRenamed("k", "other"), "l_orderkey").select("word", "other").distinct()
    alike = t.part.select(key.cast("string").alias("word"), (key + 1).cast("string").alias("other"))
    synonyms = related.where((F.length("word") == F.length("other")) & (F.expr("right(word, 1)") == F.expr("right(other, 1)")))
    pool = words.select(F.col("word").alias("other"), "gloss", "band")
    return reader.distractors(words, related, alike, pool, synonyms, 3, 5).withColumn("rank", F.col("rank").cast("long"))
