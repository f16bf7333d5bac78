"""Queries that cut the documents' words into morphemes of a table made from their vocabulary."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import morphemes
from ..sources.shared import stash
from .registry import Registry, Tables
from .relational import _VOCABULARY, vocabulary

query = Registry()

#: Words of two letters are prefixes, of three to five roots (one root with and without a final e), the ends of
#: many long words suffixes; conditions of all three kinds.
_TABLE = f"""{_VOCABULARY}, v AS MATERIALIZED (SELECT lower(word) AS w, sum(n)::BIGINT AS n FROM vocabulary GROUP BY 1),
m AS (
  SELECT 'prefix' AS kind, w AS form, 'p:' || w AS id, n FROM v WHERE length(w) = 2 AND n >= 3
  UNION ALL SELECT 'root', w, 'r:' || regexp_replace(w, 'e$', ''), n FROM v WHERE length(w) BETWEEN 3 AND 5 AND n >= 3
  UNION ALL SELECT 'suffix', form, 's:' || form, count(*) FROM (SELECT w, unnest([w[-2:], w[-3:], w[-4:]]) AS form FROM v WHERE length(w) >= 6) GROUP BY form HAVING count(*) >= 20),
t AS MATERIALIZED (
  SELECT kind, form, id, row_number() OVER (ORDER BY kind, n DESC, form)::INT AS place, CASE WHEN kind = 'prefix' AND form LIKE '%e' THEN '^[^aeiou]' END AS ahead,
    CASE WHEN kind = 'prefix' AND form LIKE 'i%' THEN '(tion|e|d)$' END AS whole, CASE WHEN kind = 'root' AND length(form) = 3 THEN 's$' END AS unless FROM m)"""
_EDGES = """list({'n': length(form), 'x': form, 'i': id} ORDER BY length(form) DESC, place, id) FILTER (WHERE kind = """
_PARSES = f"""WITH RECURSIVE {_TABLE},
cut AS (SELECT w, a, w[a + 1 : a + n] AS form FROM (SELECT w, a, unnest(range(1, least(5, length(w) - a) + 1)) AS n FROM (SELECT w, unnest(range(length(w))) AS a FROM v))),
e AS (
  SELECT w, a, kind, form, id, place FROM cut JOIN t USING (form) WHERE (ahead IS NULL OR regexp_matches(w[a + length(form) + 1 :], ahead)) AND (whole IS NULL OR regexp_matches(w, whole))
    AND (unless IS NULL OR NOT regexp_matches(w, unless)) AND (kind <> 'prefix' OR length(w) - a - length(form) >= 2)),
lat AS (SELECT w, a, {_EDGES}'prefix') AS pre, {_EDGES}'root') AS root, {_EDGES}'suffix') AS suf FROM e GROUP BY w, a),
l AS MATERIALIZED (
  SELECT c.w, c.a, coalesce(pre, []) AS pre, coalesce(root, []) AS root, coalesce(suf, []) AS suf,
    coalesce(min(CASE WHEN suf IS NOT NULL THEN c.a END) OVER (PARTITION BY c.w ORDER BY c.a ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), length(c.w)) - c.a AS run,
    contains('aeiouy', c.w[c.a + 1]) AND lead(root) OVER (PARTITION BY c.w ORDER BY c.a) IS NOT NULL AS links
  FROM (SELECT w, unnest(range(length(w))) AS a FROM v) c LEFT JOIN lat ON lat.w = c.w AND lat.a = c.a),
best AS (
  SELECT w, length(w) AS a, [{{'s': 0, 'o': 0, 'p': ''}}] AS f0, [{{'s': 0, 'o': 0, 'p': ''}}] AS f1, [{{'s': 0, 'o': 0, 'p': ''}}] AS f2 FROM v
  UNION ALL
  SELECT w, a, list_prepend(b0, f0), list_prepend(b1, f1), list_prepend(b2, f2) FROM (
    SELECT *, list_sort(list_concat(list_transform(pre, lambda x, i: {{'s': (100 * x.n - 12 + f0[x.n].s)::INT, 'o': (-i)::INT, 'p': 'prefix;' || x.x || ';' || x.i || '|' || f0[x.n].p}}),
        [{{'s': b1.s, 'o': -10000, 'p': b1.p}}]), 'DESC')[1] AS b0 FROM (
      SELECT *, list_sort(list_concat(list_transform(root, lambda x, i: {{'s': (100 * x.n + 88 + f1[x.n].s)::INT, 'o': (-i)::INT, 'p': 'root;' || x.x || ';' || x.i || '|' || f1[x.n].p}}),
          CASE WHEN links THEN [{{'s': (f1[1].s - 7)::INT, 'o': -5000, 'p': 'linker;' || w[a + 1] || ';|' || f1[1].p}}] ELSE [] END,
          [{{'s': b2.s, 'o': -10000, 'p': b2.p}}]), 'DESC')[1] AS b1 FROM (
        SELECT l.*, f0, f1, f2, list_sort(list_concat(list_transform(suf, lambda x, i: {{'s': (100 * x.n - 12 + f2[x.n].s)::INT, 'o': (-i)::INT, 'p': 'suffix;' || x.x || ';' || x.i || '|' || f2[x.n].p}}),
            CASE WHEN l.a = length(l.w) - 1 AND l.w[l.a + 1] = 'e' THEN [{{'s': -7, 'o': -5000, 'p': 'silent;e;|'}}] ELSE [] END,
            CASE WHEN len(suf) = 0 THEN [{{'s': (-70 * run - 12 + f2[run].s)::INT, 'o': -6000, 'p': 'unknown;' || l.w[l.a + 1 : l.a + run] || ';|' || f2[run].p}}] ELSE [] END), 'DESC')[1] AS b2
        FROM best JOIN l ON l.w = best.w AND l.a = best.a - 1)))),
p AS MATERIALIZED (
  SELECT word, score, list_transform(x, lambda y: split_part(y, ';', 1)) AS k, list_transform(x, lambda y: split_part(y, ';', 2)) AS t, list_transform(x, lambda y: split_part(y, ';', 3)) AS i
  FROM (SELECT w AS word, f0[1].s AS score, string_split(f0[1].p, '|')[:-2] AS x FROM best WHERE a = 0)),
parses AS (
  SELECT word, score, CASE WHEN peel THEN list_concat(t[:-2], [t[-1][:-2], 'e']) ELSE t END AS t, CASE WHEN peel THEN list_append(k, 'silent') ELSE k END AS k, CASE WHEN peel THEN list_append(i, '') ELSE i END AS i
  FROM (SELECT p.*, r.id IS NOT NULL AND k[-1] = 'root' AND length(t[-1]) >= 4 AND t[-1] LIKE '%e' AS peel FROM p LEFT JOIN (SELECT DISTINCT id, form FROM t WHERE kind = 'root') r ON r.id = i[-1] AND r.form = t[-1][:-2]))"""


def _table(words):
    """The morpheme table of the words (w, n)."""
    size = F.length("w")
    prefix = words.where((size == 2) & (F.col("n") >= 3)).select(F.lit("prefix").alias("kind"), F.col("w").alias("form"), F.concat(F.lit("p:"), "w").alias("id"), "n")
    root = words.where(size.between(3, 5) & (F.col("n") >= 3)).select(F.lit("root"), "w", F.concat(F.lit("r:"), F.regexp_replace("w", "e$", "")), "n")
    ends = words.where(size >= 6).select(F.explode(F.array(*(F.expr(f"substring(w, -{k})") for k in (2, 3, 4)))).alias("form")).groupBy("form").agg(F.count("*").alias("n")).where("n >= 20")
    suffix = ends.select(F.lit("suffix"), "form", F.concat(F.lit("s:"), "form"), "n")
    m = prefix.union(root).union(suffix)
    when = lambda c, x: F.when(c, F.lit(x))
    place = F.row_number().over(Window.orderBy("kind", F.desc("n"), "form"))  # a table of morphemes, not of words
    ahead = when((F.col("kind") == "prefix") & F.col("form").endswith("e"), "^[^aeiou]").alias("ahead")
    whole = when((F.col("kind") == "prefix") & F.col("form").startswith("i"), "(tion|e|d)$").alias("whole")
    unless = when((F.col("kind") == "root") & (F.length("form") == 3), "s$").alias("unless")
    return m.select("kind", "form", "id", place.alias("place"), ahead, whole, unless)


def _parsed(spark, sf_dir):
    words = vocabulary(Tables(spark, sf_dir).documents).groupBy(F.lower("word").alias("w")).agg(F.sum("n").alias("n"))
    words = stash(words, "vocabulary")  # words and table are both made of it
    return morphemes.decompose(words.select(F.col("w").alias("word")), _table(words))


@query(f"{_PARSES} SELECT word, array_to_string(t, '+') AS pieces, array_to_string(k, '+') AS kinds, score::BIGINT AS score FROM parses")
def decompose_words(spark, sf_dir):
    """Parses of all lower-cased words of documents."""
    texts, kinds = (F.array_join(F.transform("parts", lambda p: p[x]), "+") for x in ("text", "kind"))
    return _parsed(spark, sf_dir).select("word", texts.alias("pieces"), kinds.alias("kinds"), F.col("score").cast("long").alias("score"))


@query(f"""{_PARSES},
post AS (SELECT DISTINCT word, id FROM (SELECT word, unnest(t) AS x, unnest(i) AS id FROM parses WHERE length(word) >= 4 AND list_contains(k, 'root') AND NOT list_contains(k, 'unknown')) WHERE length(x) >= 3 AND id <> ''),
o AS (SELECT id, word, row_number() OVER (PARTITION BY id ORDER BY length(word), word) AS rank, count(*) OVER (PARTITION BY id) AS n FROM post)
SELECT id, word, rank, n FROM o WHERE n <= 60 OR rank <= 44 OR rank > n - 16""")
def morpheme_index(spark, sf_dir):
    """The words of each morpheme; of many, those from both ends."""
    return morphemes.index(_parsed(spark, sf_dir))
