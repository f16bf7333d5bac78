"""Queries that write etymologies of orders and parts as prose, and read prose back; the SQL has the rows without the prose."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import etymology
from .registry import Registry, Tables

query = Registry()
_OWN = "NATION_0"
_TYPES = {
    "F": "CASE l_returnflag WHEN 'R' THEN 'inherited_from' WHEN 'A' THEN 'borrowed_from' ELSE 'derived_from' END",
    "O": "CASE WHEN l_quantity < 8 THEN 'clipping_of' WHEN l_quantity < 14 THEN 'named_after' WHEN l_quantity < 22 THEN 'has_prefix' WHEN l_quantity < 34 THEN 'compound_of' WHEN l_quantity < 45 THEN 'has_suffix' ELSE 'cognate_of' END",
}
_RELTYPE = f"CASE WHEN l_linestatus = 'F' THEN {_TYPES['F']} ELSE {_TYPES['O']} END"


def _lines(t):
    """Lines with the names of their suppliers' nations and of their parts."""
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    return t.lineitem.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))


_LINES = "lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN part ON p_partkey = l_partkey"


@query(f"""WITH r AS (SELECT 'w' || l_orderkey AS word, l_linenumber AS row, {_RELTYPE} AS reltype, n_name AS language, CASE WHEN l_linestatus = 'F' THEN p_name ELSE split_part(p_name, ' ', 2) END AS term FROM {_LINES}),
g AS (SELECT 'NATION_' || (p_size % 25) AS language, p_name AS term, min(lower(p_type)) AS gloss FROM part GROUP BY 1, 2),
a AS (SELECT word, language, term, min((row, reltype)) AS r FROM r WHERE reltype IN ('inherited_from', 'borrowed_from', 'derived_from') GROUP BY ALL),
k AS (SELECT word, language, term, r[2] AS reltype, row_number() OVER (PARTITION BY word ORDER BY r[1], language, term) AS k FROM a QUALIFY k <= 5),
h AS (SELECT k.*, gloss, k = max(k) OVER (PARTITION BY word) AS last FROM k LEFT JOIN g USING (language, term)),
chain AS (SELECT word, string_agg(CASE WHEN k > 1 THEN 'from' WHEN reltype = 'borrowed_from' THEN 'Borrowed from' ELSE 'From' END || ' ' || language || ' ' || term || CASE WHEN last AND gloss IS NOT NULL THEN ' (“' || gloss || '”)' ELSE '' END, ', ' ORDER BY k) || '.' AS chain FROM h GROUP BY word),
f AS (SELECT word, row, CASE reltype WHEN 'clipping_of' THEN 'Clipping of ' ELSE 'Named after ' END || CASE WHEN language <> '{_OWN}' THEN language || ' ' ELSE '' END || term || '.' AS t FROM r WHERE reltype IN ('clipping_of', 'named_after')),
simple AS (SELECT word, t AS simple FROM f QUALIFY row_number() OVER (PARTITION BY word ORDER BY row, t) = 1),
s AS (SELECT word, row, CASE reltype WHEN 'has_suffix' THEN '-' || term WHEN 'has_prefix' THEN term || '-' ELSE CASE WHEN language <> '{_OWN}' THEN language || ' ' ELSE '' END || term END AS t FROM r WHERE reltype IN ('has_prefix', 'has_suffix', 'compound_of')),
parts AS (SELECT word, 'By surface analysis, ' || string_agg(t, ' + ' ORDER BY row, t) || '.' AS parts FROM (SELECT word, t, min(row) AS row FROM s GROUP BY word, t) GROUP BY word HAVING count(*) >= 2)
SELECT word, substr(concat_ws(' ', coalesce(chain, simple), parts), 1, 400) AS prose FROM chain FULL JOIN simple USING (word) FULL JOIN parts USING (word)""")
def etymology_assembled(spark, sf_dir):
    """Each order's lines as relations of a word."""
    t = Tables(spark, sf_dir)
    term = F.when(F.col("l_linestatus") == "F", F.col("p_name")).otherwise(F.split_part("p_name", F.lit(" "), F.lit(2)))
    rows = _lines(t).select(F.concat(F.lit("w"), "l_orderkey").alias("word"), F.col("l_linenumber").alias("row"), F.expr(_RELTYPE).alias("reltype"), F.col("n_name").alias("language"), term.alias("term"), F.col("l_linenumber").alias("position"))
    glosses = t.part.select(F.concat(F.lit("NATION_"), F.col("p_size") % 25).alias("language"), F.col("p_name").alias("term"), F.lower("p_type").alias("gloss"))
    return etymology.assembled(rows, glosses, own=_OWN)


@query(f"""WITH l AS (
  SELECT 'w' || l_orderkey AS word, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax, l_discount, l_returnflag) AS n, l_linestatus AS status, l_quantity AS q, n_name AS language, p_name AS term, lower(p_type) AS gloss,
    CASE l_returnflag WHEN 'R' THEN 'inh' WHEN 'A' THEN 'bor' ELSE 'der' END AS kind, l_discount >= 0.08 AS hedged, l_tax >= 0.06 AS nested, 'NATION_' || ((s_nationkey + 1) % 25) AS language2, 'base ' || split_part(p_name, ' ', 2) AS term2 FROM {_LINES}),
steps AS (
  SELECT word, n, 0 AS sub, kind, language, term, gloss, CASE WHEN hedged THEN 'probably' ELSE '' END AS hedge FROM l WHERE status = 'F'
  UNION ALL SELECT word, n, 1, 'der', language2, term2, '', 'perhaps' FROM l WHERE status = 'F' AND nested),
placed AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n, sub) - 1 AS place FROM steps),
chain AS (
  SELECT word, place, kind, language, term, gloss, hedge, CASE WHEN sub = 1 THEN place - 1 ELSE coalesce(max(CASE WHEN sub = 0 THEN place END) OVER (PARTITION BY word ORDER BY n, sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) END AS of FROM placed),
others AS (
  SELECT word, 1 AS list, min(n) AS n, 'doublet' AS kind, 'English' AS language, term, '' AS gloss FROM l WHERE status = 'O' AND q < 20 GROUP BY word, term
  UNION ALL SELECT word, 2, n, 'cognate', language, term, gloss FROM l WHERE status = 'O' AND q >= 20 AND q < 35
  UNION ALL SELECT word, 3, min(n), 'see', 'English', term, '' FROM l WHERE status = 'O' AND q >= 35 GROUP BY word, term),
c AS (SELECT word, count(*) AS n FROM chain GROUP BY word)
SELECT word, place, kind, language, term, gloss, hedge, of FROM chain
UNION ALL SELECT o.word, coalesce(c.n, 0) + row_number() OVER (PARTITION BY o.word ORDER BY list, o.n) - 1, kind, language, term, gloss, '', -1 FROM others o LEFT JOIN c USING (word)""")
def etymology_parsed(spark, sf_dir):
    """Each order's lines written as prose with brackets, hedges and lists, and read back; the languages are the table's."""
    t = Tables(spark, sf_dir)
    lines = _lines(t).withColumn("step", F.expr("""concat(CASE WHEN l_discount >= 0.08 THEN 'probably ' ELSE '' END, CASE l_returnflag WHEN 'R' THEN 'inherited from ' WHEN 'A' THEN 'borrowed from ' ELSE 'from ' END, n_name, ' ', p_name, ' (“', lower(p_type), '”',
      CASE WHEN l_tax >= 0.06 THEN concat(', perhaps from NATION_', (s_nationkey + 1) % 25, ' base ', split_part(p_name, ' ', 2)) ELSE '' END, ')')"""))
    lines = lines.withColumn("cognate", F.expr("concat(n_name, ' ', p_name, ' (“', lower(p_type), '”)')"))
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_discount", "l_returnflag", "l_linestatus", "step", "cognate", "p_name")
    held = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("l"))  # an order's lines

    def sentence(opening: str, test, text: str, closing: str = ".") -> F.Column:
        found = F.transform(F.filter("l", test), lambda x: x[text])
        return F.when(F.size(found) > 0, F.concat(F.lit(opening), F.array_join(found, ", "), F.lit(closing)))

    is_ = lambda x, s: x["l_linestatus"] == s
    prose = F.concat_ws(
        " ",
        sentence("First attested in 1534; ", lambda x: is_(x, "F"), "step"),
        sentence("Doublet of ", lambda x: is_(x, "O") & (x["l_quantity"] < 20), "p_name"),
        sentence("Cognate with ", lambda x: is_(x, "O") & (x["l_quantity"] >= 20) & (x["l_quantity"] < 35), "cognate"),
        sentence("See also ", lambda x: is_(x, "O") & (x["l_quantity"] >= 35), "p_name"),
    )
    languages = [r.n_name for r in t.nation.select("n_name").collect()]  # a small table of names
    return etymology.parsed(held.select(F.concat(F.lit("w"), "l_orderkey").alias("word"), prose.alias("prose")), languages)


_JOINED = "replace(p_name, ' ', '') || lower(p_type)"


@query(f"""WITH p AS (SELECT 'w' || p_partkey AS word, p_partkey % 7 AS form, {_JOINED} AS x, split_part(p_name, ' ', 2) || lower(p_type) AS y, 'NATION_' || (p_size % 25) AS language FROM part),
heads AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN upper(h[1:1]) || h[2:] ELSE h END AS h FROM (SELECT p_partkey, {_JOINED} AS h FROM part WHERE p_size <= 9)),
e AS (
  SELECT word, 0 AS place, 'English' AS language, x AS term, 'der' AS kind, x AS need FROM p WHERE form IN (1, 2)
  UNION ALL SELECT word, 0, 'English', x, 'part', x FROM p WHERE form = 0 UNION ALL SELECT word, 1, 'English', '-ish', 'affix', x FROM p WHERE form = 0
  UNION ALL SELECT word, 0, language, y, 'part', NULL FROM p WHERE form = 3 UNION ALL SELECT word, 1, 'English', x, 'part', x FROM p WHERE form = 3)
SELECT word, place, language, term, kind FROM e WHERE need IS NULL AND EXISTS (SELECT 1 FROM e o, heads WHERE o.word = e.word AND o.need IN (h, lower(h))) OR EXISTS (SELECT 1 FROM heads WHERE need IN (h, lower(h)))""")
def etymology_derived(spark, sf_dir):
    """Parts' names derived from one another, where the other is a headword; half of these are spelt with a capital."""
    p = Tables(spark, sf_dir).part
    x, y = F.expr("concat(replace(p_name, ' ', ''), lower(p_type))"), F.expr("concat(split_part(p_name, ' ', 2), lower(p_type))")
    form = F.col("p_partkey") % 7
    said = F.when(form == 0, F.concat(F.lit("From "), x, F.lit(" (“old”) + -ish. See also that.")))
    said = said.when(form == 1, F.concat(F.lit("Clipping of the noun "), x, F.lit(".")))
    said = said.when(form == 2, F.concat(F.lit("(1612) Deverbal from "), x, F.lit(", at first “x”.")))
    said = said.when(form == 3, F.concat(F.lit("Compound of NATION_"), F.col("p_size") % 25, F.lit(" "), y, F.lit(" + "), x))
    said = said.when(form == 4, F.concat(F.lit("From "), x, F.lit(" and others.")))  # two words are no one parent
    said = said.when(form == 5, F.concat(F.lit("Of "), x, F.lit(".")))
    heads = p.where("p_size <= 9").select(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 99))).otherwise(x).alias("word"))
    languages = [r.n_name for r in Tables(spark, sf_dir).nation.select("n_name").collect()]
    return etymology.derived(p.select(F.concat(F.lit("w"), "p_partkey").alias("word"), said.alias("prose")), heads, languages=languages)
