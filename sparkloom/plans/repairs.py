"""Queries of repairs to entries: pointers, cut-off texts, overrides, merges, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curation, relational, sampling
from .registry import Registry, Tables

query = Registry()


@query("""WITH RECURSIVE p AS (SELECT DISTINCT l_partkey AS word, (l_partkey * 7 + l_suppkey) % 500 AS target FROM lineitem WHERE l_quantity >= 49 AND l_discount >= 0.08),
pair AS (SELECT word AS a, target AS b FROM p WHERE word <> target UNION SELECT target, word FROM p WHERE word <> target),
reach AS (SELECT a AS node, a AS other FROM pair UNION SELECT node, b FROM reach JOIN pair ON other = a),
c AS (SELECT node AS word, min(other) AS component FROM reach GROUP BY node), t AS (SELECT component, arg_min(word, (word % 13, word)) AS canonical FROM c GROUP BY 1)
SELECT word, canonical FROM c JOIN t USING (component) WHERE word <> canonical""")
def resolved_pointers(spark, sf_dir):
    """Parts that point to one another; the one whose key is least modulo 13 stands for its cluster."""
    l = Tables(spark, sf_dir).lineitem.where("l_quantity >= 49 AND l_discount >= 0.08")  # noqa: E741
    p = l.select(F.col("l_partkey").alias("word"), ((F.col("l_partkey") * 7 + F.col("l_suppkey")) % 500).alias("target")).distinct()
    return curation.resolve_pointers(p, [F.col("word") % 13])


_POINTED = "SELECT p_partkey, p_name AS word, p_type AS target, CASE p_partkey % 4 WHEN 0 THEN 'plural of ' || p_type WHEN 1 THEN 'form of ' || split_part(p_name, ' ', 1) || ' ' || ['ring', 'zzz', 'bolt'][(p_partkey % 3 + 1)::INT] WHEN 2 THEN 'form of ' || p_name ELSE 'a thing' END AS gloss FROM part"


@query(f"""WITH p AS ({_POINTED}), w AS (SELECT DISTINCT p_name AS known FROM part),
j AS (SELECT p.*, known, contains(gloss, target) AS told FROM p LEFT JOIN w ON known = regexp_extract(gloss, ' of (.+)$', 1))
SELECT p_partkey, word, CASE WHEN NOT told AND known IS NOT NULL AND known <> word THEN known ELSE target END AS target, CASE WHEN told THEN 'keep' WHEN known IS NOT NULL AND known <> word THEN 'retarget' ELSE 'remove' END AS verdict FROM j""")
def repaired_pointers(spark, sf_dir):
    """Pointers of parts kept where their gloss tells of the target, led to what it names, or removed."""
    name, k = F.col("p_name"), F.col("p_partkey")
    other = F.concat(F.lit("form of "), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" "), F.element_at(F.array(*map(F.lit, ("ring", "zzz", "bolt"))), (k % 3 + 1).cast("int")))
    gloss = F.when(k % 4 == 0, F.concat(F.lit("plural of "), "p_type")).when(k % 4 == 1, other).when(k % 4 == 2, F.concat(F.lit("form of "), name)).otherwise("a thing")
    p = Tables(spark, sf_dir).part.select("p_partkey", name.alias("word"), F.col("p_type").alias("target"), gloss.alias("gloss"))
    return curation.repair_pointers(p, p.select("word"), F.contains(F.col("gloss"), F.col("target")), F.regexp_extract("gloss", " of (.+)$", 1)).select("p_partkey", "word", "target", "verdict")


_STUB = "CASE doc_id % 4 WHEN 0 THEN left(text, 60) || '…' WHEN 1 THEN left(text, 8) || '...' WHEN 2 THEN text ELSE 'x' || left(text, 50) || '…' END"


@query(f"SELECT doc_id, lang, text FROM documents WHERE text IS NOT NULL AND starts_with(text, rtrim(regexp_replace({_STUB}, '(…|\\.\\.\\.)$', ''), ' ')) AND length(text) > length({_STUB}) AND length(rtrim(regexp_replace({_STUB}, '(…|\\.\\.\\.)$', ''), ' ')) >= 10")
def restored_texts(spark, sf_dir):
    """Documents whose texts were cut off, after which they are whole again."""
    d = Tables(spark, sf_dir).documents.select("doc_id", "lang", "text")
    return curation.untruncated(d.select("doc_id", "lang", F.expr(_STUB).alias("text")), d, "doc_id", "text")


@query("""WITH e AS (SELECT p_partkey, replace(p_name, ' ', '') AS word, [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)] AS new, CASE WHEN p_size > 34 THEN [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)] WHEN p_size > 17 THEN [replace(p_name, ' ', '')] END AS old FROM part)
SELECT word || '#' || p_partkey AS word, array_to_string(list_append(new, '#' || p_partkey), '+') AS pieces FROM e WHERE p_partkey % 7 <> 1 AND (old IS NULL OR old <> new)""")
def curated_overrides(spark, sf_dir):
    """Curated analyses of parts' names that join to the name and differ from what is there."""
    p = Tables(spark, sf_dir).part
    k = F.col("p_partkey")
    tail = F.concat(F.lit("#"), k)
    piece = lambda c: F.struct(c.alias("s"))
    word = F.concat(F.replace("p_name", F.lit(" "), F.lit("")), tail)
    first, second = (F.split_part("p_name", F.lit(" "), F.lit(x)) for x in (1, 2))
    whole = F.array(piece(first), piece(second), piece(tail))
    there = p.where("p_size > 17").select(word.alias("word"), F.when(F.col("p_size") > 34, whole).otherwise(F.array(piece(word))).alias("pieces"))
    wrong = F.array(piece(first), piece(F.lit("other")), piece(tail))
    curated = p.select(word.alias("word"), F.when(k % 7 == 1, wrong).otherwise(whole).alias("pieces"))
    return curation.override(there, curated).select("word", F.array_join(F.transform("pieces", lambda x: x["s"]), "+").alias("pieces"))


@query("""WITH b AS (SELECT p_partkey AS word, CASE p_partkey % 4 WHEN 0 THEN string_split(p_name, ' ') WHEN 1 THEN [p_name] WHEN 2 THEN [] END AS parts FROM part WHERE p_size > 8),
n AS (SELECT p_partkey AS word, CASE WHEN p_size % 2 = 0 THEN string_split(p_name, ' ') ELSE [p_type] END AS parts FROM part)
SELECT word, array_to_string(n.parts, '+') AS parts FROM n LEFT JOIN b USING (word) WHERE len(n.parts) > 1 AND n.parts IS DISTINCT FROM b.parts OR b.parts IS NULL OR len(b.parts) = 0""")
def merged_parses(spark, sf_dir):
    """Parses of several parts replace what is there, single ones fill gaps."""
    p, k = Tables(spark, sf_dir).part, F.col("p_partkey")
    several = F.split("p_name", " ")
    base = p.where("p_size > 8").select(k.alias("word"), F.when(k % 4 == 0, several).when(k % 4 == 1, F.array("p_name")).when(k % 4 == 2, F.array().cast("array<string>")).alias("parts"))
    new = p.select(k.alias("word"), F.when(F.col("p_size") % 2 == 0, several).otherwise(F.array("p_type")).alias("parts"))
    return curation.split_merge(base, new).select("word", F.array_join("parts", "+").alias("parts"))


@query("""WITH v AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents)),
n AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS token FROM documents),
c AS (SELECT DISTINCT a.w || 'ing' AS w FROM v a JOIN v b ON b.w = a.w || 'ing')
SELECT doc_id, token, CASE WHEN length(token) % 3 <> 0 AND lower(token) IN (SELECT w FROM c) THEN 'compound' WHEN length(token) % 3 = 0 THEN 'word' ELSE 'name' END AS kind FROM n""")
def relabelled_names(spark, sf_dir):
    """Capitalised words taken for names that are other words with an ending."""
    d = Tables(spark, sf_dir).documents
    words = d.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).select(F.lower("w").alias("w")).distinct()
    compounds = words.select(F.concat("w", F.lit("ing")).alias("word")).join(words.select(F.col("w").alias("word")), "word", "left_semi")
    tokens = d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("token")).distinct()
    return curation.relabelled(tokens.withColumn("kind", F.when(F.length("token") % 3 == 0, "word").otherwise("name")), compounds)


@query("""WITH w AS (SELECT o_orderkey AS word, o_orderpriority || ' ' || o_orderstatus || ' ' || o_custkey AS gloss FROM orders WHERE o_orderstatus <> 'F')
SELECT DISTINCT sha1(gloss) AS hash, gloss FROM w WHERE sha1(gloss) NOT IN (SELECT sha1(o_orderpriority || ' P ' || o_custkey) FROM orders)""")
def glosses_to_embed(spark, sf_dir):
    """Orders as words: those that are filled are done, what others say may be cached."""
    o = Tables(spark, sf_dir).orders
    gloss = F.concat_ws(" ", "o_orderpriority", "o_orderstatus", F.col("o_custkey").cast("string"))
    words = o.select(F.col("o_orderkey").alias("word"), gloss.alias("gloss"))
    cached = o.select(F.sha1(F.concat_ws(" ", "o_orderpriority", F.lit("P"), F.col("o_custkey").cast("string")).cast("binary")).alias("hash")).distinct()
    return curation.to_embed(words, o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("word")), cached)


_CHANGED = "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders"


@query(f"{_CHANGED} UNION ALL SELECT o_orderkey + 100000000, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice < 2000")
def applied_upsert(spark, sf_dir):
    """A plan of changes and new rows, made and applied."""
    base = Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = base.where("o_totalprice < 2000").withColumn("o_orderkey", F.col("o_orderkey") + 100_000_000)
    patch = base.withColumn("o_orderstatus", F.when(F.col("o_totalprice") > 300_000, "X")).unionByName(new)
    plan = curation.upsert(base, patch, ["o_orderkey"])
    return relational.apply_diff(base, plan.drop("change"), ["o_orderkey"])


@query("SELECT o_orderkey, 'lost' AS side FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT o_orderkey + 100000000, 'new' FROM orders WHERE o_totalprice < 2000")
def changed_keys(spark, sf_dir):
    """Keys that an edit lost or invented."""
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_totalprice")
    after = o.where("o_totalprice <= 400000").unionByName(o.where("o_totalprice < 2000").withColumn("o_orderkey", F.col("o_orderkey") + 100_000_000))
    return relational.same_keys(o, after, ["o_orderkey"])


@query("""WITH RECURSIVE v AS (SELECT lower(w) AS w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents) WHERE length(w) >= 4 GROUP BY 1),
r AS (SELECT w[:2] AS key, w, row_number() OVER (PARTITION BY w[:2] ORDER BY n DESC, w) AS rank FROM v QUALIFY rank <= 30),
f AS (SELECT DISTINCT key, 0::BIGINT AS k, []::VARCHAR[] AS taken FROM r
  UNION ALL SELECT f.key, r.rank, CASE WHEN len(taken) < 6 AND len(list_filter(taken, lambda t: t[:5] = r.w[:5] AND (contains(t, r.w) OR contains(r.w, t)))) = 0 THEN list_append(taken, r.w) ELSE taken END FROM f JOIN r ON r.key = f.key AND r.rank = f.k + 1)
SELECT key, unnest(range(len(taken))) AS place, unnest(taken) AS word FROM (SELECT key, arg_max(taken, k) AS taken FROM f GROUP BY key)""")
def distinct_enough(spark, sf_dir):
    """The six commonest words of each two letters that aren't forms of one another: the lists are the feature."""
    v = Tables(spark, sf_dir).documents.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).where(F.length("w") >= 4)
    v = v.groupBy(F.lower("w").alias("word")).agg(F.count("*").alias("n")).withColumn("key", F.substring("word", 1, 2))
    ranked = relational.top_by(v, ["key"], [F.desc("n"), F.col("word")], 30)
    return sampling.distinct_enough(ranked, ["key"], "word").select("key", F.col("place").cast("long").alias("place"), "word")


@query("""WITH RECURSIVE s AS (SELECT p_brand AS word, p_partkey AS ord, p_name, p_type, p_size FROM part),
e AS (SELECT x.word, x.ord AS a, y.ord AS b FROM s x JOIN s y ON x.word = y.word AND x.ord < y.ord AND (x.p_name = y.p_name OR x.p_type = y.p_type AND x.p_size = y.p_size)),
pair AS (SELECT word, a, b FROM e UNION SELECT word, b, a FROM e), reach AS (SELECT word, a, a AS other FROM pair UNION SELECT reach.word, reach.a, pair.b FROM reach JOIN pair ON pair.word = reach.word AND pair.a = other)
SELECT word, a AS ord, min(other) AS cluster FROM reach GROUP BY word, a""")
def clustered_senses(spark, sf_dir):
    """Parts of a brand as senses, alike by name or by type and size."""
    s = Tables(spark, sf_dir).part.select(F.col("p_brand").alias("word"), F.col("p_partkey").alias("ord"), "p_name", "p_type", "p_size")
    pairs = []
    for keys in (["word", "p_name"], ["word", "p_type", "p_size"]):
        least = s.groupBy(*keys).agg(F.min("ord").alias("a"))  # a star around the least says the same as all pairs
        pairs.append(s.join(least, keys).where("ord <> a").select("word", "a", F.col("ord").alias("b")))
    return curation.sense_clusters(pairs[0].unionByName(pairs[1]).distinct(), ["word"])
