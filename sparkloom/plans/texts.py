"""Queries of similarity and full text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import setjoin, similarity, text
from ..operators.components import connected_components
from ..sources.shared import stash
from .registry import Registry, Tables
from .relational import _VOCABULARY, vocabulary

query = Registry()
_COS = "round(list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) / (sqrt(list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[])) * sqrt(list_dot_product(y.embedding::DOUBLE[], y.embedding::DOUBLE[]))), 4)"


def _vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


@query(f"""SELECT x.vec_id AS probe, y.vec_id AS id, {_COS} AS cosine, row_number() OVER (PARTITION BY x.vec_id ORDER BY {_COS} DESC, y.vec_id) AS rank
FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE x.vec_id % 100 = 0 QUALIFY rank <= 10""")
def similar_topk(spark, sf_dir):
    """Probes are the ids divisible by 100, against all vectors; ten each."""
    v = _vectors(Tables(spark, sf_dir))
    return similarity.top_similar(v, v.where("id % 100 = 0"), 10)


@query(f"SELECT x.label, x.vec_id AS a, y.vec_id AS b, {_COS} AS cosine FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id WHERE {_COS} >= 0.3")
def similar_within_group(spark, sf_dir):
    return similarity.similar_pairs(_vectors(Tables(spark, sf_dir)), ["label"], 0.3)


@query("""WITH m AS (SELECT label, position, avg(x) AS mean FROM (SELECT label, unnest(range(len(embedding))) AS position, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY ALL)
SELECT label, position, round(mean / sqrt(sum(mean * mean) OVER (PARTITION BY label)), 5) + 0.0 AS value FROM m""")
def mean_vector(spark, sf_dir):
    m = similarity.mean_vectors(_vectors(Tables(spark, sf_dir)), "label")
    return m.select("label", F.col("position").cast("long").alias("position"), (F.round("value", 5) + 0.0).alias("value"))


@query(f"""WITH RECURSIVE e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id WHERE {_COS} >= 0.35),
pair AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT a AS node, a AS other FROM pair UNION SELECT node, b FROM reach JOIN pair ON other = a)
SELECT node, min(other) AS component FROM reach GROUP BY node""")
def cluster_components(spark, sf_dir):
    return connected_components(similarity.similar_forest(_vectors(Tables(spark, sf_dir)), ["label"], 0.35))


_TOKENS = r"list_transform(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+'), lambda w: lower(w))"


@query(f"""WITH {_VOCABULARY}, t AS (SELECT *, CASE WHEN word = 'that' THEN 0 WHEN lower(word) = 'that' THEN 1 WHEN starts_with(lower(word), 'that') THEN 2 END AS tier FROM vocabulary)
SELECT word, n, tier FROM t WHERE tier IS NOT NULL ORDER BY tier, length(word), n DESC, word LIMIT 40""")
def prefix_search(spark, sf_dir):
    """Forty rows are shown."""
    return text.prefix_search(vocabulary(Tables(spark, sf_dir).documents), "that")


_NAMES = "names AS (SELECT DISTINCT unnest(regexp_extract_all(p_name || ' ' || p_type || ' ' || p_brand, '[A-Za-z]+')) AS word FROM part)"
_PAIRS = "list_transform(range(1, length(word)), lambda i: lower(word)[i : i + 1])"


@query(f"""WITH {_NAMES}, e AS (SELECT word, unnest({_PAIRS}) AS e FROM names WHERE length(word) > 1), n AS (SELECT word, e, count(*) AS n, sum(count(*)) OVER (PARTITION BY word) AS size FROM e GROUP BY word, e),
d AS (SELECT p.word AS probe, w.word, round(2 * sum(least(p.n, w.n)) / (max(p.size) + max(w.size)), 6)::DOUBLE AS dice FROM n p JOIN n w ON p.e = w.e AND p.word <> w.word AND abs(length(p.word) - length(w.word)) <= 3 GROUP BY 1, 2)
SELECT probe, word, dice, row_number() OVER (PARTITION BY probe ORDER BY dice DESC, word) AS rank FROM d WHERE dice >= 0.3 QUALIFY rank <= 5""")
def lookalikes(spark, sf_dir):
    """Five a word are the report."""
    names = Tables(spark, sf_dir).part.select(F.explode(F.regexp_extract_all(F.concat_ws(" ", "p_name", "p_type", "p_brand"), F.lit("[A-Za-z]+"), F.lit(0))).alias("word")).distinct()
    return text.look_alikes(names, names).select("probe", "word", "dice", F.col("rank").cast("long").alias("rank"))


@query("""WITH n AS (SELECT DISTINCT p_name FROM part), w AS (SELECT p_name, unnest(string_split(p_name, ' ')) AS w FROM n)
SELECT DISTINCT x.p_name AS a, y.p_name AS b, round(1 - levenshtein(x.p_name, y.p_name)::DOUBLE / greatest(length(x.p_name), length(y.p_name), 1), 6) AS similarity
FROM w x JOIN w y ON x.w = y.w AND x.p_name < y.p_name WHERE round(1 - levenshtein(x.p_name, y.p_name)::DOUBLE / greatest(length(x.p_name), length(y.p_name), 1), 6) >= 0.6""")
def edit_similarity(spark, sf_dir):
    """Names that share a word."""
    n = Tables(spark, sf_dir).part.select("p_name").distinct().select("p_name", F.explode(F.split("p_name", " ")).alias("w"))
    pairs = n.withColumnRenamed("p_name", "a").join(n.withColumnRenamed("p_name", "b"), "w").where("a < b").select("a", "b").distinct()
    return pairs.withColumn("similarity", F.round(scalar.edit_similarity(F.col("a"), F.col("b")), 6)).where("similarity >= 0.6")


@query(r"""WITH g AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')) AS norm, n_chars FROM documents)
SELECT arg_min(doc_id, (-n_chars, doc_id)) AS doc_id, count(*) AS copies FROM g GROUP BY norm""")
def exact_dup_fold(spark, sf_dir):
    """The richest of each normalised text."""
    d = Tables(spark, sf_dir).documents.select("doc_id", "n_chars", F.sha2(scalar.normal_gloss(F.col("text")).cast("binary"), 256).alias("norm"))
    return d.groupBy("norm").agg(F.min_by("doc_id", F.struct(-F.col("n_chars"), "doc_id")).alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


_SETS = f"""w AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k + 1 : k + 5], ' ') AS e FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 4))) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.e = y.e AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 180 * common >= 80 * (p.n + q.n))"""


@query(f"""WITH {_SETS}, k AS (SELECT a, count(*) AS n, min(b) FILTER (WHERE NOT EXISTS (SELECT 1 FROM s u WHERE u.doc_id = a AND u.e NOT IN (SELECT e FROM s v WHERE v.doc_id = b))) AS other FROM link GROUP BY a)
SELECT d.doc_id, coalesce(k.n, 0) AS n_links FROM documents d LEFT JOIN k ON k.a = d.doc_id""".replace(", min(b) FILTER (WHERE NOT EXISTS (SELECT 1 FROM s u WHERE u.doc_id = a AND u.e NOT IN (SELECT e FROM s v WHERE v.doc_id = b))) AS other", ""))
def jaccard_near_dup(spark, sf_dir):
    """A row a document with its number of links: five words, 80 %."""
    d = Tables(spark, sf_dir).documents.select(F.col("doc_id").alias("id"), "text")
    links = setjoin.link_counts(d)
    return d.select("id").join(links, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))


_ITEM = "list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' '), lambda x: length(x) >= 3))"


@query(f"""WITH b AS (SELECT item_id, {_ITEM} AS s FROM benchmark), d AS (SELECT doc_id, {_ITEM} AS s FROM documents)
SELECT item_id, doc_id FROM b JOIN d ON len(b.s) > 0 AND len(list_intersect(b.s, d.s)) = len(b.s)""")
def contained_dup(spark, sf_dir):
    """Items all of whose content words a document has: postings of the items' words, counted."""
    t = Tables(spark, sf_dir)
    b = t.benchmark.select("item_id", scalar.content_words(F.col("text")).alias("s")).where(F.size("s") > 0)
    items = b.select("item_id", F.size("s").alias("size"), F.explode("s").alias("w"))
    # a document counts for an item only if it has the item's rarest word
    words = t.documents.select("doc_id", F.explode(scalar.content_words(F.col("text"))).alias("w")).join(items.select("w").distinct(), "w")
    words = stash(words, "words")  # texts are cut once; only items' words are kept
    counts = words.groupBy("w").agg(F.count("*").alias("n"))
    rare = items.join(counts, "w", "left").groupBy("item_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "w")).alias("r")).where("r.n > 0")
    first = words.join(rare.select("item_id", F.col("r.w").alias("w")), "w").select("item_id", "doc_id")
    n = first.join(items, "item_id").join(words, ["doc_id", "w"]).groupBy("item_id", "doc_id", "size").agg(F.count("*").alias("n"))
    return n.where("n = size").select("item_id", "doc_id")


def _line_tiers(t):
    """(doc_id, item_id, tier) of lines that are equal (1), or equal when normalised (2)."""

    def lines(df, key):
        p = df.select(key, F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") > 0).distinct()
        return p.withColumn("norm", scalar.normal_gloss(F.col("line")))

    q, i = lines(t.documents, "doc_id"), lines(t.benchmark, "item_id")
    exact = q.join(i.select("item_id", "line"), "line").select("doc_id", "item_id", F.lit(1).alias("tier"))
    normal = q.join(i.select("item_id", "norm"), "norm").where("norm <> ''").select("doc_id", "item_id", F.lit(2).alias("tier"))
    return exact.unionAll(normal)


@query(r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), q AS (SELECT DISTINCT doc_id, line, trim(regexp_replace(lower(line), '[^a-z]+', ' ', 'g')) AS norm FROM p WHERE length(line) > 0),
b AS (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark), i AS (SELECT DISTINCT item_id, line, trim(regexp_replace(lower(line), '[^a-z]+', ' ', 'g')) AS norm FROM b WHERE length(line) > 0),
c AS (SELECT doc_id, item_id, 1 AS tier FROM q JOIN i USING (line) UNION ALL SELECT doc_id, item_id, 2 FROM q JOIN i USING (norm) WHERE norm <> '')
SELECT doc_id, min(tier)::BIGINT AS tier, min(item_id) FILTER (WHERE tier = m) AS item_id FROM (SELECT *, min(tier) OVER (PARTITION BY doc_id) AS m FROM c) GROUP BY doc_id""")
def cascade_resolve(spark, sf_dir):
    """Documents' lines resolved to items' lines: exact before normalised, least item of the best tier."""
    best = _line_tiers(Tables(spark, sf_dir)).groupBy("doc_id").agg(F.min(F.struct("tier", "item_id")).alias("m"))
    return best.select("doc_id", F.col("m.tier").cast("long").alias("tier"), F.col("m.item_id").alias("item_id"))


_NORM = "trim(regexp_replace(lower({}), '[^a-z]+', ' ', 'g'))"
#: Words of an item by which documents that can contain it are found.
_PROBE = 8


@query(rf"""WITH q AS (SELECT doc_id, line, {_NORM.format("line")} AS norm FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) > 0),
i AS (SELECT item_id, line, {_NORM.format("line")} AS norm FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark) WHERE length(line) > 0),
d AS (SELECT doc_id, ' ' || {_NORM.format("text")} || ' ' AS norm FROM documents), b AS (SELECT item_id, ' ' || {_NORM.format("text")} || ' ' AS norm FROM benchmark WHERE {_NORM.format("text")} <> ''),
c AS (SELECT doc_id, item_id, 1 AS tier FROM q JOIN i USING (line) UNION ALL SELECT doc_id, item_id, 2 FROM q JOIN i USING (norm) WHERE norm <> '' UNION ALL SELECT doc_id, item_id, 3 FROM d JOIN b ON contains(d.norm, b.norm)),
best AS (SELECT doc_id, min(tier) AS tier, min(item_id) FILTER (WHERE tier = m) AS item_id FROM (SELECT *, min(tier) OVER (PARTITION BY doc_id) AS m FROM c) GROUP BY doc_id)
SELECT a.doc_id, coalesce(tier, 4)::BIGINT AS tier, item_id FROM (SELECT DISTINCT doc_id FROM documents) a LEFT JOIN best ON a.doc_id IS NOT DISTINCT FROM best.doc_id""")
def cascade_tiers(spark, sf_dir):
    """All documents: a line that is an item's (1), or is when normalised (2), an item as
    words in a row anywhere in the text (3), none (4); least item of the best tier."""
    t = Tables(spark, sf_dir)
    items = t.benchmark.select("item_id", scalar.normal_gloss(F.col("text")).alias("item")).where("item <> ''").withColumn("w", F.split("item", " "))
    items = items.withColumn("span", F.least(F.size("w"), F.lit(_PROBE))).withColumn("probe", F.xxhash64("span", F.array_join(F.slice("w", 1, F.lit(_PROBE)), " "))).drop("w")
    norm = t.documents.select("doc_id", scalar.normal_gloss(F.col("text")).alias("norm"))
    # documents with an item's first words, at every span that items have (8 at most); then the whole item
    w = norm.select("doc_id", F.split("norm", " ").alias("w")).withColumn("n", F.size("w"))
    w = w.join(F.broadcast(items.select("span").distinct()), F.col("span") <= F.col("n"))
    probes = F.transform(F.sequence(F.lit(1), F.col("n") - F.col("span") + 1), lambda k: F.xxhash64("span", F.array_join(F.slice("w", k, F.col("span")), " ")))
    found = w.select("doc_id", F.explode(F.array_distinct(probes)).alias("probe")).join(items, "probe").select(F.col("doc_id").alias("d"), "item_id", "item").distinct()
    contained = found.join(norm, F.col("d").eqNullSafe(F.col("doc_id"))).where(F.concat(F.lit(" "), "norm", F.lit(" ")).contains(F.concat(F.lit(" "), "item", F.lit(" "))))
    tiers = _line_tiers(t).unionAll(contained.select("doc_id", "item_id", F.lit(3).alias("tier")))
    all_ = tiers.unionAll(t.documents.select("doc_id", F.lit(None).cast("long").alias("item_id"), F.lit(4).alias("tier")))
    best = all_.groupBy("doc_id").agg(F.min(F.struct("tier", "item_id")).alias("m"))
    return best.select("doc_id", F.col("m.tier").cast("long").alias("tier"), F.col("m.item_id").alias("item_id"))


@query(f"""WITH {_VOCABULARY}, known AS (SELECT lower(word) AS w FROM vocabulary GROUP BY 1 HAVING sum(n) >= 20),
t AS (SELECT doc_id, unnest({_TOKENS}) AS w FROM documents), c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE k.w IS NULL) AS unknown FROM t LEFT JOIN known k ON k.w = t.w GROUP BY doc_id)
SELECT doc_id, n, unknown, CASE WHEN unknown BETWEEN 1 AND 3 AND 100 * unknown <= 15 * n THEN 0 WHEN 100 * unknown <= 30 * n THEN 1 ELSE 2 END::BIGINT AS tier FROM c""")
def state_coverage(spark, sf_dir):
    """Words seen twenty times are known; texts by how many they leave unknown."""
    d = Tables(spark, sf_dir).documents
    known = vocabulary(d).groupBy(F.lower("word").alias("w")).agg(F.sum("n").alias("s")).where("s >= 20").select("w", F.lit(True).alias("k"))
    c = d.select("doc_id", F.explode(text.tokens(F.col("text"))).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("c")).join(known, "w", "left")
    n = c.groupBy("doc_id").agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("c"))), F.lit(0)).alias("unknown"))
    tier = F.when(F.col("unknown").between(1, 3) & (100 * F.col("unknown") <= 15 * F.col("n")), 0).when(100 * F.col("unknown") <= 30 * F.col("n"), 1).otherwise(2)
    return n.withColumn("tier", tier.cast("long"))
