"""Queries of lookups, gaps, picks and merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import relational as rel
from .registry import Registry, Tables

query = Registry()
ALL = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_LINE = ", ".join(LINE)


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ALL))
def table_counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return reduce(lambda a, b: a.unionAll(b), (getattr(t, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ALL))


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_partkey LIMIT 200")
def filter_kind_distinct(spark, sf_dir):
    """The first 200 keys are the report."""
    return Tables(spark, sf_dir).lineitem.where("l_returnflag = 'R'").select("l_partkey").distinct().orderBy("l_partkey").limit(200)


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def gap_missing_relation(spark, sf_dir):
    t = Tables(spark, sf_dir)
    urgent = t.orders.where("o_orderpriority = '1-URGENT'")
    return rel.missing_relation(t.customer, urgent, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name")


@query("SELECT doc_id FROM documents d WHERE coalesce((SELECT max(quality)::VARCHAR FROM labels l WHERE l.doc_id = d.doc_id), '') = ''")
def gap_missing_scalar(spark, sf_dir):
    t = Tables(spark, sf_dir)
    quality = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return t.documents.select("doc_id").join(quality, "doc_id", "left").where(rel.blank(F.col("quality"))).select("doc_id")


@query("""SELECT DISTINCT p_partkey FROM part WHERE p_brand = 'Brand#2' AND NOT EXISTS (
  SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1999-01-01')""")
def gap_driven_by_filter(spark, sf_dir):
    t = Tables(spark, sf_dir)
    returned = t.lineitem.where("l_returnflag = 'R' AND l_shipdate >= TIMESTAMP_NTZ '1998-01-01' AND l_shipdate < TIMESTAMP_NTZ '1999-01-01'")
    return rel.missing_relation(t.part.where("p_brand = 'Brand#2'"), returned, F.col("l_partkey") == F.col("p_partkey")).select("p_partkey").distinct()


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P'")
def inner_hash_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.orders.where("o_orderstatus = 'P'").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "c_mktsegment")


@query("""WITH o AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS u, max(o_totalprice) AS most FROM orders GROUP BY o_custkey),
s AS (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey),
j AS (SELECT c_custkey, coalesce(f, 0) = 0 AS a, coalesce(u, 0) = 0 AS b, c_acctbal < 0 AS c, coalesce(n, 0) < 3 AS d, coalesce(most, 0) > 400000 AS e
  FROM customer LEFT JOIN o ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN s ON s_nationkey = n_nationkey)
SELECT c_custkey, (3 * a::INT + 2 * b::INT + 2 * c::INT + d::INT - 3 * e::INT)::BIGINT AS score,
  concat_ws(',', CASE WHEN a THEN 'none_filled' END, CASE WHEN b THEN 'none_urgent' END, CASE WHEN c THEN 'in_debt' END, CASE WHEN d THEN 'few_suppliers' END, CASE WHEN e THEN 'large_order' END) AS fired FROM j""")
def left_multiway_signals(spark, sf_dir):
    t = Tables(spark, sf_dir)
    of = t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("u"), F.max("o_totalprice").alias("most"))
    near = t.supplier.groupBy("s_nationkey").agg(F.count("*").alias("n"))
    j = t.customer.join(of, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(near, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rules = [("none_filled", 3, zero("f") == 0), ("none_urgent", 2, zero("u") == 0), ("in_debt", 2, F.col("c_acctbal") < 0), ("few_suppliers", 1, zero("n") < 3), ("large_order", -3, zero("most") > 400000)]
    return rel.signals(j, rules).select("c_custkey", "score", "fired")


_WORD = "[A-Za-z]+"


def vocabulary(docs):
    """(word, n) of all ASCII words of docs."""
    return docs.select(F.explode(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


_VOCABULARY = f"vocabulary AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_WORD}')) AS word FROM documents) GROUP BY word)"
_PROBES = f"probes AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_WORD}')) AS word FROM benchmark)"


@query(f"""WITH {_VOCABULARY}, {_PROBES}, folded AS (SELECT lower(word) AS f, sum(n)::BIGINT AS n FROM vocabulary GROUP BY 1)
SELECT p.word, lower(p.word[1:2]) AS shard, v.n AS exact, f.n AS folded, coalesce(v.n, f.n) AS n
FROM probes p LEFT JOIN vocabulary v ON v.word = p.word LEFT JOIN folded f ON f.f = lower(p.word)""")
def partitionwise_fallback_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = rel.exact_else_folded(vocabulary(t.benchmark).select("word"), vocabulary(t.documents), "n")
    return found.select("word", F.lower(F.substring("word", 1, 2)).alias("shard"), "exact", "folded", "n")


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size < 10) GROUP BY l_returnflag")
def semi_exists(spark, sf_dir):
    t = Tables(spark, sf_dir)
    kept = t.lineitem.join(t.part.where("p_size < 10"), F.col("p_partkey") == F.col("l_partkey"), "left_semi")
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS target, count(*) AS n FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') GROUP BY 1")
def anti_dangling(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return rel.dangling(t.lineitem, "l_orderkey", t.orders.where("o_orderstatus = 'F'"), "o_orderkey")


@query(f"""WITH {_VOCABULARY}, {_PROBES}, u AS (SELECT lower(word) AS folded, min(word) AS spelling FROM vocabulary GROUP BY 1 HAVING count(*) = 1)
SELECT p.word, spelling FROM probes p JOIN u ON folded = lower(p.word)""")
def case_insensitive_unique(spark, sf_dir):
    t = Tables(spark, sf_dir)
    one = rel.unique_fold(vocabulary(t.documents)).withColumnRenamed("word", "spelling")
    return vocabulary(t.benchmark).join(one, F.col("folded") == F.lower("word")).select("word", "spelling")


@query(f"""WITH e AS (SELECT DISTINCT l_returnflag AS kind, l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {_LINE}) AS b FROM lineitem)
SELECT kind, a, b FROM e WHERE b IS NOT NULL AND a <> b AND NOT EXISTS (SELECT 1 FROM e r WHERE r.kind = e.kind AND r.a = e.b AND r.b = e.a)""")
def symmetrize(spark, sf_dir):
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", *LINE))
    e = Tables(spark, sf_dir).lineitem.select(F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("a"), after.alias("b")).where("b IS NOT NULL AND a <> b").distinct()
    return rel.one_way(e, ["kind"])


@query(f"SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, {_LINE}) = 1")
def relation_cleanup(spark, sf_dir):
    return rel.first_by(Tables(spark, sf_dir).lineitem, ["l_orderkey", "l_partkey"], [F.col(c) for c in ("l_linenumber", *LINE)]).select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def first_row_per_group(spark, sf_dir):
    return rel.first_by(Tables(spark, sf_dir).events, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type", "value")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def argmax_first_wins(spark, sf_dir):
    return rel.first_by(Tables(spark, sf_dir).orders, ["o_custkey"], [-F.col("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT user_id, event_type, votes FROM (SELECT user_id, event_type, count(DISTINCT ts::DATE) AS votes FROM events GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) = 1""")
def majority_vote(spark, sf_dir):
    e = Tables(spark, sf_dir).events.withColumn("day", F.col("ts").cast("date"))
    return rel.majority(e, ["user_id"], "event_type", ["day"])


@query("""SELECT l_orderkey, min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END)::BIGINT AS rank,
  arg_min(l_returnflag, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) AS kind FROM lineitem GROUP BY l_orderkey""")
def kind_precedence(spark, sf_dir):
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2).cast("long")
    return Tables(spark, sf_dir).lineitem.groupBy("l_orderkey").agg(F.min(rank).alias("rank"), F.min_by("l_returnflag", rank).alias("kind"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name), p_name, p_partkey) AS up, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT p_brand, p_partkey, p_name FROM r WHERE n <= 60 OR up <= 44 OR up > n - 16""")
def two_sided_trim(spark, sf_dir):
    p = Tables(spark, sf_dir).part.withColumn("_length", F.length("p_name"))
    return rel.trimmed(p, ["p_brand"], ["_length", "p_name", "p_partkey"]).select("p_brand", "p_partkey", "p_name")


@query(f"""WITH s AS (SELECT l_orderkey, string_agg(l_returnflag, '' ORDER BY l_linenumber, {_LINE}) AS signature FROM lineitem GROUP BY l_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY l_orderkey) AS k FROM s)
SELECT signature, count(*) AS n, string_agg(l_orderkey::VARCHAR, ',' ORDER BY l_orderkey) FILTER (WHERE k <= 8) AS samples FROM r GROUP BY signature""")
def signature_groups(spark, sf_dir):
    """Eight samples a group are the report."""
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", *[c for c in LINE if c != "l_linenumber"])))
    s = Tables(spark, sf_dir).lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(ordered, lambda x: x["l_returnflag"]), "").alias("signature"))
    counts = s.groupBy("signature").agg(F.count("*").alias("n"))
    first = rel.top_by(s, ["signature"], [F.col("l_orderkey")], 8).groupBy("signature").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_orderkey")), lambda x: x.cast("string")), ",").alias("samples"))
    return counts.join(first, "signature")


_STATUS = [("toxic", "toxic = 1"), ("rejected", "quality = 0"), ("accepted", "quality = 1"), ("too_short", "n_chars < 100")]


@query(f"""WITH l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id)
SELECT CASE {" ".join(f"WHEN {t} THEN '{n}'" for n, t in _STATUS)} ELSE 'to_do' END AS status, count(*) AS n FROM documents LEFT JOIN l USING (doc_id) GROUP BY 1""")
def ledger_status(spark, sf_dir):
    t = Tables(spark, sf_dir)
    label = t.labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    status = rel.first_class([(n, F.expr(x)) for n, x in _STATUS], "to_do")
    return t.documents.select("doc_id", "n_chars").join(label, "doc_id", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(r"""SELECT (length(text) - length(replace(text, '%', '')) < 20 AND length(text) >= 100)::INT AS predicted, quality, count(*) AS n, sum((quality = (length(text) - length(replace(text, '%', '')) < 20 AND length(text) >= 100)::INT)::INT)::BIGINT AS agree
FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2""")
def agreement_matrix(spark, sf_dir):
    t = Tables(spark, sf_dir)
    plain = (F.length("text") - F.length(F.replace("text", F.lit("%"), F.lit(""))) < 20) & (F.length("text") >= 100)
    j = t.documents.select("doc_id", plain.cast("int").alias("predicted")).join(t.labels, "doc_id")
    return j.groupBy("predicted", "quality").agg(F.count("*").alias("n"), F.sum((F.col("quality") == F.col("predicted")).cast("long")).alias("agree"))


@query("""WITH r AS (SELECT *, lag(event_type) OVER w AS was, lead(1) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, event_type FROM r WHERE was IS DISTINCT FROM event_type OR after IS NULL""")
def rle_collapse(spark, sf_dir):
    return rel.run_starts(Tables(spark, sf_dir).events, ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@query("""SELECT user_id, event_id, CASE WHEN count(value) OVER w >= 4 THEN round(avg(value) OVER w, 6) END AS mean FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def moving_average(spark, sf_dir):
    return rel.last_mean(Tables(spark, sf_dir).events, ["user_id"], ["ts", "event_id"], "value").select("user_id", "event_id", F.round("mean", 6).alias("mean"))


@query("""SELECT band, min(n_chars) AS least, max(n_chars) AS most, count(*) AS n FROM (SELECT n_chars, ((row_number() OVER (ORDER BY n_chars, doc_id)) - 1) // 400 AS band FROM documents) GROUP BY band""")
def bands(spark, sf_dir):
    d = Tables(spark, sf_dir).documents.select("doc_id", "n_chars")
    return rel.bands(d, [F.col("n_chars"), F.col("doc_id")], 400).groupBy("band").agg(F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.count("*").alias("n"))


@query("SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rank FROM documents) WHERE rank <= CASE source WHEN 'src0' THEN 300 ELSE 40 END")
def author_cap(spark, sf_dir):
    """The caps are the feature: so many of each source, src0 being favoured."""
    d = Tables(spark, sf_dir).documents.select("source", "doc_id", "n_chars")
    r = rel.top_by(d, ["source"], [F.col("n_chars"), F.col("doc_id")], 300)
    return r.where((F.col("rank") <= 40) | (F.col("source") == "src0")).select("source", "doc_id", F.col("rank").cast("long").alias("rank"))


@query("""SELECT CASE WHEN regexp_full_match(p_name[1:2], '[A-Za-z]{2}') THEN lower(p_name[1:2]) ELSE '__other' END AS shard, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1""")
def shard_partition(spark, sf_dir):
    from ..functions.scalar import shard_key

    return Tables(spark, sf_dir).part.groupBy(shard_key(F.col("p_name")).alias("shard")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


@query("""WITH a AS (SELECT user_id, event_type, event_id, value, (props->>'k')::INT AS k, event_id % 2 AS side FROM events)
SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value, max(k)::BIGINT AS k FROM a GROUP BY ALL""".replace(" GROUP BY ALL", " GROUP BY user_id, event_type"))
def lww_merge(spark, sf_dir):
    e = Tables(spark, sf_dir).events.select("user_id", "event_type", "event_id", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))
    # two devices, each with its own latest state, then the merge of both
    sides = [rel.latest(e.where(F.col("event_id") % 2 == s), ["user_id", "event_type"], [F.col("event_id")], ["k"]) for s in (0, 1)]
    return rel.latest(sides[0].unionByName(sides[1]), ["user_id", "event_type"], [F.col("event_id")], ["k"])


@query("""WITH b AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 3 = 0), m AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 3 = 1), t AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 3 = 2)
SELECT * FROM (SELECT * FROM b INTERSECT SELECT * FROM m INTERSECT SELECT * FROM t) UNION SELECT * FROM ((SELECT * FROM m UNION SELECT * FROM t) EXCEPT SELECT * FROM b)""")
def three_way_lists(spark, sf_dir):
    """Events dealt in three stand for the base and the two edited lists."""
    e = Tables(spark, sf_dir).events
    return rel.three_way(*(e.where(F.col("event_id") % 3 == k) for k in range(3)), ["user_id", "event_type"])


@query("SELECT l_orderkey, l_linenumber, o_orderdate::DATE::VARCHAR AS ordered, l_shipdate::DATE::VARCHAR AS shipped FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE NOT (o_orderdate <= l_shipdate + INTERVAL 150 DAY AND l_shipdate <= o_orderdate + INTERVAL 90 DAY)")
def backward_edge_filter(spark, sf_dir):
    """Edges that run backwards in time by more than they may."""
    t = Tables(spark, sf_dir)
    ok = (F.col("o_orderdate") <= F.col("l_shipdate") + F.expr("INTERVAL 150 DAY")) & (F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("INTERVAL 90 DAY"))
    j = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).where(~ok)
    return j.select("l_orderkey", "l_linenumber", F.col("o_orderdate").cast("date").cast("string").alias("ordered"), F.col("l_shipdate").cast("date").cast("string").alias("shipped"))


@query("""SELECT event_type, (props->>'k')::BIGINT % 10 AS digit, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS k FROM events GROUP BY 1, 2""")
def json_props(spark, sf_dir):
    e = Tables(spark, sf_dir).events.select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return e.groupBy("event_type", (F.col("k") % 10).alias("digit")).agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@query(r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang,
  len(regexp_extract_all(html, '<a href="[^"]*"'))::BIGINT AS n_links, len(regexp_extract_all(html, '<p>'))::BIGINT AS n_p FROM pages""")
def html_fields(spark, sf_dir):
    count = lambda p: F.coalesce(F.regexp_count("html", F.lit(p)), F.lit(0)).cast("long")
    return Tables(spark, sf_dir).pages.select(
        "page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("lang"), count('<a href="[^"]*"').alias("n_links"), count("<p>").alias("n_p")
    )


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 0 EXCEPT SELECT doc_id FROM labels".replace(" WHERE doc_id % 2 = 0", ""))
def append_missing(spark, sf_dir):
    """What a resumable job has still to do."""
    t = Tables(spark, sf_dir)
    return t.documents.select("doc_id").distinct().join(t.labels, "doc_id", "left_anti")


@query("""SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)""")
def cube_counts(spark, sf_dir):
    return Tables(spark, sf_dir).orders.cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, user_id, event_id FROM (SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_quantity >= 49) l
JOIN (SELECT user_id, event_id FROM events WHERE value >= 30) e ON e.user_id = l.l_suppkey""")
def filtered_equi_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    l, e = t.lineitem.where("l_quantity >= 49"), t.events.where("value >= 30")  # noqa: E741
    return l.join(e, F.col("user_id") == F.col("l_suppkey")).select("l_orderkey", "l_linenumber", "user_id", "event_id")
