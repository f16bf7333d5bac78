"""Queries of capped lists, ratios, histograms, grouped and tiered reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as rel
from .registry import Registry, Tables
from .relational import _VOCABULARY, vocabulary

query = Registry()


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders)
SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY k) AS top FROM r WHERE k <= 4 GROUP BY o_custkey""")
def capped_lists(spark, sf_dir):
    """Four best a customer, in order."""
    top = rel.top_by(Tables(spark, sf_dir).orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 4)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "o_orderkey")))
    return top.groupBy("o_custkey").agg(F.array_join(F.transform(ordered, lambda x: x["o_orderkey"].cast("string")), ",").alias("top"))


@query("SELECT p_brand, round(sum(p_retailprice * p_size) / sum(p_size), 6) AS centre, min(p_size)::BIGINT AS least, max(p_size)::BIGINT AS most FROM part GROUP BY p_brand")
def weighted_centres(spark, sf_dir):
    p = Tables(spark, sf_dir).part.groupBy("p_brand")
    return p.agg(F.round(F.try_divide(F.sum(F.col("p_retailprice") * F.col("p_size")), F.sum("p_size")), 6).alias("centre"), F.min("p_size").cast("long").alias("least"), F.max("p_size").cast("long").alias("most"))


@query("SELECT floor(n_chars / 500.0)::BIGINT AS bin, count(*) AS n FROM documents GROUP BY 1")
def score_histogram(spark, sf_dir):
    return Tables(spark, sf_dir).documents.groupBy(F.floor(F.col("n_chars") / 500).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT source, round(CASE WHEN count(l.doc_id) = 0 THEN 0 ELSE sum(quality) * 100.0 / count(l.doc_id) END, 6)::DOUBLE AS percent, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def ratio_report(spark, sf_dir):
    t = Tables(spark, sf_dir)
    j = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    share = F.coalesce(F.try_divide(F.sum("quality") * F.lit(100.0), F.count("quality")), F.lit(0.0))
    return j.groupBy("source").agg(F.round(share, 6).alias("percent"), F.count("*").alias("n"))


@query("""SELECT CASE WHEN value < 1 THEN 'small' WHEN event_type = 'error' THEN 'error' WHEN user_id % 7 = 0 THEN 'left_out' ELSE 'kept' END AS reason, count(*) AS n, min(event_id) AS sample FROM events GROUP BY 1""")
def audit_counts(spark, sf_dir):
    """Why rows are kept or not, the first reason counting, with a sample."""
    why = rel.first_class([("small", F.col("value") < 1), ("error", F.col("event_type") == "error"), ("left_out", F.col("user_id") % 7 == 0)], "kept")
    return Tables(spark, sf_dir).events.groupBy(why.alias("reason")).agg(F.count("*").alias("n"), F.min("event_id").alias("sample"))


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS first, count(*) AS n FROM events GROUP BY 1, 2)
SELECT user_id, event_type, n, row_number() OVER (PARTITION BY user_id ORDER BY first) AS place FROM f""")
def grouped_by_first(spark, sf_dir):
    """Groups in the order of their first member."""
    from pyspark.sql import Window

    g = Tables(spark, sf_dir).events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"), F.count("*").alias("n"))
    return g.select("user_id", "event_type", "n", F.row_number().over(Window.partitionBy("user_id").orderBy("first")).cast("long").alias("place"))


@query("""WITH u AS (SELECT 0 AS tier, o_custkey AS k, o_orderkey AS ord FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 1, o_custkey, o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 2, c_custkey, 0 FROM customer WHERE c_acctbal < 0)
SELECT k AS c_custkey, tier FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY tier, ord) = 1""")
def ordered_union(spark, sf_dir):
    """Keys of several lists, each in the first list that has it."""
    t = Tables(spark, sf_dir)
    lists = [t.orders.where("o_orderstatus = 'P'").select("o_custkey", "o_orderkey"), t.orders.where("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey"), t.customer.where("c_acctbal < 0").select("c_custkey", F.lit(0).cast("long"))]
    out = None
    for k, d in enumerate(lists):
        part = d.toDF("c_custkey", "ord").withColumn("tier", F.lit(k))
        out = part if out is None else out.unionAll(part)
    return rel.first_by(out, ["c_custkey"], [F.col("tier"), F.col("ord")]).select("c_custkey", "tier")


@query(f"WITH {_VOCABULARY} SELECT word, n FROM vocabulary WHERE starts_with(lower(word), 'b') ORDER BY word LIMIT 600")
def browse_letter(spark, sf_dir):
    """A page of 600 words of one letter."""
    return vocabulary(Tables(spark, sf_dir).documents).where(F.lower("word").startswith("b")).orderBy("word").limit(600)


@query("""SELECT p_type, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands, count(DISTINCT p_name) AS names FROM part GROUP BY p_type""")
def inverted_collections(spark, sf_dir):
    return Tables(spark, sf_dir).part.groupBy("p_type").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands"), F.count_distinct("p_name").alias("names"))


@query("""WITH s AS (SELECT l_partkey AS child, l_suppkey AS parent, l_returnflag AS source FROM lineitem)
SELECT child, parent, count(DISTINCT source) AS sources, string_agg(DISTINCT source, '' ORDER BY source) AS which FROM s GROUP BY 1, 2 HAVING count(DISTINCT source) >= 2""")
def source_agreement(spark, sf_dir):
    """Edges that two sources or more have."""
    e = Tables(spark, sf_dir).lineitem.groupBy(F.col("l_partkey").alias("child"), F.col("l_suppkey").alias("parent")).agg(F.collect_set("l_returnflag").alias("s"))
    return e.where(F.size("s") >= 2).select("child", "parent", F.size("s").cast("long").alias("sources"), F.array_join(F.array_sort("s"), "").alias("which"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b1[0-9]{3}\\b|[0-9]+')) AS y FROM documents)
SELECT doc_id, min(try_cast(y AS INTEGER)) FILTER (WHERE length(y) = 4)::BIGINT AS year, count(*) AS numbers FROM w GROUP BY doc_id""".replace("\\b1[0-9]{3}\\b|", ""))
def earliest_number(spark, sf_dir):
    """Least four-digit number and how many numbers a text has."""
    y = Tables(spark, sf_dir).documents.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))).alias("y"))
    return y.groupBy("doc_id").agg(F.min(F.when(F.length("y") == 4, F.col("y").try_cast("long"))).alias("year"), F.count("*").alias("numbers"))


@query("""SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)""")
def rollup_counts(spark, sf_dir):
    return Tables(spark, sf_dir).customer.rollup("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))


@query("SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48 EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 48")
def set_difference(spark, sf_dir):
    l = Tables(spark, sf_dir).lineitem.where("l_quantity > 48")  # noqa: E741
    return l.where("l_returnflag = 'R'").select("l_partkey").subtract(l.where("l_returnflag = 'A'").select("l_partkey"))
