"""Queries over usage series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as rel
from ..operators import series as ser
from .registry import Registry, Tables

query = Registry()
_QUARTER = "(year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) - 1"
_HALF = "(year(l_shipdate) - 1995) * 2 + (quarter(l_shipdate) - 1) // 2"


def _quarters(t):
    at = ((F.year("o_orderdate") - 1995) * 4 + F.quarter("o_orderdate") - 1).cast("int")
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return ser.dense(j, ["c_mktsegment"], at, 27)


def _halves(t):
    at = ((F.year("l_shipdate") - 1995) * 2 + F.floor((F.quarter("l_shipdate") - 1) / 2)).cast("int")
    return ser.dense(t.lineitem, ["l_partkey"], at, 14)


_SEGMENTS = f"""c AS (SELECT c_mktsegment, {_QUARTER} AS bucket, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
dense AS (SELECT s.c_mktsegment, b.bucket, coalesce(n, 0) AS n FROM (SELECT DISTINCT c_mktsegment FROM c) s CROSS JOIN (SELECT unnest(range(27)) AS bucket) b
  LEFT JOIN c ON c.c_mktsegment = s.c_mktsegment AND c.bucket = b.bucket),
pct AS (SELECT c_mktsegment, bucket, floor(100 * n / max(n) OVER (PARTITION BY c_mktsegment) + 0.5)::BIGINT AS percent FROM dense)"""


@query(f"WITH {_SEGMENTS} SELECT c_mktsegment, bucket, percent FROM pct")
def usage_buckets(spark, sf_dir):
    s = _quarters(Tables(spark, sf_dir)).withColumn("series", ser.percent_of_peak(F.col("series")))
    return s.select("c_mktsegment", F.posexplode("series").alias("bucket", "percent")).withColumn("bucket", F.col("bucket").cast("long"))


@query(f"""WITH {_SEGMENTS}, f AS (SELECT *, CASE WHEN c_mktsegment < 'C' THEN 40 ELSE length(c_mktsegment) END AS first FROM pct),
k AS (SELECT *, max(CASE WHEN bucket >= first THEN percent ELSE 0 END) OVER (PARTITION BY c_mktsegment) AS rest FROM f)
SELECT c_mktsegment, bucket, CASE WHEN bucket < first AND rest > 0 THEN 0 ELSE percent END::BIGINT AS percent FROM k""")
def usage_floor(spark, sf_dir):
    """The floor is the length of the name, or, for names before C, behind all buckets."""
    first = F.when(F.col("c_mktsegment") < "C", 40).otherwise(F.length("c_mktsegment"))
    s = _quarters(Tables(spark, sf_dir)).withColumn("series", ser.percent_of_peak(F.col("series"))).withColumn("first", first)
    s = s.withColumn("series", ser.floored(F.col("series"), F.col("first")))
    return s.select("c_mktsegment", F.posexplode("series").alias("bucket", "percent")).withColumn("bucket", F.col("bucket").cast("long"))


_PARTS = f"""c AS (SELECT l_partkey, {_HALF} AS bucket, count(*) AS n FROM lineitem GROUP BY 1, 2),
dense AS (SELECT p.l_partkey, b.bucket, coalesce(n, 0) AS n FROM (SELECT DISTINCT l_partkey FROM c) p CROSS JOIN (SELECT unnest(range(14)) AS bucket) b
  LEFT JOIN c ON c.l_partkey = p.l_partkey AND c.bucket = b.bucket)"""


@query(f"""WITH {_PARTS},
pct AS (SELECT l_partkey, bucket, floor(100 * n / max(n) OVER (PARTITION BY l_partkey) + 0.5)::BIGINT AS percent FROM dense),
s AS (SELECT l_partkey, min(bucket) FILTER (WHERE percent = 100)::BIGINT AS peak, round(max(percent) - sum(percent) / 14, 6)::DOUBLE AS distinctiveness FROM pct GROUP BY l_partkey)
SELECT peak, l_partkey, p_name, distinctiveness, row_number() OVER (PARTITION BY peak ORDER BY distinctiveness DESC, length(p_name), p_name, l_partkey) AS rank FROM s JOIN part ON p_partkey = l_partkey
QUALIFY rank <= 100""")
def era_peak_topk(spark, sf_dir):
    """The flagship: the hundred parts most of each half-year, the report's size."""
    t = Tables(spark, sf_dir)
    s = _halves(t).withColumn("series", ser.percent_of_peak(F.col("series")))
    s = s.select("l_partkey", ser.peak(F.col("series")).alias("peak"), F.round(ser.distinctiveness(F.col("series")), 6).alias("distinctiveness"))
    j = s.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    top = rel.top_by(j, ["peak"], [F.desc("distinctiveness"), F.length("p_name"), F.col("p_name"), F.col("l_partkey")], 100)
    return top.select("peak", "l_partkey", "p_name", "distinctiveness", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_PARTS},
s AS (SELECT l_partkey, sum(n * bucket)::BIGINT::DOUBLE / sum(n)::BIGINT AS centroid, count(*) FILTER (WHERE n > 0) AS nz FROM dense GROUP BY l_partkey),
q AS (SELECT l_partkey, p_type, round(2 * (17 - centroid) + 1.6::DOUBLE * (14 - length(p_name)) + 1.2::DOUBLE * (18 - nz), 6) AS score FROM s JOIN part ON p_partkey = l_partkey WHERE centroid BETWEEN 5 AND 8),
r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY score DESC, l_partkey) AS k FROM q)
SELECT l_partkey, p_type, score FROM r WHERE k <= CASE p_type WHEN 'ECONOMY' THEN 30 WHEN 'PROMO' THEN 20 ELSE 1000000000 END ORDER BY score DESC, l_partkey LIMIT 400""")
def centroid_quota_pool(spark, sf_dir):
    """A pool of 400 with quotas by type."""
    t = Tables(spark, sf_dir)
    c = _halves(t).select("l_partkey", ser.centroid(F.col("series")).alias("centroid"), ser.non_zero(F.col("series")).alias("nz")).where("centroid BETWEEN 5 AND 8")
    score = F.round(2 * (17 - F.col("centroid")) + F.lit(1.6) * (14 - F.length("p_name")) + F.lit(1.2) * (18 - F.col("nz")), 6)
    j = c.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select("l_partkey", "p_type", score.alias("score"))
    return rel.quota(j, "p_type", {"ECONOMY": 30, "PROMO": 20}, [F.desc("score"), F.col("l_partkey")], 400)
