"""Queries over the tree region <- nation <- customer <- orders and other graphs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, layout
from ..operators.components import connected_components
from .registry import Registry, Tables

query = Registry()
_NODE = lambda kind, col: F.concat(F.lit(kind), F.col(col).cast("string"))
_EDGES = """edges AS (SELECT 'o' || o_orderkey AS child, 'c' || o_custkey AS parent FROM orders
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
reach AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM edges UNION ALL SELECT r.node, e.parent, r.depth + 1 FROM reach r JOIN edges e ON e.child = r.ancestor)"""


def tree(t):
    """(child, parent) of the whole tree."""
    each = [
        t.orders.select(_NODE("o", "o_orderkey").alias("child"), _NODE("c", "o_custkey").alias("parent")),
        t.customer.select(_NODE("c", "c_custkey").alias("child"), _NODE("n", "c_nationkey").alias("parent")),
        t.nation.select(_NODE("n", "n_nationkey").alias("child"), _NODE("r", "n_regionkey").alias("parent")),
    ]
    return reduce(lambda a, b: a.unionAll(b), each)


@query(f"WITH RECURSIVE {_EDGES} SELECT node, ancestor, depth::BIGINT AS depth FROM reach")
def lineage(spark, sf_dir):
    return graph.closure(tree(Tables(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_EDGES} SELECT ancestor, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "O", count(*) FILTER (WHERE o_orderstatus = 'P') AS "P"
FROM reach JOIN orders ON node = 'o' || o_orderkey GROUP BY ancestor""")
def subtree_counts(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return graph.subtree(graph.closure(tree(t)), t.orders.select(_NODE("o", "o_orderkey").alias("node"), "o_orderstatus"), "o_orderstatus", ["F", "O", "P"])


@query(f"""WITH RECURSIVE {_EDGES}, pairs AS (SELECT 'c' || c_custkey AS a, 'c' || (c_custkey + 1) AS b FROM customer),
own AS (SELECT node, ancestor, depth FROM reach UNION ALL SELECT DISTINCT child, child, 0 FROM edges),
m AS (SELECT a, b, x.ancestor, (x.depth + y.depth)::BIGINT AS together FROM pairs JOIN own x ON x.node = a JOIN own y ON y.node = b AND y.ancestor = x.ancestor),
best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY together, ancestor) = 1)
SELECT p.a, p.b, ancestor, together FROM pairs p LEFT JOIN best USING (a, b)""")
def split_point(spark, sf_dir):
    t = Tables(spark, sf_dir)
    pairs = t.customer.select(_NODE("c", "c_custkey").alias("a"), F.concat(F.lit("c"), (F.col("c_custkey") + 1).cast("string")).alias("b"))
    return graph.nearest_common(pairs, graph.closure(tree(t)))


_BIT = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 4 WHEN 'HOUSEHOLD' THEN 8 ELSE 16 END"


@query(f"""WITH RECURSIVE {_EDGES}, b AS (SELECT 'c' || c_custkey AS node, {_BIT} AS mask FROM customer),
u AS (SELECT ancestor AS node, mask FROM reach JOIN b USING (node) UNION ALL SELECT node, mask FROM b)
SELECT node, bit_or(mask)::BIGINT AS mask FROM u GROUP BY node""")
def ancestor_mask(spark, sf_dir):
    t = Tables(spark, sf_dir)
    bits = t.customer.select(_NODE("c", "c_custkey").alias("node"), F.expr(_BIT).cast("long").alias("mask"))
    return graph.upward_mask(graph.closure(tree(t)), bits)


_FUNCTION = "(p_partkey * p_partkey + 1) % (SELECT count(*) FROM part)"


@query(f"""WITH RECURSIVE f AS (SELECT p_partkey AS child, {_FUNCTION} AS parent FROM part),
reach AS (SELECT child AS a, parent AS b FROM f UNION SELECT a, parent FROM reach JOIN f ON b = child),
loops AS (SELECT a, (SELECT min(r.b) FROM reach r WHERE r.a = x.a) AS low FROM (SELECT a FROM reach WHERE a = b) x)
SELECT child, parent FROM f JOIN loops ON a = child AND a = low""")
def cycle_break(spark, sf_dir):
    """A parent for each part, by its key's square; one edge of each cycle is cut."""
    p = Tables(spark, sf_dir).part
    n = p.count()
    return graph.break_cycles(p.select(F.col("p_partkey").alias("child"), ((F.col("p_partkey") * F.col("p_partkey") + 1) % n).alias("parent")))


@query("""SELECT p_partkey, (SELECT count(*) FROM part q WHERE q.p_partkey <> p.p_partkey AND (p.p_size - q.p_size) ** 2 + (p.p_retailprice - q.p_retailprice) ** 2 <= 2.25) AS n FROM part p""")
def grid_neighbours(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    points = p.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return graph.grid_counts(points, 1.5).select(F.col("id").alias("p_partkey"), "n")


@query("""WITH e AS (SELECT l_partkey AS child, l_suppkey AS parent, CASE l_returnflag WHEN 'R' THEN 'inh' WHEN 'A' THEN 'bor' ELSE 'der' END AS kind FROM lineitem),
u AS (SELECT child, parent, min(CASE kind WHEN 'inh' THEN 0 WHEN 'bor' THEN 1 ELSE 2 END) AS r, count(*) AS votes FROM e GROUP BY 1, 2)
SELECT child, parent, CASE r WHEN 0 THEN 'inh' WHEN 1 THEN 'bor' ELSE 'der' END AS kind, votes FROM u QUALIFY row_number() OVER (PARTITION BY child ORDER BY r, votes DESC, parent) = 1""")
def primary_parent(spark, sf_dir):
    """Edge upsert by kind, then one parent a child."""
    kind = F.when(F.col("l_returnflag") == "R", "inh").when(F.col("l_returnflag") == "A", "bor").otherwise("der")
    rank = F.when(F.col("kind") == "inh", 0).when(F.col("kind") == "bor", 1).otherwise(2)
    e = Tables(spark, sf_dir).lineitem.select(F.col("l_partkey").alias("child"), F.col("l_suppkey").alias("parent"), kind.alias("kind"))
    return graph.primary_parent(graph.edge_upsert(e, rank, [F.col("kind")]), rank, [-F.col("votes"), F.col("parent")])


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, min(l_partkey) OVER (PARTITION BY l_orderkey) AS b FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.09),
pair AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach AS (SELECT a AS node, a AS other FROM pair UNION SELECT node, b FROM reach JOIN pair ON other = a)
SELECT node, min(other) AS component FROM reach GROUP BY node""")
def order_components(spark, sf_dir):
    """Parts linked by large discounted lines of one order."""
    l = Tables(spark, sf_dir).lineitem.where("l_quantity >= 50 AND l_discount >= 0.09")  # noqa: E741
    low = l.groupBy("l_orderkey").agg(F.min("l_partkey").alias("b"))
    return connected_components(l.join(low, "l_orderkey").select(F.col("l_partkey").alias("a"), "b"))


@query("""SELECT DISTINCT least(x.l_suppkey, y.l_suppkey) AS a, greatest(x.l_suppkey, y.l_suppkey) AS b FROM lineitem x JOIN lineitem y ON x.l_partkey = y.l_partkey AND x.l_suppkey <> y.l_suppkey
WHERE x.l_returnflag = 'R' AND y.l_returnflag = 'R' AND x.l_quantity >= 49 AND y.l_quantity >= 49""")
def doublet_pairs(spark, sf_dir):
    l = Tables(spark, sf_dir).lineitem.where("l_returnflag = 'R' AND l_quantity >= 49").select("l_partkey", "l_suppkey").distinct()  # noqa: E741
    return graph.undirected(l.withColumnRenamed("l_suppkey", "a").join(l.withColumnRenamed("l_suppkey", "b"), "l_partkey"))


@query("""WITH l0 AS (SELECT l_orderkey AS child, min(l_partkey) AS parent FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
l1 AS (SELECT l_orderkey AS child, min(l_partkey) AS parent FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), l2 AS (SELECT l_orderkey AS child, min(l_partkey) AS parent FROM lineitem GROUP BY 1)
SELECT child, parent, 0 AS layer FROM l0 UNION ALL SELECT child, parent, 1 FROM l1 WHERE child NOT IN (SELECT child FROM l0)
UNION ALL SELECT child, parent, 2 FROM l2 WHERE child NOT IN (SELECT child FROM l0) AND child NOT IN (SELECT child FROM l1)""")
def layered_edges(spark, sf_dir):
    l = Tables(spark, sf_dir).lineitem  # noqa: E741
    pick = lambda d: d.groupBy(F.col("l_orderkey").alias("child")).agg(F.min("l_partkey").alias("parent"))
    return graph.layered([pick(l.where("l_returnflag = 'R'")), pick(l.where("l_returnflag = 'A'")), pick(l)])




_HEAP = "heap AS (SELECT p_partkey AS child, (p_partkey - 1) // 2 AS parent FROM part WHERE p_partkey > 0 AND p_size <> 50)"


@query(f"""WITH RECURSIVE {_HEAP}, pairs AS (SELECT DISTINCT min(l_partkey) AS a, max(l_partkey) AS b FROM lineitem GROUP BY l_orderkey),
up AS (SELECT x AS node, [x] AS path, true AS more FROM (SELECT a AS x FROM pairs UNION SELECT b FROM pairs)
  UNION ALL SELECT node, CASE WHEN parent IS NULL THEN path ELSE list_append(path, parent) END, parent IS NOT NULL FROM up LEFT JOIN heap ON child = path[-1] WHERE more AND len(path) <= 14),
line AS (SELECT node, arg_max(path, len(path)) AS path FROM up GROUP BY node),
j AS (SELECT a, b, x.path AS pa, y.path AS pb, list_filter(x.path, lambda n: list_contains(y.path, n))[1] AS via FROM pairs JOIN line x ON x.node = a JOIN line y ON y.node = b)
SELECT a, b, via, array_to_string(CASE WHEN via IS NULL THEN pa ELSE pa[: list_position(pa, via)] END, ' ') AS path_a, array_to_string(CASE WHEN via IS NULL THEN pb ELSE pb[: list_position(pb, via)] END, ' ') AS path_b FROM j""")
def fork_paths(spark, sf_dir):
    """Parts as a tree by halves of their keys, cut above one size; the first and last part of each order."""
    t = Tables(spark, sf_dir)
    heap = t.part.where("p_partkey > 0 AND p_size <> 50").selectExpr("p_partkey AS child", "(p_partkey - 1) DIV 2 AS parent")
    pairs = t.lineitem.groupBy("l_orderkey").agg(F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b"))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    return graph.fork_paths(pairs, heap).select("a", "b", "via", text("path_a"), text("path_b"))


@query("""WITH RECURSIVE l AS (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS b FROM lineitem),
e AS (SELECT a, b, count(*) AS n FROM l WHERE b IS NOT NULL AND a <> b GROUP BY a, b), w AS (SELECT a, list(b ORDER BY n DESC, b) AS ways FROM e GROUP BY a),
g AS (SELECT p_partkey AS node, [p_partkey] AS path, 0 AS hops FROM part
  UNION ALL SELECT node, list_append(path, list_filter(ways, lambda x: NOT list_contains(path, x))[1]), hops + 1 FROM g JOIN w ON a = path[-1] WHERE hops < 5 AND len(list_filter(ways, lambda x: NOT list_contains(path, x))) > 0)
SELECT node, array_to_string(arg_max(path, hops), ' ') AS path FROM g GROUP BY node""")
def grown_paths(spark, sf_dir):
    """From each part to the part that most often follows it in an order, five times, never back."""
    t = Tables(spark, sf_dir)
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    e = t.lineitem.select(F.col("l_partkey").alias("a"), after.alias("b")).where("b IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n"))
    paths = graph.grown_paths(e, t.part.select(F.col("p_partkey").alias("node")), [F.desc("n"), F.col("b")])
    return paths.select("node", F.array_join(F.col("path").cast("array<string>"), " ").alias("path"))


@query("""WITH r AS (SELECT p_brand AS title, p_type AS language, p_partkey, p_name AS gloss FROM part),
g AS (SELECT title, language, gloss, min(p_partkey) AS first FROM r GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY title, language ORDER BY first) AS k FROM g)
SELECT title, language, min(p_partkey) AS p_partkey, (SELECT string_agg(gloss, ', ' ORDER BY k) FROM k WHERE k.title = r.title AND k.language = r.language AND k <= 4) AS glosses, count(*) AS merged FROM r GROUP BY title, language""")
def merged_nodes(spark, sf_dir):
    """Parts of one brand and type as one node, with its first four names."""
    r = Tables(spark, sf_dir).part.select(F.col("p_brand").alias("title"), F.col("p_type").alias("language"), "p_partkey", F.col("p_name").alias("gloss"))
    return graph.merge_nodes(r, ["title", "language"], [F.col("p_partkey")], "gloss").select("title", "language", "p_partkey", F.array_join("glosses", ", ").alias("glosses"), "merged")


@query("SELECT DISTINCT l_partkey AS part, l_suppkey AS supplier FROM lineitem WHERE (l_partkey, l_suppkey) NOT IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N')")
def bare_nodes(spark, sf_dir):
    """Pairs of parts and suppliers that are cited but never kept."""
    l = Tables(spark, sf_dir).lineitem.select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), "l_returnflag")  # noqa: E741
    return graph.bare_nodes(l, l.where("l_returnflag = 'N'"), ["part", "supplier"])


@query(f"""WITH RECURSIVE {_EDGES}, pairs AS (SELECT 'o' || o_orderkey AS node, 'r' || o_orderkey % 5 AS ancestor FROM orders)
SELECT node, ancestor FROM pairs WHERE EXISTS (SELECT 1 FROM reach r WHERE r.node = pairs.node AND r.ancestor = pairs.ancestor)""")
def reaching_pairs(spark, sf_dir):
    """Orders that belong to the region that their key names."""
    t = Tables(spark, sf_dir)
    pairs = t.orders.select(_NODE("o", "o_orderkey").alias("node"), F.concat(F.lit("r"), F.col("o_orderkey") % 5).alias("ancestor"))
    return graph.reaches(tree(t), pairs)


@query(f"""WITH RECURSIVE {_EDGES}, seeds AS (SELECT 'o' || o_orderkey AS node FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'),
up AS (SELECT node FROM seeds UNION SELECT ancestor FROM reach JOIN seeds USING (node)) SELECT child, parent FROM edges WHERE child IN (SELECT node FROM up)""")
def kept_ancestry(spark, sf_dir):
    """What urgent pending orders hang on."""
    t = Tables(spark, sf_dir)
    return graph.keep_ancestry(tree(t), t.orders.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").select(_NODE("o", "o_orderkey").alias("node")))


_BINARY = "bin AS (SELECT p_partkey AS child, (p_partkey - 1) // 2 AS parent FROM part WHERE p_partkey > 0 AND p_size > 2)"
_ROOTS = f"""{_BINARY}, roots AS (SELECT child AS node, parent AS at_, 1 AS steps FROM bin UNION ALL SELECT node, parent, steps + 1 FROM roots JOIN bin ON child = at_),
tree AS (SELECT node, arg_max(at_, steps) AS root FROM roots GROUP BY node UNION SELECT parent, parent FROM bin WHERE parent NOT IN (SELECT child FROM bin))"""


def _binary(t):
    """Parts as a forest by halves of their keys, cut above the smallest sizes."""
    return t.part.where("p_partkey > 0 AND p_size > 2").selectExpr("p_partkey AS child", "(p_partkey - 1) DIV 2 AS parent")


@query(f"WITH RECURSIVE {_ROOTS} SELECT node, root FROM tree")
def tree_roots(spark, sf_dir):
    return graph.tree_roots(_binary(Tables(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_ROOTS}, l AS (SELECT l_partkey AS child, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS parent FROM lineitem)
SELECT least(x.root, y.root) AS a, greatest(x.root, y.root) AS b, count(*) AS weight FROM l JOIN tree x ON x.node = child JOIN tree y ON y.node = parent WHERE x.root <> y.root GROUP BY 1, 2""")
def tie_weights(spark, sf_dir):
    """How many orders lead from one tree of parts to another."""
    t = Tables(spark, sf_dir)
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    links = t.lineitem.select(F.col("l_partkey").alias("child"), after.alias("parent"))
    return graph.tie_weights(links, graph.tree_roots(_binary(t)))


@query("""SELECT l_partkey AS child FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY l_partkey HAVING bool_and(p_size % 2 = s_nationkey % 2 OR l_quantity < 40)""")
def fold_set(spark, sf_dir):
    """Parts all of whose larger lines come from nations of their own parity."""
    t = Tables(spark, sf_dir)
    j = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    own = F.col("p_size") % 2
    e = j.select(F.col("l_partkey").alias("child"), own.cast("long").alias("child_family"), F.when(F.col("l_quantity") < 40, own).otherwise(F.col("s_nationkey") % 2).cast("long").alias("parent_family"))
    return graph.fold_set(e)


@query(f"WITH RECURSIVE {_BINARY}, up AS (SELECT child AS node, parent AS at_, 1 AS depth FROM bin UNION ALL SELECT node, parent, depth + 1 FROM up JOIN bin ON child = at_ WHERE depth < 12) SELECT node, max(depth)::BIGINT AS generations FROM up GROUP BY node HAVING max(depth) >= 6")
def generations(spark, sf_dir):
    """Parts with six generations or more above them, of the twelve that are followed."""
    return graph.generations(graph.closure(_binary(Tables(spark, sf_dir))), 6)


@query(f"""WITH RECURSIVE {_BINARY}, w AS (SELECT p_partkey AS node FROM part WHERE p_partkey IN (40, 41, 42)),
up AS (SELECT child AS node, parent AS at_, 1 AS depth FROM bin UNION ALL SELECT node, parent, depth + 1 FROM up JOIN bin ON child = at_ WHERE depth < 12)
SELECT at_ AS ancestor FROM up JOIN w USING (node) GROUP BY at_ HAVING count(DISTINCT node) = (SELECT count(*) FROM w)""")
def common_ancestors(spark, sf_dir):
    """What three parts have in common above them: the words are the query's parameters."""
    t = Tables(spark, sf_dir)
    return graph.common_ancestors(graph.closure(_binary(t)), t.part.where("p_partkey IN (40, 41, 42)").select(F.col("p_partkey").alias("node")))


@query("""WITH n AS (SELECT p_partkey AS node, p_type AS language, p_name AS title FROM part), e AS (SELECT DISTINCT l_partkey AS child FROM lineitem WHERE l_quantity >= 46),
s(language, older, ord) AS (VALUES ('PROMO', 'STANDARD', 1), ('PROMO', 'ECONOMY', 2), ('LARGE', 'MEDIUM', 1), ('LARGE', 'SMALL', 2), ('MEDIUM', 'SMALL', 1))
SELECT n.node AS child, arg_min(h.node, (ord, h.node)) AS parent FROM n JOIN s USING (language) JOIN n h ON h.language = s.older AND h.title = n.title WHERE n.node NOT IN (SELECT child FROM e) AND h.node IN (SELECT child FROM e) GROUP BY n.node""")
def bridged_stages(spark, sf_dir):
    """Parts without large lines led to the same name in an older type; the types' order is the query's parameter."""
    t = Tables(spark, sf_dir)
    nodes = t.part.select(F.col("p_partkey").alias("node"), F.col("p_type").alias("language"), F.col("p_name").alias("title"))
    stages = spark.createDataFrame([("PROMO", "STANDARD", 1), ("PROMO", "ECONOMY", 2), ("LARGE", "MEDIUM", 1), ("LARGE", "SMALL", 2), ("MEDIUM", "SMALL", 1)], "language string, older string, ord int")
    return graph.bridge(nodes, t.lineitem.where("l_quantity >= 46").select(F.col("l_partkey").alias("child")), stages)


_STAGE = "CASE WHEN p_size % 3 = 0 THEN 'Proto-' || p_type ELSE p_type END"


@query(f"""WITH RECURSIVE {_BINARY}, up AS (SELECT child AS node, parent AS at_, 1 AS depth FROM bin UNION ALL SELECT node, parent, depth + 1 FROM up JOIN bin ON child = at_ WHERE depth < 12),
l AS (SELECT p_partkey AS at_, {_STAGE} AS language FROM part), f AS (SELECT node, arg_min(language, (depth, at_)) AS donor FROM up JOIN l USING (at_) WHERE language NOT IN ('SMALL', 'LARGE', 'MEDIUM') GROUP BY node)
SELECT node, CASE WHEN NOT starts_with(donor, 'Proto-') THEN donor END AS donor FROM f""")
def donors(spark, sf_dir):
    """The type of the nearest part above that isn't one of the sizes' own; none if a reconstruction comes before."""
    t = Tables(spark, sf_dir)
    languages = t.part.select(F.col("p_partkey").alias("node"), F.expr(_STAGE.replace("'Proto-' || p_type", "concat('Proto-', p_type)")).alias("language"))
    return graph.donor(graph.closure(_binary(t)), languages, ["SMALL", "LARGE", "MEDIUM"])


_KIND = "CASE left(child, 1) WHEN 'o' THEN 'of' WHEN 'c' THEN 'from' ELSE 'in' END"


@query(f"""WITH RECURSIVE {_EDGES}, line AS (SELECT ancestor AS child, depth FROM reach WHERE node = 'o7' UNION ALL SELECT 'o7', 0)
SELECT line.child, depth::BIGINT AS depth, parent || ' ' || {_KIND.replace("child", "line.child")} AS parents FROM line LEFT JOIN edges USING (child)""")
def lineage_rows(spark, sf_dir):
    """The ancestry of one order with its parents: the order is the query's parameter."""
    edges = tree(Tables(spark, sf_dir)).withColumn("kind", F.expr(_KIND))
    rows = graph.lineage_rows(graph.closure(edges), edges, "o7")
    return rows.select("child", "depth", F.array_join(F.transform("parents", lambda p: F.concat_ws(" ", p["parent"], p["kind"])), ", ").alias("parents"))


@query(f"""WITH RECURSIVE {_EDGES}, k AS (SELECT child FROM edges WHERE parent = 'n3' ORDER BY child LIMIT 60)
SELECT ancestor AS node, 'ancestor' AS role, depth::BIGINT AS depth FROM reach WHERE node = 'n3' UNION ALL SELECT child, 'child', -1 FROM k
UNION ALL SELECT child, 'grandchild', -2 FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY child) AS n FROM edges WHERE parent IN (SELECT child FROM k)) WHERE n <= 20""")
def focus(spark, sf_dir):
    """What is shown around one nation: the numbers shown are the feature."""
    return graph.focus(tree(Tables(spark, sf_dir)), "n3")


@query("""WITH RECURSIVE a AS (SELECT p_partkey AS child, (p_partkey - 1) // 2 AS parent FROM part WHERE p_partkey > 0 AND p_size > 2), b AS (SELECT p_partkey AS child, (p_partkey - 1) // 2 AS parent FROM part WHERE p_partkey > 0 AND p_size > 3),
ua AS (SELECT child AS node, parent AS up, 1 AS depth FROM a UNION ALL SELECT node, parent, depth + 1 FROM ua JOIN a ON child = up WHERE depth < 12), ub AS (SELECT child AS node, parent AS up, 1 AS depth FROM b UNION ALL SELECT node, parent, depth + 1 FROM ub JOIN b ON child = up WHERE depth < 12),
o AS (SELECT node, max(depth) AS o FROM ua GROUP BY 1), n AS (SELECT node, max(depth) AS n FROM ub GROUP BY 1)
SELECT count(*) AS nodes, count(*) FILTER (WHERE coalesce(n, 0) >= o) AS kept, count(*) FILTER (WHERE coalesce(n, 0) >= o) / count(*) AS share, count(*) FILTER (WHERE coalesce(n, 0) >= o) / count(*) >= 0.97 AS enough FROM o LEFT JOIN n USING (node)""")
def depth_report(spark, sf_dir):
    """Whether a forest cut at one more size is still as deep."""
    t = Tables(spark, sf_dir)
    fewer = t.part.where("p_partkey > 0 AND p_size > 3").selectExpr("p_partkey AS child", "(p_partkey - 1) DIV 2 AS parent")
    return graph.depth_report(graph.closure(_binary(t)), graph.closure(fewer))


@query("""WITH RECURSIVE b AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 0 AND p_size > 2 THEN (p_partkey - 1) // 2 END AS parent, -ln(2400 - least((800 + (p_partkey * 37) % 1300)::DOUBLE, 2000.0::DOUBLE)) AS t FROM part),
up AS (SELECT node, node AS at_ FROM b WHERE node NOT IN (SELECT parent FROM b WHERE parent IS NOT NULL) UNION ALL SELECT up.node, parent FROM up JOIN b ON b.node = at_ WHERE parent IS NOT NULL),
l AS (SELECT at_ AS node, count(*) AS leaves FROM up GROUP BY 1),
s AS (SELECT b.*, leaves, coalesce(sum(leaves) OVER (PARTITION BY parent ORDER BY leaves DESC, b.node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b JOIN l USING (node)),
p AS (
  SELECT node AS tree, node, leaves, t AS begun, 0.0::DOUBLE AS start, 2 * pi() AS width, 0.0::DOUBLE AS radius FROM s WHERE parent IS NULL
  UNION ALL SELECT p.tree, s.node, s.leaves, begun, start + width * before::DOUBLE / p.leaves, width * s.leaves / p.leaves, greatest(radius + 0.02::DOUBLE, s.t - begun) FROM p JOIN s ON s.parent = p.node),
r AS (SELECT tree, greatest(max(radius), 1e-6) AS rim, max(leaves) AS leaves, count(*) AS n FROM p GROUP BY tree),
z AS (SELECT tree, greatest(leaves / (2 * pi()) / rim, 3.5, 0.8 * sqrt(n) / rim) AS scale FROM r)
SELECT tree, node, round(radius * scale * cos(start + width / 2), 6) + 0.0 AS x, round(radius * scale * sin(start + width / 2), 6) + 0.0 AS y FROM p JOIN z USING (tree)""")
def radial_layout(spark, sf_dir):
    """The forest of parts laid out by years, a tree around each root."""
    t = Tables(spark, sf_dir)
    roots = graph.tree_roots(_binary(t))
    p = t.part.select(F.col("p_partkey").alias("node"), F.when((F.col("p_partkey") > 0) & (F.col("p_size") > 2), F.expr("(p_partkey - 1) DIV 2")).alias("parent"), (800 + F.col("p_partkey") * 37 % 1300).alias("year"))
    nodes = p.join(roots.hint("merge"), "node", "left").select(F.coalesce("root", "node").alias("tree"), "node", "parent", "year")
    return layout.radial(nodes).select("tree", "node", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


@query(f"""WITH RECURSIVE {_EDGES}, b AS (SELECT 'c' || c_custkey AS node, {_BIT} AS mask FROM customer),
u AS (SELECT ancestor AS node, mask FROM reach JOIN b USING (node) UNION ALL SELECT node, mask FROM b UNION ALL SELECT 'o' || o_orderkey, 0 FROM orders), m AS (SELECT node, bit_or(mask) AS mask FROM u GROUP BY node)
SELECT node FROM m WHERE mask = 0 OR (mask & 20) <> 0""")
def shown_nodes(spark, sf_dir):
    """Nodes that show while the segments 1, 2 and 8 are hidden; orders have none."""
    t = Tables(spark, sf_dir)
    bits = t.customer.select(_NODE("c", "c_custkey").alias("node"), F.expr(_BIT).cast("long").alias("mask"))
    none = t.orders.select(_NODE("o", "o_orderkey").alias("node"), F.lit(0).cast("long").alias("mask"))
    masks = graph.upward_mask(graph.closure(tree(t)), bits).unionByName(none)
    return masks.where(graph.shown(F.col("mask"), F.lit(11).cast("long"))).select("node")
