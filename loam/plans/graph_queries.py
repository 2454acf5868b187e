"""Queries of the graph, retrieval and integrity operators; orders, events and vectors stand for flows and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loam.operators import checks as C, graph as G, retrieval as M
from loam.sources.tables import table


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Supplier to part, as a flow of steps whose numbers overlap."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))


_EDGES = "e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey <> l_partkey)"


def flow_joints(spark: SparkSession, d: str) -> DataFrame:
    return G.joints(_edges(spark, d))


FLOW_JOINTS = f"WITH {_EDGES} SELECT * FROM (SELECT dst AS node, 'converge' AS role, count(*) AS n FROM e GROUP BY 1 UNION ALL SELECT src, 'branch', count(*) FROM e GROUP BY 1) WHERE n >= 2"


def flow_roots(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("node"))
    edges = table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), (F.col("o_custkey") + F.col("o_orderkey") % 2).alias("dst"))
    return G.roots(customers, edges)


FLOW_ROOTS = "SELECT c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT o_custkey + o_orderkey % 2 FROM orders)"


def dangling_refs(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "part").where("p_size < 40").select(F.col("p_partkey").alias("node"))
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("src"), (F.col("l_partkey") + 1).alias("dst"))
    return G.dangling(edges, nodes)


DANGLING_REFS = """
WITH n AS (SELECT p_partkey AS node FROM part WHERE p_size < 40), e AS (SELECT l_orderkey AS holder, l_partkey AS src, l_partkey + 1 AS dst FROM lineitem)
SELECT ref, field, holder FROM (SELECT src AS ref, 'src' AS field, holder FROM e UNION ALL SELECT dst, 'dst', holder FROM e) WHERE ref NOT IN (SELECT node FROM n)
"""


def orphan_links(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "events").select(F.col("user_id").alias("group"), F.col("event_id").alias("step"), (F.col("event_id") % 3 == 0).alias("has_predecessor"), (F.col("event_type") == "signup").alias("is_root"))
    return G.link_orphans(steps).select("group", "src", "dst")


ORPHAN_LINKS = """
SELECT "group", src, dst FROM (SELECT user_id AS "group", lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS src, event_id AS dst, event_type FROM events)
WHERE dst % 3 <> 0 AND event_type <> 'signup' AND src IS NOT NULL
"""


def spliced_flow(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), (F.col("o_orderkey") + 1 + F.col("o_custkey") % 3).alias("dst"))
    present = table(spark, d, "orders").where("o_orderkey % 4 <> 1").select(F.col("o_orderkey").alias("node"))
    return G.splice(edges, present)


SPLICED_FLOW = """
WITH RECURSIVE e AS (SELECT o_orderkey AS src, o_orderkey + 1 + o_custkey % 3 AS dst FROM orders), p AS (SELECT o_orderkey AS node FROM orders WHERE o_orderkey % 4 <> 1),
w(src, dst) AS (SELECT src, dst FROM e WHERE src IN (SELECT node FROM p) UNION SELECT w.src, e.dst FROM w JOIN e ON e.src = w.dst WHERE w.dst NOT IN (SELECT node FROM p))
SELECT DISTINCT src, dst FROM w WHERE dst IN (SELECT node FROM p) AND src <> dst
"""


def flow_reach(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "customer").select(F.col("c_custkey").alias("src"), (F.col("c_custkey") + F.col("c_nationkey") + 1).alias("dst"))
    return G.reachable(edges, edges.select(F.col("src").alias("node")), 5)


FLOW_REACH = """
WITH RECURSIVE e AS (SELECT c_custkey AS src, c_custkey + c_nationkey + 1 AS dst FROM customer),
w(start, node, depth) AS (SELECT c_custkey, c_custkey, 0 FROM customer UNION ALL SELECT w.start, e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 5)
SELECT start, node, min(depth) AS depth FROM w GROUP BY 1, 2
"""


def flipped_edges(spark: SparkSession, d: str) -> DataFrame:
    kinds = table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("kind"))
    edges = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("src"), (F.col("o_custkey") + 1).alias("dst"), F.lit("uses").alias("verb"))
    rules = spark.createDataFrame([("uses", "BUILDING", "MACHINERY"), ("uses", "AUTOMOBILE", "BUILDING")], "verb string, src_kind string, dst_kind string")
    return G.flipped(edges, kinds, rules)


FLIPPED_EDGES = """
WITH t AS (SELECT o_orderkey AS id, o_custkey AS src, o_custkey + 1 AS dst, a.c_mktsegment AS sk, b.c_mktsegment AS dk FROM orders
  LEFT JOIN customer a ON a.c_custkey = o_custkey LEFT JOIN customer b ON b.c_custkey = o_custkey + 1),
f AS (SELECT *, coalesce((dk, sk) IN (('BUILDING', 'MACHINERY'), ('AUTOMOBILE', 'BUILDING')) AND (sk, dk) NOT IN (('BUILDING', 'MACHINERY'), ('AUTOMOBILE', 'BUILDING')), false) AS turn FROM t)
SELECT id, CASE WHEN turn THEN dst ELSE src END AS src, CASE WHEN turn THEN src ELSE dst END AS dst, 'uses' AS verb, turn AS was_flipped FROM f
"""


def line_sections(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("first"), F.col("l_suppkey").alias("last"), F.col("l_returnflag").alias("kind"))
    return G.section_ranges(raw)


LINE_SECTIONS = """
WITH r AS (SELECT l_orderkey AS doc, least(l_partkey, l_suppkey) AS first, greatest(l_partkey, l_suppkey) AS last, l_returnflag AS kind FROM lineitem),
c AS (SELECT doc, greatest(first, coalesce(max(last) OVER (PARTITION BY doc ORDER BY first, last, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, first)) AS first, last, kind FROM r)
SELECT doc, first, last, kind FROM c WHERE first <= last
"""


def lexical_top(spark: SparkSession, d: str) -> DataFrame:
    """For every document the five catalogue items with the best token overlap, each for the top of its list."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("item"), "text")
    best = M.best_by_tokens(docs, items, 5)
    return best.select("id", "item", F.round("score", 9).alias("score"), "rank")


LEXICAL_TOP = """
WITH a AS (SELECT doc_id AS id, unnest(t) AS w, len(t) AS na FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS t FROM documents)),
b AS (SELECT item_id AS item, unnest(t) AS w, len(t) AS nb FROM (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS t FROM benchmark)),
s AS (SELECT id, item, count(*) / (any_value(na) + any_value(nb) - count(*))::DOUBLE AS score FROM a JOIN b USING (w) GROUP BY 1, 2)
SELECT id, item, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, item)::INT AS rank FROM s) WHERE rank <= 5
"""


def verbatim_matches(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    found = M.contained(docs, table(spark, d, "benchmark").select(F.col("item_id").alias("item"), "text"))
    return found.select("id", "item").distinct()


VERBATIM_MATCHES = r"""
WITH d AS (SELECT doc_id, trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM documents), b AS (SELECT item_id, trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM benchmark)
SELECT DISTINCT doc_id AS id, item_id AS item FROM d, b WHERE b.t <> '' AND contains(d.t, b.t)
"""


def semantic_top(spark: SparkSession, d: str) -> DataFrame:
    """Every vector's three closest label centres; a centre is the mean of its label's vectors."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    parts = v.select("label", F.posexplode("vector").alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("x"))
    centres = parts.groupBy(F.col("label").alias("item")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p.x).alias("vector"))
    return M.nearest_centres(v, centres, 3).select("id", "item", F.round("score", 6).alias("score"), "rank")


SEMANTIC_TOP = """
WITH c AS (SELECT label, list(x ORDER BY k) AS c FROM (SELECT label, k, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT vec_id AS id, c.label AS item, list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), c) AS score FROM embeddings, c)
SELECT id, item, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, item)::INT AS rank FROM s) WHERE rank <= 3
"""


def shared_parts(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of suppliers of one nation that share two parts or more, grouped by the nation: clusters by overlap."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    sold = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_partkey").distinct().join(s, "s_suppkey")
    other = sold.select(F.col("s_suppkey").alias("other"), "s_nationkey", "l_partkey")
    pairs = sold.join(other, ["s_nationkey", "l_partkey"]).where("s_suppkey < other").groupBy("s_nationkey", "s_suppkey", "other").count().where("count >= 2")
    return pairs.groupBy("s_nationkey").agg(F.count("*").alias("n_pairs"), F.max("count").alias("most_shared"))


SHARED_PARTS = """
WITH s AS (SELECT DISTINCT s_nationkey, s_suppkey, l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
p AS (SELECT a.s_nationkey, a.s_suppkey, b.s_suppkey AS other, count(*) AS n FROM s a JOIN s b ON a.s_nationkey = b.s_nationkey AND a.l_partkey = b.l_partkey AND a.s_suppkey < b.s_suppkey GROUP BY 1, 2, 3 HAVING count(*) >= 2)
SELECT s_nationkey, count(*) AS n_pairs, max(n) AS most_shared FROM p GROUP BY 1
"""


def order_checks(spark: SparkSession, d: str) -> DataFrame:
    """Correction records over orders: missing fields, roles, duplicates and dangling references, by rule."""
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderpriority")).alias("name"), F.col("o_orderstatus").alias("role"), F.col("o_custkey").alias("ref"),
    )
    again = o.unionByName(o.where("id % 101 = 0"))
    known = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return C.summary(C.required(o, ["name"]).unionByName(C.vocabulary(o, "role", ["F", "O"])).unionByName(C.unique(again)).unionByName(C.resolvable(o, "ref", known)))


ORDER_CHECKS = """
SELECT rule, severity, count(*) AS n, bool_or(severity = 'hard_fail') AS fails FROM (
  SELECT 'required:name' AS rule, 'hard_fail' AS severity FROM orders WHERE o_orderkey % 17 = 0 UNION ALL
  SELECT 'vocabulary:role', 'auto_fix' FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL
  SELECT 'unique:id', 'hard_fail' FROM orders WHERE o_orderkey % 101 = 0 UNION ALL
  SELECT 'dangling:ref', 'warn' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) GROUP BY 1, 2
"""

QUERIES = {f.__name__: (f, sql) for f, sql in (
    (flow_joints, FLOW_JOINTS), (flow_roots, FLOW_ROOTS), (dangling_refs, DANGLING_REFS), (orphan_links, ORPHAN_LINKS), (spliced_flow, SPLICED_FLOW), (flow_reach, FLOW_REACH),
    (flipped_edges, FLIPPED_EDGES), (line_sections, LINE_SECTIONS), (lexical_top, LEXICAL_TOP), (verbatim_matches, VERBATIM_MATCHES), (semantic_top, SEMANTIC_TOP),
    (shared_parts, SHARED_PARTS), (order_checks, ORDER_CHECKS),
)}
