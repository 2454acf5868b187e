"""Queries of flows: overlaps, outcomes, inversions, rollups, removals, routing, components, paths and undo."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from loam.operators import components as P, graph as G, retrieval as M
from loam.plans import feedback_queries
from loam.sources.shared import saved
from loam.sources.tables import table


def overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("group"), F.col("turn").alias("id"), "text")
    found = M.overlapping(turns, 0.1)
    return found.select(F.col("group").alias("conv_id"), "id", "other", F.round("score", 9).alias("score"))


OVERLAP_PAIRS = """
WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS t FROM conversations),
p AS (SELECT a.conv_id, a.turn AS id, b.turn AS other, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE AS score FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn < b.turn WHERE len(a.t) > 0 AND len(b.t) > 0)
SELECT conv_id, id, other, round(score, 9) AS score FROM p WHERE score >= 0.1
"""


def proposal_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of each proposed id: kept, redirected to an active one, revoked for nothing, deprecated, or made up."""
    c = table(spark, d, "customer")
    state = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", "revoked").when(F.col("c_mktsegment") == "MACHINERY", "deprecated").otherwise("active").alias("state"))
    proposed = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") + F.when(F.col("o_orderkey") % 50 == 0, F.lit(10_000_000)).otherwise(F.lit(0))).alias("id"))
    target = state.select((F.col("id") - 1).alias("id"), F.col("id").alias("to_id"), F.col("state").alias("to_state"))
    told = proposed.join(state, "id", "left").join(target, "id", "left")
    active = F.col("to_state") == "active"
    outcome = F.when(F.col("state").isNull(), "dropped_hallucinated").when(F.col("state") == "active", "kept_active").when(F.col("state") == "deprecated", "dropped_deprecated").when(active, "redirected").otherwise("dropped_revoked_no_redirect")
    return told.select("o_orderkey", outcome.alias("outcome"), F.when(F.col("state") == "active", F.col("id")).when((F.col("state") == "revoked") & active, F.col("to_id")).otherwise(F.lit(-1)).cast("long").alias("final_id"))


PROPOSAL_OUTCOMES = """
WITH s AS (SELECT c_custkey AS id, CASE c_mktsegment WHEN 'BUILDING' THEN 'revoked' WHEN 'MACHINERY' THEN 'deprecated' ELSE 'active' END AS state FROM customer),
p AS (SELECT o_orderkey, o_custkey + CASE WHEN o_orderkey % 50 = 0 THEN 10000000 ELSE 0 END AS id FROM orders)
SELECT o_orderkey, CASE WHEN s.state IS NULL THEN 'dropped_hallucinated' WHEN s.state = 'active' THEN 'kept_active' WHEN s.state = 'deprecated' THEN 'dropped_deprecated' WHEN t.state = 'active' THEN 'redirected' ELSE 'dropped_revoked_no_redirect' END AS outcome,
  CASE WHEN s.state = 'active' THEN p.id WHEN s.state = 'revoked' AND t.state = 'active' THEN t.id ELSE -1 END AS final_id FROM p LEFT JOIN s ON s.id = p.id LEFT JOIN s t ON t.id = p.id + 1
"""


def sequence_inversion(spark: SparkSession, d: str) -> DataFrame:
    """Predecessors turned into successors, distinct and in order, per order."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("seq"), F.array_distinct(F.array(F.col("l_linenumber") - 1, F.col("l_linenumber") - 2, (F.col("l_partkey") % 7).cast("int"))).alias("before"))
    back = lines.select("o", "seq", F.explode("before").alias("p")).where("p <> seq")
    known = lines.select("o", F.col("seq").alias("p")).distinct()
    return back.join(known, ["o", "p"]).groupBy("o", "p").agg(F.array_join(F.array_sort(F.collect_set("seq")).cast("array<string>"), ",").alias("after")).select(F.col("o").alias("l_orderkey"), F.col("p").alias("l_linenumber"), "after")


SEQUENCE_INVERSION = """
WITH b AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS s, unnest([l_linenumber - 1, l_linenumber - 2, l_partkey % 7]) AS p FROM lineitem)
SELECT o AS l_orderkey, p::INT AS l_linenumber, string_agg(DISTINCT s::VARCHAR, ',' ORDER BY s::VARCHAR) AS after FROM b WHERE p <> s AND (o, p) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem) GROUP BY 1, 2
"""


def actor_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Relationships rolled up: per customer nation (actor) the distinct parts used, suppliers aimed at, and orders."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey")
    used = saved(line.join(o.join(c, "c_custkey"), "o_orderkey").select("c_nationkey", "l_partkey", "l_suppkey", "o_orderkey"), "actor-lines")
    # each is made distinct alone: together, a task would hold three rows a line
    names = {"uses": "l_partkey", "targets": "l_suppkey", "procedures": "o_orderkey"}
    each = [used.select("c_nationkey", F.col(c).alias("x")).distinct().groupBy("c_nationkey").agg(F.count("x").alias("n")).withColumn("what", F.lit(what)) for what, c in names.items()]
    return reduce(DataFrame.unionByName, each).groupBy("c_nationkey").agg(*[F.max(F.when(F.col("what") == what, F.col("n"))).alias(what) for what in names])


ACTOR_ROLLUP = """
SELECT c_nationkey, count(DISTINCT l_partkey) AS uses, count(DISTINCT l_suppkey) AS targets, count(DISTINCT o_orderkey) AS procedures FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1
"""


def analyst_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges less those the analyst removed by key, and with those added that are not there yet; unnamed ends stay. One grouping by key settles all three."""
    edges = table(spark, d, "lineitem").select(F.lower(F.concat_ws("|", F.coalesce("l_returnflag", F.lit("")), F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string"))).alias("key"))
    removed = table(spark, d, "supplier").select(F.lower(F.concat_ws("|", F.lit("A"), F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string"))).alias("key"))
    added = table(spark, d, "supplier").select(F.lower(F.concat_ws("|", F.lit("Z"), F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string"))).alias("key"))
    said = [df.select("key", *[F.lit(k == n).alias(n) for n in ("edge", "removed", "added")]) for df, k in ((edges, "edge"), (removed, "removed"), (added, "added"))]
    of = reduce(DataFrame.unionByName, said).groupBy("key").agg(*[F.max(n).alias(n) for n in ("edge", "removed", "added")])
    origin = F.when(F.col("edge") & ~F.col("removed"), "derived").when(~F.col("edge") & F.col("added"), "analyst")
    return of.select("key", origin.alias("origin")).where("origin is not null")


ANALYST_EDGES = """
WITH e AS (SELECT DISTINCT lower(l_returnflag) || '|' || l_suppkey || '|' || l_partkey AS key FROM lineitem)
SELECT key, 'derived' AS origin FROM e WHERE key NOT IN (SELECT 'a|' || s_suppkey || '|' || s_nationkey FROM supplier) UNION ALL
SELECT DISTINCT 'z|' || s_suppkey || '|' || s_nationkey, 'analyst' FROM supplier WHERE 'z|' || s_suppkey || '|' || s_nationkey NOT IN (SELECT key FROM e)
"""


def outcome_diff(spark: SparkSession, d: str) -> DataFrame:
    """Recommendations against what was submitted: silence approves; where the source was rejected the rest is moot."""
    e = table(spark, d, "events")
    said = e.where("event_id % 2 = 0").select("event_id", F.when(F.col("value") > 30, "remove").otherwise("approve").alias("did"))
    rejected = e.groupBy("user_id").agg(F.bool_or((F.col("event_type") == "error") & (F.col("value") > 45)).alias("rejected"))
    told = e.select("event_id", "user_id", F.when(F.col("event_type") == "click", "remove").otherwise("approve").alias("advised")).join(said, "event_id", "left").join(rejected, "user_id")
    did = F.coalesce("did", F.lit("approve"))
    result = F.when(F.col("rejected"), "moot").when(did == F.col("advised"), "agreed").otherwise("overridden")
    return told.groupBy(result.alias("result"), "advised").agg(F.count("*").alias("n"))


OUTCOME_DIFF = """
WITH r AS (SELECT user_id, bool_or(event_type = 'error' AND value > 45) AS rejected FROM events GROUP BY 1),
t AS (SELECT rejected, CASE event_type WHEN 'click' THEN 'remove' ELSE 'approve' END AS advised, CASE WHEN event_id % 2 = 0 AND value > 30 THEN 'remove' ELSE 'approve' END AS did FROM events JOIN r USING (user_id))
SELECT CASE WHEN rejected THEN 'moot' WHEN did = advised THEN 'agreed' ELSE 'overridden' END AS result, advised, count(*) AS n FROM t GROUP BY 1, 2
"""


def example_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Corrections by key: how often, the first reason given, the terms united."""
    e = table(spark, d, "events").withColumn("key", F.substring(F.sha2(F.concat_ws("|", F.lower("event_type"), (F.col("user_id") % 20).cast("string")), 256), 1, 24))
    reason = F.when(F.col("event_id") % 5 == 0, F.col("props"))
    return e.groupBy("key").agg(F.count("*").alias("n"), F.coalesce(F.min(F.when(reason.isNotNull(), F.col("event_id"))), F.lit(-1)).cast("long").alias("reason_at"), F.size(F.collect_set("user_id")).alias("n_terms"))


EXAMPLE_UPSERT = """
SELECT substr(sha256(lower(event_type) || '|' || user_id % 20), 1, 24) AS key, count(*) AS n, coalesce(min(event_id) FILTER (event_id % 5 = 0 AND props IS NOT NULL), -1) AS reason_at, count(DISTINCT user_id)::INT AS n_terms FROM events GROUP BY 1
"""


def surfacing_scores(spark: SparkSession, d: str) -> DataFrame:
    """Summary of the rules shown: how many were a hit, a miss or unscored, and how often they were shown."""
    found = feedback_queries.surfacing_outcomes(spark, d)
    return found.groupBy("outcome").agg(F.count("*").alias("patterns"), F.sum("n").alias("shown"))


SURFACING_SCORES = f"SELECT outcome, count(*) AS patterns, sum(n)::BIGINT AS shown FROM ({feedback_queries.SURFACING_OUTCOMES}) GROUP BY 1"


def undo_preview(spark: SparkSession, d: str) -> DataFrame:
    """Before a report (order) is undone: parts that it alone describes, shared ones, and the catalogue's own."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    reports = line.groupBy("l_partkey").agg(F.count("*").alias("n"))
    ours = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") > 10).alias("ours"))
    told = line.join(reports, "l_partkey").join(ours, "l_partkey", "left").withColumn("ours", F.coalesce("ours", F.lit(False)))
    return told.groupBy("l_orderkey").agg(F.count_if(F.col("ours") & (F.col("n") == 1)).alias("owned"), F.count_if(F.col("ours") & (F.col("n") > 1)).alias("shared"), F.count_if(~F.col("ours")).alias("catalogue"))


UNDO_PREVIEW = """
WITH l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), r AS (SELECT l_partkey, count(*) AS n FROM l GROUP BY 1)
SELECT l_orderkey, count(*) FILTER (p_size > 10 AND n = 1) AS owned, count(*) FILTER (p_size > 10 AND n > 1) AS shared, count(*) FILTER (NOT coalesce(p_size > 10, false)) AS catalogue FROM l JOIN r USING (l_partkey) LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1
"""


def write_counts(spark: SparkSession, d: str) -> DataFrame:
    """Edges to write by verb: how many have both ends, how many are dropped for a missing one."""
    nodes = table(spark, d, "part").where("p_size <= 45").select("p_partkey", F.lit(True).alias("there"))
    edges = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.when(F.col("l_returnflag") == "R", "IMPLEMENTS").otherwise("USES").alias("verb"))
    told = edges.join(nodes, "p_partkey", "left")
    return told.groupBy("verb").agg(F.count("there").alias("written"), F.count_if(F.col("there").isNull()).alias("dropped"))


WRITE_COUNTS = """
SELECT CASE l_returnflag WHEN 'R' THEN 'IMPLEMENTS' ELSE 'USES' END AS verb, count(p_partkey) AS written, count(*) FILTER (p_partkey IS NULL) AS dropped FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 45) ON p_partkey = l_partkey GROUP BY 1
"""


def _follows(spark: SparkSession, d: str) -> DataFrame:
    """Each customer after the one that its balance points at: small trees and chains."""
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1 + F.col("c_nationkey")).alias("b"))


def flow_components(spark: SparkSession, d: str) -> DataFrame:
    return P.connected_components(_follows(spark, d))


FLOW_COMPONENTS = """
WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey + 1 + c_nationkey AS b FROM customer), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, t) AS (SELECT a, a FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.t)
SELECT node, min(t) AS component FROM r GROUP BY 1
"""


def flow_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Nations in a cycle of trade: orders of a nation's customers filled by another nation's suppliers, the largest flow."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    o = table(spark, d, "orders").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "c_nationkey")
    flow = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(o, "l_orderkey").join(s, "l_suppkey").where("s_nationkey <> c_nationkey").groupBy("s_nationkey", "c_nationkey").count()
    best = flow.groupBy(F.col("s_nationkey").alias("src")).agg(F.max_by("c_nationkey", F.struct("count", "c_nationkey")).alias("dst"))
    return G.cyclic(best)


def _cycle_sql(step: int = 26) -> str:
    return f"""
WITH RECURSIVE f AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2),
b AS (SELECT src, arg_max(dst, n * 100 + dst) AS dst FROM f GROUP BY 1), w(s, t, k) AS (SELECT src, dst, 1 FROM b UNION ALL SELECT w.s, b.dst, k + 1 FROM w JOIN b ON b.src = w.t WHERE k < {step})
SELECT DISTINCT s AS node FROM w WHERE s = t
"""


def short_paths(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "nation").select(F.col("n_nationkey").alias("src"), (F.col("n_regionkey") + 100).alias("dst"))
    edges = edges.unionByName(table(spark, d, "supplier").select((F.col("s_suppkey") + 1000).cast("int").alias("src"), F.col("s_nationkey").alias("dst")))
    pairs = table(spark, d, "supplier").select((F.col("s_suppkey") + 1000).cast("int").alias("src"), F.lit(102).alias("dst"))
    return G.shortest_paths(edges, pairs, 4).select("src", "dst", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


SHORT_PATHS = """
SELECT (s_suppkey + 1000)::INT AS src, 102 AS dst, (s_suppkey + 1000) || '>' || s_nationkey || '>102' AS path FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 2
"""


def shared_segments(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that two roots or more reach, with how many do and the least depth."""
    edges = table(spark, d, "customer").select(F.col("c_custkey").alias("src"), (F.col("c_custkey") + F.col("c_nationkey") + 1).alias("dst"))
    return G.reachable(edges, edges.select(F.col("src").alias("node")), 4).groupBy("node").agg(F.count("*").alias("n_roots"), F.min("depth").alias("depth")).where("n_roots >= 2")


SHARED_SEGMENTS = """
WITH RECURSIVE e AS (SELECT c_custkey AS src, c_custkey + c_nationkey + 1 AS dst FROM customer),
w(start, node, depth) AS (SELECT c_custkey, c_custkey, 0 FROM customer UNION ALL SELECT w.start, e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 4)
SELECT node, count(DISTINCT start) AS n_roots, min(depth) AS depth FROM w GROUP BY 1 HAVING count(DISTINCT start) >= 2
"""


def tactic_order(spark: SparkSession, d: str) -> DataFrame:
    """Steps of a user that go back in a fixed order of stages: signup, view, click, purchase, error."""
    order = F.array(*map(F.lit, ["signup", "view", "click", "purchase", "error"]))
    from pyspark.sql import Window

    e = table(spark, d, "events").select("user_id", "event_id", F.array_position(order, F.col("event_type")).alias("rank"))
    before = F.lag("rank").over(Window.partitionBy("user_id").orderBy("event_id"))
    return e.withColumn("before", before).where("rank <= 2 and rank < before").groupBy("user_id").agg(F.count("*").alias("warnings"))


TACTIC_ORDER = """
WITH e AS (SELECT user_id, event_id, list_position(['signup', 'view', 'click', 'purchase', 'error'], event_type) AS rank FROM events)
SELECT user_id, count(*) AS warnings FROM (SELECT *, lag(rank) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM e) WHERE rank <= 2 AND rank < before GROUP BY 1
"""


def gate_modes(spark: SparkSession, d: str) -> DataFrame:
    """Settings of a source over the defaults: each gate's mode, unknown modes read as review."""
    defaults = F.create_map(*[F.lit(x) for x in ("entities", "review", "chunks", "review", "drafts", "assist", "bundle", "review")])
    own = F.create_map(F.when(F.col("event_id") % 2 == 0, F.lit("chunks")).otherwise(F.lit("bundle")), F.when(F.col("user_id") % 3 == 0, F.lit("auto")).otherwise(F.lit("maybe")))
    mode = lambda gate: F.coalesce(F.try_element_at(own, F.lit(gate)), F.element_at(defaults, gate))
    known = lambda m: F.when(m.isin("review", "assist", "auto"), m).otherwise("review")
    return table(spark, d, "events").select("event_id", *[known(mode(g)).alias(g) for g in ("entities", "chunks", "drafts", "bundle")])


GATE_MODES = """
SELECT event_id, 'review' AS entities, CASE WHEN event_id % 2 = 0 AND user_id % 3 = 0 THEN 'auto' ELSE 'review' END AS chunks, 'assist' AS drafts, CASE WHEN event_id % 2 = 1 AND user_id % 3 = 0 THEN 'auto' ELSE 'review' END AS bundle FROM events
"""

QUERIES = {f.__name__: (f, sql) for f, sql in (
    (overlap_pairs, OVERLAP_PAIRS), (proposal_outcomes, PROPOSAL_OUTCOMES), (sequence_inversion, SEQUENCE_INVERSION), (actor_rollup, ACTOR_ROLLUP), (analyst_edges, ANALYST_EDGES), (outcome_diff, OUTCOME_DIFF),
    (example_upsert, EXAMPLE_UPSERT), (surfacing_scores, SURFACING_SCORES), (undo_preview, UNDO_PREVIEW), (write_counts, WRITE_COUNTS), (flow_components, FLOW_COMPONENTS), (flow_cycles, _cycle_sql()),
    (short_paths, SHORT_PATHS), (shared_segments, SHARED_SEGMENTS), (tactic_order, TACTIC_ORDER), (gate_modes, GATE_MODES),
)}
