"""Queries of what follows review: orders stand for drafts and chunks, lines for picks, customers for sources and entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loam.functions import values as V
from loam.functions.text import short_hash
from loam.operators import brands, chunks as K, drafts as D, feedback as B, picks as P, relationships as R
from loam.plans.bundle_queries import objects
from loam.sources import store as S
from loam.sources.tables import table

_TEXTS = "array<string>"


def _text(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def artifact_observables(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts of chunks that are entities of their source; an entity is known by its value and by the analyst's edit of it."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    values = F.create_map(F.lit("priority"), F.array("o_orderpriority", F.lower("o_orderpriority"), F.lit(None)), F.lit("status"), F.array(F.concat(F.lit(" "), "o_orderstatus")))
    found = o.select(F.col("o_custkey").alias("source_id"), k.alias("chunk_id"), values.alias("artifacts"))
    entities = o.select(
        F.col("o_custkey").alias("source_id"), k.alias("entity_id"), k.alias("position"), F.when(k % 2 == 0, F.col("o_orderpriority")).otherwise(F.col("o_orderstatus")).alias("value"), F.when(k % 6 == 0, F.lower("o_orderstatus")).when(k % 7 == 0, "").alias("edited_value"),
        F.when(k % 3 == 0, "ioc_ip").when(k % 3 == 1, "software").otherwise("malware").alias("entity_type"), F.when(k % 11 == 0, "campaign").alias("edited_type"), F.when(k % 5 == 0, "remove").when(k % 5 == 1, "approve").alias("gate_action"), F.when(k % 13 != 0, _text("o-", "o_orderkey")).alias("stix_id"),
    )
    return R.observable_links(found, entities)


ARTIFACT_OBSERVABLES = """
WITH e AS (SELECT o_custkey AS s, o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END AS v, CASE WHEN o_orderkey % 6 = 0 THEN o_orderstatus END AS ed FROM orders
  WHERE o_orderkey % 5 > 0 AND o_orderkey % 13 > 0 AND o_orderkey % 3 < 2 AND o_orderkey % 11 > 0),
n AS (SELECT s, k, 0 AS c, lower(trim(ed)) AS v FROM e WHERE ed IS NOT NULL UNION ALL SELECT s, k, 1, lower(trim(v)) FROM e), w AS (SELECT s, v, arg_min(k, (k, c)) AS k FROM n WHERE v <> '' GROUP BY 1, 2)
SELECT DISTINCT o_custkey AS source_id, o_orderkey AS chunk_id, 'priority' AS category, 'o-' || w.k AS stix_id FROM orders JOIN w ON s = o_custkey AND v = lower(trim(o_orderpriority))
UNION ALL SELECT DISTINCT o_custkey, o_orderkey, 'status', 'o-' || w.k FROM orders JOIN w ON s = o_custkey AND v = lower(trim(o_orderstatus))
"""


def candidate_union(spark: SparkSession, d: str) -> DataFrame:
    """Active techniques that retrieval, proposals or brands name, and by how many of the three."""
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("technique_id"), "l_linenumber", "l_suppkey", "l_returnflag")
    size = F.col("p_size")
    found = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("technique_id"), F.col("p_name").alias("name"), F.when(size % 3 != 0, size % 7 == 0).alias("revoked"), (size % 5 == 0).alias("deprecated"))
    proposed = lines.where("l_linenumber = 2").select(F.when(F.col("l_suppkey") % 3 != 0, F.col("technique_id")).alias("final_id"))
    return P.candidates(lines.where("l_linenumber = 1"), proposed, lines.where("l_returnflag = 'R'"), found)


CANDIDATE_UNION = """
WITH n AS (SELECT l_partkey AS t, 'a' AS b FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT l_partkey, 'b' FROM lineitem WHERE l_linenumber = 2 AND l_suppkey % 3 <> 0 UNION ALL SELECT l_partkey, 'c' FROM lineitem WHERE l_returnflag = 'R')
SELECT t::VARCHAR AS technique_id, any_value(p_name) AS name, count(DISTINCT b) AS n_sources FROM n JOIN part ON p_partkey = t WHERE p_size % 5 <> 0 AND (p_size % 3 = 0 OR p_size % 7 <> 0) GROUP BY 1
"""


def best_picks(spark: SparkSession, d: str) -> DataFrame:
    """One pick per chunk and technique: bucket, then confidence, then place decide."""
    flag = F.col("l_returnflag")
    picks = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("position"), (F.col("l_suppkey") % 3).alias("technique_id"),
        F.when(flag == "A", "possible").when(flag == "N", "definite").alias("confidence_bucket"), F.when(F.col("l_discount") > 0, F.col("l_discount") * 10).alias("confidence"),
    )
    return P.best_of_chunk(picks)


BEST_PICKS = """
WITH p AS (SELECT l_orderkey AS chunk_id, l_linenumber AS position, l_suppkey % 3 AS technique_id, CASE l_returnflag WHEN 'A' THEN 'possible' WHEN 'N' THEN 'definite' END AS confidence_bucket, CASE WHEN l_discount > 0 THEN l_discount * 10 END AS confidence FROM lineitem)
SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY chunk_id, technique_id ORDER BY CASE confidence_bucket WHEN 'possible' THEN 1 WHEN 'definite' THEN 3 ELSE 2 END DESC, coalesce(confidence, 0.5) DESC, position) = 1
"""


def unanswered_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that no pick names."""
    return P.unanswered(table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id")), table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("chunk_id")))


UNANSWERED_CHUNKS = "SELECT DISTINCT o_orderkey AS chunk_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"


def technique_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Drafts whose chunk's text was overridden before get the techniques told then, and their phases are made anew."""
    o = table(spark, d, "orders")
    technique = lambda t, tactic: F.array(F.struct(t.alias("technique_id"), tactic.alias("tactic")))
    drafts = o.select(F.col("o_orderkey").alias("draft_id"), F.col("o_orderkey").alias("chunk_id"), technique(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus"))).alias("techniques"))
    texts = o.where("o_orderkey % 10 <> 0").select(F.col("o_orderkey").alias("chunk_id"), F.concat(F.lit("  "), F.upper("o_orderpriority")).alias("text"))
    told = o.where("o_orderpriority like '1%' or o_orderpriority like '3%'").groupBy("o_orderpriority").agg(F.min("o_orderkey").cast("string").alias("t"))
    found = P.overridden(drafts, texts, told.select(short_hash(F.col("o_orderpriority")).alias("text_hash"), technique(F.col("t"), F.lit("told")).alias("techniques")))
    return found.select("draft_id", F.get("techniques", F.lit(0))["technique_id"].alias("technique_id"), F.array_join("phases", ",").alias("phases"), "was_overridden")


TECHNIQUE_OVERRIDES = """
WITH t AS (SELECT o_orderpriority AS p, min(o_orderkey) AS t FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '3%' GROUP BY 1)
SELECT o_orderkey AS draft_id, coalesce(t, o_orderkey)::VARCHAR AS technique_id, CASE WHEN t IS NOT NULL THEN 'told' WHEN o_orderkey % 3 <> 0 THEN o_orderstatus ELSE '' END AS phases, t IS NOT NULL AS was_overridden FROM orders LEFT JOIN t ON p = o_orderpriority AND o_orderkey % 10 <> 0
"""


def entity_edits(spark: SparkSession, d: str) -> DataFrame:
    """Entities after the analyst's edits, roles going to organisations or places by the type that holds then, and added ones."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    c, null = table(spark, d, "customer"), F.lit(None).cast("string")
    entities = c.select(
        k.alias("entity_id"), F.col("c_name").alias("value"), F.when(n < 8, "organization").when(n < 16, "location").otherwise("malware").alias("entity_type"), F.when(k % 4 == 0, "remove").alias("gate_action"),
        null.alias("edited_value"), F.when(k % 5 == 0, "location").when(k % 5 == 1, "").alias("edited_type"), F.when(n % 2 == 0, "old").alias("organization_role"), F.when(n % 3 == 0, "old").alias("location_role"),
    )
    reviews = c.where("c_custkey % 3 = 0").select(k.alias("entity_id"), F.when(k % 2 == 0, "edit").alias("action"), F.when(k % 6 == 0, "").otherwise(F.lower("c_name")).alias("edited_value"), F.when(k % 9 == 0, "organization").alias("edited_type"), F.when(k % 12 == 0, "").otherwise(F.lower("c_mktsegment")).alias("role"))
    added = table(spark, d, "supplier").select((-F.col("s_suppkey")).alias("entity_id"), F.col("s_name").alias("value"), F.lit("tool").alias("entity_type"))
    return D.entity_edits(entities, reviews, added)


ENTITY_EDITS = """
WITH e AS (SELECT c_custkey AS k, *, CASE WHEN c_nationkey < 8 THEN 'organization' WHEN c_nationkey < 16 THEN 'location' ELSE 'malware' END AS t, c_custkey % 3 = 0 AS r, CASE WHEN c_custkey % 9 = 0 THEN 'organization' WHEN c_custkey % 5 = 0 THEN 'location' WHEN c_custkey % 5 = 1 THEN '' END AS et,
  CASE WHEN c_custkey % 3 = 0 AND c_custkey % 12 <> 0 THEN lower(c_mktsegment) END AS role FROM customer), f AS (SELECT *, coalesce(nullif(et, ''), t) AS kind FROM e)
SELECT k AS entity_id, c_name AS value, t AS entity_type, CASE WHEN r AND k % 2 = 0 THEN 'edit' WHEN k % 4 = 0 THEN 'remove' ELSE 'approve' END AS gate_action, CASE WHEN r AND k % 6 <> 0 THEN lower(c_name) END AS edited_value, et AS edited_type,
  CASE WHEN kind = 'organization' AND role IS NOT NULL THEN role WHEN c_nationkey % 2 = 0 THEN 'old' END AS organization_role, CASE WHEN kind = 'location' AND role IS NOT NULL THEN role WHEN c_nationkey % 3 = 0 THEN 'old' END AS location_role, FALSE AS analyst_added FROM f
UNION ALL SELECT -s_suppkey, s_name, 'tool', 'approve', NULL, NULL, NULL, NULL, TRUE FROM supplier
"""


def rule_indicators(spark: SparkSession, d: str) -> DataFrame:
    """An indicator per detection rule, named by a hash of its content."""
    rules = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.col("lang").alias("rule_type"), F.col("text").alias("rule_content"), F.col("source").alias("description"))
    return D.indicators(rules, F.lit("identity--1"))


RULE_INDICATORS = "SELECT doc_id AS source_id, 'indicator--' || substr(sha256(concat_ws('|', lang, text)), 1, 12) AS id, 'indicator' AS type, concat_ws(' ', lang, 'rule') AS name, source AS description, text AS pattern, lang AS pattern_type, 'identity--1' AS created_by_ref FROM documents"


def missing_extensions(spark: SparkSession, d: str) -> DataFrame:
    """Definitions of extensions that a bundle's objects need and that it lacks."""
    return D.extension_objects(objects(spark, d))


MISSING_EXTENSIONS = """
SELECT c_custkey AS bundle, 'extension-definition--fb9c968a-745b-4ade-9b25-c324172197f4' AS id, 'extension-definition' AS type FROM customer
UNION ALL SELECT DISTINCT o_custkey, 'extension-definition--b422519e-c47a-439d-9195-0f16b94fa889', 'extension-definition' FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE coalesce(c_nationkey >= 20, TRUE)
"""


def boundary_feedback(spark: SparkSession, d: str) -> DataFrame:
    """Chunks rejected for their boundaries, with their text where it is there still."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    corrections = o.select(F.col("o_custkey").alias("source_id"), k.alias("chunk_id"), F.when(k % 4 == 0, "approve").otherwise("reject").alias("action"), F.when(k % 3 == 0, "bad_boundary").when(k % 3 == 1, "other").alias("reason"), F.col("o_orderstatus").alias("rationale"))
    return D.rerun_feedback(corrections, o.where("o_orderkey % 5 <> 0").select(F.col("o_custkey").alias("source_id"), k.alias("chunk_id"), F.col("o_orderpriority").alias("text")))


BOUNDARY_FEEDBACK = "SELECT o_custkey AS source_id, o_orderkey AS chunk_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS text, o_orderstatus AS rationale FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 3 = 0"


def unattended_advice(spark: SparkSession, d: str) -> DataFrame:
    """What a reviewer's advice does by itself: a number for its tier, and removals unless they would leave no technique."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    lines = table(spark, d, "lineitem")
    drafts = lines.groupBy(F.col("l_orderkey").alias("draft_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("technique_id")))).alias("techniques"))
    advice = o.select(k.alias("draft_id"), F.lit("edit").alias("action"), F.when(k % 4 == 0, "high").when(k % 4 == 1, "medium").when(k % 4 == 2, "low").otherwise("sure").alias("confidence"), F.when(k % 5 != 0, F.array(F.lit("R"), F.lit("A"))).alias("remove_technique_ids"))
    found = D.reviewer_submission(advice, drafts)
    return found.select("draft_id", "action", "confidence", F.array_join(F.transform("techniques", lambda t: F.concat(t.n.cast("string"), t.technique_id)), " ").alias("techniques"))


UNATTENDED_ADVICE = """
WITH l AS (SELECT *, l_orderkey % 5 <> 0 AND l_returnflag IN ('R', 'A') AS gone FROM lineitem), t AS (SELECT *, bool_and(gone) OVER (PARTITION BY l_orderkey) AS every FROM l)
SELECT o_orderkey AS draft_id, 'edit' AS action, CASE o_orderkey % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.7 WHEN 2 THEN 0.5 END::DOUBLE AS confidence, string_agg(l_linenumber || l_returnflag, ' ' ORDER BY l_linenumber, l_returnflag) FILTER (every OR NOT gone) AS techniques FROM orders JOIN t ON l_orderkey = o_orderkey GROUP BY 1, 2, 3
"""


def reviewer_overrides(spark: SparkSession, d: str) -> DataFrame:
    """Lines for a reviewer's next pass on advice that was neither followed nor moot, where the advice names known types alone."""
    e, k = table(spark, d, "events"), F.col("event_id")
    kind = F.when(k % 3 == 0, "addition").when(k % 3 == 1, "entity").otherwise("edge")
    advice = e.select(F.col("user_id").alias("source_id"), F.col("event_type").alias("gate_key"), kind.alias("kind"), k.cast("string").alias("ref"), F.lit("add").alias("recommended"), F.when(k % 7 != 0, "keep").alias("actual"), (k % 4 == 0).alias("agreed"), (k % 5 == 0).alias("moot"), F.when(k % 2 == 0, "tool").when(k % 11 == 0, "odd").when(k % 13 == 0, "").alias("entity_type"))
    return B.override_feedback(B.known_types(advice, ["tool", "malware"]))


REVIEWER_OVERRIDES = """
WITH a AS (SELECT *, ['addition', 'entity', 'edge'][event_id % 3 + 1] AS kind FROM events WHERE event_id % 4 <> 0 AND event_id % 5 <> 0 AND CASE WHEN event_id % 2 = 0 THEN TRUE WHEN event_id % 11 = 0 THEN FALSE ELSE event_id % 3 <> 0 END),
b AS (SELECT user_id, event_type, concat_ws(' ', kind || ':', event_id::VARCHAR, 'advised add but', CASE WHEN event_id % 7 <> 0 THEN 'keep' END) AS line FROM a)
SELECT user_id AS source_id, event_type AS gate_key, string_agg(line, chr(10) ORDER BY line) AS text FROM b GROUP BY 1, 2
"""


def told_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules as text, permanent ones first, then by category."""
    e = table(spark, d, "events")
    return B.told_rules(e.select(F.col("user_id").alias("source_id"), F.col("event_type").alias("category"), _text("rule ", "event_id").alias("pattern"), (F.col("event_id") % 7 == 0).alias("pinned"), F.col("event_id").alias("rank")))


TOLD_RULES = """
WITH b AS (SELECT user_id AS s, event_id % 7 <> 0 AS later, CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END AS c, string_agg('- rule ' || event_id, chr(10) ORDER BY event_id) AS l FROM events GROUP BY 1, 2, 3)
SELECT s AS source_id, string_agg(CASE WHEN later THEN upper(c) ELSE 'PERMANENT RULES' END || chr(10) || l, chr(10) || chr(10) ORDER BY later, c) AS text FROM b GROUP BY 1
"""


def technique_observables(spark: SparkSession, d: str) -> DataFrame:
    """Procedures that implement a technique with the names of what was seen of them, also those without any."""
    lines = table(spark, d, "lineitem")
    part, proc, seen = _text("p-", "l_partkey"), _text("x-", "l_orderkey"), _text("s-", "l_suppkey")
    edges = lines.select(proc.alias("src"), F.lit("IMPLEMENTS_TECHNIQUE").alias("verb"), part.alias("dst")).unionByName(lines.where("l_linenumber <= 2").select(proc.alias("src"), F.lit("HAS_OBSERVABLE").alias("verb"), seen.alias("dst")))
    nodes = table(spark, d, "supplier").select(_text("s-", "s_suppkey").alias("stix_id"), F.when(F.col("s_suppkey") % 4 != 0, F.create_map(F.lit("name"), F.col("s_name"))).otherwise(F.create_map(F.lit("value"), F.col("s_name"))).alias("props"))
    found = S.observables_of(table(spark, d, "part").where("p_size < 25").select(_text("p-", "p_partkey").alias("technique")), edges, nodes)
    return found.select("technique", "procedure", F.array_join("values", ",").alias("names"))


TECHNIQUE_OBSERVABLES = """
WITH v AS (SELECT l_orderkey AS k, string_agg(DISTINCT s_name, ',' ORDER BY s_name) AS names FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linenumber <= 2 AND s_suppkey % 4 <> 0 GROUP BY 1)
SELECT DISTINCT 'p-' || l_partkey AS technique, 'x-' || l_orderkey AS procedure, coalesce(names, '') AS names FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size < 25 LEFT JOIN v ON k = l_orderkey
"""


def node_names(spark: SparkSession, d: str) -> DataFrame:
    """What a node is called, and what tells it from others of its name."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    label = F.when(k % 3 == 0, "AttackPattern").when(k % 3 == 1, "AttackOperator").otherwise("Tool")
    pairs = {"name": F.when(k % 4 == 0, "").when(k % 4 != 1, F.col("p_name")), "value": F.when(k % 8 != 0, F.col("p_brand")), "mitre_id": F.when(k % 2 == 0, _text("T", "p_partkey")), "operator": F.lit("AND"), "description": F.repeat("p_type", F.lit(9))}
    props = F.map_filter(F.create_map(*[x for key, v in pairs.items() for x in (F.lit(key), v)]), lambda _, v: v.isNotNull())
    return S.display_names(p.select(_text("node-00000", "p_partkey").alias("stix_id"), label.alias("label"), props.alias("props")))


NODE_NAMES = """
SELECT 'node-00000' || p_partkey AS stix_id, CASE WHEN p_partkey % 4 >= 2 THEN p_name WHEN p_partkey % 8 <> 0 THEN p_brand ELSE ['AttackPattern', 'AttackOperator', 'Tool'][p_partkey % 3 + 1] || ' ' || right('node-00000' || p_partkey, 8) END AS name,
  CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'T' || p_partkey ELSE '' END WHEN 1 THEN 'AND' ELSE substr(repeat(p_type, 9), 1, 80) END AS secondary FROM part
"""


def pool_labels(spark: SparkSession, d: str) -> DataFrame:
    """Which brands named a technique, and whether the source's own reference sections list it."""
    lines = table(spark, d, "lineitem")
    technique = F.concat(F.lit("T"), F.lpad(F.col("l_suppkey").cast("string"), 4, "0"))
    sections = lines.select(F.col("l_orderkey").alias("section_id"), F.when(F.col("l_returnflag") == "R", "technique_reference").when(F.col("l_returnflag") == "A", "other").alias("classification"), F.concat(F.lit("see "), technique, F.lit(" and ("), technique, F.lit(".00"), (F.col("l_linenumber") % 9 + 1).cast("string"), F.lit(").")).alias("text"))
    hits = lines.where("l_linenumber = 1").select(technique.alias("technique_id"), F.lower("l_linestatus").alias("brand"))
    return brands.pool_labels(hits, brands.listed_techniques(sections)).select("technique_id", F.array_join("labels", "; ").alias("labels"))


POOL_LABELS = """
WITH l AS (SELECT *, 'T' || lpad(l_suppkey::VARCHAR, 4, '0') AS t FROM lineitem), n AS (SELECT t, 'brand: ' || lower(l_linestatus) AS b FROM l WHERE l_linenumber = 1 UNION SELECT t, 'listed by the source' FROM l WHERE l_returnflag = 'R' UNION SELECT t || '.00' || (l_linenumber % 9 + 1), 'listed by the source' FROM l WHERE l_returnflag = 'R')
SELECT t AS technique_id, string_agg(b, '; ' ORDER BY b) AS labels FROM n GROUP BY 1
"""


def removed_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges between chunks without those that the analyst removed by the procedures' names, letter case aside."""
    o, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    s = F.col("o_custkey").alias("source_id")
    pair = lambda df: df.withColumn("dst", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).where("dst is not null")
    edges = pair(o).select(s, F.col("o_orderkey").alias("src"), "dst")
    named = o.select(s, F.col("o_orderkey").alias("chunk_id"), F.concat(F.lit(" "), "o_orderpriority").alias("name"))
    removed = o.where("o_orderkey % 5 = 0").select(s, F.lower("o_orderpriority").alias("source_name"), F.lit("1-urgent ").alias("target_name"))
    joints = edges.groupBy("source_id", F.col("src").alias("anchor")).agg(F.array_sort(F.collect_list("dst")).alias("outputs")).withColumn("role", F.when(F.col("anchor") % 2 == 0, "branch").otherwise("join"))
    left, mended = K.without_removed_edges(edges, joints, removed, named)
    return left.select("source_id", "src", "dst", F.lit("edge").alias("what")).unionByName(mended.select("source_id", F.col("anchor").alias("src"), F.coalesce(F.get("outputs", F.lit(0)), F.lit(-1)).alias("dst"), F.col("role").alias("what")))


REMOVED_EDGES = """
WITH e AS (SELECT o_custkey AS s, o_orderkey AS src, lead(o_orderkey) OVER w AS dst, o_orderpriority AS a, lead(o_orderpriority) OVER w AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
f AS (SELECT *, b = '1-URGENT' AND (s, a) IN (SELECT (o_custkey, o_orderpriority) FROM orders WHERE o_orderkey % 5 = 0) AS gone FROM e WHERE dst IS NOT NULL)
SELECT s AS source_id, src, dst, 'edge' AS what FROM f WHERE NOT gone UNION ALL SELECT s, src, CASE WHEN gone AND src % 2 = 0 THEN -1 ELSE dst END, CASE WHEN src % 2 = 0 THEN 'branch' ELSE 'join' END FROM f
"""


def draft_vulnerabilities(spark: SparkSession, d: str) -> DataFrame:
    """Entities of the vulnerability ids that drafts name, by first mention."""
    o = table(spark, d, "orders")
    cve = lambda k: F.concat(F.lit("cve-2024-"), F.lpad(k.cast("string"), 4, "0"))
    texts = o.select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("draft_id"), F.concat_ws(" and ", cve(F.col("o_orderkey") % 7), cve(F.col("o_orderkey") % 5), cve(F.col("o_orderkey") % 7)).alias("text"))
    entities = o.select(
        F.col("o_custkey").alias("source_id"), _text("e", "o_orderkey").alias("entity_id"), F.col("o_orderkey").alias("position"), F.upper(cve(F.col("o_orderkey") % 4)).alias("value"), F.lit("").alias("edited_value"), F.lit(None).cast("string").alias("edited_type"),
        F.when(F.col("o_orderkey") % 3 == 0, "malware").otherwise("vulnerability").alias("entity_type"), F.when(F.col("o_orderkey") % 10 == 0, "remove").alias("gate_action"),
    )
    return R.vulnerability_refs(texts, entities).select("source_id", "draft_id", F.array_join("refs", ",").alias("refs"))


DRAFT_VULNERABILITIES = """
WITH e AS (SELECT o_custkey AS s, o_orderkey % 4 AS v, min(o_orderkey) AS k FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 10 <> 0 GROUP BY 1, 2),
m AS (SELECT o_custkey AS s, o_orderkey AS d, o_orderkey % 7 AS v, 0 AS n FROM orders UNION ALL SELECT o_custkey, o_orderkey, o_orderkey % 5, 1 FROM orders WHERE o_orderkey % 5 <> o_orderkey % 7)
SELECT m.s AS source_id, m.d AS draft_id, string_agg('e' || k, ',' ORDER BY n) AS refs FROM m JOIN e USING (s, v) GROUP BY 1, 2
"""


def named_log_sources(spark: SparkSession, d: str) -> DataFrame:
    """Log sources named by their component, else by their strategy, else not at all."""
    links = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 40).alias("component_id"), (F.col("o_custkey") % 20).alias("strategy_id"))
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    return R.log_source_names(links, n.select(F.col("n_nationkey").alias("id"), F.when(F.col("n_regionkey") != 2, F.col("n_name")).alias("name")), s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


NAMED_LOG_SOURCES = "SELECT o_orderkey AS id, coalesce(CASE WHEN n_regionkey <> 2 THEN n_name END, s_name) AS name FROM orders LEFT JOIN nation ON n_nationkey = o_orderkey % 40 LEFT JOIN supplier ON s_suppkey = o_custkey % 20"


def source_prints(spark: SparkSession, d: str) -> DataFrame:
    """A source's fingerprint, the text that stands for it, and whether its chunking failed."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderpriority")).alias("values"), F.count("*").alias("n"))
    c = table(spark, d, "customer").join(o, "c_custkey", "left")
    text, title = F.repeat(F.col("c_mktsegment"), F.lit(300)), F.when(F.col("c_nationkey") % 3 != 0, F.col("c_name"))
    shown = V.representation(title, F.slice("values", 1, 3), F.array("c_mktsegment"), 60, 2)
    return c.select("c_custkey", V.source_fingerprint(title, text, F.col("values"), F.array(F.lit("b"), F.lit("a"))).alias("print"), shown.alias("shown"), V.chunking_failed(F.col("n"), text).alias("failed"))


SOURCE_PRINTS = """
WITH o AS (SELECT o_custkey AS c_custkey, list(o_orderpriority ORDER BY o_orderpriority) AS v, count(*) AS n FROM orders GROUP BY 1), c AS (SELECT *, CASE WHEN c_nationkey % 3 <> 0 THEN c_name ELSE '' END AS title FROM customer LEFT JOIN o USING (c_custkey))
SELECT c_custkey, substr(sha1(concat_ws('|', title, substr(repeat(c_mktsegment, 300), 1, 2000), coalesce(array_to_string(v, ','), ''), 'a,b')), 1, 16) AS print,
  substr(concat_ws(chr(10), title, c_mktsegment, CASE WHEN v IS NOT NULL THEN array_to_string(v[1:2], chr(10)) END), 1, 60) AS shown, n IS NULL AS failed FROM c
"""

QUERIES = {f.__name__: (f, sql) for f, sql in (
    (artifact_observables, ARTIFACT_OBSERVABLES), (candidate_union, CANDIDATE_UNION), (best_picks, BEST_PICKS), (unanswered_chunks, UNANSWERED_CHUNKS), (technique_overrides, TECHNIQUE_OVERRIDES), (entity_edits, ENTITY_EDITS),
    (rule_indicators, RULE_INDICATORS), (missing_extensions, MISSING_EXTENSIONS), (boundary_feedback, BOUNDARY_FEEDBACK), (unattended_advice, UNATTENDED_ADVICE), (reviewer_overrides, REVIEWER_OVERRIDES), (told_rules, TOLD_RULES),
    (technique_observables, TECHNIQUE_OBSERVABLES), (node_names, NODE_NAMES), (pool_labels, POOL_LABELS), (removed_edges, REMOVED_EDGES), (draft_vulnerabilities, DRAFT_VULNERABILITIES), (named_log_sources, NAMED_LOG_SOURCES), (source_prints, SOURCE_PRINTS),
)}
