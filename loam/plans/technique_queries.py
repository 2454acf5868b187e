"""Queries of the technique operators: parts stand for the catalogue, orders for chunks, their lines for picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loam.operators import brands as N, picks as P
from loam.sources import catalogue as C
from loam.sources.tables import table


def _tid(key):
    """T0000.001 for odd keys, T0000 for even ones: the even one before is the parent."""
    base = F.concat(F.lit("T"), F.lpad(F.floor(key / 2).cast("string"), 4, "0"))
    return F.when(key % 2 == 1, F.concat(base, F.lit(".001"))).otherwise(base)


_TID = "'T' || lpad((({k}) // 2)::VARCHAR, 4, '0') || CASE WHEN ({k}) % 2 = 1 THEN '.001' ELSE '' END"


def _catalogue(spark: SparkSession, d: str) -> DataFrame:
    """One technique per part of the first 10,000 keys that ids of four digits can name twice over; the rest is named after them."""
    p = table(spark, d, "part").select((F.col("p_partkey") % 20_000).alias("k"), "p_partkey", "p_name", "p_type", "p_size", "p_brand")
    first = p.groupBy("k").agg(F.min_by(F.struct("p_name", "p_type", "p_size", "p_brand"), "p_partkey").alias("p"))
    return first.select(
        _tid(F.col("k")).alias("technique_id"), F.concat(F.lit("attack-pattern--"), F.col("k").cast("string")).alias("stix_id"), F.col("p.p_name").alias("name"), F.concat_ws(" ", "p.p_name", "p.p_type", "p.p_brand").alias("description"),
        F.when(F.col("p.p_size") % 3 == 0, F.array("p.p_type")).otherwise(F.array(F.col("p.p_type"), F.lit("impact"))).alias("tactics"), (F.col("p.p_size") % 10 == 1).alias("revoked"), (F.col("p.p_size") % 10 == 2).alias("deprecated"), "k",
    )


_CATALOGUE = f"""cat AS (SELECT k, {_TID.format(k='k')} AS tid, 'attack-pattern--' || k AS stix, p.n AS name, p.n || ' ' || p.t || ' ' || p.b AS descr, p.t AS type, p.s AS size, p.s % 10 = 1 AS revoked, p.s % 10 = 2 AS deprecated
  FROM (SELECT p_partkey % 20000 AS k, arg_min({{'n': p_name, 't': p_type, 's': p_size, 'b': p_brand}}, p_partkey) AS p FROM part GROUP BY 1))"""


def _picks(spark: SparkSession, d: str) -> DataFrame:
    """A pick per line; a few name no technique of the catalogue."""
    li = table(spark, d, "lineitem")
    key = F.when(F.col("l_partkey") % 97 == 3, F.lit(19_999)).otherwise(F.col("l_partkey") % 20_000)
    bucket = F.element_at(F.array(F.lit("possible"), F.lit("probable"), F.lit("definite")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return li.groupBy(F.col("l_orderkey").alias("chunk_id"), _tid(key).alias("technique_id")).agg(F.min("l_linenumber").alias("position"), F.min(F.col("l_quantity") / 100).alias("confidence"), F.min(bucket).alias("confidence_bucket")).select(
        "chunk_id", F.col("position").cast("int").alias("position"), "technique_id", F.lit("as picked").alias("technique_name"), F.lit("execution").alias("tactic"), "confidence", "confidence_bucket",
        F.lit("").alias("source_quote"), F.lit("").alias("rationale"), F.lit(None).cast("string").alias("stix_id"), F.lit("llm").alias("provenance"),
    )


_PICKS = f"""pk AS (SELECT l_orderkey AS chunk_id, {_TID.format(k='CASE WHEN l_partkey % 97 = 3 THEN 19999 ELSE l_partkey % 20000 END')} AS tid, min(l_linenumber) AS position, min(l_quantity / 100) AS confidence,
  min(['possible', 'probable', 'definite'][l_linenumber % 3 + 1]) AS bucket FROM lineitem GROUP BY 1, 2)"""


def technique_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Picks resolved: active, led on from a revoked one to the technique after next, kept as deprecated, or unresolved."""
    c = _catalogue(spark, d)
    to = c.where("revoked").select("technique_id", _tid(F.col("k") + 2).alias("target_id"))
    found = P.resolved(_picks(spark, d), c, to)
    return found.select("chunk_id", "technique_id", "technique_name", "stix_id", "redirected_from", "is_deprecated", "outcome")


TECHNIQUE_RESOLUTION = f"""
WITH {_CATALOGUE}, {_PICKS}, act AS (SELECT * FROM cat WHERE NOT revoked AND NOT deprecated),
r AS (SELECT c.tid, a.tid AS to_tid, a.stix, a.name FROM cat c JOIN act a ON a.k = c.k + 2 WHERE c.revoked)
SELECT chunk_id, coalesce(CASE WHEN a.tid IS NULL THEN r.to_tid END, pk.tid) AS technique_id, coalesce(a.name, r.name, o.name, 'as picked') AS technique_name, coalesce(a.stix, r.stix, o.stix) AS stix_id,
  CASE WHEN a.tid IS NULL AND r.to_tid IS NOT NULL THEN pk.tid END AS redirected_from, a.tid IS NULL AND r.tid IS NULL AND o.tid IS NOT NULL AS is_deprecated,
  CASE WHEN a.tid IS NOT NULL THEN 'active' WHEN r.tid IS NOT NULL THEN 'redirected' WHEN o.tid IS NOT NULL THEN 'deprecated' ELSE 'unresolved' END AS outcome
FROM pk LEFT JOIN act a ON a.tid = pk.tid LEFT JOIN r ON r.tid = pk.tid LEFT JOIN (SELECT * FROM cat WHERE deprecated) o ON o.tid = pk.tid
"""


def technique_proposals(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of proposed ids over chains of redirects, among them ids of nothing and redirects onto themselves."""
    c = _catalogue(spark, d)
    to = c.where("revoked").select("technique_id", F.when(F.col("k") % 7 == 0, F.col("technique_id")).otherwise(_tid(F.col("k") + 1)).alias("target_id"))
    asked = c.select(F.col("technique_id").alias("id")).union(spark.createDataFrame([("T9999.001",), ("none",)], "id string"))
    return P.proposals(asked, c, to)


TECHNIQUE_PROPOSALS = f"""
WITH RECURSIVE {_CATALOGUE}, w(id, k, hops) AS (SELECT tid, k, 0 FROM cat UNION ALL SELECT w.id, CASE WHEN w.k % 7 = 0 THEN w.k ELSE w.k + 1 END, hops + 1 FROM w JOIN cat c ON c.k = w.k AND c.revoked WHERE hops < 10),
e AS (SELECT id, arg_max(k, hops) AS k, max(hops) AS hops FROM w GROUP BY 1)
SELECT e.id, CASE WHEN NOT c.revoked AND NOT c.deprecated THEN 'kept_active' WHEN NOT c.revoked THEN 'dropped_deprecated' WHEN f.tid IS NOT NULL AND NOT f.revoked AND NOT f.deprecated THEN 'redirected' ELSE 'dropped_revoked_no_redirect' END AS outcome,
  CASE WHEN NOT c.revoked AND NOT c.deprecated THEN e.id WHEN c.revoked AND f.tid IS NOT NULL AND NOT f.revoked AND NOT f.deprecated THEN f.tid END AS final_id
FROM e JOIN cat c ON c.tid = e.id LEFT JOIN cat f ON f.k = e.k
UNION ALL SELECT id, 'dropped_hallucinated', NULL FROM (VALUES ('T9999.001'), ('none')) v(id) WHERE id NOT IN (SELECT tid FROM cat)
"""


def technique_tactics(spark: SparkSession, d: str) -> DataFrame:
    """Picks with the tactic that their technique has, where it has one alone, and their lane."""
    found = P.lanes(P.corrected_tactics(_picks(spark, d), _catalogue(spark, d)))
    return found.groupBy("tactic", "lane").agg(F.count("*").alias("n"))


TECHNIQUE_TACTICS = f"""
WITH {_CATALOGUE}, {_PICKS} SELECT CASE WHEN size % 3 = 0 THEN type ELSE 'execution' END AS tactic, CASE WHEN bucket = 'possible' THEN 'review' ELSE 'bundle' END AS lane, count(*) AS n
FROM pk LEFT JOIN cat USING (tid) GROUP BY 1, 2
"""


def curated_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Picks against brands that stand for a technique (one a chunk, by its customer), firm for two of three."""
    o = table(spark, d, "orders")
    hits = o.select(F.col("o_orderkey").alias("chunk_id"), F.lower("o_orderpriority").alias("brand"), _tid(F.col("o_custkey") % 20_000).alias("technique_id"), F.when(F.col("o_custkey") % 3 > 0, "definitional").otherwise("suggestive").alias("strength"))
    listed = _catalogue(spark, d).where("k % 5 = 0").select("technique_id")
    found = P.reconciled(_picks(spark, d), hits, listed, _catalogue(spark, d))
    return found.groupBy("provenance", "confidence_bucket", F.coalesce("curated_provenance", F.lit("-")).alias("curated"), F.col("brand_mismatch").isNotNull().alias("mismatch")).agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"), F.sum(F.length("technique_id")).alias("ids"))


CURATED_RECONCILE = f"""
WITH {_CATALOGUE}, {_PICKS}, h AS (SELECT o_orderkey AS chunk_id, {_TID.format(k='o_custkey % 20000')} AS tid FROM orders WHERE o_custkey % 3 > 0),
e AS (SELECT h.chunk_id, h.tid, split_part(h.tid, '.', 1) AS parent, CASE WHEN c.k % 5 = 0 THEN 'brand+vendor' ELSE 'brand' END AS src FROM h JOIN cat c USING (tid) WHERE NOT revoked AND NOT deprecated),
f AS (SELECT e.*, pk.tid AS picked FROM e JOIN pk ON pk.chunk_id = e.chunk_id AND split_part(pk.tid, '.', 1) = e.parent),
m AS (SELECT e.chunk_id, e.tid, e.parent, e.src, coalesce(bool_or(f.picked = e.tid), false) AS met, count(*) FILTER (f.picked <> e.tid AND f.picked <> e.parent) > 0 AS others FROM e LEFT JOIN f ON f.chunk_id = e.chunk_id AND f.tid = e.tid GROUP BY 1, 2, 3, 4),
tag AS (SELECT chunk_id, tid, src FROM m WHERE met UNION ALL SELECT f.chunk_id, f.picked, f.src FROM f JOIN m USING (chunk_id, tid) WHERE NOT met AND m.tid = m.parent AND others AND f.picked <> f.tid AND f.picked <> f.parent),
add_ AS (SELECT * FROM m WHERE NOT met AND NOT (tid = parent AND others)),
bad AS (SELECT f.chunk_id, f.picked AS tid FROM f JOIN add_ a ON a.chunk_id = f.chunk_id AND a.tid = f.tid WHERE a.tid <> a.parent AND f.picked <> f.tid AND f.picked <> f.parent),
r AS (SELECT 'llm' AS provenance, CASE WHEN bad.tid IS NOT NULL THEN 'possible' ELSE bucket END AS confidence_bucket, coalesce(src, '-') AS curated, bad.tid IS NOT NULL AS mismatch, CASE WHEN bad.tid IS NOT NULL THEN least(confidence, 0.5) ELSE confidence END AS confidence, pk.tid
  FROM pk LEFT JOIN tag ON tag.chunk_id = pk.chunk_id AND tag.tid = pk.tid LEFT JOIN bad ON bad.chunk_id = pk.chunk_id AND bad.tid = pk.tid
  UNION ALL SELECT 'brand_inferred', 'possible', src, false, 0.5, tid FROM add_)
SELECT provenance, confidence_bucket, curated, mismatch, count(*) AS n, round(sum(confidence), 4) AS confidence, sum(length(tid))::BIGINT AS ids FROM r GROUP BY 1, 2, 3, 4
"""


def promoted_picks(spark: SparkSession, d: str) -> DataFrame:
    """Parents whose sub-technique the text overlaps more; each order's text is its lines' part names."""
    c = _catalogue(spark, d)
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("t"))
    texts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), "l_partkey").distinct().join(p, "l_partkey").groupBy("chunk_id").agg(F.array_join(F.array_sort(F.collect_set("t")), " ").alias("text"))
    found = P.promoted(_picks(spark, d), texts, c)
    return found.select("chunk_id", "position", "technique_id", "technique_name")


PROMOTED_PICKS = f"""
WITH {_CATALOGUE}, {_PICKS}, act AS (SELECT *, list_distinct(regexp_extract_all(lower(descr), '[a-z]{{3,}}')) AS w FROM cat WHERE NOT revoked AND NOT deprecated),
x AS (SELECT chunk_id, list_distinct(regexp_extract_all(lower(string_agg(t, ' ')), '[a-z]{{3,}}')) AS w FROM (SELECT DISTINCT l_orderkey AS chunk_id, p_name || ' ' || p_type || ' ' || p_brand AS t FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1),
j AS (SELECT pk.*, s.tid AS sub, s.name AS sub_name,
  CASE WHEN len(x.w) = 0 OR s.w IS NULL OR len(s.w) = 0 THEN 0 ELSE len(list_intersect(x.w, s.w)) / len(list_distinct(list_concat(x.w, s.w)))::DOUBLE END AS sj,
  CASE WHEN len(x.w) = 0 OR a.w IS NULL OR len(a.w) = 0 THEN 0 ELSE len(list_intersect(x.w, a.w)) / len(list_distinct(list_concat(x.w, a.w)))::DOUBLE END AS aj
  FROM pk JOIN x USING (chunk_id) LEFT JOIN act s ON s.tid = pk.tid || '.001' LEFT JOIN act a ON a.tid = pk.tid)
SELECT chunk_id, position, CASE WHEN sub IS NOT NULL AND sj > aj + 0.05::DOUBLE AND sj >= 0.2::DOUBLE THEN sub ELSE tid END AS technique_id, CASE WHEN sub IS NOT NULL AND sj > aj + 0.05::DOUBLE AND sj >= 0.2::DOUBLE THEN sub_name ELSE 'as picked' END AS technique_name FROM j
"""


def pick_intake(spark: SparkSession, d: str) -> DataFrame:
    """Answers and decisions on verbatim matches taken in; some ids are no ids, some decisions are on nothing."""
    li = table(spark, d, "lineitem")
    base = li.groupBy(F.col("l_orderkey").alias("chunk_id"), (F.col("l_partkey") % 20_000).alias("k")).agg(F.min("l_linenumber").alias("position"), F.min("l_quantity").alias("q"))
    tid = F.when(F.col("k") % 11 == 0, F.lit("T12")).otherwise(F.concat(F.lit(" "), _tid(F.col("k"))))
    raw = base.select("chunk_id", "position", tid.alias("technique_id"), F.lit("n").alias("technique_name"), F.lit(None).cast("string").alias("tactic"), (F.col("q") / 40).alias("confidence"), F.when(F.col("k") % 2 == 0, "definite").otherwise("sure").alias("confidence_bucket"), F.lit(" q ").alias("source_quote"), F.lit(None).cast("string").alias("rationale"))
    decisions = base.where("k % 4 = 0").select("chunk_id", "position", _tid(F.col("k")).alias("technique_id"), F.when(F.col("k") % 8 == 0, "confirm").otherwise("reject").alias("decision"), F.lit(None).cast("string").alias("rejection_reason"))
    matches = base.where("k % 3 = 0").select("chunk_id", _tid(F.col("k")).alias("technique_id"), F.lit("s").alias("matched_substring"), F.lit("a").alias("source_actor_name"))
    chunks = table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"))
    found = P.taken_in(raw, decisions, matches, chunks, _catalogue(spark, d))
    return found.groupBy("provenance", "confidence_bucket").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"), F.sum(F.length("technique_id")).alias("ids"))


PICK_INTAKE = f"""
WITH b AS (SELECT l_orderkey AS chunk_id, l_partkey % 20000 AS k, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2),
r AS (SELECT CASE WHEN k % 8 = 0 THEN 'verbatim_match' ELSE 'verbatim_match_rejected' END AS provenance, CASE WHEN k % 8 = 0 THEN 'definite' ELSE 'possible' END AS confidence_bucket, CASE WHEN k % 8 = 0 THEN 0.95 ELSE 0.3 END::DOUBLE AS c, {_TID.format(k='k')} AS tid FROM b WHERE k % 12 = 0
  UNION ALL SELECT 'llm', CASE WHEN k % 2 = 0 THEN 'definite' ELSE 'probable' END, least(1.0, q / 40), {_TID.format(k='k')} FROM b WHERE k % 12 <> 0 AND k % 11 <> 0)
SELECT provenance, confidence_bucket, count(*) AS n, round(sum(c), 4) AS confidence, sum(length(tid))::BIGINT AS ids FROM r GROUP BY 1, 2
"""


def moved_picks(spark: SparkSession, d: str) -> DataFrame:
    """Denied picks sent to review, then promotions of a reviewer: every third chunk's, and the best of chunks without any."""
    picks = P.lanes(_picks(spark, d))
    deny = table(spark, d, "part").where("p_size = 7").select(_tid(F.col("p_partkey") % 20_000).alias("technique_id"), F.col("p_brand").alias("pattern_id"))
    denied = P.denied(picks, deny)
    chunks = table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"))
    asked = denied.where("chunk_id % 3 = 0 and lane = 'review'").select("chunk_id", "technique_id").union(P.best_orphans(denied, chunks))
    moved = P.moved_up(denied, asked)
    return moved.groupBy("lane", "moved", F.col("denied_by").isNotNull().alias("denied"), "confidence_bucket").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 4).alias("confidence"))


MOVED_PICKS = f"""
WITH {_PICKS}, dn AS (SELECT DISTINCT {_TID.format(k='p_partkey % 20000')} AS tid FROM part WHERE p_size = 7),
p AS (SELECT pk.*, dn.tid IS NOT NULL AS denied, CASE WHEN dn.tid IS NOT NULL OR bucket = 'possible' THEN 'review' ELSE 'bundle' END AS lane FROM pk LEFT JOIN dn USING (tid)),
best AS (SELECT chunk_id, arg_max(tid, (confidence, -position)) AS tid FROM p WHERE chunk_id NOT IN (SELECT chunk_id FROM p WHERE lane = 'bundle') GROUP BY 1),
m AS (SELECT p.*, lane = 'review' AND (chunk_id % 3 = 0 OR best.tid IS NOT NULL) AS moved FROM p LEFT JOIN best USING (chunk_id, tid))
SELECT CASE WHEN moved THEN 'bundle' ELSE lane END AS lane, moved, denied, CASE WHEN moved AND bucket = 'possible' THEN 'probable' ELSE bucket END AS confidence_bucket, count(*) AS n,
  round(sum(CASE WHEN moved THEN greatest(confidence, 0.7) ELSE confidence END), 4) AS confidence FROM m GROUP BY 1, 2, 3, 4
"""


def brand_scan(spark: SparkSession, d: str) -> DataFrame:
    """Words of the benchmark's items as brands in documents, letter case and neighbouring signs aside."""
    words = table(spark, d, "benchmark").select(F.col("item_id"), F.element_at(F.split("text", " "), 1).alias("brand")).where(F.rlike("brand", F.lit("^[A-Za-z]{3,}$")))
    brands = words.groupBy(F.lower("brand").alias("brand")).agg(F.concat(F.lit("T"), F.lpad(F.min("item_id").cast("string"), 4, "0")).alias("technique_id")).withColumn("strength", F.when(F.length("brand") > 5, "definitional"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.lit(None).cast("string").alias("source_excerpt"))
    return N.brand_techniques(docs, brands).groupBy("chunk_id").agg(F.count("*").alias("n"), F.count_if(F.col("strength") == "definitional").alias("firm"))


BRAND_SCAN = r"""
WITH w AS (SELECT item_id, lower(string_split(text, ' ')[1]) AS brand FROM benchmark WHERE regexp_matches(string_split(text, ' ')[1], '^[A-Za-z]{3,}$')), b AS (SELECT DISTINCT brand FROM w),
h AS (SELECT DISTINCT doc_id, brand FROM documents, b WHERE contains(lower(text), brand) AND regexp_matches(lower(text), '(^|[^a-z0-9])' || regexp_escape(brand) || '([^a-z0-9]|$)'))
SELECT doc_id AS chunk_id, count(*) AS n, count(*) FILTER (length(brand) > 5) AS firm FROM h GROUP BY 1
"""


def catalogue_graph(spark: SparkSession, d: str) -> DataFrame:
    """A catalogue graph: parts as techniques, types as tactics, suppliers as strategies, nations as analytics, regions as components."""
    none = F.array().cast("array<string>")
    tid = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    empty = {c: F.lit(None).cast("string") for c in ("source_ref", "target_ref", "relationship_type", "shortname")} | {c: none for c in ("tactics", "analytic_refs", "component_refs")}
    make = lambda df, id_, kind, **given: df.select(id_.alias("id"), F.lit(kind).alias("type"), *[given.get(c, v).alias(c) for c, v in empty.items()])
    p, s, n, r, li = (table(spark, d, t) for t in ("part", "supplier", "nation", "region", "lineitem"))
    techniques = make(p, tid("ap-", "p_partkey"), "attack-pattern", tactics=F.array("p_type"))
    tactics = make(p.select("p_type").distinct().where("p_type <> 'SMALL'"), F.concat(F.lit("ta-"), F.col("p_type")), "x-mitre-tactic", shortname=F.col("p_type"))
    strategies = make(s, tid("ds-", "s_suppkey"), "x-mitre-detection-strategy", analytic_refs=F.array(tid("an-", "s_nationkey"), F.lit("an-none")))
    analytics = make(n, tid("an-", "n_nationkey"), "x-mitre-analytic", component_refs=F.array(tid("dc-", "n_regionkey"), tid("dc-", "n_regionkey")))
    components = make(r, tid("dc-", "r_regionkey"), "x-mitre-data-component")
    links = make(li, tid("rel-", "l_orderkey"), "relationship", source_ref=tid("ds-", "l_suppkey"), target_ref=tid("ap-", "l_partkey"), relationship_type=F.when(F.col("l_linenumber") == 1, "detects").otherwise("unknown"))
    found = C.edges(techniques.unionByName(tactics).unionByName(strategies).unionByName(analytics).unionByName(components).unionByName(links))
    return found.groupBy("verb", "dst").agg(F.count("*").alias("n"))


CATALOGUE_GRAPH = """
SELECT 'BELONGS_TO_TACTIC' AS verb, 'ta-' || p_type AS dst, count(*) AS n FROM part WHERE p_type <> 'SMALL' GROUP BY 2
UNION ALL SELECT 'HAS_ANALYTIC', 'an-' || s_nationkey, count(*) FROM supplier GROUP BY 2
UNION ALL SELECT 'USES_DATA_COMPONENT', 'dc-' || n_regionkey, count(*) FROM nation GROUP BY 2
UNION ALL SELECT 'DETECTS', 'ap-' || l_partkey, count(DISTINCT l_suppkey) FROM lineitem WHERE l_linenumber = 1 GROUP BY 2
"""


def catalogue_examples(spark: SparkSession, d: str) -> DataFrame:
    """Worked examples: lines as uses of parts by suppliers; only even parts are techniques, blank descriptions do not count."""
    p, s, li = table(spark, d, "part"), table(spark, d, "supplier"), table(spark, d, "lineitem")
    of = p.where("p_partkey % 2 = 0").select(F.concat(F.lit("ap-"), F.col("p_partkey").cast("string")).alias("stix_id"), _tid(F.col("p_partkey") % 20_000).alias("technique_id"))
    null = F.lit(None).cast("string")
    actors = s.select(F.concat(F.lit("is-"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("intrusion-set").alias("type"), F.col("s_name").alias("name"), null.alias("description"), null.alias("source_ref"), null.alias("target_ref"), null.alias("relationship_type"))
    uses = li.select(F.lit("r").alias("id"), F.lit("relationship").alias("type"), null.alias("name"), F.when(F.col("l_linenumber") == 2, " ").otherwise(F.col("l_returnflag")).alias("description"), F.concat(F.lit("is-"), F.col("l_suppkey").cast("string")).alias("source_ref"), F.concat(F.lit("ap-"), F.col("l_partkey").cast("string")).alias("target_ref"), F.lit("uses").alias("relationship_type"))
    found = C.procedure_examples(actors.unionByName(uses), of)
    return found.groupBy("technique_id", "source_actor_name").agg(F.count("*").alias("n"), F.max("description").alias("description"))


CATALOGUE_EXAMPLES = f"""
SELECT {_TID.format(k='l_partkey % 20000')} AS technique_id, s_name AS source_actor_name, count(*) AS n, max(l_returnflag) AS description FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey % 2 = 0 AND l_linenumber <> 2 GROUP BY 1, 2
"""

QUERIES = {f.__name__: (f, sql) for f, sql in (
    (technique_resolution, TECHNIQUE_RESOLUTION), (technique_proposals, TECHNIQUE_PROPOSALS), (technique_tactics, TECHNIQUE_TACTICS), (curated_reconcile, CURATED_RECONCILE), (promoted_picks, PROMOTED_PICKS),
    (pick_intake, PICK_INTAKE), (moved_picks, MOVED_PICKS), (brand_scan, BRAND_SCAN), (catalogue_graph, CATALOGUE_GRAPH), (catalogue_examples, CATALOGUE_EXAMPLES),
)}
