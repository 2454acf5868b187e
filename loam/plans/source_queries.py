"""Queries of the chunk, relationship and draft operators: a customer stands for a source, its orders for chunks and drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loam.functions import values as V
from loam.operators import chunks as K, drafts as D, relationships as R, schemas
from loam.sources import tables
from loam.sources.shared import saved
from loam.sources.tables import table

_NONE = "array<string>"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Orders in order as chunks of their customer: each follows the one before and, every fourth, the one before that."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = table(spark, d, "orders").withColumn("i", F.row_number().over(w))
    tactics = F.element_at(F.array(*map(F.lit, K.TACTIC_ORDER[1:6])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    back = F.filter(F.array(F.when(F.col("o_orderkey") % 7 != 0, F.col("i") - 1), F.when(F.col("o_orderkey") % 4 == 0, F.col("i") - 2)), lambda x: x.isNotNull())
    return o.select(
        F.col("o_custkey").alias("source_id"), F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("chunk_id"), F.col("i").alias("sequence_index"), F.col("o_orderpriority").alias("text"), F.lit("").alias("source_excerpt"),
        back.alias("predecessor_indices"), F.array().cast(_NONE).alias("precedes_ids"), ((F.col("i") == 1) | (F.col("o_orderkey") % 9 == 0)).alias("chain_root"), F.when((F.col("i") == 1) | (F.col("o_orderkey") % 9 == 0), F.concat(F.lit("L"), F.col("i").cast("string"))).alias("chain_label"),
        F.array(F.initcap(tactics)).alias("tactics"), "o_orderkey",
    )


_CHUNKS = """ch AS (SELECT o_custkey AS s, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_orderpriority AS text FROM orders),
ed AS (SELECT a.s, a.k AS src, b.k AS dst FROM ch b JOIN ch a ON a.s = b.s AND (b.k % 7 <> 0 AND a.i = b.i - 1 OR b.k % 4 = 0 AND a.i = b.i - 2))"""


def chunk_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Per source: chunks, edges, roots, declared and undeclared ones, and steps back in the tactics' order."""
    return K.shape(_chunks(spark, d))


CHUNK_SHAPES = f"""
WITH {_CHUNKS}, r AS (SELECT s, k, i = 1 OR k % 9 = 0 AS root FROM ch WHERE (s, k) NOT IN (SELECT (s, dst) FROM ed))
SELECT s AS source_id, (SELECT count(*) FROM ch c WHERE c.s = x.s) AS n_chunks, (SELECT count(*) FROM ed WHERE ed.s = x.s) AS n_edges, (SELECT count(*) FROM r WHERE r.s = x.s) AS n_roots,
  (SELECT count(*) FROM ch c WHERE c.s = x.s AND (i = 1 OR k % 9 = 0)) AS n_declared, (SELECT count(*) FROM r WHERE r.s = x.s AND NOT root) AS n_undeclared,
  (SELECT count(*) FROM ed WHERE ed.s = x.s AND dst % 5 <= 1 AND src % 5 > dst % 5) AS n_warnings FROM (SELECT DISTINCT s FROM ch) x
"""


def chain_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of chains and how many roots reach each chunk."""
    return K.chain_labels(_chunks(spark, d))


CHAIN_LABELS = f"""
WITH RECURSIVE {_CHUNKS}, ro AS (SELECT s, k, i, 'L' || i AS label FROM ch WHERE i = 1 OR k % 9 = 0),
w(s, root, node) AS (SELECT s, k, k FROM ro UNION SELECT w.s, w.root, ed.dst FROM w JOIN ed ON ed.s = w.s AND ed.src = w.node), n AS (SELECT s, node, count(*) AS n FROM w GROUP BY 1, 2),
v(s, root, node) AS (SELECT s, k, k FROM ro UNION SELECT v.s, v.root, ed.dst FROM v JOIN ed ON ed.s = v.s AND ed.src = v.node JOIN n ON n.s = v.s AND n.node = v.node WHERE n.n < 2 OR v.node = v.root),
g AS (SELECT v.s, v.node, arg_min(label, (ro.i, 'c' || ro.k)) AS label FROM v JOIN ro ON ro.s = v.s AND ro.k = v.root JOIN n ON n.s = v.s AND n.node = v.node WHERE n.n < 2 OR v.node = v.root GROUP BY 1, 2)
SELECT ch.s AS source_id, 'c' || ch.k AS chunk_id, coalesce(ro.label, g.label, '') AS chain_label, coalesce(n.n, 0) AS n_roots FROM ch LEFT JOIN ro ON ro.k = ch.k LEFT JOIN g ON g.s = ch.s AND g.node = ch.k LEFT JOIN n ON n.s = ch.s AND n.node = ch.k
"""


def chunk_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Chunks after drops, edits, merges and additions: what follows what is led around the dropped ones."""
    c = _chunks(spark, d).drop("o_orderkey")
    after = F.lead("chunk_id").over(Window.partitionBy("source_id").orderBy("sequence_index"))
    c = saved(c.withColumn("precedes_ids", F.filter(F.array(after), lambda x: x.isNotNull())), "chunks")  # each step of the decisions reads them
    key = F.substring("chunk_id", 2, 20).cast("long")
    action = F.when(key % 5 == 0, "drop").when(key % 5 == 1, "edit").when(key % 10 == 3, "merge").when(key % 5 == 2, "approve")
    partner = F.when(F.size("precedes_ids") > 0, F.col("precedes_ids")).otherwise(F.array(F.lit("none")))
    said = c.select("source_id", "chunk_id", action.alias("action"), F.when(key % 5 == 1, "edited").alias("text"), F.lit(None).cast("string").alias("source_excerpt"), F.when(key % 10 == 3, partner).alias("merge_with"), F.lit("r").alias("rationale")).where("action is not null")
    more = table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("source_id"), F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("chunk_id"), F.lit("added").alias("text"), F.lit("").alias("source_excerpt"))
    out, _ = K.decided(c, said, more)
    return out.select("source_id", "chunk_id", "sequence_index", "text", F.size("precedes_ids").alias("n_next"), F.array_join(F.col("predecessor_indices").cast(_NONE), ",").alias("before"))


CHUNK_DECISIONS = f"""
WITH RECURSIVE {_CHUNKS}, n AS (SELECT *, lead(k) OVER w AS nxt, lag(k) OVER w AS prv, lead(text) OVER w AS nxt_text FROM ch WINDOW w AS (PARTITION BY s ORDER BY i)),
a AS (SELECT *, CASE WHEN k % 5 = 0 OR (prv IS NOT NULL AND prv % 10 = 3) THEN 'remove' WHEN k % 5 = 1 OR (k % 10 = 3 AND nxt IS NOT NULL) THEN 'edit' ELSE 'approve' END AS act FROM n),
kept AS (SELECT s, k, i, CASE WHEN k % 5 = 1 THEN 'edited' WHEN k % 10 = 3 AND nxt IS NOT NULL THEN text || ' ' || nxt_text ELSE text END AS text FROM a WHERE act <> 'remove'),
f AS (SELECT *, lead(i) OVER w AS nx, lag(i) OVER w AS pv FROM kept WINDOW w AS (PARTITION BY s ORDER BY i))
SELECT s AS source_id, 'c' || k AS chunk_id, i::INT AS sequence_index, text, CASE WHEN nx IS NULL THEN 0 ELSE 1 END AS n_next, coalesce(pv::VARCHAR, '') AS before FROM f
UNION ALL SELECT c_custkey, 'n' || c_custkey, coalesce((SELECT max(i) FROM ch WHERE ch.s = c_custkey), 0)::INT + 1, 'added', 0, '' FROM customer WHERE c_nationkey = 3
"""


def chunk_operators(spark: SparkSession, d: str) -> DataFrame:
    """Edges led through operators and conditions, counted by what they join; every sixth chunk has no procedure, every eighth branch a condition."""
    c = _chunks(spark, d)
    edges = saved(K.successors(c), "edges", "zstd")  # the walk over chunks without a procedure and the operators read them
    procs = c.where("o_orderkey % 6 <> 0").select("source_id", "chunk_id", F.concat(F.lit("x-procedure--"), F.col("o_orderkey").cast("string")).alias("stix_id"))
    joints = K.operator_objects(K.operators(edges), procs)
    pre = F.when(F.col("o_orderkey") % 8 == 0, F.struct(F.lit(" if ").alias("description"), F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("string").alias("pattern_type"), F.col("next").alias("on_true_ids"), F.array().cast(_NONE).alias("on_false_ids")))
    ways = K.led_to(edges).select("source_id", F.col("src").alias("chunk_id"), F.col("ways").alias("next"))
    conds = K.conditions(c.drop("precedes_ids").join(ways, ["source_id", "chunk_id"], "left").withColumn("precedes_ids", F.col("next")).withColumn("precondition", pre), c.select("source_id", (F.col("source_id") % 4 != 0).alias("is_sequential")).distinct())
    objects = K.condition_objects(conds, procs)
    found = K.routed(edges, procs, joints, objects)
    kind = lambda c: F.substring_index(c, "--", 1)
    return found.groupBy("source_id", kind(F.col("source_ref")).alias("source"), kind(F.col("target_ref")).alias("target")).agg(F.count("*").alias("n"))


CHUNK_OPERATORS = f"""
WITH RECURSIVE {_CHUNKS}, p AS (SELECT s, k FROM ch WHERE k % 6 <> 0),
br AS (SELECT s, src AS k FROM ed GROUP BY 1, 2 HAVING count(*) >= 2 AND count(*) FILTER (dst % 6 <> 0) >= 2), cv AS (SELECT s, dst AS k FROM ed GROUP BY 1, 2 HAVING count(*) >= 2 AND dst % 6 <> 0),
cd AS (SELECT DISTINCT s, src AS k FROM ed WHERE src % 8 = 0 AND s % 4 <> 0 AND dst % 6 <> 0),
w(s, src, dst) AS (SELECT s, src, dst FROM ed WHERE src % 6 <> 0 UNION SELECT w.s, w.src, ed.dst FROM w JOIN ed ON ed.s = w.s AND ed.src = w.dst WHERE w.dst % 6 = 0), e AS (SELECT DISTINCT s, src, dst FROM w WHERE dst % 6 <> 0 AND src <> dst),
t AS (SELECT e.*, cd.k IS NOT NULL AS c, br.k IS NOT NULL AS b, cv.k IS NOT NULL AS v FROM e LEFT JOIN cd ON cd.s = e.s AND cd.k = e.src LEFT JOIN br ON br.s = e.s AND br.k = e.src LEFT JOIN cv ON cv.s = e.s AND cv.k = e.dst),
r AS (SELECT s, 'x-procedure' AS source, CASE WHEN c THEN 'attack-condition' ELSE 'attack-operator' END AS target, 'p' || src AS a, 'l' || src AS z FROM t WHERE c OR b
  UNION SELECT s, CASE WHEN c THEN 'attack-condition' WHEN b THEN 'attack-operator' ELSE 'x-procedure' END, CASE WHEN v THEN 'attack-operator' ELSE 'x-procedure' END, CASE WHEN c OR b THEN 'l' ELSE 'p' END || src, CASE WHEN v THEN 'v' ELSE 'p' END || dst FROM t
  UNION SELECT s, 'attack-operator', 'x-procedure', 'v' || dst, 'p' || dst FROM t WHERE v)
SELECT s AS source_id, source, target, count(*) AS n FROM r GROUP BY 1, 2, 3
"""


def chunk_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Turns as chunks of their conversation that say the same, by words or by names; numbers of pairs, and of shared words."""
    c = table(spark, d, "conversations")
    chunks = c.select(F.col("conv_id").alias("source_id"), F.col("turn").cast("string").alias("chunk_id"), "text", F.array(F.concat(F.lit("M"), (F.col("turn") % 2).cast("string"))).alias("malware"), F.array(F.col("role"), F.lit("all")).alias("tools"), F.lit(None).cast("string").alias("target"))
    chunks = chunks.dropDuplicates(["source_id", "chunk_id"])
    found = K.overlaps(chunks)
    return found.select("source_id", "chunk_id", "other", "score", "detection", F.array_join("shared_entities", ",").alias("entities"))


def section_texts(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut into the lines of raw ranges, some turned round, overlapping or beyond the end; sections joined again but for one kind."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    n = F.size(F.split("text", "\n"))
    pieces = F.array(F.struct(F.lit(1).alias("first"), F.lit(3).alias("last"), F.lit("a").alias("kind")), F.struct(F.lit(6).alias("first"), F.lit(2).alias("last"), F.lit("b").alias("kind")), F.struct((n - 1).alias("first"), (n + 5).alias("last"), F.lit("c").alias("kind")))
    raw = docs.select("doc", F.explode(pieces).alias("p")).select("doc", "p.*")
    sections = K.line_sections(docs, raw)
    return K.text_without(docs, sections, ["b"]).select("doc", F.md5("text").alias("text_hash"))


SECTION_TEXTS = r"""
WITH l AS (SELECT doc_id AS doc, text, string_split(text, chr(10)) AS l FROM documents), n AS (SELECT *, len(l) AS n FROM l),
r AS (SELECT doc, 1 AS f, least(3, n) AS t, 'a' AS kind FROM n UNION ALL SELECT doc, 2, least(6, n), 'b' FROM n WHERE n >= 2 UNION ALL SELECT doc, greatest(n - 1, 1), n, 'c' FROM n),
c AS (SELECT doc, kind, greatest(f, coalesce(max(t) OVER (PARTITION BY doc ORDER BY f, t, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, f)) AS f, t FROM r),
s AS (SELECT doc, kind, f, array_to_string(n.l[f:t], chr(10)) AS x FROM c JOIN n USING (doc) WHERE f <= t),
k AS (SELECT doc, string_agg(x, chr(10) || chr(10) ORDER BY f, x) AS x FROM s WHERE kind <> 'b' AND regexp_matches(x, '[^ \t\n\x0B\f\r]') GROUP BY 1)
SELECT l.doc, md5(coalesce(nullif(k.x, ''), l.text)) AS text_hash FROM l LEFT JOIN k USING (doc)
"""


def _entities(spark: SparkSession, d: str) -> DataFrame:
    """Per nation (a source): its suppliers as clusters, tools and malware, some of its customers as victims."""
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    kind = F.element_at(F.array(F.lit("intrusion_set"), F.lit("tool"), F.lit("malware"), F.lit("threat_actor"), F.lit("campaign")), (F.col("s_suppkey") % 5 + 1).cast("int"))
    text = lambda col: F.col(col).cast("string")
    one = s.select(
        F.col("s_nationkey").cast("long").alias("source_id"), F.concat(F.lit("e"), text("s_suppkey")).alias("entity_id"), F.col("s_suppkey").alias("position"), kind.alias("entity_type"), F.col("s_name").alias("value"), F.when(F.col("s_suppkey") % 7 == 0, F.concat(F.lit("X"), text("s_suppkey"))).alias("edited_value"),
        F.lit(None).cast("string").alias("edited_type"), F.when(F.col("s_suppkey") % 11 == 0, "remove").alias("gate_action"), (F.col("s_acctbal") / 10000).alias("confidence"), F.lit(None).cast("string").alias("organization_role"), F.lit(None).cast("string").alias("location_role"),
        F.when(F.col("s_suppkey") % 10 == 0, F.array(F.concat(F.lit(" SUPPLIER#"), F.lpad((F.col("s_suppkey") + 3).cast("string"), 9, "0")))).alias("attributed_to"), F.lit(True).alias("is_maas"), F.concat(F.lit("id--"), text("s_suppkey")).alias("stix_id"),
    )
    two = c.where("c_acctbal < 0").select(
        F.col("c_nationkey").cast("long").alias("source_id"), F.concat(F.lit("v"), text("c_custkey")).alias("entity_id"), (F.col("c_custkey") + 1_000_000).alias("position"), F.when(F.col("c_custkey") % 2 == 0, "organization").otherwise("location").alias("entity_type"), F.col("c_name").alias("value"), F.lit(None).cast("string").alias("edited_value"),
        F.lit(None).cast("string").alias("edited_type"), F.lit(None).cast("string").alias("gate_action"), F.lit(0.9).alias("confidence"), F.when(F.col("c_custkey") % 4 == 0, "victim").otherwise("publisher").alias("organization_role"), F.when(F.col("c_custkey") % 3 == 0, "victim").alias("location_role"),
        F.lit(None).cast("array<string>").alias("attributed_to"), F.lit(False).alias("is_maas"), F.concat(F.lit("idv--"), text("c_custkey")).alias("stix_id"),
    )
    return one.unionByName(two)


def _procedures(spark: SparkSession, d: str) -> DataFrame:
    """Per customer a procedure of its nation: a technique by its segment, tools and actors by name."""
    c = table(spark, d, "customer")
    name = lambda k: F.concat(F.lit("supplier#"), F.lpad(k.cast("string"), 9, "0"))
    key = F.col("c_custkey")
    tech = F.struct(F.lit("T1").alias("technique_id"), F.lit("t").alias("technique_name"), F.lit("execution").alias("tactic"), F.concat(F.lit("attack-pattern--"), F.col("c_mktsegment")).alias("stix_id"))
    return c.select(
        F.col("c_nationkey").cast("long").alias("source_id"), F.concat(F.lit("d"), key.cast("string")).alias("draft_id"), F.lit("c").alias("chunk_id"), key.alias("position"), F.col("c_name").alias("name"), F.concat(F.lit("x-procedure--"), key.cast("string")).alias("stix_id"), F.array(tech).alias("techniques"),
        F.when(key % 6 == 0, F.array(F.concat(F.lit("process--"), key.cast("string")), F.lit(""))).otherwise(F.array().cast(_NONE)).alias("components_refs"), F.array().cast(_NONE).alias("observable_refs"),
        F.when(key % 9 == 0, F.array(F.lit("vulnerability--1"))).otherwise(F.array().cast(_NONE)).alias("vulnerability_refs"), F.array(name(key % 100), F.lit(" ")).alias("attributed_actors"), F.array(name(key % 50 + 1)).alias("malware_used"), F.array(F.upper(name(key % 70 + 1)), name(key % 70 + 1)).alias("tools_used"),
    )


def source_relationships(spark: SparkSession, d: str) -> DataFrame:
    """All relationships of the sources, counted by verb and kinds of ends."""
    found = R.relationships(_procedures(spark, d), _entities(spark, d))
    kind = lambda c: F.substring_index(c, "--", 1)
    return found.groupBy("source_id", "verb", kind(F.col("source_ref")).alias("source"), kind(F.col("target_ref")).alias("target")).agg(F.count("*").alias("n"))


_RELS = """en AS (SELECT s_nationkey::BIGINT AS s, 'id--' || s_suppkey AS id, s_suppkey AS k, ['intrusion_set', 'tool', 'malware', 'threat_actor', 'campaign'][s_suppkey % 5 + 1] AS t,
  CASE WHEN s_suppkey % 7 = 0 THEN 'x' || s_suppkey ELSE lower(s_name) END AS name, s_acctbal / 10000 AS conf FROM supplier WHERE s_suppkey % 11 <> 0),
vi AS (SELECT c_nationkey::BIGINT AS s, 'idv--' || c_custkey AS id, c_custkey AS k FROM customer WHERE c_acctbal < 0),
pr AS (SELECT c_nationkey::BIGINT AS s, c_custkey AS k, 'x-procedure--' || c_custkey AS id, 'attack-pattern--' || c_mktsegment AS tech, 'supplier#' || lpad((c_custkey % 100)::VARCHAR, 9, '0') AS actor,
  'supplier#' || lpad((c_custkey % 50 + 1)::VARCHAR, 9, '0') AS mal, 'supplier#' || lpad((c_custkey % 70 + 1)::VARCHAR, 9, '0') AS tool FROM customer),
one AS (SELECT s, min(id) AS id FROM en WHERE t = 'intrusion_set' GROUP BY 1 HAVING count(*) = 1),
act AS (SELECT pr.s, pr.k, pr.id AS p, en.id AS a FROM pr JOIN en ON en.s = pr.s AND en.t = 'intrusion_set' AND en.name = pr.actor
  UNION SELECT pr.s, pr.k, pr.id, one.id FROM pr JOIN one USING (s) WHERE NOT EXISTS (SELECT 1 FROM en WHERE en.s = pr.s AND en.t = 'intrusion_set' AND en.name = pr.actor)),
us AS (SELECT s, k, id AS p, tech AS r FROM pr UNION SELECT pr.s, pr.k, pr.id, en.id FROM pr JOIN en ON en.s = pr.s AND (en.t = 'malware' AND en.name = pr.mal OR en.t = 'tool' AND en.name = pr.tool)),
ta AS (SELECT i.s, i.id AS a, e.id AS r FROM en i JOIN en e ON e.s = i.s AND e.t = 'threat_actor' AND i.k % 10 = 0 AND e.name = 'supplier#' || lpad((i.k + 3)::VARCHAR, 9, '0') WHERE i.t = 'intrusion_set'),
re AS (SELECT s, p AS a, 'uses' AS v, r AS b FROM us UNION SELECT s, 'process--' || k, 'component-of', id FROM pr WHERE k % 6 = 0
  UNION SELECT s, id, 'exploits', 'vulnerability--1' FROM pr WHERE k % 9 = 0 UNION SELECT s, a, 'uses', p FROM act
  UNION SELECT c.s, c.id, 'attributed-to', i.id FROM en c JOIN en i ON i.s = c.s AND i.t = 'intrusion_set' AND (i.conf >= 0.8 OR NOT EXISTS (SELECT 1 FROM en m WHERE m.s = c.s AND m.t = 'malware')) WHERE c.t = 'campaign'
  UNION SELECT s, a, 'attributed-to', r FROM ta
  UNION SELECT one.s, one.id, 'attributed-to', e.id FROM one JOIN en e ON e.s = one.s AND e.t = 'threat_actor' WHERE (SELECT count(*) FROM en x WHERE x.s = one.s AND x.t = 'threat_actor') = 1 AND one.id NOT IN (SELECT a FROM ta)
  UNION SELECT i.s, i.id, 'targets', vi.id FROM en i JOIN vi USING (s) WHERE i.t = 'intrusion_set' AND vi.k % 4 = 0
  UNION SELECT i.s, i.id, 'targets', vi.id FROM en i JOIN vi USING (s) WHERE i.t IN ('intrusion_set', 'campaign') AND vi.k % 2 = 1 AND vi.k % 3 = 0
  UNION SELECT act.s, act.a, 'uses', us.r FROM act JOIN us ON us.s = act.s AND us.k = act.k UNION SELECT c.s, c.id, 'uses', us.r FROM en c JOIN us USING (s) WHERE c.t = 'campaign'
  UNION SELECT e.s, e.id, 'exploits', 'vulnerability--1' FROM en e JOIN pr USING (s) WHERE e.t IN ('intrusion_set', 'campaign') AND pr.k % 9 = 0)"""
SOURCE_RELATIONSHIPS = f"""
WITH {_RELS} SELECT s AS source_id, v AS verb, split_part(a, '--', 1) AS source, split_part(b, '--', 1) AS target, count(*) AS n FROM re GROUP BY 1, 2, 3, 4
"""


def analyst_rows(spark: SparkSession, d: str) -> DataFrame:
    """Relationships after the analyst: rows removed from the preview by what they say, rows added by name with and without types."""
    procs, ents = _procedures(spark, d), _entities(spark, d)
    names = saved(R.name_index(procs, ents), "names")
    edges = saved(R.relationships(procs, ents), "relationships")
    # Rows are numbered among those that say the same, verb included, so the others' ids aren't needed for those of one verb.
    shown = saved(R.preview(edges.where("verb = 'uses'"), names), "preview")
    gone = shown.where("verb = 'uses' and source_type = 'campaign' and target_type = 'attack-pattern'").select("source_id", "id")
    kept = R.without_removed(edges, shown, gone)
    c = table(spark, d, "customer")
    rows = c.select(
        F.col("c_nationkey").cast("long").alias("source_id"), F.col("c_custkey").alias("row"), F.upper("c_name").alias("source_name"), F.when(F.col("c_custkey") % 2 == 0, "x-procedure").alias("source_type"), F.when(F.col("c_custkey") % 5 > 0, "Related-To").alias("verb"),
        F.concat(F.lit("Customer#"), F.lpad((F.col("c_custkey") - F.col("c_custkey") % 3).cast("string"), 9, "0")).alias("target_name"), F.lit("x-procedure").alias("target_type"),
    )
    new, skipped = R.added(rows, names, kept)
    n = lambda df, what: df.groupBy("source_id").agg(F.count("*").alias("n")).withColumn("what", F.lit(what))
    return n(kept, "kept").unionByName(n(new, "new")).unionByName(n(skipped, "skipped"))


ANALYST_ROWS = f"""
WITH {_RELS}, nm AS (SELECT s, lower('Customer#' || lpad(k::VARCHAR, 9, '0')) AS name, 'x-procedure' AS t, id FROM pr UNION ALL SELECT s, lower('Customer#' || lpad(k::VARCHAR, 9, '0')), CASE WHEN k % 2 = 0 THEN 'identity' ELSE 'location' END, id FROM vi),
ro AS (SELECT c_nationkey::BIGINT AS s, c_custkey AS row, lower(c_name) AS sn, c_custkey % 2 = 0 AS typed, c_custkey % 5 > 0 AS has, lower('Customer#' || lpad((c_custkey - c_custkey % 3)::VARCHAR, 9, '0')) AS tn FROM customer),
f AS (SELECT ro.*, (SELECT min(id) FROM nm WHERE nm.s = ro.s AND nm.name = sn AND CASE WHEN typed THEN t = 'x-procedure' ELSE (SELECT count(*) FROM nm x WHERE x.s = ro.s AND x.name = sn) = 1 END) AS a, (SELECT min(id) FROM nm WHERE nm.s = ro.s AND nm.name = tn AND t = 'x-procedure') AS b FROM ro),
g AS (SELECT *, coalesce(has AND a <> b, false) AS ok FROM f)
SELECT s AS source_id, count(*) AS n, 'kept' AS what FROM re WHERE NOT (v = 'uses' AND a IN (SELECT id FROM en WHERE t = 'campaign') AND b LIKE 'attack-pattern%') GROUP BY 1
UNION ALL SELECT s, count(DISTINCT (a, b)), 'new' FROM g WHERE ok GROUP BY 1 UNION ALL SELECT s, count(*), 'skipped' FROM g WHERE NOT ok GROUP BY 1
"""


def draft_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Drafts of orders: names that the text evidences, phases of the picks in order, confidence cut off; then the analyst's edits."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    text = lambda c: F.col(c).cast("string")
    chunks = o.where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("source_id"), text("o_orderkey").alias("chunk_id"), F.concat_ws(" ", "o_orderpriority", F.lit("Mimikatz")).alias("text"), F.lit("").alias("source_excerpt"), F.lit(1).alias("sequence_index"), (F.col("o_totalprice") % 100 / 100).alias("behavioral_confidence"))
    none = F.array().cast(_NONE)
    raw = o.select(F.col("o_custkey").alias("source_id"), F.lit(0).alias("position"), text("o_orderkey").alias("chunk_id"), F.lit("n").alias("name"), F.lit("uses Cobalt").alias("description"), none.alias("platforms"), F.array(F.lit("mimikatz "), F.lit("cobalt"), F.lit("nmap"), F.lit("")).alias("tools_used"), none.alias("malware_used"), none.alias("attributed_actors"), F.array(F.substring("o_orderpriority", 1, 4), F.lit("zzz")).alias("command_lines"))
    picks = li.groupBy(text("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("position")).agg(F.min("l_partkey").alias("p"), F.min("l_returnflag").alias("tactic"))
    picks = picks.select("chunk_id", "position", F.concat(F.lit("T"), text("p")).alias("technique_id"), F.lit("t").alias("technique_name"), "tactic", F.concat(F.lit("attack-pattern--"), text("p")).alias("stix_id"))
    made = D.assembled(raw, chunks, picks)
    edits = made.where("cast(chunk_id as long) % 4 = 0").select("draft_id", F.lit("edit").alias("action"), F.lit("new").alias("name"))
    out = D.edited(made, edits)
    return out.select("chunk_id", "name", "gate_action", F.array_join("tools_used", ",").alias("tools"), F.size("raw_command_lines").alias("commands"), F.coalesce(F.size("techniques"), F.lit(-1)).alias("techniques"), F.array_join("phases", ",").alias("phases"), "confidence")


DRAFT_ASSEMBLY = """
WITH p AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS t FROM lineitem GROUP BY 1, 2),
f AS (SELECT l_orderkey, t, min(l_linenumber) AS pos FROM p GROUP BY 1, 2), g AS (SELECT l_orderkey, string_agg(t, ',' ORDER BY pos) AS phases FROM f GROUP BY 1), n AS (SELECT l_orderkey, count(*) AS n FROM p GROUP BY 1)
SELECT o_orderkey::VARCHAR AS chunk_id, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE 'n' END AS name, CASE WHEN o_orderkey % 4 = 0 THEN 'edit' ELSE 'approve' END AS gate_action, 'mimikatz ,cobalt' AS tools, 1 AS commands,
  coalesce(n, -1)::INT AS techniques, coalesce(phases, '') AS phases, trunc(o_totalprice % 100 / 100 * 100)::INT AS confidence
FROM orders LEFT JOIN g ON g.l_orderkey = o_orderkey LEFT JOIN n ON n.l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'
"""


def odd_values(spark: SparkSession, d: str) -> DataFrame:
    """Places, commands, addresses, parameters, titles and JSON in many forms."""
    e, k, u = table(spark, d, "events"), F.col("event_id"), F.col("user_id").cast("string")
    pick = lambda *forms: F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else x for x in forms]), (k % len(forms) + 1).cast("int"))
    region = pick("South_Eastern  Asia", "emea", "France", " EUROPE ", "Middle-East", "asiapacific", "")
    command = pick(F.concat(F.lit("C:\\Tools\\a"), u, F.lit(".exe -x /y")), F.concat(F.lit("/usr/bin/b"), u, F.lit(" -q")), " ", F.concat(F.lit("net user "), u))
    address = pick(F.concat(F.lit("10.0.0."), u), F.concat(F.lit("[10.0.0."), u, F.lit("]:443")), F.lit("2001:DB8:0:0::1"), F.lit("[::1]:80"), F.lit("10.0.0.1:2967"), F.lit("a:b:c"), F.lit("300.1.1.1"))
    ip = V.ip_address(address)
    body = pick(F.col("props"), F.lit('{"p": "C:\\Windows"}'), F.concat(F.col("props"), F.lit(" and more")))
    read = V.lenient_json(body)
    title = V.display_title(pick("Untitled Source", " A ", ""), F.when(k % 2 == 0, F.col("event_type")), "none")
    parameter = V.unwrapped_parameter(pick(F.concat(F.lit(' <parameter name="x">'), u, F.lit("</parameter> ")), u))
    return e.select("event_id", V.is_region(region).alias("region"), V.executable(command).alias("exe"), ip["kind"].alias("kind"), ip["address"].alias("address"), read["repaired"].alias("repaired"), (read["discarded"] > 0).alias("cut"), title.alias("title"), parameter.alias("parameter"))


ODD_VALUES = r"""
SELECT event_id, event_id % 7 IN (0, 1, 3, 4, 5) AS region, [('a' || user_id || '.exe'), ('b' || user_id), NULL, 'net'][event_id % 4 + 1] AS exe,
  CASE event_id % 7 WHEN 2 THEN 'ipv6-addr' WHEN 3 THEN 'ipv6-addr' WHEN 4 THEN 'ipv4-addr' WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE CASE WHEN user_id <= 255 THEN 'ipv4-addr' END END AS kind,
  CASE event_id % 7 WHEN 2 THEN '2001:db8::1' WHEN 3 THEN '::1' WHEN 4 THEN '10.0.0.1' WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE CASE WHEN user_id <= 255 THEN '10.0.0.' || user_id END END AS address,
  event_id % 3 > 0 AS repaired, event_id % 3 = 2 AS cut, CASE WHEN event_id % 3 = 1 THEN 'A' WHEN event_id % 2 = 0 THEN event_type ELSE 'none' END AS title, user_id::VARCHAR AS parameter FROM events
"""

def process_images(spark: SparkSession, d: str) -> DataFrame:
    """Command lines of events with the files of the same user that they were started from."""
    e, u = table(spark, d, "events"), F.col("user_id").cast("string")
    command = F.element_at(F.array(F.concat(F.lit("C:\\\\bin\\\\"), F.upper("event_type"), F.lit(".EXE -x")), F.concat(F.col("event_type"), F.lit(" /q")), F.concat(F.lit("/opt/run"), u)), (F.col("event_id") % 3 + 1).cast("int"))
    commands = e.select(F.col("user_id").alias("source_id"), command.alias("command_line")).distinct()
    files = e.where("value > 25").select(F.col("user_id").alias("source_id"), F.concat(F.lit(" "), F.col("event_type"), F.lit(".exe")).alias("name"), F.concat(F.lit("file--"), F.col("event_type")).alias("stix_id"))
    return D.process_objects(commands, files).select("source_id", "command_line", "image_ref", "exe_name")


PROCESS_IMAGES = r"""
WITH f AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 25),
c AS (SELECT DISTINCT user_id, event_type, event_id % 3 AS k, ['C:\\bin\\' || upper(event_type) || '.EXE -x', event_type || ' /q', '/opt/run' || user_id][event_id % 3 + 1] AS l FROM events)
SELECT DISTINCT c.user_id AS source_id, l AS command_line, CASE WHEN k < 2 AND f.user_id IS NOT NULL THEN 'file--' || c.event_type END AS image_ref,
  CASE WHEN k = 2 THEN 'run' || c.user_id WHEN f.user_id IS NULL THEN CASE WHEN k = 0 THEN upper(c.event_type) || '.EXE' ELSE c.event_type END END AS exe_name FROM c LEFT JOIN f ON f.user_id = c.user_id AND f.event_type = c.event_type
"""


def draft_scores(spark: SparkSession, d: str) -> DataFrame:
    """Completeness, composite confidence and fingerprint of approved drafts (orders that are not pending)."""
    o = table(spark, d, "orders")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("l_partkey")).alias("p"), F.array_sort(F.collect_set("l_returnflag")).alias("f"))
    told = o.join(lines, "o_orderkey", "left")
    tech = F.transform(F.coalesce("p", F.array().cast("array<bigint>")), lambda p: F.struct(F.lit("").alias("stix_id"), p.cast("string").alias("technique_id")))
    none = F.array().cast(_NONE)
    drafts = told.select(
        F.col("o_custkey").alias("source_id"), F.col("o_orderkey").cast("string").alias("draft_id"), F.repeat("o_orderpriority", (F.col("o_orderkey") % 15).cast("int")).alias("description"), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("c"))).otherwise(none).alias("raw_command_lines"), tech.alias("techniques"),
        F.when(F.col("o_orderkey") % 3 == 0, "2024").alias("first_observed"), none.alias("source_refs"), F.coalesce("f", none).alias("platforms"), (F.col("o_orderstatus") == "F").alias("detail_gap"), (F.col("o_custkey") % 101).cast("int").alias("confidence"), F.array("o_orderstatus").alias("phases"),
    )
    sources = table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), F.when(F.col("c_custkey") % 5 > 0, (F.col("c_custkey") % 101).cast("int")).alias("source_reliability"))
    return D.normalised(drafts, o.where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").cast("string").alias("draft_id")), sources)


DRAFT_SCORES = """
WITH l AS (SELECT l_orderkey, list(DISTINCT l_partkey) AS p, list(DISTINCT l_returnflag) AS f FROM lineitem GROUP BY 1),
o AS (SELECT orders.*, coalesce(p, []) AS p, coalesce(f, []) AS f, length(o_orderpriority) * (o_orderkey % 15) AS w FROM orders LEFT JOIN l ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'),
c AS (SELECT *, least(100, CASE WHEN w > 100 THEN 25 WHEN w > 30 THEN 15 WHEN w > 0 THEN 5 ELSE 0 END + CASE WHEN o_orderkey % 2 = 0 THEN 25 ELSE 0 END + CASE WHEN len(p) >= 1 THEN 15 ELSE 0 END + CASE WHEN len(p) >= 2 THEN 5 ELSE 0 END
  + CASE WHEN o_orderkey % 3 = 0 THEN 10 ELSE 0 END + CASE WHEN len(f) > 0 THEN 5 ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 5 END) AS c FROM o)
SELECT o_custkey AS source_id, o_orderkey::VARCHAR AS draft_id, c::INT AS completeness, trunc(0.30::DOUBLE * (CASE WHEN o_custkey % 5 > 0 THEN o_custkey % 101 ELSE 50 END) + 0.25::DOUBLE * c + 0.45::DOUBLE * (o_custkey % 101))::INT AS composite_confidence,
  substr(sha256(array_to_string(list_sort(list_transform(p, lambda x: 'attack-pattern--' || x)), '|') || '::' || array_to_string(list_sort(f), '|') || '::' || o_orderstatus), 1, 32) AS fingerprint FROM c
"""


def mirrored_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that take the order of their approved drafts: every third one follows two that stand before it."""
    c = _chunks(spark, d).drop("o_orderkey")
    drafts = c.where("sequence_index % 3 = 0").select("source_id", "chunk_id", "sequence_index", F.array(F.col("sequence_index") - 1, F.col("sequence_index") - 2, F.col("sequence_index")).alias("predecessor_indices"), F.lit(False).alias("chain_root"), F.lit("m").alias("chain_label"))
    out = K.mirrored(c, drafts)
    return out.select("source_id", "chunk_id", F.array_join(F.col("predecessor_indices").cast(_NONE), ",").alias("before"), F.size("precedes_ids").alias("n_next"), F.coalesce("chain_label", F.lit("")).alias("label"))


MIRRORED_CHUNKS = f"""
WITH {_CHUNKS}, e AS (SELECT ed.s, a.i AS src, b.i AS dst FROM ed JOIN ch a ON a.s = ed.s AND a.k = ed.src JOIN ch b ON b.s = ed.s AND b.k = ed.dst WHERE b.i % 3 > 0 UNION SELECT s, i - 1, i FROM ch WHERE i % 3 = 0 UNION SELECT s, i - 2, i FROM ch WHERE i % 3 = 0)
SELECT ch.s AS source_id, 'c' || k AS chunk_id, coalesce((SELECT string_agg(src::VARCHAR, ',' ORDER BY src) FROM e WHERE e.s = ch.s AND e.dst = ch.i), '') AS before, (SELECT count(*) FROM e WHERE e.s = ch.s AND e.src = ch.i)::INT AS n_next,
  CASE WHEN i % 3 = 0 THEN 'm' WHEN i = 1 OR k % 9 = 0 THEN 'L' || i ELSE '' END AS label FROM ch
"""


def detection_nodes(spark: SparkSession, d: str) -> DataFrame:
    """What detects techniques (parts): suppliers as strategies, their nations as analytics, regions as log sources; steps may be missing."""
    p, li, s, n = (table(spark, d, t) for t in ("part", "lineitem", "supplier", "nation"))
    techniques = p.select(F.col("p_partkey").alias("technique_id"))
    strategies = li.select(F.col("l_partkey").alias("technique_id"), F.col("l_suppkey").alias("strategy_id")).distinct()
    analytics = s.where("s_acctbal > 0").select(F.col("s_suppkey").alias("strategy_id"), F.col("s_nationkey").alias("analytic_id"))
    logs = n.where("n_regionkey < 3").select(F.col("n_nationkey").alias("analytic_id"), F.col("n_regionkey").alias("log_source_id"))
    components = table(spark, d, "region").where("r_regionkey = 1").select(F.col("r_regionkey").alias("log_source_id"), F.col("r_name").alias("component_id"))
    nodes, edges = R.detection_chain(techniques, strategies, analytics, logs, components)
    return nodes.groupBy(F.col("label").alias("what")).agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.col("verb").alias("what")).agg(F.count("*").alias("n")))


DETECTION_NODES = """
WITH c AS (SELECT DISTINCT p_partkey AS t, l_suppkey AS s, n1.n AS a, n_regionkey AS l, r_name AS c FROM part LEFT JOIN lineitem ON l_partkey = p_partkey LEFT JOIN (SELECT s_suppkey, s_nationkey AS n FROM supplier WHERE s_acctbal > 0) n1 ON s_suppkey = l_suppkey
  LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON n_nationkey = n1.n LEFT JOIN (SELECT * FROM region WHERE r_regionkey = 1) r ON r_regionkey = n_regionkey)
SELECT * FROM (SELECT 'detection-strategy' AS what, count(DISTINCT s) AS n FROM c UNION ALL SELECT 'analytic', count(DISTINCT a) FROM c UNION ALL SELECT 'log-source', count(DISTINCT l) FROM c UNION ALL SELECT 'data-component', count(DISTINCT c) FROM c
UNION ALL SELECT 'detects', count(DISTINCT (s, t)) FROM c WHERE s IS NOT NULL UNION ALL SELECT 'uses-analytic', count(DISTINCT (s, a)) FROM c WHERE a IS NOT NULL UNION ALL SELECT 'reads', count(DISTINCT (a, l)) FROM c WHERE l IS NOT NULL UNION ALL SELECT 'provides', count(DISTINCT (l, c)) FROM c WHERE c IS NOT NULL) WHERE n > 0
"""


def parsed_sources(spark: SparkSession, d: str) -> DataFrame:
    """Pages, documents and a type that nothing reads, by source type."""
    pages = table(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("source_id"), F.lit("html").alias("source_type"), F.encode("html", "UTF-8").alias("content"))
    docs = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_id"), F.when(F.col("doc_id") % 5 == 0, "pdf").otherwise("markdown").alias("source_type"), F.encode("text", "UTF-8").alias("content"))
    found = tables.parsed(pages.unionByName(docs))
    return found.select("source_id", "status", F.md5("parsed_text").alias("text_hash"), F.size("warnings").alias("warnings"))


PARSED_SOURCES = r"""
WITH t AS (SELECT 'p' || page_id AS id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS x FROM pages
  UNION ALL SELECT 'd' || doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END FROM documents), g AS (SELECT *, length(trim(x, ' ')) >= 10 AS ok, len(regexp_extract_all(x, '[^ \t\n\x0B\f\r]+')) AS n FROM t)
SELECT id AS source_id, CASE WHEN ok THEN 'parsed' ELSE 'failed' END AS status, md5(CASE WHEN ok THEN x ELSE '' END) AS text_hash, CASE WHEN NOT ok OR n < 50 THEN 1 ELSE 0 END AS warnings FROM g
"""


def schema_violations(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of two types against what their schemas ask for."""
    known = {
        "order": {"required": ["id", "status"], "properties": {"id": {"type": "string"}, "type": {}, "status": {"enum": ["O", "F"]}, "price": {"type": "number"}}, "additionalProperties": False},
        "note": {"required": ["text"], "properties": {"text": {"type": "string"}}},
    }
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    body = F.to_json(F.struct(
        k.cast("string").alias("id"), F.when(k % 3 == 0, "note").when(k % 3 == 1, "order").otherwise("free").alias("type"), F.when(k % 5 > 0, F.col("o_orderstatus")).alias("status"),
        F.when(k % 7 == 0, "dear").otherwise(F.floor("o_totalprice").cast("string")).alias("price"), F.when(k % 2 == 0, "x").alias("extra"),
    ))
    return schemas.schema_errors(o.select(F.col("o_custkey").alias("bundle"), k.alias("position"), body.alias("body")), known)


SCHEMA_VIOLATIONS = """
SELECT o_custkey AS bundle, o_orderkey::VARCHAR AS id, 'note' AS type, 'missing:text' AS error FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_custkey, o_orderkey::VARCHAR, 'order', 'missing:status' FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 5 = 0 UNION ALL SELECT o_custkey, o_orderkey::VARCHAR, 'order', 'value:status' FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 5 > 0 AND o_orderstatus = 'P'
UNION ALL SELECT o_custkey, o_orderkey::VARCHAR, 'order', 'type:price' FROM orders WHERE o_orderkey % 3 = 1 UNION ALL SELECT o_custkey, o_orderkey::VARCHAR, 'order', 'unknown:extra' FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 2 = 0
"""

def nested_schema_violations(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of orders with their lines against a schema with references, alternatives, items, patterns and formats."""
    known = {"order": {
        "definitions": {
            "line": {"type": "object", "required": ["part", "how"], "properties": {"part": {"type": "integer", "minimum": 100}, "how": {"type": "string", "pattern": "^[AN]", "maxLength": 7}}, "additionalProperties": {"type": "string"}},
            "name": {"type": "string", "minLength": 1},
        },
        "required": ["id"],
        "allOf": [{"properties": {"id": {"type": "string", "pattern": "^order--[0-9]+$"}}}],
        "properties": {
            "lines": {"type": "array", "minItems": 2, "maxItems": 6, "uniqueItems": True, "items": {"$ref": "#/definitions/line"}},
            "when": {"type": "string", "format": "date-time"},
            "buyer": {"anyOf": [{"$ref": "#/definitions/name"}, {"type": "integer", "maximum": 500}]},
            "priority": {"oneOf": [{"pattern": "^1"}, {"pattern": "URGENT$"}, {"pattern": "^5"}]},
            "status": {"not": {"const": "P"}},
        },
    }}
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    line = F.struct(F.col("l_partkey").alias("part"), F.when(F.col("l_linenumber") % 3 > 0, F.concat("l_returnflag", F.when(F.col("l_quantity") > 48, "-------").otherwise(""))).alias("how"), F.when(F.col("l_quantity") > 45, F.lit(1)).alias("extra"))
    lines = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    body = F.to_json(F.struct(
        F.concat(F.when(k % 11 == 0, "x").otherwise("order--"), k.cast("string")).alias("id"), F.lit("order").alias("type"), "lines", F.concat(day, F.when(k % 4 == 0, "T25:00:00Z").otherwise("T05:00:00.5Z")).alias("when"),
        F.col("o_custkey").alias("buyer"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"),
    ))
    return schemas.schema_errors(o.join(lines, "o_orderkey").select(F.col("o_custkey").alias("bundle"), k.alias("position"), body.alias("body")), known, formats=True)


NESTED_SCHEMA_VIOLATIONS = """
WITH o AS (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE 'order--' END || o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
h AS (SELECT *, CASE WHEN l_linenumber % 3 > 0 THEN l_returnflag || CASE WHEN l_quantity > 48 THEN '-------' ELSE '' END END AS how FROM lineitem),
li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, how NULLS FIRST, l_quantity > 45) - 1 AS nth FROM h),
n AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT (l_partkey, coalesce(how, ''), l_quantity > 45)) AS different FROM li GROUP BY 1),
e AS (
SELECT o_orderkey AS k, 'pattern:id' AS error FROM o WHERE o_orderkey % 11 = 0
UNION ALL SELECT o_orderkey, 'format:when' FROM o WHERE o_orderkey % 4 = 0
UNION ALL SELECT o_orderkey, 'no_match:buyer' FROM o WHERE o_custkey > 500
UNION ALL SELECT o_orderkey, 'no_match:priority' FROM o WHERE NOT (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '%URGENT' OR o_orderpriority LIKE '5%')
UNION ALL SELECT o_orderkey, 'several:priority' FROM o WHERE o_orderpriority LIKE '1%URGENT'
UNION ALL SELECT o_orderkey, 'forbidden:status' FROM o WHERE o_orderstatus = 'P'
UNION ALL SELECT l_orderkey, 'short:lines' FROM n WHERE n < 2
UNION ALL SELECT l_orderkey, 'long:lines' FROM n WHERE n > 6
UNION ALL SELECT l_orderkey, 'repeated:lines' FROM n WHERE different < n
UNION ALL SELECT l_orderkey, 'small:lines/' || nth || '/part' FROM li WHERE l_partkey < 100
UNION ALL SELECT l_orderkey, 'missing:lines/' || nth || '/how' FROM li WHERE l_linenumber % 3 = 0
UNION ALL SELECT l_orderkey, 'long:lines/' || nth || '/how' FROM li WHERE length(how) > 7
UNION ALL SELECT l_orderkey, 'pattern:lines/' || nth || '/how' FROM li WHERE NOT regexp_matches(how, '^[AN]')
UNION ALL SELECT l_orderkey, 'type:lines/' || nth || '/extra' FROM li WHERE l_quantity > 45)
SELECT o_custkey AS bundle, id, 'order' AS type, error FROM e JOIN o ON o_orderkey = k
"""

QUERIES = {f.__name__: (f, sql) for f, sql in (
    (chunk_shapes, CHUNK_SHAPES), (chain_labels, CHAIN_LABELS), (chunk_decisions, CHUNK_DECISIONS), (chunk_operators, CHUNK_OPERATORS), (chunk_overlaps, None), (section_texts, SECTION_TEXTS),
    (source_relationships, SOURCE_RELATIONSHIPS), (analyst_rows, ANALYST_ROWS), (draft_assembly, DRAFT_ASSEMBLY), (odd_values, ODD_VALUES),
    (process_images, PROCESS_IMAGES), (draft_scores, DRAFT_SCORES), (mirrored_chunks, MIRRORED_CHUNKS), (detection_nodes, DETECTION_NODES), (parsed_sources, PARSED_SOURCES), (schema_violations, SCHEMA_VIOLATIONS), (nested_schema_violations, NESTED_SCHEMA_VIOLATIONS),
)}
