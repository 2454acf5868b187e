"""Queries of the feedback and store operators: users stand for rules and sources, events for showings, advice and corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loam.operators import feedback as B
from loam.plans.bundle_queries import objects
from loam.sources.shared import new_path, saved
from loam.sources import store as S
from loam.sources.tables import table

_NOW = "2024-02-01 00:00:00"
_CATEGORIES = ("defender_ioc", "over_chunked", "wrong_technique", "wrong_relationship", "of_no_area")
_AREAS, _GATES = ("entities", "chunks", "techniques", "relationships"), ("entities", "chunks", "procedures", "bundle")


def _nth(values, key):
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def advice_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Advice of five kinds against decisions; a wholesale rejection makes what else was advised there moot."""
    e = table(spark, d, "events")
    kind = _nth(("entity", "addition", "edge", "technique", "rerun"), F.col("event_id"))
    advice = e.select(F.col("user_id").alias("source_id"), F.col("event_type").alias("gate_key"), kind.alias("kind"), F.col("event_id").cast("string").alias("ref"), F.when(kind == "entity", "remove").when(kind == "addition", "add").when(kind == "edge", "cut").when(kind == "technique", "remove").otherwise("rerun").alias("recommended"))
    said = e.where("event_id % 3 = 0").select(F.col("user_id").alias("source_id"), F.col("event_type").alias("gate_key"), kind.alias("kind"), F.col("event_id").cast("string").alias("ref"), F.when(F.col("event_id") % 2 == 0, "remove").otherwise("cut").alias("action"))
    rejected = e.where("event_id % 50 = 0").select(F.col("user_id").alias("source_id"), F.col("event_type").alias("gate_key"))
    found = B.advice_outcomes(advice, said, rejected)
    return found.groupBy("gate_key", "kind", "actual", "agreed", "moot").agg(F.count("*").alias("n"))


ADVICE_OUTCOMES = """
WITH r AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 50 = 0),
a AS (SELECT e.*, ['entity', 'addition', 'edge', 'technique', 'rerun'][event_id % 5 + 1] AS kind, r.user_id IS NOT NULL AS rej, CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'remove' ELSE 'cut' END END AS act FROM events e LEFT JOIN r USING (user_id, event_type)),
f AS (SELECT *, CASE WHEN kind = 'rerun' THEN CASE WHEN rej THEN 'rerun' ELSE 'kept_this_pass' END WHEN rej THEN 'moot_rerun' WHEN kind = 'entity' THEN coalesce(act, 'approve') WHEN kind = 'addition' THEN CASE WHEN act IS NULL THEN 'not_added' ELSE 'add' END
  WHEN kind = 'edge' THEN coalesce(act, 'not_applied') ELSE CASE WHEN act IS NULL THEN 'kept' ELSE 'remove' END END AS actual, CASE kind WHEN 'entity' THEN 'remove' WHEN 'addition' THEN 'add' WHEN 'edge' THEN 'cut' WHEN 'technique' THEN 'remove' ELSE 'rerun' END AS rec FROM a)
SELECT event_type AS gate_key, kind, actual, NOT (rej AND kind <> 'rerun') AND rec = actual AS agreed, rej AND kind <> 'rerun' AS moot, count(*) AS n FROM f GROUP BY 1, 2, 3, 4, 5
"""


def _turns(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    item = F.struct(_nth(("entity", "addition"), F.col("event_id")).alias("kind"), F.col("event_id").cast("string").alias("ref"), F.lit("a").alias("recommended"), F.lit("b").alias("actual"), F.when(F.col("value") >= 40, "high").when(F.col("value") >= 15, "medium").otherwise("low").alias("confidence"), (F.col("event_id") % 3 != 0).alias("agreed"), (F.col("event_id") % 11 == 0).alias("moot"), (F.col("event_id") % 13 == 0).alias("quote_unsupported"))
    gate = F.when(F.col("event_type") == "view", "initial_read").otherwise(_nth(_GATES, F.col("user_id")))
    items = F.when(F.col("event_id") % 17 != 0, F.array(item))
    return e.select(F.col("user_id").alias("source_id"), gate.alias("gate_key"), F.when(F.col("event_id") % 19 == 0, "failed").otherwise("ok").alias("status"), (F.col("event_id") % 23 == 0).alias("auto"), F.col("ts").cast("timestamp").alias("created_at"), items.alias("items"))


_TURNS = f"""t AS (SELECT *, CASE WHEN event_type = 'view' THEN 'initial_read' ELSE {_list(_GATES)}[user_id % 4 + 1] END AS gate FROM events),
i AS (SELECT * FROM t WHERE gate <> 'initial_read' AND event_id % 19 <> 0 AND event_id % 23 <> 0 AND event_id % 17 <> 0)"""


def gate_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Reviews, sources, agreement, unsupported quotes and failures of each gate."""
    return B.agreement(_turns(spark, d))["gates"]


GATE_AGREEMENT = f"""
WITH {_TURNS} SELECT gate AS gate_key, count(*) FILTER (ok) AS reviews, count(DISTINCT CASE WHEN ok THEN user_id END) AS sources, count(*) FILTER (ok AND live AND event_id % 3 <> 0) AS agreed, count(*) FILTER (ok AND live) AS total,
  round(count(*) FILTER (ok AND live AND event_id % 3 <> 0) / count(*) FILTER (ok AND live)::DOUBLE, 3) AS rate, count(*) FILTER (ok AND live AND event_id % 13 = 0) AS unsupported_quotes, count(*) FILTER (event_id % 19 = 0) AS failures,
  list_position({_list(_GATES)}, gate)::INT - 1 AS place FROM (SELECT *, event_id % 19 <> 0 AND event_id % 23 <> 0 AND event_id % 17 <> 0 AS ok, event_id % 11 <> 0 AS live FROM t WHERE gate <> 'initial_read') GROUP BY 1
"""


def tier_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of each gate by how sure the reviewer was; all three tiers are told."""
    return B.agreement(_turns(spark, d))["tiers"]


TIER_AGREEMENT = f"""
WITH {_TURNS}, k AS (SELECT gate, CASE WHEN value >= 40 THEN 'high' WHEN value >= 15 THEN 'medium' ELSE 'low' END AS tier, event_id FROM i WHERE event_id % 11 <> 0),
g AS (SELECT DISTINCT gate, tier FROM t, (SELECT unnest(['high', 'medium', 'low']) AS tier) WHERE gate <> 'initial_read')
SELECT g.gate AS gate_key, g.tier AS confidence, count(k.event_id) FILTER (k.event_id % 3 <> 0) AS agreed, count(k.event_id) AS total, round(count(k.event_id) FILTER (k.event_id % 3 <> 0) / nullif(count(k.event_id), 0)::DOUBLE, 3) AS rate FROM g LEFT JOIN k USING (gate, tier) GROUP BY 1, 2
"""


def _patterns(spark: SparkSession, d: str) -> DataFrame:
    """A rule per user, with the vector of the embedding of that number."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max(F.col("ts").cast("timestamp")).alias("last"))
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("user_id"), "embedding")
    u = F.col("user_id")
    return e.join(v, "user_id", "left").select(
        u.cast("string").alias("pattern_id"), _nth(_CATEGORIES, u).alias("category"), F.concat(F.lit("rule about CVE-2024-"), (u % 3 + 1000).cast("string")).alias("pattern"), _nth(("active", "promoted_to_denylist", "promoted_to_prompt", "dismissed"), F.floor(u / 5)).alias("status"),
        F.col("n").alias("occurrence_count"), F.lit(1).cast("long").alias("hit_count"), F.lit(1).cast("long").alias("miss_count"), (u % 10 / 10).alias("salience"), "embedding", F.array(F.concat(F.lit("T"), (u % 9).cast("string"))).alias("technique_ids"), F.array(F.concat(F.lit("k"), (u % 4).cast("string"))).alias("entity_types"),
        F.array(F.concat(F.lit("c"), (u % 5).cast("string"))).alias("tactics"), F.col("last").alias("last_seen_at"),
    )


_PATTERNS = f"""pt AS (SELECT user_id AS u, {_list(_CATEGORIES)}[user_id % 5 + 1] AS category, ['active', 'promoted_to_denylist', 'promoted_to_prompt', 'dismissed'][(user_id // 5) % 4 + 1] AS status, count(*) AS n, max(ts) AS last, any_value(embedding) AS v FROM events LEFT JOIN embeddings ON vec_id = user_id GROUP BY 1)"""


def surfacing_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Rules shown to users: a hit or miss only where a person attended the gate, a miss by a removed technique or a like vector."""
    e = table(spark, d, "events")
    shown = e.select(F.col("user_id").alias("source_id"), (F.col("event_id") % 150).cast("string").alias("pattern_id"), F.when(F.col("event_id") % 5 == 0, "hit").alias("outcome"))
    gates = e.select(F.col("user_id").alias("source_id")).distinct().select("source_id", F.explode(F.array(*map(F.lit, _GATES))).alias("gate_key"), (F.col("source_id") % 7 != 0).alias("enabled"), F.when(F.col("source_id") % 5 == 0, "auto").alias("mode"))
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("k"), "embedding")
    wrong = e.where("event_type = 'error'").select(F.col("user_id").alias("source_id"), _nth(_AREAS, F.col("event_id")).alias("area"), F.array(F.concat(F.lit("T"), (F.col("event_id") % 40).cast("string"))).alias("removed_technique_ids"), (F.col("event_id") % 150).alias("k")).join(v, "k", "left")
    found = B.surfacing_outcomes(shown, _patterns(spark, d), gates, wrong)
    return found.select("source_id", "pattern_id", "outcome", "n")


SURFACING_OUTCOMES = f"""
WITH {_PATTERNS}, s AS (SELECT user_id AS src, event_id % 150 AS p, count(*) AS n FROM events WHERE event_id % 5 <> 0 GROUP BY 1, 2),
c AS (SELECT user_id AS src, event_id % 4 AS a, event_id % 40 AS t, event_id % 150 AS k FROM events WHERE event_type = 'error'),
m AS (SELECT DISTINCT s.src, s.p FROM s JOIN pt ON pt.u = s.p JOIN c ON c.src = s.src AND (pt.u % 5 = 4 OR pt.u % 5 = c.a)
  LEFT JOIN embeddings e ON e.vec_id = c.k WHERE c.t = pt.u % 9 OR coalesce(list_dot_product(list_transform(pt.v, lambda x: x::DOUBLE), list_transform(e.embedding, lambda x: x::DOUBLE)), 0) >= 0.55)
SELECT s.src AS source_id, s.p::VARCHAR AS pattern_id, CASE WHEN pt.u IS NULL OR pt.u % 5 = 4 OR s.src % 7 = 0 OR s.src % 5 = 0 THEN 'unscored' WHEN m.p IS NOT NULL THEN 'miss' ELSE 'hit' END AS outcome, s.n
FROM s LEFT JOIN pt ON pt.u = s.p LEFT JOIN m ON m.src = s.src AND m.p = s.p
"""


def pattern_scores(spark: SparkSession, d: str) -> DataFrame:
    """Rules after their outcomes: hits, misses and salience."""
    e = table(spark, d, "events")
    outcomes = e.select((F.col("event_id") % 150).cast("string").alias("pattern_id"), _nth(("hit", "miss", "unscored"), F.floor(F.col("event_id") / 150)).alias("outcome"))
    found = B.scored_patterns(_patterns(spark, d), outcomes, F.lit(_NOW).cast("timestamp"))
    return found.select("pattern_id", "hit_count", "miss_count", F.round("salience", 6).alias("salience"))


PATTERN_SCORES = f"""
WITH {_PATTERNS}, o AS (SELECT event_id % 150 AS u, count(*) FILTER ((event_id // 150) % 3 = 0) AS h, count(*) FILTER ((event_id // 150) % 3 = 1) AS m FROM events GROUP BY 1),
k AS (SELECT pt.*, 1 + coalesce(h, 0) AS h1, 1 + coalesce(m, 0) AS m1, coalesce(h, 0) + coalesce(m, 0) AS hm FROM pt LEFT JOIN o USING (u))
SELECT u::VARCHAR AS pattern_id, h1 AS hit_count, m1 AS miss_count, round(CASE WHEN hm > 0 THEN (h1 + 2) / (h1 + m1 + 3.0) * pow(0.5, greatest(epoch_us(TIMESTAMP '{_NOW}') - epoch_us(last), 0) / 86400000000.0 / 45) * ln(1 + n) ELSE u % 10 / 10.0 END, 6) AS salience FROM k
"""


def rule_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The rules told to each source (a document's source), by vector, keywords, terms and salience, and the pinned ones."""
    docs = table(spark, d, "documents").groupBy("source").agg(F.min("doc_id").alias("k"))
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("j"), F.col("embedding").alias("vector"))
    n = F.col("k") % 150
    sources = docs.withColumn("j", n).join(v, "j", "left").select(
        F.col("source").alias("source_id"), "vector", F.array(F.concat(F.lit("cve-2024-"), (n % 6 + 1000).cast("string"))).alias("keywords"), F.array(F.concat(F.lit("T"), (n % 18).cast("string"))).alias("technique_ids"), F.array(F.concat(F.lit("k"), (n % 8).cast("string"))).alias("entity_types"), F.array(F.concat(F.lit("c"), (n % 10).cast("string"))).alias("tactics"),
    )
    found = B.ranked_patterns(sources, _patterns(spark, d), ["defender_ioc", "over_chunked", "wrong_technique"], [], F.lit(_NOW).cast("timestamp"))
    return found.select("source_id", "pattern_id", F.round("score", 5).alias("score"), "rank", "pinned")


RULE_RANKING = f"""
WITH {_PATTERNS}, c AS (SELECT * FROM pt WHERE u % 5 < 3 AND status IN ('active', 'promoted_to_denylist') AND last >= TIMESTAMP '{_NOW}' - INTERVAL 90 DAY ORDER BY n DESC, last DESC, u::VARCHAR LIMIT 80),
s AS (SELECT source, j, embedding AS w FROM (SELECT source, min(doc_id) % 150 AS j FROM documents GROUP BY 1) LEFT JOIN embeddings ON vec_id = j),
x AS (SELECT source, u, n, last, coalesce(list_dot_product(list_transform(w, lambda x: x::DOUBLE), list_transform(v, lambda x: x::DOUBLE)), 0) + CASE WHEN u % 3 = j % 6 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN u % 9 = j % 18 THEN 0.5::DOUBLE ELSE 0 END
  + CASE WHEN u % 4 = j % 8 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN u % 5 = j % 10 THEN 0.2::DOUBLE ELSE 0 END + 0.15::DOUBLE * (u % 10 / 10.0) AS score FROM s, c),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, n DESC, last DESC, u::VARCHAR)::INT AS rank FROM x)
SELECT source AS source_id, u::VARCHAR AS pattern_id, round(score, 5) AS score, rank, false AS pinned FROM r WHERE rank <= 15
UNION ALL SELECT source, u::VARCHAR, NULL, 0, true FROM s, (SELECT u FROM pt WHERE u % 5 < 3 AND status = 'promoted_to_prompt' ORDER BY n DESC, last DESC, u::VARCHAR LIMIT 25)
"""


def rule_upsert(spark: SparkSession, d: str) -> DataFrame:
    """New rules against known ones: the same text, a like vector with like words, or new."""
    v = table(spark, d, "embeddings")
    text = lambda k: F.concat(F.lit("rule on theme "), _nth(("alpha", "beta", "gamma", "delta"), k), F.lit(" and "), _nth(("red", "green", "blue"), k), F.lit(" things"))
    known = v.where("vec_id % 2 = 0").select(F.col("vec_id").cast("string").alias("pattern_id"), (F.col("label") % 3).cast("string").alias("category"), F.concat(text(F.col("vec_id")), (F.col("vec_id") % 40).cast("string")).alias("pattern"), (F.col("vec_id") % 13).alias("occurrence_count"), "embedding")
    of = v.select(F.col("vec_id").alias("j"), F.col("embedding").alias("near"))
    new = v.withColumn("j", F.col("vec_id") - F.col("vec_id") % 2).join(of, "j", "left").select(F.col("vec_id").alias("new_id"), (F.col("label") % 3).cast("string").alias("category"), F.concat(text(F.col("vec_id") + F.col("vec_id") % 3), (F.col("vec_id") % 40).cast("string")).alias("pattern"), F.col("near").alias("embedding"))
    found = B.upserted_patterns(known, new)
    return found.groupBy("how").agg(F.count("*").alias("n"), F.count_distinct("pattern_id").alias("patterns"), F.sum(F.col("pattern_id").cast("long")).alias("ids"))


RULE_UPSERT = """
WITH t AS (SELECT vec_id, (label % 3)::VARCHAR AS cat, list_transform(embedding, lambda x: x::DOUBLE) AS e, vec_id + vec_id % 3 AS m FROM embeddings),
k AS (SELECT vec_id AS p, cat, 'rule on theme ' || ['alpha', 'beta', 'gamma', 'delta'][vec_id % 4 + 1] || ' and ' || ['red', 'green', 'blue'][vec_id % 3 + 1] || ' things' || vec_id % 40 AS text, vec_id % 13 AS occ, e FROM t WHERE vec_id % 2 = 0),
n AS (SELECT a.vec_id AS id, a.cat, 'rule on theme ' || ['alpha', 'beta', 'gamma', 'delta'][a.m % 4 + 1] || ' and ' || ['red', 'green', 'blue'][a.m % 3 + 1] || ' things' || a.vec_id % 40 AS text, b.e FROM t a LEFT JOIN t b ON b.vec_id = a.vec_id - a.vec_id % 2),
x AS (SELECT n.id, min(k.p::VARCHAR) AS p FROM n JOIN k ON k.cat = n.cat AND k.text = n.text GROUP BY 1),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY occ DESC, p::VARCHAR) AS r FROM k) WHERE r <= 300),
c AS (SELECT n.id, n.text, s.p, s.text AS known, list_dot_product(n.e, s.e) AS sim FROM n JOIN s USING (cat) WHERE n.id NOT IN (SELECT id FROM x) AND list_dot_product(n.e, s.e) > 0),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, p::VARCHAR) AS r FROM c) WHERE r = 1),
w AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS a, list_distinct(regexp_extract_all(lower(known), '[a-z]{3,}')) AS z FROM b),
m AS (SELECT id, p::VARCHAR AS p FROM w WHERE sim >= 0.55 AND len(list_intersect(a, z)) / len(list_distinct(list_concat(a, z)))::DOUBLE >= 0.2),
f AS (SELECT id, p, 'exact' AS how FROM x UNION ALL SELECT id, p, 'similar' FROM m UNION ALL SELECT id, min(id) OVER (PARTITION BY cat, text)::VARCHAR, 'new' FROM n WHERE id NOT IN (SELECT id FROM x) AND id NOT IN (SELECT id FROM m))
SELECT how, count(*) AS n, count(DISTINCT p) AS patterns, sum(p::BIGINT)::BIGINT AS ids FROM f GROUP BY 1
"""


def correction_examples(spark: SparkSession, d: str) -> DataFrame:
    """Corrections as examples of gates that a person attended, each once a source, then counted over all sources."""
    e = table(spark, d, "events")
    src, pos, null = F.col("user_id").alias("source_id"), F.col("event_id").alias("position"), F.lit(None).cast("string")
    of = lambda kind: e.where(F.col("event_type") == kind)
    entities = of("click").select(src, pos, F.when(F.col("event_id") % 2 == 0, "edit").alias("action"), F.concat(F.lit(" V"), (F.col("event_id") % 10).cast("string")).alias("value"), F.lit("tool").alias("entity_type"), F.when(F.col("event_id") % 2 == 0, "w").alias("edited_value"), null.alias("edited_type"), F.lit("because").alias("rationale"))
    chunks = of("view").select(src, pos, _nth(("analyst_added", "wholesale_reject", ""), F.col("event_id")).alias("kind"), F.lit("edit").alias("action"), F.concat(F.lit("o"), (F.col("event_id") % 4).cast("string")).alias("original_text"), F.when(F.col("event_id") % 2 == 0, "n").alias("new_text"), F.when(F.col("event_id") % 5 > 0, "r").alias("rationale"))
    techniques = of("error").select(src, pos, F.when(F.col("event_id") % 3 == 0, "promotion").alias("kind"), F.when(F.col("event_id") % 7 > 0, F.concat(F.lit("T"), (F.col("event_id") % 6).cast("string"))).alias("technique_id"), null.alias("technique_name"), F.lit("p").alias("name"), F.when(F.col("event_id") % 2 == 0, "removed").otherwise("added").alias("change"), null.alias("rationale"))
    gates = e.select("user_id").distinct().select(F.col("user_id").alias("source_id"), F.explode(F.array(*map(F.lit, _GATES))).alias("gate_key"), F.lit(True).alias("enabled"), F.when((F.col("user_id") % 3 == 0) & (F.col("gate_key") == "chunks"), "auto").otherwise("review").alias("mode"))
    new = B.examples(entities, chunks, techniques, gates)
    old = new.where("source_id < 10").select("dedup_key", F.lit(5).cast("long").alias("occurrence_count"), F.lit("").alias("rationale"), F.array(F.lit("old")).alias("sources")).dropDuplicates(["dedup_key"])
    found = B.upserted_examples(old, new)
    return found.select("dedup_key", "occurrence_count", F.size("sources").alias("sources"))


CORRECTION_EXAMPLES = """
WITH k AS (SELECT user_id AS s, 'entities|' || CASE WHEN event_id % 2 = 0 THEN 'edit' ELSE 'remove' END || '|' || substr(sha256('tool|v' || event_id % 10), 1, 24) AS key FROM events WHERE event_type = 'click'
  UNION ALL SELECT user_id, 'chunks|' || ['add', 'reject', 'edit'][event_id % 3 + 1] || '|' || substr(sha256(CASE event_id % 3 WHEN 0 THEN 'n' WHEN 1 THEN 'r' ELSE 'o' || event_id % 4 END), 1, 24) FROM events
    WHERE event_type = 'view' AND user_id % 3 > 0 AND CASE event_id % 3 WHEN 0 THEN event_id % 2 = 0 WHEN 1 THEN event_id % 5 > 0 ELSE true END
  UNION ALL SELECT user_id, CASE WHEN event_id % 3 = 0 THEN 'techniques|promote|' || substr(sha256('t' || event_id % 6), 1, 24) ELSE 'techniques|' || CASE WHEN event_id % 2 = 0 THEN 'remove' ELSE 'add' END || '|' || substr(sha256('t' || event_id % 6 || '|p'), 1, 24) END FROM events WHERE event_type = 'error' AND event_id % 7 > 0),
d AS (SELECT DISTINCT s, key FROM k), o AS (SELECT DISTINCT key FROM d WHERE s < 10)
SELECT key AS dedup_key, count(*) + CASE WHEN any_value(o.key) IS NOT NULL THEN 5 ELSE 0 END AS occurrence_count, (count(DISTINCT s) + CASE WHEN any_value(o.key) IS NOT NULL THEN 1 ELSE 0 END)::INT AS sources FROM d LEFT JOIN o USING (key) GROUP BY 1
"""


def graph_writes(spark: SparkSession, d: str) -> DataFrame:
    """Bundles as graph rows: nodes by label, and edges written or dropped for want of an end, by verb."""
    nodes, edges, _ = S.graph_rows(objects(spark, d))
    written, counts, _ = S.writable(edges, nodes)
    n = lambda df, c: df.groupBy("bundle", F.col(c).alias("what")).agg(F.count("*").alias("n"))
    total = counts.select("bundle", F.lit("dropped").alias("what"), F.col("dropped").alias("n")).where("n > 0")
    return n(nodes, "label").unionByName(n(written, "verb")).unionByName(total)


GRAPH_WRITES = """
WITH o AS (SELECT o_orderkey AS k, o_custkey AS b, o_orderstatus AS st, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders),
e AS (SELECT b, 'TARGETS' AS v, CASE WHEN k % 2 = 1 THEN 'i' ELSE k::VARCHAR END AS s, CASE WHEN k % 2 = 1 THEN k::VARCHAR ELSE 'i' END AS t FROM o UNION SELECT b, 'PRECEDES', before::VARCHAR, k::VARCHAR FROM o WHERE before IS NOT NULL
  UNION SELECT b, 'PRECEDES', max(k)::VARCHAR, min(k)::VARCHAR FROM o WHERE b % 10 = 0 GROUP BY b)
SELECT c_custkey AS bundle, 'Identity' AS what, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT c_custkey, 'AttackFlow', CASE WHEN c_custkey % 9 = 0 THEN 2 ELSE 1 END FROM customer UNION ALL SELECT b, 'Procedure', count(*) FROM o GROUP BY 1
UNION ALL SELECT b, 'AttackOperator', count(*) FROM o WHERE st = 'P' GROUP BY 1 UNION ALL SELECT b, 'AttackCondition', count(*) FROM o WHERE st = 'F' AND k % 3 = 0 GROUP BY 1
UNION ALL SELECT b, v, count(*) FROM e GROUP BY 1, 2 UNION ALL SELECT b, 'dropped', count(*) FROM o WHERE k % 4 = 0 GROUP BY 1
"""


def _report_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as reports that describe the parts of their orders; every fifth part is the catalogue's."""
    o, li, p, c = (table(spark, d, t) for t in ("orders", "lineitem", "part", "customer"))
    text = lambda prefix, col: F.concat(F.lit(prefix), F.col(col).cast("string"))
    props = lambda name: F.create_map(F.lit("name"), name)
    nodes = p.select(text("p--", "p_partkey").alias("stix_id"), F.initcap(F.col("p_type")).alias("label"), props(F.col("p_name")).alias("props"), F.when(F.col("p_partkey") % 5 > 0, S.MARKER).alias("ingested_by"))
    nodes = nodes.unionByName(c.select(text("report--", "c_custkey").alias("stix_id"), F.lit("Report").alias("label"), props(F.col("c_name")).alias("props"), F.lit(S.MARKER).alias("ingested_by")))
    describes = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(text("report--", "o_custkey").alias("src"), F.lit("DESCRIBES").alias("verb"), text("p--", "l_partkey").alias("dst")).distinct()
    edges = li.select(text("p--", "l_partkey").alias("src"), F.lit("USES").alias("verb"), F.concat(F.lit("p--"), (F.col("l_partkey") + 1).cast("string")).alias("dst")).distinct()
    return nodes, edges, describes


def report_undo(spark: SparkSession, d: str) -> DataFrame:
    """The graph after some reports are taken back with what only they describe: nodes by label, edges and links."""
    nodes, edges, describes = _report_graph(spark, d)
    gone = table(spark, d, "customer").where("c_nationkey < 10").select(F.concat(F.lit("report--"), F.col("c_custkey").cast("string")).alias("stix_id"))
    n, e, ds = S.undone(nodes, edges, describes, gone)
    count = lambda df, c: df.groupBy(F.col(c).alias("what")).agg(F.count("*").alias("n"))
    return count(n, "label").unionByName(count(e, "verb")).unionByName(count(ds, "verb"))


REPORT_UNDO = """
WITH ds AS (SELECT DISTINCT o_custkey AS r, l_partkey AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey), g AS (SELECT c_custkey AS r FROM customer WHERE c_nationkey < 10),
lost AS (SELECT DISTINCT p FROM ds WHERE r IN (SELECT r FROM g) AND p % 5 > 0 AND p IN (SELECT p_partkey FROM part) EXCEPT SELECT p FROM ds WHERE r NOT IN (SELECT r FROM g))
SELECT upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS what, count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT p FROM lost) GROUP BY 1 UNION ALL SELECT 'Report', count(*) FROM customer WHERE c_nationkey >= 10
UNION ALL SELECT 'USES', count(*) FROM (SELECT DISTINCT l_partkey AS a FROM lineitem) WHERE a NOT IN (SELECT p FROM lost) AND a + 1 NOT IN (SELECT p FROM lost)
UNION ALL SELECT 'DESCRIBES', count(*) FROM ds WHERE r NOT IN (SELECT r FROM g) AND p NOT IN (SELECT p FROM lost)
"""


def report_list(spark: SparkSession, d: str) -> DataFrame:
    """Reports with how much they describe, and what by label."""
    nodes, _, describes = _report_graph(spark, d)
    by = S.contributions(describes, nodes).groupBy("src").agg(F.max_by("label", F.struct("n", "label")).alias("most"))
    return S.reports(nodes, describes).join(by.withColumnRenamed("src", "stix_id"), "stix_id", "left")


REPORT_LIST = """
WITH ds AS (SELECT DISTINCT o_custkey AS r, l_partkey AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey), l AS (SELECT r, upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS t, count(*) AS n FROM ds JOIN part ON p_partkey = p GROUP BY 1, 2),
m AS (SELECT r, arg_max(t, (n, t)) AS most FROM l GROUP BY 1), k AS (SELECT r, count(*) AS n FROM ds GROUP BY 1)
SELECT 'report--' || c_custkey AS stix_id, c_name AS name, coalesce(n, 0) AS n, most FROM customer LEFT JOIN k ON k.r = c_custkey LEFT JOIN m ON m.r = c_custkey
"""


def source_claims(spark: SparkSession, d: str) -> DataFrame:
    """Sources (orders) after claims and updates; a claimed one stays with its owner, null changes nothing."""
    o = table(spark, d, "orders")
    sources = o.select(F.col("o_orderkey").alias("source_id"), F.when(F.col("o_custkey") % 3 == 0, "ann").alias("claimed_by"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("error"))
    claims = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("source_id"), _nth(("ann", "bob"), F.floor(F.col("o_orderkey") / 4)).alias("analyst"))
    changes = o.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("source_id"), F.when(F.col("o_orderkey") % 10 == 0, "done").alias("status"), F.lit(None).cast("string").alias("error"))
    out = S.updated(S.claimed(sources, claims), changes, "source_id", may_clear=("error",))
    kept = S.deleted({"sources": out}, o.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("source_id")))["sources"]
    return kept.groupBy("claimed_by", "status", F.col("error").isNull().alias("cleared")).agg(F.count("*").alias("n"))


SOURCE_CLAIMS = """
SELECT CASE WHEN o_custkey % 3 = 0 THEN 'ann' WHEN o_orderkey % 2 = 0 THEN ['ann', 'bob'][(o_orderkey // 4) % 2 + 1] END AS claimed_by, CASE WHEN o_orderkey % 10 = 0 THEN 'done' ELSE o_orderstatus END AS status, o_orderkey % 5 = 0 AS cleared, count(*) AS n
FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1, 2, 3
"""

def rule_updates(spark: SparkSession, d: str) -> DataFrame:
    """Rules after what customers, in order, did to them: promotions with terms, dismissals and edits, several to a rule."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    text = lambda prefix, n: F.concat(F.lit(prefix), (k % n).cast("string"))
    terms = F.struct(
        F.when(k % 3 > 0, F.array(F.concat(F.lit(" "), text("Name", 50)), F.upper(text("name", 50)), F.lit(""), F.lit("a\tb"))).alias("values"),
        F.when(k % 4 > 0, F.array(F.concat(F.lit("t"), (k % 20 + 1000).cast("string")), F.lit("nope"))).alias("technique_ids"), F.array(F.lit("Tool"), F.lit("tool ")).alias("entity_types"),
    )
    changes = c.select(
        (k % 149).cast("string").alias("pattern_id"), k.alias("at"), _nth(("promote_to_prompt", "edit", "promote_to_denylist", "dismiss", "edit", "rename"), F.floor(k / 7)).alias("action"), F.col("c_mktsegment").alias("by"),
        F.when(k % 2 == 0, text("text ", 30)).alias("text"), F.when(k % 5 == 0, text("category ", 6)).alias("category"), terms.alias("terms"),
    )
    found = B.updated_patterns(_patterns(spark, d).select("pattern_id", "category", "pattern", "status"), changes)
    joined = lambda f: F.array_join(F.col(f"denylist_terms.{f}"), ",").alias(f)
    return found.select("pattern_id", "category", "pattern", "status", F.coalesce("promoted_at", F.lit(-1)).alias("promoted_at"), "promoted_by", "promoted_action", joined("values"), joined("technique_ids"), joined("entity_types"))


RULE_UPDATES = f"""
WITH {_PATTERNS}, c AS (SELECT (c_custkey % 149)::VARCHAR AS p, c_custkey AS k, c_mktsegment AS by_, ['promote_to_prompt', 'edit', 'promote_to_denylist', 'dismiss', 'edit', 'rename'][(c_custkey // 7) % 6 + 1] AS action,
  CASE WHEN c_custkey % 2 = 0 THEN 'text ' || c_custkey % 30 END AS text, CASE WHEN c_custkey % 5 = 0 THEN 'category ' || c_custkey % 6 END AS cat, CASE WHEN c_custkey % 3 > 0 THEN 'Name' || c_custkey % 50 END AS val, CASE WHEN c_custkey % 4 > 0 THEN 'T' || (c_custkey % 20 + 1000) END AS tid FROM customer),
o AS (SELECT u::VARCHAR AS p, category, 'rule about CVE-2024-' || (u % 3 + 1000) AS pattern, status FROM pt),
st AS (SELECT p, arg_max(CASE action WHEN 'dismiss' THEN 'dismissed' WHEN 'promote_to_prompt' THEN 'promoted_to_prompt' ELSE 'promoted_to_denylist' END, k) AS status FROM c WHERE action IN ('dismiss', 'promote_to_prompt', 'promote_to_denylist') GROUP BY 1),
tx AS (SELECT p, arg_max(text, k) AS text FROM c WHERE action = 'edit' AND text IS NOT NULL GROUP BY 1), ca AS (SELECT p, arg_max(cat, k) AS cat FROM c WHERE action = 'edit' AND cat IS NOT NULL GROUP BY 1),
pr AS (SELECT * FROM c WHERE action LIKE 'promote%' QUALIFY row_number() OVER (PARTITION BY p ORDER BY k DESC) = 1)
SELECT o.p AS pattern_id, coalesce(ca.cat, category) AS category, coalesce(tx.text, pattern) AS pattern, coalesce(st.status, o.status) AS status, coalesce(pr.k, -1) AS promoted_at, pr.by_ AS promoted_by,
  CASE WHEN pr.action = 'promote_to_prompt' THEN 'prompt:' || coalesce((SELECT arg_max(x.cat, x.k) FROM c x WHERE x.p = o.p AND x.action = 'edit' AND x.cat IS NOT NULL AND x.k < pr.k), category)
    WHEN pr.action IS NOT NULL AND val IS NULL AND tid IS NULL THEN 'denylist:(no enforceable terms — advisory only)' WHEN pr.action IS NOT NULL THEN 'denylist:' || concat_ws(', ', val, tid) END AS promoted_action,
  CASE WHEN pr.action = 'promote_to_denylist' THEN coalesce(val, '') WHEN pr.action IS NOT NULL THEN '' END AS "values", CASE WHEN pr.action = 'promote_to_denylist' THEN coalesce(tid, '') WHEN pr.action IS NOT NULL THEN '' END AS technique_ids,
  CASE WHEN pr.action = 'promote_to_denylist' THEN 'tool' WHEN pr.action IS NOT NULL THEN '' END AS entity_types
FROM o LEFT JOIN st USING (p) LEFT JOIN tx USING (p) LEFT JOIN ca USING (p) LEFT JOIN pr USING (p)
"""


def graph_upserts(spark: SparkSession, d: str) -> DataFrame:
    """Two bundles of reports taken into a graph on disk one after the other, and the first again with other names: what lies there then."""
    nodes, _, describes = _report_graph(spark, d)
    describes = saved(describes, "describes")  # joined once for all turns
    path = new_path(spark, "graph")
    number = F.split("stix_id", "--")[1].cast("long")
    for turn, (side, mark) in enumerate(((0, ""), (1, ""), (0, "!"))):
        name = F.concat(F.try_element_at("props", F.lit("name")), F.lit(mark))
        mine = nodes.where(number % 2 == side).withColumn("props", F.create_map(F.lit("name"), name)).withColumn("bundle", F.lit(turn))
        S.upserted(mine, describes.where(F.split("src", "--")[1].cast("long") % 2 == side), path, buckets=32)
    there, links = S.graph_at(spark, path)
    told = there.groupBy(F.col("label").alias("what")).agg(F.count("*").alias("n"), F.count_if(F.endswith(F.try_element_at("props", F.lit("name")), F.lit("!"))).alias("n_new"))
    return told.unionByName(links.groupBy(F.col("verb").alias("what")).agg(F.count("*").alias("n"), F.count_if(F.lit(False)).alias("n_new")))


GRAPH_UPSERTS = """
SELECT upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) AS what, count(*) AS n, count(*) FILTER (p_partkey % 2 = 0 AND p_partkey % 5 > 0) AS n_new FROM part GROUP BY 1 UNION ALL SELECT 'Report', count(*), count(*) FILTER (c_custkey % 2 = 0) FROM customer
UNION ALL SELECT 'DESCRIBES', count(*), 0 FROM (SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
"""

QUERIES = {f.__name__: (f, sql) for f, sql in (
    (advice_outcomes, ADVICE_OUTCOMES), (gate_agreement, GATE_AGREEMENT), (tier_agreement, TIER_AGREEMENT), (surfacing_outcomes, SURFACING_OUTCOMES), (pattern_scores, PATTERN_SCORES), (rule_ranking, RULE_RANKING),
    (rule_upsert, RULE_UPSERT), (rule_updates, RULE_UPDATES), (graph_upserts, GRAPH_UPSERTS), (correction_examples, CORRECTION_EXAMPLES), (graph_writes, GRAPH_WRITES), (report_undo, REPORT_UNDO), (report_list, REPORT_LIST), (source_claims, SOURCE_CLAIMS),
)}
