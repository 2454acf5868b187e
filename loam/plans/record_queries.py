"""Queries of the record, lane and scoring operators; events stand for picks, entities, patterns and reviewer turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loam.functions import scores as S, text as T
from loam.operators import entities as E, picks as P, records as R, turns as N
from loam.plans import feedback_queries
from loam.sources.tables import table

#: A fixed "now", so that ages do not depend on the day a query runs.
NOW = "2024-02-01 00:00:00"


def _picks(spark: SparkSession, d: str) -> DataFrame:
    """Technique picks: chunk, technique, confidence, bucket, position."""
    e = table(spark, d, "events")
    bucket = F.element_at(F.array(F.lit("possible"), F.lit("probable"), F.lit("definite")), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select(F.col("user_id").alias("chunk"), F.col("event_type").alias("technique"), (F.pmod(F.col("event_id") * 37, F.lit(101)) / 100).alias("confidence"), F.when(F.col("event_id") % 7 != 0, bucket).alias("bucket"), F.col("event_id").alias("pos"))


_PICKS = """p AS (SELECT user_id AS chunk, event_type AS technique, (event_id * 37 % 101) / 100.0::DOUBLE AS confidence,
  CASE WHEN event_id % 7 <> 0 THEN ['possible', 'probable', 'definite'][event_id % 3 + 1] END AS bucket, event_id AS pos FROM events)"""


def entity_intake(spark: SparkSession, d: str) -> DataFrame:
    """Raw entities cleaned: known types only, addresses refanged, placeholders and victims' accounts dropped, first of a value wins."""
    e, k, u = table(spark, d, "events"), F.col("event_id"), F.col("user_id").cast("string")
    kind = F.element_at(F.array(*map(F.lit, ("ioc_domain", "ioc_url", "tool", "unknown", "ioc_email", "organization", "location"))), (k % 7 + 1).cast("int"))
    host = F.concat(F.when(k % 2 == 0, F.lit("Host")).otherwise(F.lit(" host")), u, F.when(k % 3 == 0, F.lit("[.]net")).otherwise(F.lit(".net")))
    value = F.when(k % 11 == 0, F.lit(" ")).when(k % 13 == 0, F.concat(F.lit("<org>."), host)).when((k % 5 == 0) & (kind == "ioc_email"), F.concat(F.lit("victim.user@"), host)).otherwise(host)
    raw = e.select((F.col("user_id") % 10).alias("source_id"), k.alias("position"), value.alias("value"), kind.alias("entity_type"), F.when(k % 17 > 0, F.col("value") / 40 - 0.1).alias("confidence"), F.when(k % 2 == 0, "victim").otherwise("owner").alias("organization_role"), F.lit(None).cast("string").alias("location_role"))
    found = E.taken_in(raw)
    return found.select("source_id", "position", "entity_type", "value", F.round("confidence", 6).alias("confidence"), "low_confidence", F.coalesce("organization_role", "location_role", F.lit("-")).alias("role"))


ENTITY_INTAKE = """
WITH r AS (SELECT user_id % 10 AS s, event_id AS k, user_id AS u, ['ioc_domain', 'ioc_url', 'tool', 'unknown', 'ioc_email', 'organization', 'location'][event_id % 7 + 1] AS t, CASE WHEN event_id % 17 > 0 THEN value / 40 - 0.1 ELSE 0.5 END AS c FROM events),
h AS (SELECT *, (CASE WHEN k % 2 = 0 THEN 'Host' ELSE 'host' END) || u || CASE WHEN k % 3 = 0 AND t NOT IN ('ioc_domain', 'ioc_url') THEN '[.]net' ELSE '.net' END AS h, k % 13 = 0 AS ph, t IN ('ioc_domain', 'ioc_url', 'ioc_email') AS ind FROM r WHERE t <> 'unknown' AND k % 11 <> 0),
v AS (SELECT *, CASE WHEN ph AND ind THEN CASE WHEN k % 2 = 0 THEN h ELSE h END WHEN ph THEN '<org>.' || CASE WHEN k % 2 = 0 THEN h ELSE ' ' || h END WHEN k % 5 = 0 AND t = 'ioc_email' THEN 'victim' ELSE h END AS v FROM h),
n AS (SELECT *, row_number() OVER (PARTITION BY s, lower(v), t ORDER BY k) AS n FROM v WHERE v <> 'victim')
SELECT s AS source_id, k AS position, t AS entity_type, v AS value, round(least(greatest(c, 0.0), 1.0), 6) AS confidence, least(greatest(c, 0.0), 1.0) < 0.4 AS low_confidence,
  CASE t WHEN 'organization' THEN CASE WHEN k % 2 = 0 THEN 'victim' ELSE 'other' END WHEN 'location' THEN 'context' ELSE '-' END AS role FROM n WHERE n = 1
"""


def best_picks(spark: SparkSession, d: str) -> DataFrame:
    """One pick per chunk and technique: the highest bucket, then confidence, at the first position; with its lane."""
    rank = F.when(F.col("bucket") == "definite", 3).when(F.col("bucket") == "possible", 1).otherwise(2)
    best = R.best_wins(_picks(spark, d), ["chunk", "technique"], [rank.alias("r"), F.col("confidence")], "pos", "first_pos")
    return best.select("chunk", "technique", "confidence", "pos", "first_pos", S.lane(F.col("bucket")).alias("lane"))


BEST_PICKS = f"""
WITH {_PICKS}, r AS (SELECT *, row_number() OVER (PARTITION BY chunk, technique ORDER BY CASE bucket WHEN 'definite' THEN 3 WHEN 'possible' THEN 1 ELSE 2 END DESC, confidence DESC, pos) AS n,
  min(pos) OVER (PARTITION BY chunk, technique) AS first_pos FROM p)
SELECT chunk, technique, confidence, pos, first_pos, CASE WHEN bucket = 'possible' THEN 'review' ELSE 'bundle' END AS lane FROM r WHERE n = 1
"""


def orphan_promotion(spark: SparkSession, d: str) -> DataFrame:
    """Chunks (users and kinds of events) without any bundle pick get their best review pick."""
    e = table(spark, d, "events")
    picks = e.select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("chunk_id"), F.col("event_id").alias("technique_id"), F.col("event_id").alias("position"), (F.pmod(F.col("event_id") * 37, F.lit(101)) / 100).alias("confidence"), F.when(F.col("value") > 8, "review").otherwise("bundle").alias("lane"))
    return P.best_orphans(picks, picks.select("chunk_id"))


ORPHAN_PROMOTION = """
WITH p AS (SELECT user_id || '-' || event_type AS c, event_id AS k, (event_id * 37 % 101) / 100.0::DOUBLE AS q, value > 8 AS review FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY q DESC, k) AS n FROM p WHERE c NOT IN (SELECT c FROM p WHERE NOT review))
SELECT c AS chunk_id, k AS technique_id FROM r WHERE n = 1
"""


def redirect_chains(spark: SparkSession, d: str) -> DataFrame:
    """Customers in debt stand for revoked ids, redirected to the next customer."""
    c = table(spark, d, "customer")
    redirects = c.where("c_acctbal < 3000").select(F.col("c_custkey").alias("from_id"), (F.col("c_custkey") + 1).alias("to_id"))
    return R.resolve(c.select(F.col("c_custkey").alias("id")), redirects, 6)


REDIRECT_CHAINS = """
WITH RECURSIVE r AS (SELECT c_custkey AS f FROM customer WHERE c_acctbal < 3000),
w(id, final_id, hops) AS (SELECT c_custkey, c_custkey, 0 FROM customer UNION ALL SELECT id, final_id + 1, hops + 1 FROM w WHERE hops < 6 AND final_id IN (SELECT f FROM r))
SELECT id, max(final_id) AS final_id, CASE WHEN max(final_id) IN (SELECT f FROM r) THEN -1 ELSE max(hops) END AS hops FROM w GROUP BY id
"""


def order_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Graph nodes upserted: only rows of our own making (status O) may change."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_totalprice")
    new = orders.where("id % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return R.upsert(orders.where("id % 2 = 0"), new, "id", F.col("o_orderstatus") == "O")


ORDER_UPSERT = """
SELECT o_orderkey AS id, o_orderstatus, CASE WHEN o_orderkey % 2 = 1 OR (o_orderkey % 3 = 0 AND o_orderstatus = 'O') THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice
FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0
"""


def default_decisions(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    said = items.where("o_orderkey % 4 = 0").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "reject").otherwise("edit").alias("action"))
    return R.decided(items, said, "o_orderkey").groupBy("o_orderpriority", "action").count().withColumnRenamed("count", "n")


DEFAULT_DECISIONS = """
SELECT o_orderpriority, CASE WHEN o_orderkey % 4 <> 0 THEN 'approve' WHEN o_orderpriority = '1-URGENT' THEN 'reject' ELSE 'edit' END AS action, count(*) AS n FROM orders GROUP BY 1, 2
"""


def collision_suffix(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = lines.withColumn("id", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    named = R.suffixed(lines.withColumn("order", F.struct("l_partkey", "l_suppkey", "l_extendedprice")), ["l_orderkey", "l_linenumber"], "id", "order")
    return named.select("id", "l_orderkey", "l_linenumber", "l_partkey")


COLLISION_SUFFIX = """
SELECT l_orderkey || '-' || l_linenumber || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS id, l_orderkey, l_linenumber, l_partkey
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem)
"""


def pattern_salience(spark: SparkSession, d: str) -> DataFrame:
    """Users stand for rules: hits and misses by event, decayed by the last time seen; stale weak ones are archived."""
    e = table(spark, d, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "purchase").alias("hits"), F.count_if(F.col("event_type") == "error").alias("misses"), F.count("*").alias("seen"), F.max(F.col("ts").cast("timestamp")).alias("last_seen"),
    )
    now = F.lit(NOW).cast("timestamp")
    weight = S.salience(F.col("hits"), F.col("misses"), F.col("seen"), F.col("last_seen"), now)
    return e.select("user_id", "hits", "misses", F.round(weight, 6).alias("salience"), ((weight < 0.05) & (S.age_days(F.col("last_seen"), now) > 90)).alias("archived"))


PATTERN_SALIENCE = f"""
WITH p AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS hits, count(*) FILTER (event_type = 'error') AS misses, count(*) AS seen,
  greatest(epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(ts)), 0) / 86400000000.0 AS age FROM events GROUP BY user_id),
s AS (SELECT *, (hits + 2) / (hits + misses + 3.0) * pow(0.5, age / 45) * ln(1 + seen) AS s FROM p)
SELECT user_id, hits, misses, round(s, 6) AS salience, s < 0.05 AND age > 90 AS archived FROM s
"""


def reviewer_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of each gate by kind of advice; moot advice does not count."""
    return feedback_queries.B.agreement(feedback_queries._turns(spark, d))["kinds"]


REVIEWER_AGREEMENT = f"""
WITH {feedback_queries._TURNS} SELECT gate AS gate_key, ['entity', 'addition'][event_id % 2 + 1] AS kind, count(*) FILTER (event_id % 3 <> 0) AS agreed, count(*) AS total,
  round(count(*) FILTER (event_id % 3 <> 0) / count(*)::DOUBLE, 3) AS rate FROM i WHERE event_id % 11 <> 0 GROUP BY 1, 2
"""


def draft_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Orders stand for drafts: completeness and composite confidence."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.countDistinct("l_returnflag").alias("k"))
    o = table(spark, d, "orders").join(lines, "o_orderkey", "left")
    words = F.repeat(F.col("o_orderpriority"), (F.col("o_orderkey") % 15).cast("int"))
    n = F.coalesce("n", F.lit(0))
    done = S.completeness(words, (n > 4).cast("int"), F.coalesce("k", F.lit(0)), F.when(F.col("o_orderkey") % 2 == 0, "2024"), F.lit(0), n, F.col("o_orderstatus") == "F")
    sure = S.composite_confidence(F.when(F.col("o_orderkey") % 5 != 0, (F.col("o_orderkey") % 101).cast("int")), done, (F.col("o_custkey") % 101).cast("int"))
    return o.select("o_orderkey", done.alias("completeness"), sure.alias("confidence"))


DRAFT_CONFIDENCE = """
WITH l AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_returnflag) AS k FROM lineitem GROUP BY 1),
o AS (SELECT o.*, coalesce(n, 0) AS n, coalesce(k, 0) AS k, length(o_orderpriority) * (o_orderkey % 15) AS w FROM orders o LEFT JOIN l ON l_orderkey = o_orderkey),
c AS (SELECT *, least(100, CASE WHEN w > 100 THEN 25 WHEN w > 30 THEN 15 WHEN w > 0 THEN 5 ELSE 0 END + CASE WHEN n > 4 THEN 25 ELSE 0 END + CASE WHEN k >= 1 THEN 15 ELSE 0 END
  + CASE WHEN k >= 2 THEN 5 ELSE 0 END + CASE WHEN o_orderkey % 2 = 0 THEN 10 ELSE 0 END + CASE WHEN n > 0 THEN 5 ELSE 0 END + CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 5 END) AS c FROM o)
SELECT o_orderkey, c::INT AS completeness,
  trunc(0.30::DOUBLE * (CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 101 ELSE 50 END) + 0.25::DOUBLE * c + 0.45::DOUBLE * (o_custkey % 101))::INT AS confidence FROM c
"""


def pattern_page(spark: SparkSession, d: str) -> DataFrame:
    """The page 11 to 30 of rules by mean value (missing last), occurrences, latest; the report is the page."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("mean"), F.count("*").alias("n"), F.max("ts").alias("last"))
    return e.orderBy(F.desc_nulls_last("mean"), F.desc("n"), F.desc("last"), "user_id").offset(10).limit(20).select("user_id", "n", F.round("mean", 6).alias("mean"))


PATTERN_PAGE = """
SELECT user_id, n, round(mean, 6) AS mean FROM (SELECT user_id, avg(value) FILTER (event_type = 'click') AS mean, count(*) AS n, max(ts) AS last FROM events GROUP BY user_id)
ORDER BY mean DESC NULLS LAST, n DESC, last DESC, user_id LIMIT 20 OFFSET 10
"""


def status_board(spark: SparkSession, d: str) -> DataFrame:
    """Orders by board column; every column is present, unknown statuses fall into the default one."""
    to = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "queued").otherwise("working")
    columns = spark.createDataFrame([("queued", 1), ("working", 2), ("review", 3), ("done", 4)], "board string, place int")
    return N.board(table(spark, d, "orders"), to, columns)


STATUS_BOARD = """
SELECT b.board, b.place, coalesce(n, 0) AS n FROM (VALUES ('queued', 1), ('working', 2), ('review', 3), ('done', 4)) b(board, place)
LEFT JOIN (SELECT CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'working' END AS board, count(*) AS n FROM orders GROUP BY 1) o USING (board)
"""


def status_totals(spark: SparkSession, d: str) -> DataFrame:
    """Users' sources by their last event, and those completed on the last day."""
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    last = N.latest(e, ["user_id"], ["at", "event_id"])
    sources = last.select(F.when(F.col("event_type") == "purchase", "completed").otherwise(F.col("event_type")).alias("status"), F.col("at").alias("updated_at"))
    return N.status_counts(sources, F.lit("2024-01-30 12:00:00").cast("timestamp"))


STATUS_TOTALS = """
WITH l AS (SELECT arg_max(event_type, (ts, event_id)) AS t, max(ts) AS seen FROM events GROUP BY user_id), s AS (SELECT CASE WHEN t = 'purchase' THEN 'completed' ELSE t END AS status, seen FROM l)
SELECT status, count(*) AS n FROM s GROUP BY 1 UNION ALL SELECT 'completed today', count(*) FROM s WHERE status = 'completed' AND seen::DATE = DATE '2024-01-30' HAVING count(*) > 0
"""


def latest_turns(spark: SparkSession, d: str) -> DataFrame:
    """The newest turn of each role in a conversation and how many came before it."""
    last = N.latest(table(spark, d, "conversations"), ["conv_id", "role"], ["turn", "text"])
    return last.select("conv_id", "role", "passes", "turn", T.short_hash(F.col("text")).alias("text_hash"))


LATEST_TURNS = """
SELECT conv_id, role, count(*) AS passes, max(turn) AS turn, substr(sha256(lower(trim((max({'t': turn, 'x': text})).x))), 1, 20) AS text_hash FROM conversations GROUP BY 1, 2
"""


def prior_turns(spark: SparkSession, d: str) -> DataFrame:
    """For every turn, the running number of turns and characters before it."""
    c = table(spark, d, "conversations").withColumn("n", F.length("text"))
    return N.with_prior(c, "conv_id", ["turn", "role", "n"], "text").select("conv_id", "turn", "role", "n_before", "chars_before")


PRIOR_TURNS = """
SELECT conv_id, turn, role, count(n) OVER w AS n_before, coalesce(sum(n) OVER w, 0)::BIGINT AS chars_before FROM (SELECT *, length(text) AS n FROM conversations)
WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
"""


def denylist_scope(spark: SparkSession, d: str) -> DataFrame:
    """Events as entities against a denylist with optional scope by type, made of the rules that were promoted."""
    e = table(spark, d, "events")
    entities = e.select("event_id", F.concat(F.lit("User"), F.col("user_id").cast("string")).alias("value"), F.col("event_type").alias("entity_type"))
    patterns = e.select(F.col("event_id").alias("pattern_id"), F.when(F.col("value") > 48, "promoted").otherwise("active").alias("status"), F.array(F.concat(F.lit(" USER"), (F.col("user_id") + 1).cast("string"))).alias("values"), F.when(F.col("event_id") % 3 > 0, F.array("event_type")).alias("entity_types"), F.array(F.concat(F.lit("T"), F.col("event_id").cast("string"))).alias("technique_ids"))
    terms, _ = P.denylist_terms(patterns)
    return E.denied(entities, terms).select("event_id", "value", "entity_type", F.col("denylisted").alias("denied"))


DENYLIST_SCOPE = """
WITH t AS (SELECT user_id + 1 AS u, event_type AS k, event_id % 3 = 0 AS open FROM events WHERE value > 48)
SELECT event_id, 'User' || user_id AS value, event_type AS entity_type, EXISTS (SELECT 1 FROM t WHERE u = user_id AND open) OR EXISTS (SELECT 1 FROM t WHERE u = user_id AND k = event_type) AS denied FROM events
"""


def verbatim_index(spark: SparkSession, d: str) -> DataFrame:
    """Names with their type as strings of an index: kept if three brands at most use them, with the brands in order."""
    p = table(spark, d, "part").select(F.concat_ws(" ", "p_name", "p_type", (F.col("p_size") % 10).cast("string")).alias("string"), F.col("p_brand").alias("technique_id"))
    return P.verbatim_strings(p).select("string", F.size("techniques").alias("n"), F.array_join("techniques", ",").alias("brands"))


VERBATIM_INDEX = """
SELECT lower(p_name || ' ' || p_type || ' ' || p_size % 10) AS string, count(DISTINCT p_brand)::INT AS n, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM part
WHERE length(p_name || ' ' || p_type || ' ' || p_size % 10) >= 8 GROUP BY 1 HAVING count(DISTINCT p_brand) <= 3
"""


def techniques_in_play(spark: SparkSession, d: str) -> DataFrame:
    """Ids that lines, parts of a size and orders' picks name, and how many of the three do."""
    li, p, o = table(spark, d, "lineitem"), table(spark, d, "part"), table(spark, d, "orders")
    tid = lambda c: F.concat(F.lit("T"), F.col(c).cast("string")).alias("technique_id")
    return P.in_play(picked=li.select(tid("l_partkey")), listed=p.where("p_size < 10").select(tid("p_partkey")), proposed=o.select(tid("o_custkey")))


TECHNIQUES_IN_PLAY = """
WITH a AS (SELECT DISTINCT l_partkey AS k, 1 AS b FROM lineitem UNION SELECT p_partkey, 2 FROM part WHERE p_size < 10 UNION SELECT o_custkey, 3 FROM orders)
SELECT 'T' || k AS technique_id, count(*)::INT AS n_sources FROM a GROUP BY 1
"""

QUERIES = {f.__name__: (f, sql) for f, sql in (
    (entity_intake, ENTITY_INTAKE), (best_picks, BEST_PICKS), (orphan_promotion, ORPHAN_PROMOTION), (redirect_chains, REDIRECT_CHAINS), (order_upsert, ORDER_UPSERT),
    (default_decisions, DEFAULT_DECISIONS), (collision_suffix, COLLISION_SUFFIX), (pattern_salience, PATTERN_SALIENCE), (reviewer_agreement, REVIEWER_AGREEMENT),
    (draft_confidence, DRAFT_CONFIDENCE), (pattern_page, PATTERN_PAGE), (status_board, STATUS_BOARD), (latest_turns, LATEST_TURNS), (prior_turns, PRIOR_TURNS),
    (denylist_scope, DENYLIST_SCOPE), (verbatim_index, VERBATIM_INDEX), (status_totals, STATUS_TOTALS), (techniques_in_play, TECHNIQUES_IN_PLAY),
)}
