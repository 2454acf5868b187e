"""Queries of caps, demotions, keys, tuple checks, ranking and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loam.functions import keys as K, scores as S, text as T
from loam.operators import bundle as B, entities as E, picks as P
from loam.plans import feedback_queries
from loam.sources.tables import table


def quote_caps(spark: SparkSession, d: str) -> DataFrame:
    """Picks whose quote the chunk's words do not support lose their definite bucket; each turn quotes the turn after it."""
    c = table(spark, d, "conversations").dropDuplicates(["conv_id", "turn"])
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("source_quote"))
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    picks = c.join(after, ["conv_id", "turn"], "left").select(key.alias("chunk_id"), "source_quote", F.when(F.col("turn") % 2 == 0, "definite").otherwise("possible").alias("confidence_bucket"))
    return P.quote_capped(picks, c.select(key.alias("chunk_id"), "text")).select("chunk_id", "confidence_bucket", "quote_unsupported")


QUOTE_CAPS = r"""
WITH c AS (SELECT conv_id, turn, any_value(text) AS text FROM conversations GROUP BY 1, 2),
t AS (SELECT c.*, list_distinct(regexp_extract_all(lower(n.text), '[a-z]{4,}')) AS q, list_distinct(regexp_extract_all(lower(c.text), '[a-z]{4,}')) AS k FROM c LEFT JOIN c n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1),
u AS (SELECT *, coalesce(len(q) >= 4 AND len(k) > 0 AND len(list_intersect(q, k)) / len(q)::DOUBLE < 0.5, false) AS bad FROM t)
SELECT conv_id || '-' || turn AS chunk_id, CASE WHEN turn % 2 = 1 THEN 'possible' WHEN bad THEN 'probable' ELSE 'definite' END AS confidence_bucket, bad AS quote_unsupported FROM u
"""


def platform_demotions(spark: SparkSession, d: str) -> DataFrame:
    """Picks (lines) whose part's types do not meet those of the order's first part go to possible at 0.5 at most."""
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    platforms = p.select(F.col("p_partkey").alias("technique_id"), F.array("p_type").alias("platforms"))
    firsts = li.groupBy(F.col("l_orderkey").alias("chunk_id")).agg(F.min("l_partkey").alias("technique_id")).where("chunk_id % 5 > 0").join(platforms, "technique_id").select("chunk_id", "platforms")
    picks = li.select(F.col("l_orderkey").alias("chunk_id"), F.col("l_partkey").alias("technique_id")).distinct().select("*", F.lit(0.9).alias("confidence"), F.lit("definite").alias("confidence_bucket"))
    return P.demoted(picks, firsts, platforms).select("chunk_id", "technique_id", "confidence", "confidence_bucket", "platform_mismatch")


PLATFORM_DEMOTIONS = """
WITH k AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), f AS (SELECT o, p_type AS t FROM (SELECT o, min(p) AS p FROM k GROUP BY 1) JOIN part ON p_partkey = p WHERE o % 5 > 0),
m AS (SELECT k.*, coalesce(f.t <> p_type, false) AS m FROM k JOIN part ON p_partkey = p LEFT JOIN f USING (o))
SELECT o AS chunk_id, p AS technique_id, CASE WHEN m THEN 0.5 ELSE 0.9 END AS confidence, CASE WHEN m THEN 'possible' ELSE 'definite' END AS confidence_bucket, m AS platform_mismatch FROM m
"""


def relationship_keys(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    told = c.join(n, c["c_nationkey"] == n["n_nationkey"])
    key = K.relationship_key(F.concat(F.lit(" "), F.col("c_name")), F.lit("Targets"), F.when(F.col("c_acctbal") > 0, F.col("n_name")), F.lit("intrusion-set"), F.lit("location"))
    return told.select("c_custkey", key.alias("key"), K.relationship_id(key).alias("id"), K.ref_label(F.concat(F.lit("location--"), F.lpad(F.col("c_custkey").cast("string"), 12, "0")), F.when(F.col("c_custkey") % 2 == 0, F.col("n_name"))).alias("label"))


RELATIONSHIP_KEYS = """
WITH t AS (SELECT *, lower(trim(c_name)) || '|targets|' || CASE WHEN c_acctbal > 0 THEN lower(trim(n_name)) ELSE '' END || '|intrusion-set|location' AS key FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey, key, 'relp_' || substr(sha256(key), 1, 12) AS id, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE 'location ' || right(lpad(c_custkey::VARCHAR, 12, '0'), 8) END AS label FROM t
"""


def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    """Repeated requests by content: how many turns share a key, the first of them paying."""
    c = table(spark, d, "conversations")
    told = c.select("conv_id", "turn", K.cache_key(role=F.col("role"), text=T.short_hash(F.col("text")), limit=F.lit(None).cast("int")).alias("key"))
    return told.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("conv_id", "turn")).alias("first")).select("key", "n", F.col("first.conv_id").alias("conv_id"), F.col("first.turn").alias("turn"))


CACHE_KEYS = """
WITH t AS (SELECT conv_id, turn, sha256('{"limit":null,"role":"' || role || '","text":"' || substr(sha256(lower(trim(text))), 1, 20) || '"}') AS key FROM conversations)
SELECT key, count(*) AS n, (min((conv_id, turn)))[1] AS conv_id, (min((conv_id, turn)))[2] AS turn FROM t GROUP BY 1
"""


def tuple_semantics(spark: SparkSession, d: str) -> DataFrame:
    """Procedures (orders) by what they lack of techniques, log sources and components; some have no coverage."""
    ids = lambda test: F.transform(F.filter(F.collect_list(F.when(test, F.col("l_partkey"))), lambda x: x.isNotNull()), lambda x: x.cast("string"))
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(ids(F.col("l_quantity") > 25).alias("ap"), ids(F.col("l_discount") > 0.08).alias("ls"), ids(F.col("l_tax") > 0.06).alias("c"))
    o = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    none = F.array().cast("array<string>")
    lists = F.map_from_arrays(F.array(*map(F.lit, ("x_technique_refs", "x_log_source_refs", "x_components_refs"))), F.array(*[F.coalesce(c, none) for c in ("ap", "ls", "c")]))
    objects = o.select(F.col("o_custkey").alias("bundle"), F.col("o_orderkey").cast("string").alias("id"), F.lit("x-procedure").alias("type"), lists.alias("lists"), "o_orderkey", "o_orderstatus")
    sure = objects.select("bundle", "id", (F.col("o_orderkey") * 13 % 101).alias("confidence"))
    found = B.tuple_semantics(objects, sure, objects.where("o_orderstatus = 'P'"))
    return found.select(F.col("id").cast("long").alias("o_orderkey"), F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "valid")


TUPLE_SEMANTICS = """
WITH l AS (SELECT l_orderkey, count(*) FILTER (l_quantity > 25) AS ap, count(*) FILTER (l_discount > 0.08) AS ls, count(*) FILTER (l_tax > 0.06) AS c FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey, coalesce(ap, 0) = 0 AS a, coalesce(ls, 0) = 0 AS s, coalesce(c, 0) = 0 AS c, o_orderkey * 13 % 101 >= 70 AS sure, o_orderstatus = 'P' AS ex FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
SELECT o_orderkey, concat_ws(',', CASE WHEN a AND sure THEN 'AP' END, CASE WHEN s AND sure AND NOT ex THEN 'LS' END) AS errors,
  concat_ws(',', CASE WHEN a AND NOT sure THEN 'AP' END, CASE WHEN s AND (NOT sure OR ex) THEN 'LS' END, CASE WHEN c THEN 'C' END) AS warnings, NOT ((a AND sure) OR (s AND sure AND NOT ex)) AS valid FROM o
"""


def auto_removal(spark: SparkSession, d: str) -> DataFrame:
    """Events as entities of their users: denied values go, unsure ones go, others are approved; a review decides otherwise."""
    e = table(spark, d, "events")
    entities = e.select(F.col("event_id").alias("entity_id"), F.concat(F.lit("User"), F.col("user_id").cast("string")).alias("value"), F.col("event_type").alias("entity_type"), (F.col("value") / 50 < 0.4).alias("low_confidence"))
    terms = e.where("event_type = 'error' and value > 45").select(F.concat(F.lit(" USER"), F.col("user_id").cast("string")).alias("value"), F.when(F.col("event_id") % 2 == 0, F.array(F.lit("click"), F.lit("view"))).alias("scope"))
    reviews = e.where("event_id % 10 = 0").select(F.col("event_id").alias("entity_id"), F.lit("edit").alias("action"))
    found = E.unreviewed_actions(E.denied(entities, terms), reviews)
    return found.groupBy("entity_type", "gate_action", F.coalesce("removal_reason", F.lit("-")).alias("reason")).agg(F.count("*").alias("n"))


AUTO_REMOVAL = """
WITH t AS (SELECT user_id, bool_or(event_id % 2 = 1) AS open, true AS any_ FROM events WHERE event_type = 'error' AND value > 45 GROUP BY 1),
d AS (SELECT e.*, coalesce(open OR event_type IN ('click', 'view') AND (SELECT count(*) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error' AND x.value > 45 AND x.event_id % 2 = 0) > 0, false) AS den FROM events e LEFT JOIN t USING (user_id))
SELECT event_type AS entity_type, CASE WHEN event_id % 10 = 0 THEN 'edit' WHEN den OR value / 50 < 0.4 THEN 'remove' ELSE 'approve' END AS gate_action, CASE WHEN event_id % 10 = 0 THEN '-' WHEN den THEN 'denylisted' WHEN value / 50 < 0.4 THEN 'low confidence' ELSE '-' END AS reason, count(*) AS n FROM d GROUP BY 1, 2, 3
"""


def pattern_ranking(spark: SparkSession, d: str) -> DataFrame:
    """How many sources each rule is told to, and its best rank; pinned ones have rank 0."""
    return feedback_queries.rule_ranking(spark, d).groupBy("pattern_id").agg(F.count("*").alias("told"), F.min("rank").alias("best"))


PATTERN_RANKING = f"SELECT pattern_id, count(*) AS told, min(rank)::INT AS best FROM ({feedback_queries.RULE_RANKING}) GROUP BY 1"


def published_dates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = F.when(F.col("o_orderkey") % 3 == 0, day).when(F.col("o_orderkey") % 3 == 1, F.concat(day, F.lit("T01:02:03.000Z"))).otherwise(F.lit("May 1994"))
    return o.select("o_orderkey", K.published(raw, F.lit("2024-01-01T00:00:00.000Z")).alias("published"))


PUBLISHED_DATES = """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00.000Z' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T01:02:03.000Z' ELSE '2024-01-01T00:00:00.000Z' END AS published FROM orders
"""


def routed_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a flow led through a node where paths part and one where they meet; the pairs are distinct."""
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000_000).alias("dst")).distinct()
    out = e.groupBy("src").agg(F.count("*").alias("out_n"))
    into = e.groupBy("dst").agg(F.count("*").alias("in_n"))
    told = e.join(out, "src").join(into, "dst")
    a, b = F.col("src").cast("string"), F.col("dst").cast("string")
    branch, meet = F.when(F.col("out_n") >= 2, F.concat(F.lit("branch-"), a)), F.when(F.col("in_n") >= 2, F.concat(F.lit("meet-"), b))
    stops = F.filter(F.array(a, branch, meet, b), lambda x: x.isNotNull())
    hops = F.zip_with(F.slice(stops, F.lit(1), F.size(stops) - 1), F.slice(stops, F.lit(2), F.size(stops) - 1), lambda x, y: F.struct(x.alias("src"), y.alias("dst")))
    return told.select(F.explode(hops).alias("h")).select("h.src", "h.dst").distinct()


ROUTED_EDGES = """
WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey + 1000000000 AS dst FROM lineitem), o AS (SELECT src, count(*) >= 2 AS o FROM e GROUP BY 1), i AS (SELECT dst, count(*) >= 2 AS i FROM e GROUP BY 1),
t AS (SELECT list_filter([src::VARCHAR, CASE WHEN o THEN 'branch-' || src END, CASE WHEN i THEN 'meet-' || dst END, dst::VARCHAR], lambda x: x IS NOT NULL) AS s FROM e JOIN o USING (src) JOIN i USING (dst))
SELECT DISTINCT h.a AS src, h.b AS dst FROM (SELECT unnest(list_transform(range(1, len(s)), lambda k: {'a': s[k], 'b': s[k + 1]})) AS h FROM t)
"""


def bundle_counts(spark: SparkSession, d: str) -> DataFrame:
    """Per report (customer): objects, relationships and procedures, with a line that sums up what fails."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("k"))
    o = table(spark, d, "orders").join(lines, "o_orderkey", "left")
    by = o.groupBy("o_custkey").agg(F.count("*").alias("procedures"), F.coalesce(F.sum("k"), F.lit(0)).alias("relationships"), F.count_if(F.col("k").isNull()).alias("empty"))
    note = F.when(F.col("empty") > 0, F.concat(F.col("empty").cast("string"), F.lit(" procedures without evidence"))).otherwise("")
    return by.select("o_custkey", "procedures", "relationships", (F.col("procedures") + F.col("relationships")).alias("objects"), note.alias("note"))


BUNDLE_COUNTS = """
WITH l AS (SELECT l_orderkey, count(*) AS k FROM lineitem GROUP BY 1)
SELECT o_custkey, count(*) AS procedures, coalesce(sum(k), 0)::BIGINT AS relationships, (count(*) + coalesce(sum(k), 0))::BIGINT AS objects, CASE WHEN count(*) > count(k) THEN (count(*) - count(k)) || ' procedures without evidence' ELSE '' END AS note
FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1
"""


def confidence_bands(spark: SparkSession, d: str) -> DataFrame:
    """Users' lanes by share of agreed events: rate, lane and whether the rule stays."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 20).alias("agreed"))
    share = S.rate(F.col("agreed"), F.col("n"))
    bucket = F.when(share >= 0.7, "definite").when(share >= 0.5, "probable").otherwise("possible")
    return e.select("user_id", share.alias("rate"), bucket.alias("bucket"), S.lane(bucket).alias("lane"))


CONFIDENCE_BANDS = """
WITH r AS (SELECT user_id, round(count(*) FILTER (value > 20) / count(*)::DOUBLE, 3) AS rate FROM events GROUP BY 1)
SELECT user_id, rate, CASE WHEN rate >= 0.7 THEN 'definite' WHEN rate >= 0.5 THEN 'probable' ELSE 'possible' END AS bucket, CASE WHEN rate >= 0.5 THEN 'bundle' ELSE 'review' END AS lane FROM r
"""

QUERIES = {f.__name__: (f, sql) for f, sql in (
    (quote_caps, QUOTE_CAPS), (platform_demotions, PLATFORM_DEMOTIONS), (relationship_keys, RELATIONSHIP_KEYS), (cache_keys, CACHE_KEYS), (tuple_semantics, TUPLE_SEMANTICS), (auto_removal, AUTO_REMOVAL),
    (pattern_ranking, PATTERN_RANKING), (published_dates, PUBLISHED_DATES), (routed_edges, ROUTED_EDGES), (bundle_counts, BUNDLE_COUNTS), (confidence_bands, CONFIDENCE_BANDS),
)}
