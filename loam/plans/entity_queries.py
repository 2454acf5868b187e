"""Queries of the entity, span and set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loam.functions import entities as N, text as T
from loam.operators import picks as P, spans
from loam.sources.tables import table


def placeholders(spark: SparkSession, d: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    forms = F.array(
        F.concat(F.lit("<org>.host"), user, F.lit(".com")), F.concat(F.lit("host"), user, F.lit("[.]com")), F.concat(F.lit("a{id}"), user), F.concat(F.lit("victim.user@c"), user, F.lit(".com")),
        F.concat(F.lit("hxxp[://]h"), user), F.concat(F.lit("http:[//]h"), user), F.concat(F.lit("x[/]"), user), F.concat(F.lit("x<"), F.repeat(F.lit("long"), 11), F.lit(">"), user),
    )
    value = F.element_at(forms, (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", N.has_placeholder(value).alias("has"), N.without_placeholder(value).alias("value"), N.is_victims(value).alias("victims"))


PLACEHOLDERS = """
SELECT event_id, event_id % 8 IN (0, 2, 6) AS has, CASE event_id % 8 WHEN 0 THEN 'host' || user_id || '.com' WHEN 1 THEN 'host' || user_id || '[.]com' WHEN 3 THEN 'victim.user@c' || user_id || '.com'
  WHEN 4 THEN 'hxxp[://]h' || user_id WHEN 5 THEN 'http:[//]h' || user_id WHEN 7 THEN 'x<' || repeat('long', 11) || '>' || user_id END AS value, event_id % 8 = 3 AS victims FROM events
"""


def platform_names(spark: SparkSession, d: str) -> DataFrame:
    raw = F.array(F.lit(" windows"), F.when(F.col("event_id") % 2 == 0, F.lit("Linux::Ubuntu")), F.lit("LINUX"), F.initcap("event_type"), F.lit(""), F.lit("Windows"))
    names = N.platforms(raw, {"windows": "Windows", "linux": "Linux", "view": "macOS"}, ["Windows", "Linux", "macOS"])
    return table(spark, d, "events").select("event_id", F.array_join(names, ",").alias("platforms"))


PLATFORM_NAMES = """
SELECT event_id, 'Windows,' || CASE WHEN event_id % 2 = 0 THEN 'Linux::Ubuntu' ELSE 'Linux' END || CASE WHEN event_type = 'view' THEN ',macOS' ELSE '' END AS platforms FROM events
"""


def recalibrated_picks(spark: SparkSession, d: str) -> DataFrame:
    """Turns as texts, catalogue items as techniques: confidence after anchors, blending and grounding."""
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("description"))
    c = table(spark, d, "conversations").withColumn("item_id", (F.col("conv_id") + F.col("turn")) % 40)
    told = c.join(items, "item_id")
    start = ((F.col("conv_id") * 7 + F.col("turn")) % 100 / 100).alias("c")
    bucket = F.when(F.col("turn") % 3 == 0, "possible").when(F.col("turn") % 3 == 1, "definite")
    name, tid = F.lit("thand"), F.concat(F.lit("T"), (F.col("item_id") + 1000).cast("string"))
    after = N.recalibrated(start, bucket, tid, name, F.col("description"), F.col("text"), F.substring("description", 1, 30))
    return told.select("conv_id", "turn", F.round(after, 2).alias("confidence"))


RECALIBRATED_PICKS = """
WITH t AS (SELECT conv_id, turn, c.text, b.text AS d, ((conv_id * 7 + turn) % 100) / 100.0::DOUBLE AS c, turn % 3 = 0 AS possible,
  contains(lower(c.text), 'thand') OR contains(lower(c.text), 't' || (item_id + 1000)) AS anchored FROM conversations c JOIN benchmark b ON item_id = (conv_id + turn) % 40),
s AS (SELECT *, CASE WHEN anchored AND c < 0.85 THEN 0.85 ELSE c END AS l, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS x, list_distinct(regexp_extract_all(lower(d), '[a-z]{3,}')) AS y,
  len(list_intersect(list_distinct(regexp_extract_all(lower(substr(d, 1, 30)), '[a-z]{4,}')), list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')))) > 0 AS grounded FROM t),
b AS (SELECT *, l * 0.7::DOUBLE + (CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE END) * 0.3::DOUBLE AS m FROM s),
k AS (SELECT *, CASE WHEN possible AND abs(m - l) > 0.01 THEN m ELSE l END AS n FROM b)
SELECT conv_id, turn, round_even(CASE WHEN possible AND n > 0.5 AND NOT grounded THEN 0.5 ELSE n END, 2) AS confidence FROM k
"""


def json_repair(spark: SparkSession, d: str) -> DataFrame:
    """Event properties with a path whose backslash JSON does not know; repaired, they parse."""
    broken = F.concat(F.lit('{"p":"C:\\Windows\\new\\\\x","k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    fixed = N.repaired_json(broken)
    parsed = F.from_json(fixed, "p string, k int")
    return table(spark, d, "events").select("event_id", F.length(fixed).alias("n"), parsed["k"].alias("k"), F.substring(parsed["p"], 1, 10).alias("head"))


JSON_REPAIR = r"""
SELECT event_id, length('{"p":"C:\\Windows\new\\x","k":' || (props->>'$.k') || '}')::INT AS n, (props->>'$.k')::INT AS k, 'C:\Windows' AS head FROM events
"""


def operative_strings(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.col("text"), F.lit(" run `cmd.exe /c  dir`, see /techniques/t1059 at C:\\Temp\\a.dll or --flag=1 "), F.col("source"))
    found = N.operative(text, ["`[^`]+`", r"/[a-z][\w./-]{3,}", r"[A-Z]:\\[\w\\.]+"], ["/techniques/t"])
    return table(spark, d, "documents").select("doc_id", F.array_join(found, "|").alias("strings"))


OPERATIVE_STRINGS = r"""
WITH t AS (SELECT doc_id, text || ' run `cmd.exe /c  dir`, see /techniques/t1059 at C:\Temp\a.dll or --flag=1 ' || source AS t FROM documents),
f AS (SELECT doc_id, list_concat(list_concat(regexp_extract_all(t, '`[^`]+`'), regexp_extract_all(t, '/[a-z][\w./-]{3,}')), regexp_extract_all(t, '[A-Z]:\\[\w\\.]+')) AS f FROM t),
n AS (SELECT doc_id, list_transform(f, lambda x: lower(trim(regexp_replace(x, '[ \t\n\x0B\f\r]+', ' ', 'g')))) AS n FROM f)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(n, lambda x: length(x) >= 8 AND regexp_matches(x, '[0-9\\/.:_=\-]') AND NOT contains(x, '/techniques/t')))), '|') AS strings FROM n
"""


def subtechnique_union(spark: SparkSession, d: str) -> DataFrame:
    """Selected ids with the parents of subs, and all subs of selected parents."""
    p = table(spark, d, "part")
    ids = p.select(F.concat(F.lit("T"), F.lpad((F.col("p_partkey") % 9000).cast("string"), 4, "0"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(".00"), (F.col("p_size") % 9).cast("string"))).otherwise(F.lit(""))).alias("technique_id"), "p_type")
    return P.expanded(ids.where("p_type = 'SMALL'"), ids.select("technique_id").distinct())


SUBTECHNIQUE_UNION = """
WITH i AS (SELECT 'T' || lpad((p_partkey % 9000)::VARCHAR, 4, '0') || CASE WHEN p_size % 2 = 0 THEN '.00' || p_size % 9 ELSE '' END AS tid, p_type FROM part),
c AS (SELECT tid FROM i WHERE p_type = 'SMALL'), s AS (SELECT tid FROM c UNION SELECT split_part(tid, '.', 1) FROM c)
SELECT tid AS technique_id FROM s UNION SELECT tid FROM i WHERE contains(tid, '.') AND split_part(tid, '.', 1) IN (SELECT tid FROM s)
"""


def reference_sync(spark: SparkSession, d: str) -> DataFrame:
    """References embedded in an order with those of its edges added in order, empty ones filled from the maker."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("edges"))
    o = table(spark, d, "orders").join(lines, "o_orderkey", "left")
    none = F.array().cast("array<bigint>")
    own = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit(7).cast("long"), F.col("o_custkey"))).otherwise(none)
    both = F.array_union(own, F.array_sort(F.array_except(F.coalesce("edges", none), own)))
    filled = F.when(F.size(both) == 0, F.array(F.col("o_custkey"))).otherwise(both)
    return o.select("o_orderkey", F.array_join(filled.cast("array<string>"), ",").alias("refs"))


REFERENCE_SYNC = """
WITH l AS (SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey))) AS e FROM lineitem GROUP BY 1),
b AS (SELECT o_orderkey, o_custkey, list_distinct_in_order AS own, coalesce(e, []) AS e FROM (SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN [] WHEN o_custkey = 7 THEN [7] ELSE [7, o_custkey] END AS list_distinct_in_order FROM orders) LEFT JOIN l ON l_orderkey = o_orderkey),
u AS (SELECT *, list_concat(own, list_filter(e, lambda x: NOT list_contains(own, x))) AS u FROM b)
SELECT o_orderkey, array_to_string(CASE WHEN len(u) = 0 THEN [o_custkey] ELSE u END, ',') AS refs FROM u
"""


def attribution(spark: SparkSession, d: str) -> DataFrame:
    """A customer's actors: suppliers of the nation named, else the only one there, else none."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n"), F.lower("s_name").alias("actor"))
    single = s.groupBy("n").agg(F.count("*").alias("k"), F.min("actor").alias("only"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), F.lower(F.concat(F.lit("Supplier#"), F.lpad((F.col("c_custkey") % 100 + 1).cast("string"), 9, "0"))).alias("wanted"))
    named = s.select("n", F.col("actor").alias("wanted"), F.lit(True).alias("known"))
    found = c.join(named, ["n", "wanted"], "left").join(single, "n", "left")
    return found.select("c_custkey", F.when(F.col("known"), F.col("wanted")).when(F.col("k") == 1, F.col("only")).alias("actor"))


ATTRIBUTION = """
WITH k AS (SELECT s_nationkey, count(*) AS k, min(lower(s_name)) AS sole FROM supplier GROUP BY 1)
SELECT c_custkey, coalesce((SELECT max(lower(s_name)) FROM supplier s WHERE s.s_nationkey = c_nationkey AND lower(s_name) = 'supplier#' || lpad((c_custkey % 100 + 1)::VARCHAR, 9, '0')), CASE WHEN k = 1 THEN sole END) AS actor
FROM customer LEFT JOIN k ON s_nationkey = c_nationkey
"""


def excerpt_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Excerpts found in figures, code and prose; white space does not matter."""
    head = T.one_space(F.substring("text", 1, 60))
    text = F.concat(F.lit("[FIGURE 1] "), F.col("text"), F.lit(" [/FIGURE]\n```\ncode block one\n```\nplain  end of\tall"))
    excerpt = F.when(F.col("doc_id") % 4 == 0, head).when(F.col("doc_id") % 4 == 1, F.lit("code  block one")).when(F.col("doc_id") % 4 == 2, F.lit("plain end of all")).otherwise(F.lit("nowhere to be found"))
    docs = table(spark, d, "documents").where(F.length(F.trim("text")) > 0).select("doc_id", text.alias("text"), excerpt.alias("excerpt"))
    found = docs.withColumn("s", spans.excerpt_span(F.col("excerpt"), F.col("text")))
    first = F.when(F.col("s.first") >= 0, F.col("s.first"))
    return found.select("doc_id", N.provenance(F.col("text"), first, F.col("s.last")).alias("provenance"), (F.col("s.first") >= 0).alias("found"))


EXCERPT_PROVENANCE = """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'figure' WHEN 1 THEN 'code' WHEN 2 THEN 'prose' ELSE 'paraphrased' END AS provenance, doc_id % 4 <> 3 AS found FROM documents WHERE length(trim(text)) > 0
"""


def command_closeness(spark: SparkSession, d: str) -> DataFrame:
    """Lines of conversations as commands against the next turn of the talk; no SQL says difflib's ratio, tests compare with it."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    after = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("source"))
    command = F.concat_ws(" ", F.slice(F.split("text", " "), 1, 12))
    told = c.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(spans.near_ratio(command, F.concat_ws(" ", "source", F.when(F.col("turn") % 2 == 0, command))), 6).alias("ratio"))
    return told.withColumn("near", F.col("ratio") >= 0.95)


def nth_occurrence(spark: SparkSession, d: str) -> DataFrame:
    """The k-th turn that quotes a role takes the k-th place; a counter per text, hot ones by range of turns."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n"))
    k = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn", "n"))
    return c.select("conv_id", "turn", "role", k.alias("k"))


NTH_OCCURRENCE = "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, length(text))::INT AS k FROM conversations"


def log_sources(spark: SparkSession, d: str) -> DataFrame:
    """Three hops: part <- line -> supplier -> nation, distinct names per brand; brands without any are kept as gaps."""
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    line = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey").distinct()
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    linked = line.join(s, "l_suppkey").join(n, "s_nationkey").select("p_partkey", "n_name").distinct()
    return p.join(linked, "p_partkey", "left").groupBy("p_brand").agg(F.countDistinct("n_name").alias("n_sources"), F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("sources"))


LOG_SOURCES = """
SELECT p_brand, count(DISTINCT n_name) AS n_sources, coalesce(string_agg(DISTINCT n_name, ',' ORDER BY n_name), '') AS sources FROM part LEFT JOIN (SELECT DISTINCT l_partkey, n_name FROM lineitem
  JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey) ON l_partkey = p_partkey GROUP BY 1
"""


def page_layers(spark: SparkSession, d: str) -> DataFrame:
    """Pages as parsed documents: tags stripped, words counted, short ones warned of."""
    plain = T.one_space(F.regexp_replace(F.col("html"), r"<[^>]*>", " "))
    n = F.size(F.filter(F.split(plain, " "), lambda w: w != ""))
    return table(spark, d, "pages").select("page_id", F.md5(plain).alias("text_hash"), n.alias("n_words"), (n < 50).alias("short"), T.extension(F.col("url")).alias("extension"))


PAGE_LAYERS = r"""
SELECT page_id, md5(t) AS text_hash, len(list_filter(string_split(t, ' '), lambda x: x <> ''))::INT AS n_words, len(list_filter(string_split(t, ' '), lambda x: x <> '')) < 50 AS short,
  lower(regexp_extract(url, '\.([A-Za-z0-9]+)$', 1)) AS extension FROM (SELECT *, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM pages)
"""

QUERIES = {f.__name__: (f, sql) for f, sql in (
    (placeholders, PLACEHOLDERS), (platform_names, PLATFORM_NAMES), (recalibrated_picks, RECALIBRATED_PICKS), (json_repair, JSON_REPAIR), (operative_strings, OPERATIVE_STRINGS),
    (subtechnique_union, SUBTECHNIQUE_UNION), (reference_sync, REFERENCE_SYNC), (attribution, ATTRIBUTION), (excerpt_provenance, EXCERPT_PROVENANCE), (command_closeness, None),
    (nth_occurrence, NTH_OCCURRENCE), (log_sources, LOG_SOURCES), (page_layers, PAGE_LAYERS),
)}
