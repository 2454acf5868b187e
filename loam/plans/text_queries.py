"""Queries of the text functions over documents, benchmark, conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loam.functions import text as T
from loam.operators import entities as E
from loam.sources.tables import table



def text_profile(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", F.size(T.tokens(t)).alias("n_tokens"), F.size(T.tokens(t, 4)).alias("n_long_tokens"), T.short_hash(t).alias("text_hash"),
        F.size(F.split(t, "\n")).alias("n_lines"), T.has_watermark(t).alias("watermark"), F.length(T.one_space(t)).alias("n_dense_chars"),
    )


TEXT_PROFILE = r"""
SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')))::INT AS n_tokens,
  len(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')))::INT AS n_long_tokens,
  substr(sha256(lower(trim(text))), 1, 20) AS text_hash, len(string_split(text, chr(10)))::INT AS n_lines,
  regexp_matches(text, '\n[A-Za-z0-9+/=_-]{80,}\s*$') AS watermark,
  length(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')))::INT AS n_dense_chars
FROM documents
"""


def text_overlap(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u"))
    return docs.join(after, "doc_id").select("doc_id", F.round(T.jaccard(F.col("t"), F.col("u")), 9).alias("overlap"))


TEXT_OVERLAP = r"""
WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS t FROM documents)
SELECT a.doc_id, round(CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0.0 ELSE len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE END, 9) AS overlap
FROM t a JOIN t b ON b.doc_id = a.doc_id + 1
"""


def overlap_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(T.overlap_tokens(F.col("text"), list(T.STOP_WORDS))), " ").alias("tokens"))


STOP_LIST = "[" + ",".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
OVERLAP_TOKENS = rf"""
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_\-./]+'),
  lambda x: rtrim(x, '.,;:')), lambda x: length(x) > 2 AND NOT list_contains({STOP_LIST}, x)))), ' ') AS tokens
FROM conversations
"""


def refang_values(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    user = F.col("user_id").cast("string")
    forms = F.array(
        F.concat(F.lit(" hXXps://host"), user, F.lit("[.]example(.)com[:]8080[/]a\\.b ")), F.concat(F.lit("fxp://files"), user, F.lit("{ . }net")),
        F.concat(F.lit("mail"), user, F.lit(" [at] example[.]org")), F.concat(F.lit("hxxtp://x"), user, F.lit(".io")), F.concat(F.lit("10[.]0[.]"), user, F.lit("[.]1")),
    )
    value = F.element_at(forms, (F.col("event_id") % 5 + 1).cast("int"))
    return e.select("event_id", T.refang(value).alias("value"), T.refang(T.refang(value)).alias("again"), T.hash_kind(F.md5(value)).alias("kind"))


REFANG_VALUES = r"""
WITH v AS (SELECT event_id, [' hXXps://host' || user_id || '[.]example(.)com[:]8080[/]a\.b ', 'fxp://files' || user_id || '{ . }net',
  'mail' || user_id || ' [at] example[.]org', 'hxxtp://x' || user_id || '.io', '10[.]0[.]' || user_id || '[.]1'][event_id % 5 + 1] AS v FROM events),
r AS (SELECT event_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(v),
  'hxxt?ps://', 'https://', 'gi'), 'hxxt?p://', 'http://', 'gi'), 'fxp://', 'ftp://', 'gi'), '[\[({]\s*\.\s*[\])}]', '.', 'g'),
  '[\[({]\s*at\s*[\])}]', '@', 'gi'), '[\[({]\s*:\s*[\])}]', ':', 'g'), '[\[({]\s*/\s*[\])}]', '/', 'g'), '\\\.', '.', 'g') AS value FROM v)
SELECT event_id, value, value AS again, 'MD5' AS kind FROM r
"""


def refang_artifacts(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    host = F.concat(F.lit("h"), (F.col("event_id") % 3).cast("string"), F.lit("[.]com"))
    plain = F.concat(F.lit("h"), (F.col("event_id") % 2).cast("string"), F.lit(".com"))
    lists = F.create_map(F.lit("domains"), F.array(host, plain, F.lit(" ")), F.lit("empty"), F.array(F.lit("")))
    clean = T.refang_lists(lists)
    return e.select("event_id", F.array_join(F.map_keys(clean), ",").alias("kinds"), F.array_join(clean["domains"], ",").alias("domains"))


REFANG_ARTIFACTS = r"""
SELECT event_id, 'domains' AS kinds, CASE WHEN event_id % 3 = event_id % 2 THEN 'h' || event_id % 3 || '.com' ELSE 'h' || event_id % 3 || '.com,h' || event_id % 2 || '.com' END AS domains
FROM events
"""


def tidy_documents(spark: SparkSession, d: str) -> DataFrame:
    messy = F.concat(F.lit("\n \t"), F.replace(F.col("text"), F.lit("\n"), F.lit(" \t\n\n\n\n")), F.lit(" ﬁn ﬂow \n"), F.repeat(F.lit("Ab9+"), 25), F.lit("\n"))
    tidy = T.tidy_space(T.strip_watermark(T.expand_ligatures(messy)))
    return table(spark, d, "documents").select("doc_id", T.has_watermark(messy).alias("marked"), F.md5(tidy).alias("tidy_hash"), F.length(tidy).alias("n"))


TIDY_DOCUMENTS = r"""
WITH m AS (SELECT doc_id, chr(10) || ' ' || chr(9) || replace(text, chr(10), ' ' || chr(9) || repeat(chr(10), 4)) || ' fin flow' AS t FROM documents),
s AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', repeat(chr(10), 2), 'g') AS t FROM m),
k AS (SELECT doc_id, regexp_replace(regexp_replace(t, '^\s+', ''), '\s+$', '') AS t FROM s)
SELECT doc_id, true AS marked, md5(t) AS tidy_hash, length(t)::INT AS n FROM k
"""


def numbered_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(T.numbered_lines(F.col("text"))).alias("numbered_hash"), T.ellipsis(T.one_space(F.col("text")), 40).alias("title"))


NUMBERED_LINES = r"""
SELECT doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: i || '| ' || x), chr(10))) AS numbered_hash,
  CASE WHEN length(t) > 40 THEN substr(t, 1, 39) || '…' ELSE t END AS title
FROM (SELECT *, trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM documents)
"""


def technique_scan(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    tid = F.concat(F.lit("T"), F.lpad((F.col("doc_id") % 900 + 1000).cast("string"), 4, "0"))
    full = F.concat(F.col("text"), F.lit(" see "), tid, F.lit(", "), tid, F.lit(".00"), (F.col("doc_id") % 9).cast("string"), F.lit(" and XT1234 or "), tid, F.lit("."))
    found = T.technique_ids(full)
    return docs.select("doc_id", F.array_join(found, ",").alias("found"), T.is_technique_id(F.element_at(found, 1)).alias("valid"), T.is_technique_id(F.col("source")).alias("source_valid"))


TECHNIQUE_SCAN = r"""
WITH t AS (SELECT doc_id, source, 'T' || (doc_id % 900 + 1000) AS tid FROM documents)
SELECT doc_id, tid || ',' || tid || '.00' || doc_id % 9 AS found, true AS valid, false AS source_valid FROM t
"""


def cve_forms(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers in many written forms, made of prices and dates; too short numbers are none."""
    o = table(spark, d, "orders")
    n, y = F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyy")
    forms = F.array(F.concat(F.lit("CVE-"), y, F.lit("-"), n), F.concat(F.lit("cve "), y, F.lit(" "), n), F.concat(F.lit("x Cve_"), y, F.lit("_"), n, F.lit("!")), F.concat(F.lit("no id "), n))
    value = F.element_at(forms, (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select("o_orderkey", T.cve_id(value).alias("cve"))


CVE_FORMS = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 AND length(o_custkey::VARCHAR) BETWEEN 4 AND 7 THEN 'CVE-' || strftime(o_orderdate, '%Y') || '-' || o_custkey END AS cve FROM orders"


def quote_support(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("quote"))
    items = table(spark, d, "benchmark").select("item_id", T.tokens(F.col("text"), 4).alias("known"))
    share = T.support(F.col("quote"), F.col("known"))
    return docs.join(items, "item_id").select("item_id", F.round(share, 9).alias("support"), F.coalesce(share >= 0.5, F.lit(True)).alias("grounded"))


QUOTE_SUPPORT = r"""
WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(d.text), '[a-z]{4,}')) AS q, list_distinct(regexp_extract_all(lower(b.text), '[a-z]{4,}')) AS k
  FROM documents d JOIN benchmark b ON d.doc_id = b.item_id),
s AS (SELECT item_id, CASE WHEN len(q) >= 4 AND len(k) > 0 THEN len(list_intersect(q, k)) / len(q)::DOUBLE END AS s FROM q)
SELECT item_id, round(s, 9) AS support, coalesce(s >= 0.5, true) AS grounded FROM s
"""


def small_values(spark: SparkSession, d: str) -> DataFrame:
    """Hash kinds, addresses, registry paths and file names that events stand for."""
    e, k = table(spark, d, "events"), F.col("event_id")
    octet = (F.col("user_id") % 300).cast("string")
    address = F.concat(F.lit("10."), octet, F.lit(".2.1"), F.when(k % 2 == 0, F.lit(":443")).otherwise(F.lit("")))
    path = F.concat(F.element_at(F.array(F.lit("HKLM\\"), F.lit("hkcu\\"), F.lit("HKLMX\\")), (k % 3 + 1).cast("int")), F.col("event_type"))
    name = F.concat(F.lit("Report "), k.cast("string"), F.lit("(1)."), F.upper("event_type"))
    return e.select("event_id", T.hash_kind(F.sha2(name, 256)).alias("kind"), T.ipv4(address).alias("address"), T.hive(path).alias("path"), T.safe_name(name).alias("file"), T.extension(name).alias("extension"))


SMALL_VALUES = r"""
SELECT event_id, 'SHA-256' AS kind, CASE WHEN user_id % 300 <= 255 THEN '10.' || user_id % 300 || '.2.1' END AS address,
  ['HKEY_LOCAL_MACHINE\', 'HKEY_CURRENT_USER\', 'HKLMX\'][event_id % 3 + 1] || event_type AS path,
  'Report_' || event_id || '_1_.' || upper(event_type) AS file, event_type AS extension
FROM events
"""


def order_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.concat(F.lit("attack-pattern--"), F.col("l_partkey").cast("string"))).alias("refs"), F.collect_list("l_returnflag").alias("platforms"), F.collect_list("l_linestatus").alias("tactics"),
    )
    return lines.select("l_orderkey", T.fingerprint(F.col("refs"), F.col("platforms"), F.col("tactics")).alias("fingerprint"))


ORDER_FINGERPRINTS = r"""
SELECT l_orderkey, substr(sha256(string_agg('attack-pattern--' || l_partkey, '|' ORDER BY 'attack-pattern--' || l_partkey) || '::' || string_agg(l_returnflag, '|' ORDER BY l_returnflag)
  || '::' || string_agg(DISTINCT l_linestatus, '|' ORDER BY l_linestatus)), 1, 32) AS fingerprint
FROM lineitem GROUP BY l_orderkey
"""


def rule_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Turns as detection rules: bodies stay, names and unknown types go; some turns are cut to their first word, as a name."""
    name = F.element_at(F.split("text", " "), 1)
    raw = table(spark, d, "conversations").select(F.col("conv_id").alias("source_id"), "turn", F.when(F.col("turn") % 4 > 0, "yara").otherwise("other").alias("rule_type"), F.when(F.col("turn") % 3 == 0, name).otherwise(F.col("text")).alias("rule_content"))
    return E.detection_rules(raw).select("source_id", "turn", F.length("rule_content").alias("n"))


RULE_BODIES = r"""
WITH c AS (SELECT conv_id, turn, regexp_replace(CASE WHEN turn % 3 = 0 THEN string_split(text, ' ')[1] ELSE text END, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS c FROM conversations WHERE turn % 4 > 0)
SELECT conv_id AS source_id, turn, length(c)::INT AS n FROM c WHERE c <> '' AND (contains(c, chr(10)) OR regexp_matches(c, '[:{}|=()$\\]|->') OR length(c) > 120)
"""

QUERIES = {
    "text_profile": (text_profile, TEXT_PROFILE),
    "text_overlap": (text_overlap, TEXT_OVERLAP),
    "overlap_tokens": (overlap_tokens, OVERLAP_TOKENS),
    "refang_values": (refang_values, REFANG_VALUES),
    "refang_artifacts": (refang_artifacts, REFANG_ARTIFACTS),
    "tidy_documents": (tidy_documents, TIDY_DOCUMENTS),
    "numbered_lines": (numbered_lines, NUMBERED_LINES),
    "technique_scan": (technique_scan, TECHNIQUE_SCAN),
    "cve_forms": (cve_forms, CVE_FORMS),
    "quote_support": (quote_support, QUOTE_SUPPORT),
    "small_values": (small_values, SMALL_VALUES),
    "order_fingerprints": (order_fingerprints, ORDER_FINGERPRINTS),
    "rule_bodies": (rule_bodies, RULE_BODIES),
}
