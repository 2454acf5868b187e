"""Queries written in Spark SQL alone, over the functions that the library names in a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loam.functions.session import register

_NOW = "2024-02-01 00:00:00"


def _sql(spark: SparkSession, d: str, text: str, *tables: str) -> DataFrame:
    register(spark)
    return spark.sql(text, **{t: spark.read.parquet(f"{d}/{t}.parquet") for t in tables})


def sql_excerpt_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where the second word of a turn stands in the other turns of its conversation."""
    return _sql(spark, d, """
        WITH t AS (SELECT conv_id, turn, text, array_join(slice(filter(split(loam_one_space(text), ' '), w -> w <> ''), 2, 1), ' ') AS head FROM {conversations})
        SELECT a.conv_id, a.turn, b.turn AS other, count(*) AS n, sum(s.last - s.first) AS n_chars, max(s.nth) AS last_nth
        FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn <> b.turn, LATERAL loam_spans(b.text, a.head) s
        GROUP BY a.conv_id, a.turn, b.turn
    """, "conversations")  # fmt: skip


SQL_EXCERPT_SPANS = r"""
WITH t AS (SELECT conv_id, turn, text, list_filter(string_split(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g')), ' '), lambda w: w <> '')[2:2] AS head FROM conversations),
f AS (SELECT a.conv_id, a.turn, b.turn AS other, regexp_extract_all(b.text, array_to_string(list_transform(a.head, lambda w: regexp_escape(w)), '\s+')) AS found FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn <> b.turn WHERE len(a.head) > 0)
SELECT conv_id, turn, other, len(found) AS n, list_sum(list_transform(found, lambda x: length(x)))::BIGINT AS n_chars, len(found)::INT AS last_nth FROM f WHERE len(found) > 0
"""


def sql_ranked_rules(spark: SparkSession, d: str) -> DataFrame:
    """Each user's three most salient kinds of event."""
    return _sql(spark, d, f"""
        WITH seen AS (SELECT user_id, event_type, count(*) AS n, count_if(value > 50) AS misses, max(ts) AS last FROM {{events}} GROUP BY user_id, event_type),
        scored AS (SELECT user_id, event_type, round(loam_salience(n - misses, misses, n, (unix_micros(TIMESTAMP '{_NOW}') - unix_micros(CAST(last AS TIMESTAMP))) / 86400000000D), 9) AS score FROM seen)
        SELECT * FROM loam_ranked(TABLE(SELECT * FROM scored), 'user_id', 'score', 'event_type', 3)
    """, "events")  # fmt: skip


SQL_RANKED_RULES = f"""
WITH seen AS (SELECT user_id, event_type, count(*) AS n, count(*) FILTER (value > 50) AS misses, max(ts) AS last FROM events GROUP BY 1, 2),
scored AS (SELECT user_id, event_type, round((n - misses + 2.0::DOUBLE) / (n + 3.0::DOUBLE) * pow(0.5::DOUBLE, (epoch_us(TIMESTAMP '{_NOW}') - epoch_us(last)) / 86400000000::DOUBLE / 45.0::DOUBLE) * ln(1.0::DOUBLE + n), 9) AS score FROM seen)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_type)::INT AS rank FROM scored) WHERE rank <= 3
"""


def sql_source_paths(spark: SparkSession, d: str) -> DataFrame:
    """Brands' ways to nations: brand to part type, type to supplier, supplier to nation, told as whole paths and counted by brand.

    A brand's suppliers are dealt over 256 roots, each with the links that lead to them: a path has one supplier, so it lies in one of them whole.
    """
    return _sql(spark, d, """
        WITH sold AS (SELECT DISTINCT concat(pmod(hash(l_suppkey), 256), '|', p_brand) AS root, p_brand, p_type, l_suppkey FROM {part} JOIN {lineitem} ON l_partkey = p_partkey),
        links AS (
            SELECT DISTINCT root, 1 AS step, p_brand AS src, p_type AS dst FROM sold
            UNION ALL SELECT root, 2, p_type, CAST(l_suppkey AS STRING) FROM sold
            UNION ALL SELECT root, 3, CAST(l_suppkey AS STRING), n_name FROM (SELECT DISTINCT root, l_suppkey FROM sold) JOIN {supplier} ON s_suppkey = l_suppkey JOIN {nation} ON n_nationkey = s_nationkey
        )
        SELECT substring(root, instr(root, '|') + 1) AS p_brand, first AS p_type, third AS n_name, count(*) AS n_paths FROM loam_source_paths(TABLE(links)) GROUP BY 1, 2, 3
    """, "part", "lineitem", "supplier", "nation")  # fmt: skip


SQL_SOURCE_PATHS = """
SELECT p_brand, p_type, n_name, count(*) AS n_paths FROM (SELECT DISTINCT p_brand, p_type, l_suppkey FROM part JOIN lineitem ON l_partkey = p_partkey) JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2, 3
"""

QUERIES = {"sql_excerpt_spans": (sql_excerpt_spans, SQL_EXCERPT_SPANS), "sql_ranked_rules": (sql_ranked_rules, SQL_RANKED_RULES), "sql_source_paths": (sql_source_paths, SQL_SOURCE_PATHS)}
