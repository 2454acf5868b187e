"""The operators' queries over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loam.llm import op1_token_codes, op2_mixing, op3_cotraining, op4_sharding, op5_language, op6_pivots, op7_packing, op8_rules, op9_toxicity, op10_simhash, op11_best_position, op12_repair_search, op13_suffix_arrays
from loam.llm.tokens import vocabulary


#: The shards of the registered query.
SHARDS = [f"shard-{k:04d}" for k in range(256)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = op1_token_codes.token_codes(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_mixing.taken_words(op2_mixing.mix(_table(spark, sf_dir, "documents")))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_cotraining.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_document_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = op4_sharding.shard_documents(_table(spark, sf_dir, "documents"), SHARDS)
    return sharded.select("doc_id", F.col("_slot").alias("slot"), F.col("_shard").alias("shard"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_language.identify(_table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_pivots.near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = op7_packing.pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_rules.apply_rules(_table(spark, sf_dir, "documents"))


def op9_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op10_simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", op10_simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op11_best_position_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_best_position.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return op12_repair_search.repaired(op12_repair_search.damaged(conversations), conversations)


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = op13_suffix_arrays.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), "_found")
    f = F.col("_found")
    digest = F.sha2(F.array_join(f["items"], ","), 256).alias("items_sha256")
    return found.select("doc_id", f["n_words"].alias("n_words"), f["n_hit"].alias("n_hit"), F.size(f["items"]).cast("long").alias("n_items"), digest, (f["n_hit"] > 0).alias("contaminated"))


OPERATORS = (
    op1_token_output, op2_source_mixing, op3_quality_classifier, op4_document_sharding, op5_language_id,
    op6_embedding_dedup, op7_sequence_packing, op8_quality_rules, op9_toxicity_scores, op10_simhash_dedup,
    op11_best_position_search, op12_conversation_repair, op13_benchmark_decontamination,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {f.__name__: f for f in OPERATORS} | {"pipeline": corpus_pipeline.run}


#: All pairs within a label; at these scales no two vectors of the tables are close, so links are few.
_OP6 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93
), reach(vec_id, to_id) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, p.b FROM reach r JOIN pairs p ON p.a = r.to_id
)
SELECT v.vec_id, (SELECT count(*) FROM pairs p WHERE p.a = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT vec_id, min(to_id) AS component_id FROM reach GROUP BY vec_id) c ON c.vec_id = v.vec_id
"""


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    sql = {"op4_document_sharding": op4_sharding.oracle_sql(SHARDS), "op6_embedding_dedup": _OP6, "op8_quality_rules": op8_rules.ORACLE_SQL}
    sql |= {"op11_best_position_search": op11_best_position.ORACLE_SQL, "op12_conversation_repair": op12_repair_search.ORACLE_SQL, "op13_benchmark_decontamination": op13_suffix_arrays.ORACLE_SQL}
    return sql | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
