"""Integrity checks. Each gives correction records: rule, severity, ref_id, message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _records(bad: DataFrame, rule: str, severity: str, message: Column) -> DataFrame:
    return bad.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col("id").cast("string").alias("ref_id"), message.alias("message"))


def required(objects: DataFrame, fields: list[str]) -> DataFrame:
    """Objects in which a field is null or blank; one scan for all fields."""
    blank = lambda f: F.coalesce(F.trim(F.col(f).cast("string")) == "", F.lit(True))
    missing = F.filter(F.array(*[F.when(blank(f), F.lit(f)) for f in fields]), lambda f: f.isNotNull())
    bad = objects.select("id", F.explode(missing).alias("field"))
    return bad.select(F.concat(F.lit("required:"), F.col("field")).alias("rule"), F.lit("hard_fail").alias("severity"), F.col("id").cast("string").alias("ref_id"), F.concat(F.col("field"), F.lit(" is missing")).alias("message"))


def vocabulary(objects: DataFrame, field: str, known: list[str]) -> DataFrame:
    """Values outside a vocabulary, which are folded to ``other``."""
    bad = objects.where(F.col(field).isNotNull() & ~F.col(field).isin(known))
    return _records(bad, f"vocabulary:{field}", "auto_fix", F.concat(F.col(field), F.lit(" becomes other")))


def unique(objects: DataFrame) -> DataFrame:
    bad = objects.groupBy("id").count().where("count > 1")
    return _records(bad, "unique:id", "hard_fail", F.concat(F.col("count").cast("string"), F.lit(" objects share the id")))


def resolvable(objects: DataFrame, field: str, known: DataFrame) -> DataFrame:
    """References to nothing; null is no reference."""
    ids = known.select(F.col("id").alias(field)).distinct()
    bad = objects.where(F.col(field).isNotNull()).join(ids, field, "left_anti")
    return _records(bad, f"dangling:{field}", "warn", F.concat(F.col(field).cast("string"), F.lit(" is unknown")))


def summary(corrections: DataFrame) -> DataFrame:
    return corrections.groupBy("rule", "severity").agg(F.count("*").alias("n"), F.bool_or(F.col("severity") == "hard_fail").alias("fails"))
