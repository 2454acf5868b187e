"""Turns of a reviewer's talk: the latest of a gate, what came before, and lists of them; sources on their board."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Modes of a gate, and the most outcomes that are listed.
MODES, MOST_OUTCOMES = ("review", "assist", "auto"), 2000


def latest(turns: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key by ``order``, with ``passes``: how many there are; it combines on the map side."""
    whole = F.struct(*turns.columns)
    return turns.groupBy(*[F.col(k).alias(f"key_{k}") for k in keys]).agg(F.max_by(whole, F.struct(*order)).alias("row"), F.count("*").alias("passes")).select("row.*", "passes")


def with_prior(turns: DataFrame, key: str, order: list[str], text: str) -> DataFrame:
    """Turns with ``n_before`` and ``chars_before``: how many turns and characters of the key came before."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce(F.length(text), F.lit(0))
    return turns.withColumn("n_before", F.count(F.lit(1)).over(before)).withColumn("chars_before", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long"))


def outcomes(turns: DataFrame, limit: int = MOST_OUTCOMES) -> DataFrame:
    """The newest turns but the opening read, failed ones among them; the list's length is its feature."""
    return turns.where("gate_key <> 'initial_read'").orderBy(F.desc("created_at"), "turn_id").limit(limit)


def board(sources: DataFrame, column: Column, columns: DataFrame) -> DataFrame:
    """(board, place, n): sources by the column of the board that their status falls into; every column is told."""
    return columns.join(sources.groupBy(column.alias("board")).agg(F.count("*").alias("n")), "board", "left").select("board", "place", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def status_counts(sources: DataFrame, now: Column) -> DataFrame:
    """(status, n) of sources (status, updated_at), and a row for those that were completed today; nothing is told of what is not there."""
    each = sources.groupBy("status").agg(F.count("*").alias("n"))
    today = sources.where((F.col("status") == "completed") & (F.to_date("updated_at") == F.to_date(now))).agg(F.lit("completed today").alias("status"), F.count("*").alias("n"))
    return each.unionByName(today).where("n > 0")


def gate_modes(settings: Column, defaults: dict[str, str]) -> dict[str, Column]:
    """Each gate's mode: the source's setting (a map), else the default; a mode that does not exist is review."""
    known = lambda m: F.when(m.isin(*MODES), m).otherwise("review")
    return {gate: known(F.coalesce(F.try_element_at(settings, F.lit(gate)), F.lit(mode))) for gate, mode in defaults.items()}
