"""Row and key operators: first-wins and best-wins dedup, lanes, promotions, upserts, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def first_wins(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The row with the smallest position of each key; an aggregate that combines on the map side, so hot keys do no harm."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min_by(whole, position).alias("_row")).select("_row.*")


def best_wins(df: DataFrame, keys: list[str], order: list[Column], position: str, first_as: str, ties: tuple[Column, ...] = ()) -> DataFrame:
    """The row with the largest order of each key, the smallest position among equals, at the key's first position.

    Of rows that are equal in all that, the largest by ``ties``, then by its columns, so that reruns agree.
    """
    whole = F.struct(*[F.col(c) for c in df.columns])
    rank = F.struct(*order, (-F.col(position)).alias("_p"), *ties, whole.alias("_whole"))
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(whole, rank).alias("_row"), F.min(position).alias(first_as)).select("_row.*", first_as)


def resolve(found: DataFrame, redirects: DataFrame, hops: int = 10) -> DataFrame:
    """(id) -> (id, final_id, hops): follow redirects (from_id, to_id) until there is none, ``hops`` times at most.

    A chain longer than that, or a cycle, keeps its last id with hops = -1.
    """
    at = found.select("id", F.col("id").alias("final_id"), F.lit(0).alias("hops"))
    for _ in range(hops):
        step = redirects.select(F.col("from_id").alias("final_id"), "to_id")
        at = at.join(step, "final_id", "left").select("id", F.coalesce("to_id", "final_id").alias("final_id"), (F.col("hops") + F.col("to_id").isNotNull().cast("int")).alias("hops"))
    more = redirects.select(F.col("from_id").alias("final_id"), F.lit(True).alias("_more"))
    return at.join(more, "final_id", "left").select("id", "final_id", F.when(F.col("_more"), -1).otherwise(F.col("hops")).alias("hops"))


def upsert(old: DataFrame, new: DataFrame, key: str, may_change: Column) -> DataFrame:
    """Rows of both by key: the new one where there is no old one or the old one ``may_change``, else the old one."""
    columns = [c for c in old.columns if c != key]
    o, n = old.select(key, F.struct(*columns).alias("_o"), may_change.alias("_may")), new.select(key, F.struct(*columns).alias("_n"))
    taken = F.when(F.col("_o").isNull() | (F.col("_may") & F.col("_n").isNotNull()), F.col("_n")).otherwise(F.col("_o"))
    return o.join(n, key, "full_outer").select(key, taken.alias("_row")).select(key, "_row.*")


def decided(items: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Items with the reviewer's action; an item that nobody mentions is approved."""
    return items.join(decisions.select(key, F.col("action").alias("_a")), key, "left").withColumn("action", F.coalesce("_a", F.lit("approve"))).drop("_a")


def suffixed(df: DataFrame, keys: list[str], name: str, order: str) -> DataFrame:
    """``name`` with -2, -3 and so on behind the second and later rows of a key."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn(name, F.when(n > 1, F.concat(F.col(name), F.lit("-"), n.cast("string"))).otherwise(F.col(name)))
