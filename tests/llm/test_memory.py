"""Workers that stay after their task are to hold little."""

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from loam.llm import shared


def test_a_worker_gives_back_memory_after_the_last_batch(monkeypatch):
    said = []
    pool = type("Pool", (), {"release_unused": lambda self: said.append("released")})()
    monkeypatch.setattr(pa, "default_memory_pool", lambda: pool)

    def doubled(batches):
        for k in batches:
            said.append(k)
            yield 2 * k

    assert list(shared.lean(doubled)(iter([1, 2]))) == [2, 4]
    assert said == [1, 2, "released"]


def test_lean_functions_are_udfs_as_before(spark):
    from collections.abc import Iterator

    def more(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch + 1

    rows = spark.range(3).select(F.pandas_udf(shared.lean(more), "long")("id").alias("n"))
    assert sorted(r.n for r in rows.collect()) == [1, 2, 3]
