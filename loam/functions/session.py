"""Functions for Spark SQL: register(spark) names them in a session, and queries written in SQL alone can use them."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from loam.functions import scores

#: Excerpts whose pattern a task keeps.
MOST_PATTERNS = 10_000


class Spans:
    """Where an excerpt stands in a text, white space runs being equal: (nth from 1, first, last excluded), left to right, without overlap.

    Nulls and excerpts without a word stand nowhere. One object serves all rows of a partition, and keeps the patterns that it has made.
    """

    SCHEMA = StructType([StructField(c, IntegerType()) for c in ("nth", "first", "last")])

    @staticmethod
    def analyze(text: AnalyzeArgument, excerpt: AnalyzeArgument) -> AnalyzeResult:
        for name, argument in (("text", text), ("excerpt", excerpt)):
            if argument.isTable or argument.dataType not in (StringType(), None) and argument.dataType.typeName() != "void":
                raise ValueError(f"{name} is to be a text, not {argument.dataType}")
        return AnalyzeResult(Spans.SCHEMA)

    def __init__(self) -> None:
        self.patterns: dict[str, re.Pattern[str]] = {}

    def eval(self, text: str, excerpt: str) -> Iterator[tuple[int, int, int]]:
        words = (excerpt or "").split()
        if not words or not text:
            return
        key = " ".join(words)
        if key not in self.patterns:
            if len(self.patterns) >= MOST_PATTERNS:
                self.patterns.clear()
            self.patterns[key] = re.compile(r"\s+".join(map(re.escape, words)))
        for nth, found in enumerate(self.patterns[key].finditer(text), 1):
            yield nth, found.start(), found.end()


class Ranked:
    """The ``most`` rows of each ``key`` with the largest ``score``, and their rank: all columns of the table, then ``rank``.

    ``ties`` names a column by which equal scores go, ascending. Rows come partitioned and sorted by Spark, so an object counts them and holds none;
    a null score comes last.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, score: AnalyzeArgument, ties: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument is to be a TABLE(...)")
        for argument in (key, score, ties, most):
            if not argument.isConstantExpression or argument.value is None:
                raise ValueError("key, score, ties and most are to be constants")
        names = {f.name for f in rows.dataType.fields}
        missing = [a.value for a in (key, score, ties) if a.value not in names]
        if missing:
            raise ValueError(f"the table has no column {', '.join(missing)}")
        schema = StructType([*rows.dataType.fields, StructField("rank", IntegerType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(score.value, ascending=False, overrideNullsFirst=False), OrderingColumn(ties.value, ascending=True)])

    def __init__(self) -> None:
        self.rank = 0

    def eval(self, row: Row, key: str, score: str, ties: str, most: int) -> Iterator[tuple]:
        self.rank += 1
        if self.rank <= most:
            yield (*row, self.rank)


class SourcePaths:
    """Paths of three steps through a catalogue's links, from a table (root, step: 1 to 3, src, dst): (root, first, second, third).

    A root's links are one partition and come by step; paths are told when they end, so of a root its first two steps alone are held. Links may
    repeat; a path is told once for each of its last links that differ.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or [f.name for f in rows.dataType.fields] != ["root", "step", "src", "dst"]:
            raise ValueError("the argument is to be a TABLE(...) of root, step, src, dst")
        text = [StructField(c, StringType()) for c in ("first", "second", "third")]
        return AnalyzeResult(StructType([rows.dataType.fields[0], *text]), partitionBy=[PartitioningColumn("root")], orderBy=[OrderingColumn("step", ascending=True), OrderingColumn("src", ascending=True), OrderingColumn("dst", ascending=True)])

    def __init__(self) -> None:
        self.first: set[str] = set()
        self.into: dict[str, set[str]] = {}
        self.before: tuple[str, str] | None = None

    def eval(self, row: Row) -> Iterator[tuple]:
        if row["step"] == 1:
            self.first.add(row["dst"])
        elif row["step"] == 2 and row["src"] in self.first:
            self.into.setdefault(row["dst"], set()).add(row["src"])
        elif row["step"] == 3 and (row["src"], row["dst"]) != self.before:
            self.before = (row["src"], row["dst"])
            for first in sorted(self.into.get(row["src"], ())):
                yield row["root"], first, row["src"], row["dst"]


#: Functions that Spark puts in place of their calls, so they stay in its own plan.
INLINE = {
    "loam_one_space": "(text STRING) RETURNS STRING RETURN trim(regexp_replace(text, '[ \\\\t\\\\n\\\\x0B\\\\f\\\\r]+', ' '))",
    "loam_salience": "(hits DOUBLE, misses DOUBLE, occurrences DOUBLE, age_days DOUBLE) RETURNS DOUBLE RETURN "
    f"(hits + {scores.ALPHA}D) / (hits + misses + {scores.ALPHA}D + {scores.BETA}D) * coalesce(pow(0.5D, age_days / {scores.HALF_LIFE_DAYS}D), 1.0D) * ln(1.0D + greatest(occurrences, 0.0D))",
}
TABLE_FUNCTIONS = {"loam_spans": Spans, "loam_ranked": Ranked, "loam_source_paths": SourcePaths}


def register(spark: SparkSession) -> None:
    """Names all functions in a session; doing so again replaces them."""
    from pyspark.sql.functions import udtf

    for name, text in INLINE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{text}")
    for name, handler in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(handler))
