"""The functions for SQL: what they find, refuse, and how they are set up."""

import pytest

from loam.functions import session
from loam.functions.text import one_space
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def sql(spark):
    session.register(spark)
    session.register(spark)
    return spark.sql


def test_spans_in_lateral_joins(sql):
    rows = "VALUES (1, 'a b  a\n\tb c', 'a b'), (2, 'é aa aaa', 'aa'), (3, NULL, 'x'), (4, 'x', NULL), (5, 'x', ' '), (6, 'a.b a+b', 'a.b'), (6, 'a.b', 'a.b')"
    found = sql(f"SELECT t.k, s.nth, s.first, s.last FROM {rows} AS t(k, text, excerpt), LATERAL loam_spans(t.text, t.excerpt) s").collect()
    assert sorted(tuple(r) for r in found) == [(1, 1, 0, 3), (1, 2, 5, 9), (2, 1, 2, 4), (2, 2, 5, 7), (6, 1, 0, 3), (6, 1, 0, 3)]
    with pytest.raises(Exception, match="is to be a text"):
        sql("SELECT * FROM loam_spans('x', 1)").collect()


def test_ranked_rows_of_a_table(sql):
    rows = "VALUES ('a', 1.0D, 'x'), ('a', 3.0D, 'z'), ('a', 3.0D, 'y'), ('a', NULL, 'n'), ('b', NULL, 'n'), (NULL, 2.0D, 'q'), (NULL, 1.0D, 'r'), (NULL, 0.0D, 's')"
    found = sql(f"SELECT * FROM loam_ranked(TABLE(SELECT * FROM {rows} AS t(k, score, name)), 'k', 'score', 'name', 2)").collect()
    assert sorted([(r.k, r.name, r["rank"]) for r in found], key=str) == [("a", "y", 1), ("a", "z", 2), ("b", "n", 1), (None, "q", 1), (None, "r", 2)]
    assert sql(f"SELECT * FROM loam_ranked(TABLE(SELECT * FROM {rows} AS t(k, score, name) WHERE false), 'k', 'score', 'name', 2)").count() == 0
    with pytest.raises(Exception, match="no column nope"):
        sql(f"SELECT * FROM loam_ranked(TABLE(SELECT * FROM {rows} AS t(k, score, name)), 'nope', 'score', 'name', 2)").collect()
    plan = sql(f"SELECT * FROM loam_ranked(TABLE(SELECT * FROM {rows} AS t(k, score, name)), 'k', 'score', 'name', 2)")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" in plan and "Sort" in plan


def test_paths_of_three_steps(sql):
    links = "VALUES ('r', 1, 'r', 'a'), ('r', 1, 'r', 'b'), ('r', 2, 'a', 'x'), ('r', 2, 'b', 'x'), ('r', 2, 'c', 'x'), ('r', 3, 'x', 'n'), ('r', 3, 'x', 'n'), ('r', 3, 'y', 'm'), ('s', 3, 'x', 'n')"
    found = sql(f"SELECT * FROM loam_source_paths(TABLE(SELECT * FROM {links} AS t(root, step, src, dst)))").collect()
    assert sorted(tuple(r) for r in found) == [("r", "a", "x", "n"), ("r", "b", "x", "n")]


def test_inline_functions_equal_the_expressions(spark, sql):
    row = sql("SELECT loam_one_space(' a \t b\n') AS a, loam_salience(3, 1, 4, 45) AS b, loam_salience(3, 1, -4, NULL) AS c").first()
    assert row.a == spark.createDataFrame([(" a \t b\n",)], "t string").select(one_space(F.col("t"))).first()[0]
    assert round(row.b, 9) == round((5 / 7) * 0.5 * __import__("math").log(5), 9) and row.c == 0
    assert "PythonUDF" not in sql("SELECT loam_salience(id, 1, 4, 45) FROM range(3)")._jdf.queryExecution().optimizedPlan().toString()
