"""Every query with SQL gives the SQL's rows, on the smallest tables."""

import duckdb
import pytest

from loam.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    text = lambda v: None if v is None or v != v else repr(round(float(v), 6)) if isinstance(v, float) else str(v)
    return columns, sorted([tuple(text(v) for v in r) for r in frame[columns].astype(object).where(frame[columns].notna(), None).to_numpy().tolist()], key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    assert rows(catalogue.queries()[name](spark, sf_dir).toPandas()) == rows(duck.execute(SQL[name]).df())


def test_entry_reads_without_the_training_operators():
    import __spark_entry__ as entry

    assert set(SQL) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_queries_without_sql(spark, sf_dir):
    """Their operators have brute-force tests; here a ratio of difflib and pairs that go both ways."""
    from loam.operators.spans import closeness

    found = catalogue.queries()
    assert set(found) - set(SQL) == {"chunk_overlaps", "command_closeness"}
    pairs = found["chunk_overlaps"](spark, sf_dir).collect()
    assert pairs and {(r.source_id, r.chunk_id, r.other) for r in pairs} == {(r.source_id, r.other, r.chunk_id) for r in pairs}
    turns = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()}
    ratios = found["command_closeness"](spark, sf_dir).collect()
    for r in ratios[:20]:
        command = " ".join(turns[r.conv_id, r.turn].split(" ")[:12])
        source = turns[r.conv_id, r.turn + 1] + (f" {command}" if r.turn % 2 == 0 else "")
        assert r.ratio == round(closeness(command, source), 6)
    assert any(r.near for r in ratios) and not all(r.near for r in ratios)
