"""Operators and functions on small inputs: ties, nulls, empty tables, odd texts."""

import json

import pytest
from pyspark.sql import functions as F

from loam.functions import entities as N, scores as S, text as T
from loam.operators import checks as C, components as P, graph as G, records as R, retrieval as M, spans
from loam.sources import tables
from loam.streaming import ledgers as L


def values(spark, expression, *rows, kind="string"):
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(rows)], f"k int, v {kind}")
    return [r.x for r in frame.select("k", expression(F.col("v")).alias("x")).orderBy("k").collect()]


def test_text_functions(spark):
    assert values(spark, T.tokens, "The the CAT's it", None, "") == [["the", "cat"], [], []]
    assert values(spark, T.refang, " hxxps://a[.]b(:)8/ ", "HXXTP://x", "u [AT] d{.}e", "plain", None) == ["https://a.b:8/", "http://x", "u @ d.e", "plain", None]
    assert values(spark, T.cve_id, "see cve_2021 44228!", "CVE-20-1", None) == ["CVE-2021-44228", None, None]
    assert values(spark, T.tidy_space, " a \t\n\n\n\nb  \n") == ["a\n\nb"]
    assert values(spark, T.expand_ligatures, "ﬁnd ﬂow oﬃce") == ["find flow office"]
    assert values(spark, T.ipv4, "[10.0.0.1]:80", "256.1.1.1", "01.2.3.4") == ["10.0.0.1", None, None]
    assert values(spark, T.hive, "hklm\\SOFTWARE", "HKLMX\\a", "HKCU") == ["HKEY_LOCAL_MACHINE\\SOFTWARE", "HKLMX\\a", "HKEY_CURRENT_USER"]
    assert values(spark, T.hash_kind, "a" * 40, "a" * 41) == ["SHA-1", None]
    assert values(spark, N.has_placeholder, "<org>.a.com", "a[.]b", "{12345678-1234-1234-1234-123456789abc}", None) == [True, False, False, False]
    assert values(spark, N.without_placeholder, "<org>.a.com", "a<b>c", "plain") == ["a.com", None, "plain"]
    broken = '{"p":"C:\\Win\\n\\\\x"}'
    assert json.loads(values(spark, N.repaired_json, broken)[0]) == {"p": "C:\\Win\n\\x"}


def test_fingerprint_does_not_depend_on_order(spark):
    a, b = (values(spark, lambda v: T.fingerprint(v, v, v), rows, kind="array<string>")[0] for rows in (["x", "y"], ["y", "x"]))
    assert a == b and len(a) == 32


def test_scores(spark):
    now = F.lit("2024-03-01").cast("timestamp")
    row = spark.range(1).select(
        S.salience(F.lit(0), F.lit(0), F.lit(1), F.lit(None).cast("timestamp"), now).alias("fresh"),
        S.salience(F.lit(0), F.lit(0), F.lit(1), F.lit("2024-01-16").cast("timestamp"), now).alias("old"), S.rate(F.lit(1), F.lit(0)).alias("none"),
        S.composite_confidence(F.lit(None).cast("int"), F.lit(100), F.lit(99)).alias("c"),
    ).first()
    assert row.fresh == pytest.approx(2 / 3 * 0.693147, abs=1e-5) and row.old == pytest.approx(row.fresh / 2) and row.none is None and row.c == 84


def test_records(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 3, "z"), (None, 4, "w")], "k string, pos int, v string")
    assert {(r.k, r.v) for r in R.first_wins(rows, ["k"], "pos").collect()} == {("a", "y"), (None, "z")}
    best = R.best_wins(rows, ["k"], [F.lit(1)], "pos", "first").collect()
    assert {(r.k, r.v, r.first) for r in best} == {("a", "y", 1), (None, "z", 3)}
    assert R.first_wins(rows.limit(0), ["k"], "pos").count() == 0
    redirects = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (8, 7)], "from_id long, to_id long")
    found = {r.id: (r.final_id, r.hops) for r in R.resolve(spark.createDataFrame([(1,), (3,), (7,)], "id long"), redirects, 4).collect()}
    assert found[1] == (3, 2) and found[3] == (3, 0) and found[7][1] == -1
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert {(r.id, r.v) for r in R.upsert(old, new, "id", F.col("v") == "x").collect()} == {(1, "a"), (2, "b"), (3, "d")}
    assert {(r.id, r.v) for r in R.upsert(old, new, "id", F.lit(True)).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert sorted(r.v for r in R.suffixed(spark.createDataFrame([(1, "n", 5), (1, "n", 4), (2, "m", 1)], "k int, v string, o int"), ["k"], "v", "o").collect()) == ["m", "n", "n-2"]


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 2), (1, 1), (5, None), (1, 2)], "src long, dst long")
    assert {(r.node, r.role, r.n) for r in G.joints(edges).collect()} == {(2, "converge", 2)}
    assert {r.node for r in G.cyclic(edges).collect()} == {1, 2, 3, 4}  # a loop is a cycle
    present = spark.createDataFrame([(1,), (4,)], "node long")
    assert {(r.src, r.dst) for r in G.splice(edges, present).collect()} == {(1, 4)}
    assert {(r.node, r.depth) for r in G.reachable(edges, spark.createDataFrame([(1,)], "node long")).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    paths = G.shortest_paths(edges, spark.createDataFrame([(1, 4)], "src long, dst long")).collect()
    assert [r.path for r in paths] == [[1, 2, 4]]
    raw = spark.createDataFrame([("d", 9, 1, "a"), ("d", 3, 5, "b"), ("d", 8, 12, "c")], "doc string, first int, last int, kind string")
    assert {(r.first, r.last, r.kind) for r in G.section_ranges(raw).collect()} == {(1, 9, "a"), (10, 12, "c")}
    found = P.connected_components(spark.createDataFrame([(3, 2), (2, 9), (5, 5), (7, 6)], "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {2: 2, 3: 2, 9: 2, 6: 6, 7: 6}
    assert P.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_checks(spark):
    o = spark.createDataFrame([(1, "n", "F", 10), (2, " ", "Q", 11), (2, None, None, None)], "id int, name string, role string, ref int")
    known = spark.createDataFrame([(10,)], "id int")
    found = C.required(o, ["name"]).unionByName(C.vocabulary(o, "role", ["F"])).unionByName(C.unique(o)).unionByName(C.resolvable(o, "ref", known))
    assert {(r.rule, r.n, r.fails) for r in C.summary(found).collect()} == {("required:name", 2, True), ("vocabulary:role", 1, False), ("unique:id", 1, True), ("dangling:ref", 1, False)}


def test_retrieval(spark):
    texts = spark.createDataFrame([(1, "we saw the quick brown fox jump over it"), (2, "the quick brown dog"), (3, None), (4, "")], "id long, text string")
    items = spark.createDataFrame([(1, "the quick brown fox jump over"), (2, "brown"), (3, "zzz")], "item long, text string")
    assert {(r.id, r.item) for r in M.contained(texts, items).collect()} == {(1, 1), (1, 2), (2, 2)}
    best = M.top(M.shared_tokens(texts, items), 1).collect()
    assert {(r.id, r.item) for r in best} == {(1, 1), (2, 1)}
    group = texts.withColumn("group", F.lit(1))
    assert {(r.id, r.other) for r in M.overlapping(group, 0.3).collect()} == {(1, 2)}


def test_spans():
    assert spans.closeness("certutil -decode a b", "run certutil -decode a c now") == pytest.approx(0.95)
    assert spans.closeness("short", "short") == 0 and spans.closeness(None, None) == 0


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é fine text of ten letters".encode())
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    found = {r.path.split("/")[-1]: r for r in tables.read_texts(spark, str(tmp_path / "*.txt")).collect()}
    assert found["a.txt"].status == "parsed" and found["a.txt"].warnings == ["fewer than 50 words"] and found["b.txt"].status == "failed"
    bundle = {"objects": [
        {"id": "attack-pattern--1", "type": "attack-pattern", "name": "N", "external_references": [{"source_name": "x", "external_id": "0"}, {"source_name": "mitre-attack", "external_id": "T1"}],
         "kill_chain_phases": [{"kill_chain_name": "mitre-attack", "phase_name": "execution"}, {"kill_chain_name": "other", "phase_name": "no"}]},
        {"id": "attack-pattern--2", "type": "attack-pattern", "name": "no id"}, {"id": "tool--1", "type": "tool"},
    ]}
    (tmp_path / "bundle.json").write_text(json.dumps(bundle, indent=1))
    rows = tables.techniques(tables.read_catalogue(spark, str(tmp_path / "bundle.json"))).collect()
    assert [(r.technique_id, r.tactics, r.platforms, r.revoked) for r in rows] == [("T1", ["execution"], [], False)]
    nodes = spark.createDataFrame([("a", "Tool"), ("b", "Malware")], "id string, label string")
    edges = spark.createDataFrame([("a", "b", "USES")], "src string, dst string, verb string")
    tables.write_graph(nodes, edges, str(tmp_path / "graph"))
    assert spark.read.parquet(str(tmp_path / "graph/nodes")).where("label = 'Tool'").count() == 1


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "event_id long, user_id long, event_type string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    rows((1, 1, "queued", "2024-01-01"), (2, 2, "queued", "2024-01-01")).write.parquet(f"{folder}/events.parquet")

    def run():
        frame = L.latest_status(L.event_stream(spark, folder), "user_id", F.col("event_type"), F.struct("at", "event_id"))
        L.run_once(frame, out, "update")
        return {(r.user_id, r.status, r.n) for r in L.newest_rows(spark, out, frame.schema, ["user_id"]).collect()}

    assert run() == {(1, "queued", 1), (2, "queued", 1)}
    rows((3, 1, "done", "2024-01-02"), (4, 1, "late", "2023-12-31")).write.mode("append").parquet(f"{folder}/events.parquet")
    assert run() == {(1, "done", 3), (2, "queued", 1)}
