"""Steps that several parts of a query read are made once."""

import re

from loam.operators import chunks as K, graph as G
from loam.plans import feedback_queries, flow_queries, source_queries


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_distinct_ends_of_an_actor_are_counted_apart(spark, sf_dir):
    assert "Expand" not in plan(flow_queries.actor_rollup(spark, sf_dir))


def test_chunks_of_decisions_are_made_once(spark, sf_dir):
    assert "o_custkey" not in plan(source_queries.chunk_decisions(spark, sf_dir))


def test_links_of_reports_are_joined_once(spark, sf_dir, monkeypatch):
    plans, real = [], feedback_queries.S.upserted

    def upserted(nodes, edges, path, buckets):
        plans.append(plan(edges))
        real(nodes, edges, path, buckets)

    monkeypatch.setattr(feedback_queries.S, "upserted", upserted)
    assert feedback_queries.graph_upserts(spark, sf_dir).where("what = 'DESCRIBES'").count() == 1
    assert len(plans) == 3 and not any("Join" in p for p in plans)


def test_joints_and_conditions_meet_procedures_in_one_join(spark):
    rows = [("s", "a", "b"), ("s", "a", "c"), ("s", "a", "c"), ("s", "b", "d"), ("s", "c", "d"), ("s", "d", "d"), ("s", "b", "x"), ("s", "c", "x")]
    edges, procs = spark.createDataFrame(rows, "source_id string, src string, dst string"), spark.createDataFrame([("s", k, f"p--{k}") for k in "abcd"], "source_id string, chunk_id string, stix_id string")
    joints = K.operator_objects(K.operators(edges), procs)
    assert plan(joints).count("Join") == 1
    assert sorted((r.anchor, r.role, r.effect_refs) for r in joints.collect()) == [("a", "branch", ["p--b", "p--c"]), ("d", "converge", ["p--d"])]
    told = [("s", "a", "if", None, None, ["c", "x", "b"], []), ("s", "b", "if", "p", "t", ["x"], ["d"]), ("s", "c", "if", "p", None, ["x"], [])]
    conds = K.condition_objects(spark.createDataFrame(told, "source_id string, anchor string, description string, pattern string, pattern_type string, on_true_ids array<string>, on_false_ids array<string>"), procs)
    assert plan(conds).count("Join") == 1
    assert sorted((r.anchor, r.pattern or "", r.on_true_refs, r.on_false_refs) for r in conds.collect()) == [("a", "", ["p--c", "p--b"], []), ("b", "p", [], ["p--d"])]


def test_an_edge_is_shuffled_once_for_all_that_is_known_of_an_end(spark):
    rows = [("s", "a", "b"), ("s", "a", "c"), ("s", "b", "d"), ("s", "c", "d"), ("s", "c", "x"), ("s", "x", "y"), ("s", "y", "a")]
    edges, procs = spark.createDataFrame(rows, "source_id string, src string, dst string"), spark.createDataFrame([("s", k, f"p--{k}") for k in "abcd"], "source_id string, chunk_id string, stix_id string")
    joints = spark.createDataFrame([("s", "a", "branch", "o--a"), ("s", "d", "converge", "o--d")], "source_id string, anchor string, role string, id string")
    found = K.routed(edges, procs, joints, spark.createDataFrame([("s", "b", "c--b")], "source_id string, anchor string, id string"))
    ends = [("o--a", "p--b"), ("o--a", "p--c"), ("o--d", "p--d"), ("c--b", "o--d"), ("p--a", "o--a"), ("p--b", "c--b"), ("p--c", "o--d"), ("p--c", "p--a")]
    assert sorted((r.source_ref, r.target_ref) for r in found.collect()) == sorted(ends)
    assert re.findall(r"Join \w+, .* AND \((\w+)#\d+ = ", plan(found)) == ["dst", "dst", "src", "src", "src"]  # the last join first


def test_a_splice_writes_its_edges_once(spark, monkeypatch):
    names, real = [], G.saved
    monkeypatch.setattr(G, "saved", lambda df, name, *rest: names.append(name) or real(df, name, *rest))
    edges = spark.createDataFrame([(1, 2), (2, 3), (2, 3), (3, 4), (4, 2), (1, 1), (5, None), (1, 4)], "src long, dst long")
    assert sorted(map(tuple, G.splice(edges, spark.createDataFrame([(1,), (4,), (4,)], "node long")).collect())) == [(1, 4)]
    assert names == ["splice-edges", "splice-places", "splice-steps", "splice-places", "splice-steps", "splice-places"]
