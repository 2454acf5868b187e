"""The record operators on hand-made rows: nulls, empty values, ties, repeats and empty tables."""

import json

import pytest
from pyspark.sql import functions as F

from loam.functions import values as V
from loam.operators import brands, bundle as B, chunks as K, drafts as D, entities as E, feedback as X, graph as G, picks as P, relationships as R, retrieval as M, schemas, turns as N
from loam.sources import catalogue as C, shared, store as S, tables


def objects(spark, *bodies, bundle=1):
    rows = [(bundle, k, json.dumps(b) if isinstance(b, dict) else b) for k, b in enumerate(bodies)]
    return B.objects_from_json(spark.createDataFrame(rows, "bundle long, position long, body string"))


def rel(id_, verb, src, dst):
    return {"id": id_, "type": "relationship", "relationship_type": verb, "source_ref": src, "target_ref": dst}


def rules(df):
    return sorted(((r.rule, r.ref_id, r.ref_field, r.holder_id) for r in df.collect()), key=str)


def test_object_checks(spark):
    o = objects(
        spark, {"type": "tool", "id": "tool--1", "created": "x", "modified": "x"}, {"type": "tool", "id": "tool--1"}, {"id": "no-type"}, {"type": "malware"}, {"type": "url", "id": "url--1"},
        {"type": "relationship", "id": "relationship--1", "source_ref": "tool--1"}, {"type": "x-procedure", "id": "x-procedure--1", "created": "a", "modified": "", "name": "n", "x_technique_refs": [], "x_source_refs": ["identity--9"]}, "no json",
    )
    assert rules(B.object_schema(o)) == sorted([
        ("object_missing_id", None, None, None), ("object_missing_type", "no-type", None, None), ("object_missing_type", None, None, None), ("relationship_missing_required_field", "relationship--1", "relationship_type", None),
        ("relationship_missing_required_field", "relationship--1", "target_ref", None), ("sdo_missing_created", "tool--1", None, None), ("sdo_missing_modified", "tool--1", None, None), ("sdo_missing_modified", "x-procedure--1", None, None),
    ], key=str)
    assert rules(B.id_uniqueness(o)) == [("duplicate_object_id", "tool--1", None, None)]
    assert rules(B.procedure_fields(o)) == [("x_procedure_missing_required_field", "x-procedure--1", "x_technique_refs", None)]
    assert rules(B.dangling_checks(o)) == [("dangling_ref_unrecoverable", "identity--9", "x_source_refs", "x-procedure--1")]
    assert [r.passed for r in B.verdicts(o, B.validated(o)).collect()] == [False]
    empty = objects(spark, {"type": "url", "id": "url--1"}).limit(0)
    assert B.validated(empty).count() == 0 and B.verdicts(empty, B.validated(empty)).count() == 0


def test_flow_checks_over_several_bundles(spark):
    flow = {B.FLOW_EXTENSION: {"extension_type": "new-sdo"}}
    one = objects(
        spark, rel("relationship--1", "precedes", "a", "b"), {"type": "attack-operator", "id": "b", "operator": "AND", "effect_refs": ["c"], "extensions": flow}, {"type": "attack-condition", "id": "c", "description": " ", "on_true_refs": ["a"], "pattern_type": "regex"},
        {"type": "attack-flow", "id": "f1"}, {"type": "attack-flow", "id": "f2"},
    )
    two = objects(spark, rel("relationship--1", "precedes", "a", "b"), rel("relationship--2", "precedes", "b", "c"), {"type": "attack-operator", "id": "o", "operator": "NOT"}, bundle=2)
    both = one.unionByName(two)
    assert [(r.bundle, r.rule) for r in B.flow_cycles(both).collect()] == [(1, "precedes_cycle")]
    assert {r[0] for r in rules(B.operator_integrity(both))} == {"attack_operator_invalid_kind", "attack_operator_no_effect_refs"}
    assert {r[0] for r in rules(B.condition_integrity(both))} == {"attack_condition_no_description", "attack_condition_pattern_type_without_pattern", "attack_condition_dangling_ref"}
    assert [r.rule for r in B.single_flow(both).collect()] == ["multiple_attack_flows"]
    assert {(r[0], r[1]) for r in rules(B.extension_declarations(both))} == {("attack_flow_extension_undeclared", x) for x in ("c", "f1", "f2", "o")} | {("extension_definition_missing", B.FLOW_EXTENSION)}


def test_mends_follow_one_another(spark):
    o = objects(
        spark, {"type": "identity", "id": "identity--1", "organization_role": "owner", "sectors": ["Defence", "energy", "odd"]}, {"type": "x-procedure", "id": "x-procedure--1", "created_by_ref": "identity--1", "x_technique_refs": ["attack-pattern--1", "attack-pattern--1", ""]},
        rel("relationship--1", "targets", "identity--1", "x-procedure--1"), rel("relationship--2", "targets", "x-procedure--1", "identity--1"), rel("relationship--3", "uses", "x-procedure--1", "attack-pattern--2"), rel("relationship--4", "precedes", "x-procedure--1", "x-procedure--1"),
        rel("relationship--5", "precedes", "x-procedure--1", "x"), rel("relationship--6", "uses", None, "x"), rel("relationship--7", "uses", None, "x"),
    )
    fixed, told = B.auto_fixed(o, spark.createDataFrame([(1, False)], "bundle long, is_sequential boolean"))
    assert sorted(r.rule for r in told.collect()) == sorted(["sro_direction_flipped", "sro_duplicate_dropped", "embedded_refs_deduplicated", "precedes_self_loop_dropped", "precedes_dropped_non_sequential", "embedded_technique_refs_synced", "x_source_refs_backfilled", "fingerprint_recomputed", "invalid_role_coerced", "invalid_sector_coerced", "invalid_sector_dropped"])
    rows = {r.id: r for r in fixed.collect()}
    assert set(rows) == {"identity--1", "x-procedure--1", "relationship--1", "relationship--3", "relationship--6", "relationship--7"}
    assert rows["x-procedure--1"].lists["x_technique_refs"] == ["attack-pattern--1", "attack-pattern--2"] and rows["x-procedure--1"].lists["x_source_refs"] == ["identity--1"]
    assert rows["identity--1"].sectors == ["defense", "energy"] and rows["identity--1"].labels == ["sector:defence"] and rows["identity--1"].props["organization_role"] == "other"
    again, nothing = B.auto_fixed(fixed, spark.createDataFrame([], "bundle long, is_sequential boolean"))
    assert nothing.count() == 0 and again.count() == fixed.count()


def test_mends_write_their_objects_once(spark):
    o = objects(
        spark, {"type": "identity", "id": "i"}, rel("r1", "targets", "i", "x-procedure--1"), {"type": "x-procedure", "id": "x-procedure--1", "x_source_refs": ["i", "i"]}, rel("r2", "precedes", "a", "b"),
        {"type": "relationship", "id": "r3", "relationship_type": "precedes", "source_ref": "a", "target_ref": "b", "object_refs": ["z", "z"]}, {"type": "relationship", "id": "r4", "relationship_type": "precedes", "object_refs": ["z", ""]},
    )
    both = o.unionByName(o.withColumn("bundle", F.lit(2).cast("long")))
    before = len(shared._WRITTEN)
    fixed, told = B.auto_fixed(both, spark.createDataFrame([(2, False)], "bundle long, is_sequential boolean"))
    assert [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in shared._WRITTEN[before:]] == ["bundle-objects", "bundle-links"]
    every = [("embedded_refs_deduplicated", None, "r4"), ("embedded_refs_deduplicated", None, "x-procedure--1"), ("fingerprint_recomputed", None, "x-procedure--1"), ("precedes_self_loop_dropped", "r4", None), ("sro_direction_flipped", "r1", None), ("sro_duplicate_dropped", "r3", None)]
    found = [(r.bundle, r.rule, r.ref_id, r.holder_id) for r in told.collect()]
    assert sorted(found, key=str) == sorted([(b, *x) for b in (1, 2) for x in every] + [(2, "precedes_dropped_non_sequential", None, None)], key=str)
    assert sorted((r.bundle, r.id) for r in fixed.collect()) == [(1, "i"), (1, "r1"), (1, "r2"), (1, "x-procedure--1"), (2, "i"), (2, "r1"), (2, "x-procedure--1")]
    assert {(r.single["source_ref"], r.single["target_ref"]) for r in fixed.where("id = 'r1'").collect()} == {("x-procedure--1", "i")}


def test_a_flow_is_searched_for_cycles_without_their_nodes(spark):
    ring = [rel(f"r{k}", "precedes", f"n{k}", f"n{(k + 1) % 9}") for k in range(9)]
    o = objects(spark, *ring, rel("t", "precedes", "n0", "tail")).unionByName(objects(spark, *ring[:8], rel("l", "precedes", "x", "x"), bundle=2)).unionByName(objects(spark, *ring[:8], bundle=3))
    before = len(shared._WRITTEN)
    assert sorted((r.bundle, r.rule) for r in B.flow_cycles(o).collect()) == [(1, "precedes_cycle"), (2, "precedes_cycle")]
    assert not [p for p in shared._WRITTEN[before:] if "colours" in p]


def test_a_bundles_tables_are_read_once(spark, sf_dir):
    from loam.plans.bundle_queries import objects as bundles

    plan = bundles(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert all(plan.count(f"/{t}.parquet") == 1 for t in ("orders", "lineitem", "customer"))


def test_dangling_references_are_recovered_over_several_steps(spark):
    mine = objects(spark, {"type": "report", "id": "report--1", "object_refs": ["a", "lost"]})
    upstream = objects(spark, {"type": "tool", "id": "a", "object_refs": ["b"]}, {"type": "tool", "id": "b", "object_refs": ["c"]}, {"type": "tool", "id": "c"}, bundle=7)
    out, told = B.recovered(mine, upstream)
    assert {r.id for r in out.collect()} == {"report--1", "a", "b", "c"} and told.count() == 3
    assert [r.ref for r in B.dangling_references(out).collect()] == ["lost"]


def test_malformed_references(spark):
    bad = spark.createDataFrame([(1, 0, '{"id": "x", "type": "t", "source_ref": {"a": 1}, "object_refs": ["a", 2, null], "start_refs": "s"}'), (1, 1, '{"id": "y", "source_ref": null, "object_refs": []}'), (1, 2, "{")], "bundle long, position long, body string")
    assert sorted((r.holder_id, r.ref_field) for r in B.ref_field_types(bad).collect()) == [("x", "object_refs"), ("x", "object_refs"), ("x", "source_ref"), ("x", "start_refs")]


def test_long_gaps_and_chains(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(13)], "src long, dst long")
    assert {(r.src, r.dst) for r in G.splice(edges, spark.createDataFrame([(0,), (13,)], "node long")).collect()} == {(0, 13)}
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "src long, dst long")
    assert G.cyclic(chain).count() == 0
    two = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 4), (None, 1)], "src long, dst long")
    assert {r.node for r in G.cyclic(two).collect()} == {1, 2, 4, 5}
    paths = spark.createDataFrame([([1, 2, 3],), ([3, 2],)], "path array<long>")
    assert sorted((r.kind, r.a, r.b) for r in G.path_elements(paths).where("kind = 'edge'").collect()) == [("edge", 1, 2), ("edge", 2, 3)]
    grid = spark.createDataFrame([(a, b) for a, b in ((1, 2), (1, 3), (2, 4), (3, 4), (4, 9), (9, 9))], "src long, dst long")
    found = G.shortest_paths(grid, spark.createDataFrame([(1, 9), (9, 1), (1, 7), (1, 1)], "src long, dst long")).collect()
    assert sorted((r.src, r.dst, r.path) for r in found) == [(1, 9, [1, 2, 4, 9]), (1, 9, [1, 3, 4, 9]), (9, 1, [9, 4, 2, 1]), (9, 1, [9, 4, 3, 1])]


def test_containment_folds_and_keeps_phrases_apart(spark):
    texts = spark.createDataFrame([(1, "The  QUICK brown\nfox jumps over dogs"), (2, "ab"), (3, None), (4, "")], "id long, text string")
    items = spark.createDataFrame([(1, "quick Brown fox jumps over"), (1, "nothing of it is in there at all"), (2, "own fox"), (3, "b"), (4, None), (5, " "), (6, "he quick brown fo")], "item long, text string")
    assert {(r.id, r.item, r.phrase) for r in M.contained(texts, items).collect()} == {(1, 1, "quick brown fox jumps over"), (1, 2, "own fox"), (1, 3, "b"), (2, 3, "b"), (1, 6, "he quick brown fo")}
    best = M.best_by_tokens(texts, items, 2).collect()
    assert best and all(r.id == 1 for r in best) and [r.rank for r in best] == [1, 2]
    assert {(r.id, r.item, round(r.score, 9)) for r in best} <= {(r.id, r.item, round(r.score, 9)) for r in M.shared_tokens(texts, items.where("item <> 1")).unionByName(M.shared_tokens(texts, items)).collect()}
    assert M.best_by_tokens(texts, items.limit(0), 2).count() == 0


def catalogue(spark):
    rows = [("T1", "a--1", "Shell", "runs a shell command", ["execution"], False, False), ("T1.001", "a--2", "Power", "runs a powershell command with encoded text", ["execution", "impact"], False, False), ("T2", "a--3", "Old", "old", ["impact"], True, False), ("T3", "a--4", "Gone", "gone", ["impact"], False, True)]
    return spark.createDataFrame(rows, "technique_id string, stix_id string, name string, description string, tactics array<string>, revoked boolean, deprecated boolean")


def picks(spark, *rows):
    full = [(c, k, t, "", "execution", conf, bucket, "", "", None, prov) for k, (c, t, conf, bucket, prov) in enumerate(rows)]
    return spark.createDataFrame(full, "chunk_id string, position int, technique_id string, technique_name string, tactic string, confidence double, confidence_bucket string, source_quote string, rationale string, stix_id string, provenance string")


def test_picks_resolve_promote_and_reconcile(spark):
    c = catalogue(spark)
    found = P.resolved(picks(spark, ("c", "T1", 0.5, None, "llm"), ("c", "T2", None, "possible", "llm"), ("c", "T3", 0.5, "possible", "llm"), ("c", "T9", 0.5, "possible", "llm")), c, spark.createDataFrame([("T2", "T1")], "technique_id string, target_id string"))
    assert {(r.technique_id, r.outcome, r.redirected_from, r.is_deprecated) for r in found.collect()} == {("T1", "active", None, False), ("T1", "redirected", "T2", False), ("T3", "deprecated", None, True), ("T9", "unresolved", None, False)}
    texts = spark.createDataFrame([("c", "runs a powershell command with encoded text"), ("d", None)], "chunk_id string, text string")
    up = P.promoted(picks(spark, ("c", "T1", 0.5, "possible", "llm"), ("c", "T1", 0.5, "possible", "verbatim_match"), ("d", "T1", 0.5, "possible", None)), texts, c)
    assert sorted((r.chunk_id, r.position, r.technique_id) for r in up.collect()) == [("c", 0, "T1.001"), ("c", 1, "T1"), ("d", 2, "T1")]
    hits = spark.createDataFrame([("c", "fix", "T1.001", "definitional"), ("d", "hole", "T1.001", "suggestive"), ("e", "fix", "T1", "definitional"), ("g", "fix", "T9", "definitional")], "chunk_id string, brand string, technique_id string, strength string")
    mine = picks(spark, ("c", "T1.002", 0.9, "definite", "llm"), ("c", "T1", 0.9, "definite", "llm"), ("e", "T1.001", 0.9, "definite", "llm"))
    out = sorted((r.chunk_id, r.technique_id, r.confidence_bucket, r.confidence, r.curated_provenance, r.brand_mismatch) for r in P.reconciled(mine, hits, c.where("technique_id = 'T1.001'").select("technique_id"), c).collect())
    assert out == [("c", "T1", "definite", 0.9, None, None), ("c", "T1.001", "possible", 0.5, "brand+vendor", None), ("c", "T1.002", "possible", 0.5, None, "T1.001"), ("e", "T1.001", "definite", 0.9, "brand", None)]
    assert P.reconciled(mine.limit(0), hits.limit(0), c.select("technique_id"), c).count() == 0
    told = P.proposals(spark.createDataFrame([("T1",), ("T2",), ("T3",), ("zz",), (None,)], "id string"), c, spark.createDataFrame([("T2", "T2")], "technique_id string, target_id string"))
    assert {(r.id, r.outcome) for r in told.collect() if r.id} == {("T1", "kept_active"), ("T2", "dropped_revoked_no_redirect"), ("T3", "dropped_deprecated"), ("zz", "dropped_hallucinated")}


def test_lanes_denials_and_moves(spark):
    p = P.lanes(picks(spark, ("c", "T1", 0.2, "possible", "llm"), ("c", "T2", 0.9, None, "llm"), ("d", "T1", None, "possible", "llm"), ("d", "T3", 0.4, "possible", "llm")))
    deny = spark.createDataFrame([("T2", "p2"), ("T2", "p1")], "technique_id string, pattern_id string")
    held = P.denied(p, deny)
    assert {(r.technique_id, r.lane, r.denied_by) for r in held.where("chunk_id = 'c'").collect()} == {("T1", "review", None), ("T2", "review", "p1")}
    assert {(r.chunk_id, r.technique_id) for r in P.best_orphans(p, spark.createDataFrame([("c",), ("d",), ("e",)], "chunk_id string")).collect()} == {("d", "T1")}
    moved = P.moved_up(p, spark.createDataFrame([("d", "T3"), ("c", "T2")], "chunk_id string, technique_id string"))
    assert {(r.chunk_id, r.technique_id, r.lane, r.confidence, r.moved) for r in moved.where("moved").collect()} == {("d", "T3", "bundle", 0.7, True)}
    values, ids = P.denylist_terms(spark.createDataFrame([(2, "promoted", [" A "], None, ["T1"]), (1, "promoted", ["a", "b"], ["tool"], ["T1"]), (0, "active", ["z"], None, ["T9"])], "pattern_id long, status string, values array<string>, entity_types array<string>, technique_ids array<string>"))
    assert {(r.value, tuple(r.scope) if r.scope else None) for r in values.collect()} == {("a", None), ("b", ("tool",))} and [(r.technique_id, r.pattern_id) for r in ids.collect()] == [("T1", 1)]


def test_brands_stand_between_other_signs(spark):
    texts = spark.createDataFrame([("a", "CLICKFIX-like"), ("b", "clickfixes"), ("c", None), ("d", "a watering hole, a Watering Hole")], "id string, text string")
    names = spark.createDataFrame([("clickfix",), ("watering hole",), (None,), ("",)], "brand string")
    assert {(r.id, r.brand) for r in brands.brand_hits(texts, names).collect()} == {("a", "clickfix"), ("d", "watering hole")}
    assert brands.brand_hits(texts, names.limit(0)).count() == 0
    row = spark.range(1).select(brands.anchors(F.lit("CVE-2024-12345 via Mimikatz"), ["mimikatz", "nmap"]).alias("a"), brands.anchors(F.lit(None).cast("string"), []).alias("b")).first()
    assert row.a == ["cve-2024-12345", "mimikatz"] and row.b == []


def test_entities_are_taken_in_once(spark):
    rows = [(1, 1, " evil[.]com ", "ioc_domain", None, None, None), (1, 2, "EVIL.com", "ioc_domain", 0.9, None, None), (2, 1, "evil.com", "ioc_domain", 7.0, None, None), (1, 3, "<org>.bad.com", "ioc_domain", 0.1, None, None), (1, 4, "{id}x", "ioc_url", 0.9, None, None), (1, 5, "a@example.com", "ioc_email", 0.9, None, None), (1, 6, "Org", "organization", 0.9, "owner", None), (1, 7, "x", "nothing", 0.9, None, None), (1, 8, None, "tool", 0.9, None, None)]
    found = E.taken_in(spark.createDataFrame(rows, "source_id long, position long, value string, entity_type string, confidence double, organization_role string, location_role string")).collect()
    assert sorted((r.source_id, r.position, r.value, r.confidence, r.low_confidence, r.organization_role) for r in found) == [(1, 1, "evil.com", 0.5, False, None), (1, 3, "bad.com", 0.1, True, None), (1, 6, "Org", 0.9, False, "other"), (2, 1, "evil.com", 1.0, False, None)]
    told = E.denied(spark.createDataFrame([(1, "Evil[.]com", "tool", False), (2, "evil.com", None, True), (3, "b", "tool", True)], "entity_id long, value string, entity_type string, low_confidence boolean"), spark.createDataFrame([("evil.com", ["tool"])], "value string, scope array<string>"))
    acted = E.unreviewed_actions(told, spark.createDataFrame([(3, "edit")], "entity_id long, action string"))
    assert {(r.entity_id, r.denylisted, r.gate_action, r.removal_reason) for r in acted.collect()} == {(1, True, "remove", "denylisted"), (2, False, "remove", "low confidence"), (3, False, "edit", None)}


def chunk(spark, *rows):
    return spark.createDataFrame([(1, c, i, t, "", p, n, r, label, ["Execution"]) for c, i, t, p, n, r, label in rows], "source_id long, chunk_id string, sequence_index int, text string, source_excerpt string, predecessor_indices array<int>, precedes_ids array<string>, chain_root boolean, chain_label string, tactics array<string>")


def test_chunks(spark):
    c = chunk(spark, ("a", 1, "one", [], ["b"], True, "A"), ("b", 2, "two", [1, 9, 1], ["c", "zz"], None, None), ("c", 3, None, [2], ["d"], True, ""), ("d", 4, "four", [3], [], False, None))
    assert {(r.src, r.dst) for r in K.successors(c).collect()} == {("a", "b"), ("b", "c"), ("c", "d")}
    assert {(r.chunk_id, r.chain_label, r.n_roots) for r in K.chain_labels(c).collect()} == {("a", "A", 1), ("b", "A", 1), ("c", "chain", 2), ("d", "", 2)}
    said = spark.createDataFrame([(1, "b", "drop", None, None, None, "r"), (1, "c", "merge", None, None, ["d", "nobody"], "r"), (1, "a", "edit", "new", None, None, None)], "source_id long, chunk_id string, action string, text string, source_excerpt string, merge_with array<string>, rationale string")
    out, records = K.decided(c, said, spark.createDataFrame([(1, "n", "more", "")], "source_id long, chunk_id string, text string, source_excerpt string"))
    rows = {r.chunk_id: r for r in out.collect()}
    assert set(rows) == {"a", "c", "n"} and rows["a"].text == "new" and rows["c"].text == "four" and rows["a"].precedes_ids == ["c"] and rows["c"].predecessor_indices == [1] and rows["n"].sequence_index == 5
    assert {(r.chunk_id, r.action) for r in records.collect()} == {("a", "edit"), ("b", "remove"), ("c", "edit"), ("d", "remove")}
    spans = K.occurrences(spark.createDataFrame([(1, "a", 1, "aa"), (1, "b", 2, "aa"), (1, "c", 3, "aa"), (1, "d", 4, ""), (1, "e", 5, None)], "source_id long, chunk_id string, sequence_index int, source_excerpt string"), spark.createDataFrame([(1, "xaaa")], "source_id long, text string"))
    assert {(r.chunk_id, r.start, r.end) for r in spans.collect()} == {("a", 1, 3), ("b", 2, 4), ("c", None, None)}
    assert K.shape(c.limit(0)).count() == 0


def test_overlaps_equal_all_pairs(spark):
    import random

    from loam.functions.text import STOP_WORDS

    rng = random.Random(3)
    vocabulary = [f"w{k}x" for k in range(30)] + ["the", "and"]
    rows = [(s, f"c{k}", " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25))), rng.sample(["m1", "m2", "m3"], 2), ["all"], None) for s in range(3) for k in range(25)]
    table = spark.createDataFrame(rows, "source_id long, chunk_id string, text string, malware array<string>, tools array<string>, target string")
    found = {(r.source_id, r.chunk_id, r.other): (r.score, r.detection) for r in K.overlaps(table).collect()}
    want = {}
    for s in range(3):
        own = [r for r in rows if r[0] == s]
        names = [{*r[3], *r[4]} for r in own]
        common = {e for e in set().union(*names) if sum(e in n for n in names) > len(own) / 2}
        for i, a in enumerate(own):
            for j, b in enumerate(own):
                x, y = ({w for w in t[2].split() if w not in STOP_WORDS} for t in (a, b))
                score = len(x & y) / len(x | y) if x and y else 0.0
                shared = len((names[i] & names[j]) - common)
                kind = "lexical" if score >= 0.4 else "entity" if score >= 0.05 and shared >= 2 else None
                if i != j and kind:
                    want[s, a[1], b[1]] = (round(max(score, min(0.7, 0.3 + 0.1 * shared)) if kind == "entity" else score, 3), kind)
    assert found == want and len(want) > 20


def test_relationships_of_one_actor_and_none(spark):
    ent = "source_id long, entity_id string, position long, entity_type string, value string, edited_value string, edited_type string, gate_action string, confidence double, organization_role string, location_role string, attributed_to array<string>, is_maas boolean, stix_id string"
    e = spark.createDataFrame([(1, "e1", 1, "intrusion_set", "APT", None, None, None, None, None, None, None, None, "is--1"), (1, "e2", 2, "tool", "Nmap", "NMAP2", None, None, None, None, None, None, None, "tool--1"), (1, "e3", 3, "tool", "gone", None, None, "remove", None, None, None, None, None, "tool--2"), (2, "e4", 1, "intrusion_set", "X", None, None, None, None, None, None, None, None, "is--2"), (2, "e5", 2, "intrusion_set", "Y", None, None, None, None, None, None, None, None, "is--3")], ent)
    none = []
    proc = "source_id long, draft_id string, chunk_id string, position long, name string, stix_id string, techniques array<struct<technique_id: string, technique_name: string, tactic: string, stix_id: string>>, components_refs array<string>, observable_refs array<string>, vulnerability_refs array<string>, attributed_actors array<string>, malware_used array<string>, tools_used array<string>"
    p = spark.createDataFrame([(1, "d1", "c", 1, "n", "x-procedure--1", [("T1", "t", "x", "attack-pattern--1"), ("T2", "t", "x", None)], none, none, none, none, None, [" nmap2 ", "gone", ""]), (2, "d2", "c", 1, "n", "x-procedure--2", none, none, none, none, ["y", "who"], none, none), (2, "d3", "c", 2, "n", "x-procedure--3", none, none, none, none, none, none, none), (3, "d4", "c", 1, "n", None, none, none, none, none, none, none, none)], proc)
    found = {(r.source_ref, r.verb, r.target_ref) for r in R.relationships(p, e).collect()}
    assert found == {("x-procedure--1", "uses", "attack-pattern--1"), ("x-procedure--1", "uses", "tool--1"), ("is--1", "uses", "x-procedure--1"), ("is--1", "uses", "attack-pattern--1"), ("is--1", "uses", "tool--1"), ("is--3", "uses", "x-procedure--2")}
    assert R.relationships(p.limit(0), e.limit(0)).count() == 0


def test_feedback(spark):
    new = X.upserted_patterns(
        spark.createDataFrame([("p1", "k", "drop old vendor names", 3, [1.0, 0.0])], "pattern_id string, category string, pattern string, occurrence_count long, embedding array<float>"),
        spark.createDataFrame([("a", "k", "drop old vendor names", None), ("b", "k", "drop vendor names", [0.9, 0.1]), ("c", "k", "unlike words here", [1.0, 0.0]), ("d", "other", "drop vendor names", [1.0, 0.0]), ("e", "k", "unlike words here", None)], "new_id string, category string, pattern string, embedding array<float>"),
    )
    assert {(r.new_id, r.pattern_id, r.how) for r in new.collect()} == {("a", "p1", "exact"), ("b", "p1", "similar"), ("c", "c", "new"), ("d", "d", "new"), ("e", "c", "new")}
    assert N.outcomes(spark.createDataFrame([("initial_read", 1, "t"), ("chunks", 2, "u")], "gate_key string, created_at int, turn_id string")).count() == 1
    turns = spark.createDataFrame([(1, "chunks", "ok", None, 1, None, "t1"), (1, "chunks", "failed", None, 2, None, "t2"), (1, "chunks", "ok", None, 0, None, "t0")], "source_id long, gate_key string, status string, auto boolean, created_at int, outcome string, turn_id string")
    told = X.with_outcomes(turns, spark.createDataFrame([(1, "chunks", "done")], "source_id long, gate_key string, outcome string"))
    assert {(r.turn_id, r.outcome) for r in told.collect()} == {("t1", "done"), ("t2", None), ("t0", None)}
    assert {(r.turn_id, r.pass_number) for r in X.passes(turns).collect()} == {("t0", 1), ("t1", 2), ("t2", 3)}
    ledger = spark.createDataFrame([(1, "chunks", 1, "edit"), (1, "chunks", 2, "approve")], "source_id long, area string, position long, action string")
    latest = spark.createDataFrame([(1, "chunks", 9, "drop"), (1, "entities", 1, None)], "source_id long, area string, position long, action string")
    assert {(r.area, r.position) for r in X.deltas(ledger, latest).collect()} == {("chunks", 1), ("entities", 1)}
    text = X.digest_text(ledger, F.col("action")).first().text
    assert text == "CHUNKS\n- edit\n- approve"
    assert X.appended(ledger, ledger.unionByName(latest), ["source_id", "area", "position"]).count() == 4


def test_store(spark):
    sources = spark.createDataFrame([(1, None, "new"), (2, "ann", "new"), (3, "bob", "new")], "source_id long, claimed_by string, status string")
    claims = spark.createDataFrame([(1, "bob"), (1, "ann"), (2, "bob"), (3, "bob")], "source_id long, analyst string")
    assert {(r.source_id, r.claimed_by) for r in S.claimed(sources, claims).collect()} == {(1, "ann"), (2, "ann"), (3, "bob")}
    page, n = S.page(sources, [F.desc("source_id")], 2, 1)
    assert [r.source_id for r in page.collect()] == [2, 1] and n == 3
    assert S.migrated(sources, "source_id long, more array<string>").columns == [*sources.columns, "more"]
    cache = spark.createDataFrame([("k", "old")], "key string, output string")
    assert {tuple(r) for r in S.remembered(cache, spark.createDataFrame([("k", "new"), ("j", "b"), ("j", "a")], "key string, output string")).collect()} == {("k", "old"), ("j", "a")}
    row = spark.range(1).select(S.redacted(F.create_map(F.lit("Token"), F.lit("x"), F.lit("b"), F.lit("y"))).alias("m"), S.verb_name(F.lit("uses"), F.lit("x-procedure--1"), F.lit("attack-pattern--1")).alias("v"), S.verb_name(F.lit("bad verb!"), F.lit("a"), F.lit("b")).alias("w")).first()
    assert row.m == {"Token": "[redacted]", "b": "y"} and row.v == "IMPLEMENTS_TECHNIQUE" and row.w is None
    o = objects(spark, {"type": "report", "id": "report--1", "object_refs": ["tool--1", "report--1", "gone"]}, {"type": "tool", "id": "tool--1", "name": "n"}, {"type": "attack-pattern", "id": "attack-pattern--1"}, {"type": "extension-definition", "id": "e", "created_by_ref": "identity--1"}, {"type": "identity", "id": "identity--1"}, rel("relationship--1", "uses", "tool--1", "attack-pattern--1"), rel("relationship--2", "uses", "attack-pattern--1", "attack-pattern--1"))
    nodes, edges, describes = S.graph_rows(o)
    assert {r.stix_id for r in nodes.collect()} == {"report--1", "tool--1"} and {(r.src, r.verb, r.dst) for r in edges.collect()} == {("tool--1", "USES", "attack-pattern--1")} and [(r.src, r.dst) for r in describes.collect()] == [("report--1", "tool--1")]
    good, counts, lost = S.writable(edges, nodes)
    assert good.count() == 0 and [(r.written, r.dropped) for r in counts.collect()] == [(0, 1)] and lost.count() == 1


def test_values(spark):
    row = spark.range(1).select(
        V.figures_filled(F.lit("a<!-- image -->b<!-- image -->c"), F.array(F.lit("X"))).alias("a"), V.salvaged(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(-1)), lambda x: x > 0).alias("b"), V.salvaged(F.array(F.lit(1), F.lit(-2)), lambda x: x > 0).alias("c"),
        V.rejection_route(F.array(F.lit("x"), F.lit("bad_chunk_boundary"))).alias("d"), V.rejection_route(F.array().cast("array<string>")).alias("e"), V.unnested(F.lit('{"wrap": {"a": 1}}'), "items").alias("f"), V.unnested(F.lit('{"items": "[1, 2]"}'), "items").alias("g"),
        V.figure_block(F.lit("f1"), F.lit(None).cast("int"), F.lit(""), F.lit("chart"), F.lit(" t ")).alias("h"), V.technique_list(F.array(F.struct(F.lit("T1059").alias("technique_id")), F.struct(F.lit("no").alias("technique_id")))).alias("i"), V.lenient_json(F.lit(None).cast("string")).alias("j"), V.lenient_json(F.lit("nothing")).alias("k"),
    ).first()
    assert row.a == "aXb<!-- image -->c" and row.b == [1, 2, 3] and row.c is None and row.d == "chunk_behaviors" and row.e is None and row.f == '{"a":1}' and row.g == '{"items":[1, 2]}'
    assert row.h == "\n\n[FIGURE f1 — chart, page ?]\nt\n[/FIGURE f1]\n\n" and row.i == "T1059" and row.j.value is None and row.k.discarded == 7


def test_sources_by_type_and_schemas(spark, tmp_path):
    rows = [("a", "html", b"<p>some words of a page</p><script>x</script>"), ("b", "markdown", b"\xff ten letters and more"), ("c", "pdf", b"%PDF"), ("d", "free_text", b"short"), ("e", None, None)]
    found = {r.source_id: r for r in tables.parsed(spark.createDataFrame(rows, "source_id string, source_type string, content binary")).collect()}
    assert found["a"].parsed_text == "some words of a page" and found["b"].status == "parsed" and found["c"].status == found["d"].status == found["e"].status == "failed" and found["d"].parsed_text == ""
    (tmp_path / "tool.json").write_text(json.dumps({"required": ["name"], "properties": {"name": {"type": "string"}, "kind": {"enum": ["x"]}, "n": {"type": "integer"}}, "additionalProperties": False}))
    (tmp_path / "broken.json").write_text("{")
    known = schemas.load_schemas(spark, str(tmp_path))
    raw = spark.createDataFrame([(1, 0, '{"type": "tool", "kind": "y", "n": "z"}'), (1, 1, '{"type": "other"}'), (1, 2, "no")], "bundle long, position long, body string")
    assert sorted(r.error for r in schemas.schema_errors(raw, known).collect()) == ["missing:name", "type:n", "unknown:type", "value:kind"]
    assert schemas.vocabulary('{"definitions": {"v": {"enum": ["a"]}}}', "v") == ("a",)
    with pytest.raises(ValueError):
        tables.write_figures(spark.createDataFrame([("../x", 1, "k", b"")], "source_id string, place int, kind string, content binary"), str(tmp_path / "figures"))


def test_catalogue_props(spark):
    body = json.dumps({"name": "N", "aliases": ["a"], "revoked": True, "external_references": [{"source_name": "other", "external_id": "x"}, {"source_name": "mitre-attack", "external_id": "T1"}]})
    raw = spark.createDataFrame([("a--1", "attack-pattern", body), ("r", "relationship", "{}"), ("m", "x-mitre-matrix", "{}")], "id string, type string, body string")
    rows = C.nodes(raw, ["name", "description"], ["aliases"]).collect()
    assert [(r.label, r.props) for r in rows] == [("AttackPattern", {"name": "N", "aliases": '["a"]', "revoked": "true", "mitre_id": "T1"})]


def test_saved_tables_are_deleted(spark):
    one = shared.saved(spark.range(3).toDF("a"), "t")
    shared.dropped(one, None, spark.range(1))
    with pytest.raises(Exception, match="(?i)exist|found"):
        one.count()
    kept = shared.settled(lambda: shared.saved(spark.range(3).toDF("a"), "inner"), "outer")
    assert kept.count() == 3


def test_drafts(spark):
    row = spark.range(1).select(D.distinct_commands(F.array(F.lit("Net  User"), F.lit("net user"), F.lit("x"))).alias("a"), D.evidenced(F.array(F.lit("Nmap"), F.lit(None), F.lit(" ")), F.lit("ran nmap")).alias("b"), D.window_commands(F.array(F.lit("cmd a"), F.lit("cmd b")), F.lit(""), F.lit(None).cast("string"), F.concat(F.repeat(F.lit("x"), 600), F.lit("cmd a")), F.lit(590)).alias("c")).first()
    assert row.a == ["Net  User", "x"] and row.b == ["Nmap"] and row.c == ["cmd a"]
