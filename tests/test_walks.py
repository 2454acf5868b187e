"""Reach, sole starts, the graph on disk, and rules after several changes."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from loam.operators import feedback as X, graph as G
from loam.sources import store as S


def test_reach_has_no_limit_unless_asked(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(13)] + [(13, 4), (None, 3), (3, None)], "src long, dst long")
    starts = spark.createDataFrame([(0,), (0,), (12,), (None,)], "node long")
    assert {(r.node, r.depth) for r in G.reachable(edges, starts).where("start = 0").collect()} == {(k, k) for k in range(14)}
    assert G.reachable(edges, starts).where("start = 12").count() == 10
    assert G.reachable(edges, starts, hops=2).where("start = 0").count() == 3


def slow_starts(edges, starts):
    out = {}
    for s in starts:
        seen, front = {s}, [s]
        while front:
            front = [b for a in front for x, b in edges if x == a and b not in seen and not seen.add(b)]
        for node in seen:
            out.setdefault(node, set()).add(s)
    return {node: (min(s), max(s)) for node, s in out.items()}


def test_sole_starts_equal_brute_force(spark):
    rng = random.Random(5)
    links, starts = [], []
    for g in range(30):  # thirty graphs in one table
        base, n = 1000 * g, rng.choice([3, 8, 20])
        links += [(base + rng.randrange(n), base + rng.randrange(n)) for _ in range(rng.choice([n - 1, n, 2 * n]))]
        starts += [base + rng.randrange(n) for _ in range(rng.choice([0, 1, 3]))]
    links += [(50_000 + k, 50_001 + k) for k in range(6)] + [(50_006, 50_000)]  # a circle that nothing reaches
    found = G.sole_starts(spark.createDataFrame([*links, (None, 2)], "src long, dst long"), spark.createDataFrame([(s,) for s in starts], "node long"))
    assert {r.node: (r.first, r.last) for r in found.collect()} == slow_starts([x for x in set(links) if x[0] != x[1]], set(starts))


def test_a_chain_of_two_thousand_steps(spark):
    chain = spark.range(2000).selectExpr("id AS src", "id + 1 AS dst").union(spark.range(500, 1500).selectExpr("id AS src", "id + 5000 AS dst")).union(spark.range(500, 1500).selectExpr("id + 5000 AS src", "id + 1 AS dst"))
    found = G.sole_starts(chain, spark.createDataFrame([(0,), (1800,)], "node long"))
    assert found.where("first = 0 and last = 0").count() == 2800 and found.where("first = 0 and last = 1800").count() == 201


def graph_rows(spark, *rows):
    return spark.createDataFrame(list(rows), "bundle int, stix_id string, label string, props map<string,string>, ingested_by string")


def test_bundles_in_turn_equal_one_write(spark, tmp_path):
    edges = lambda *rows: spark.createDataFrame(list(rows), "src string, verb string, dst string")
    mine = lambda k, name: (1, f"n{k}", "Tool", {"name": name, "x": "y"}, S.MARKER)
    first, second = graph_rows(spark, *[mine(k, "a") for k in range(30)], (1, "c1", "AttackPattern", {"name": "own"}, None)), graph_rows(spark, *[mine(k, "b") for k in range(25, 35)], (1, "c1", "AttackPattern", {"name": "theirs"}, S.MARKER))
    links = edges(*[(f"n{k}", "USES", f"n{k + 1}") for k in range(29)], ("n1", "USES", "n2"))
    more = edges(("n1", "USES", "n2"), ("n40", "USES", "n2"))
    path = str(tmp_path / "graph")
    times = lambda: {p: p.stat().st_mtime_ns for p in sorted(Path(path).rglob("*.parquet"))}
    S.upserted(first, links, path, buckets=16)
    before = times()
    S.upserted(first, links, path, buckets=16)
    assert times() == before
    S.upserted(second, more, path, buckets=16)
    after = times()
    untouched = [p for p in before if after.get(p) == before[p]]
    assert untouched and set(after) != set(before)
    S.upserted(second, more, path, buckets=16)
    S.upserted(graph_rows(spark).where("false"), more.where("false"), path, buckets=16)
    assert times() == after
    nodes, edges_there = S.graph_at(spark, path)
    assert {(r.stix_id, r.props["name"]) for r in nodes.collect()} == {(f"n{k}", "a" if k < 25 else "b") for k in range(35)} | {("c1", "own")}
    assert {tuple(r) for r in edges_there.collect()} == {(f"n{k}", "USES", f"n{k + 1}") for k in range(29)} | {("n40", "USES", "n2")} and edges_there.count() == 30


def test_nodes_of_no_layer_stay_visible(spark):
    nodes = spark.createDataFrame([("a", "Tool"), ("b", None), ("c", "Report")], "stix_id string, label string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    kept, ends = S.visible(nodes, edges, {"tools": ["Tool"], "reports": ["Report"]}, ["tools"])
    assert {r.stix_id for r in kept.collect()} == {"a", "b"} and [(r.src, r.dst) for r in ends.collect()] == [("a", "b")]


def test_rules_after_several_changes(spark):
    rules = spark.createDataFrame([(k, "cat", "old", "active") for k in "abcdef"], "pattern_id string, category string, pattern string, status string")
    terms = lambda *v: (list(v), ["t1059", "x", "T1059"], [" IPv4 ", "ipv4"])
    rows = [
        ("a", 1, "edit", "x", "new", None, None), ("a", 2, "dismiss", "x", None, None, None),
        ("b", 1, "promote_to_denylist", "y", None, None, terms(" Evil ", "evil", "", "a\x01b", None, "z" * 257)), ("b", 2, "dismiss", "x", None, None, None),
        ("c", 2, "promote_to_prompt", "z", None, None, terms("q")), ("c", 1, "promote_to_denylist", "y", None, None, terms("q")), ("c", 3, "edit", "x", None, "later", None),
        ("d", 1, "promote_to_denylist", "y", None, None, None), ("d", 1, "promote_to_denylist", "y", None, None, None),
        ("e", 1, "edit", "x", "one", None, None), ("e", 2, "edit", "x", None, "c2", None), ("e", 3, "promote_to_prompt", "p", None, None, None), ("nobody", 1, "dismiss", "x", None, None, None), ("f", 1, "rename", "x", "no", None, None),
    ]
    changes = spark.createDataFrame(rows, "pattern_id string, at int, action string, by string, text string, category string, terms struct<values: array<string>, technique_ids: array<string>, entity_types: array<string>>")
    found = {r.pattern_id: r for r in X.updated_patterns(rules, changes).collect()}
    assert set(found) == set("abcdef")
    told = {k: (r.pattern, r.category, r.status, r.promoted_by, r.promoted_action) for k, r in found.items()}
    assert told == {
        "a": ("new", "cat", "dismissed", None, None), "b": ("old", "cat", "dismissed", "y", "denylist:Evil, T1059"), "c": ("old", "later", "promoted_to_prompt", "z", "prompt:cat"),
        "d": ("old", "cat", "promoted_to_denylist", "y", "denylist:(no enforceable terms — advisory only)"), "e": ("one", "c2", "promoted_to_prompt", "p", "prompt:c2"), "f": ("old", "cat", "active", None, None),
    }
    assert found["b"].denylist_terms.asDict() == {"values": ["Evil"], "technique_ids": ["T1059"], "entity_types": ["ipv4"]}
    assert found["c"].denylist_terms.asDict() == {"values": [], "technique_ids": [], "entity_types": []} and found["a"].denylist_terms is None
    # what an earlier run wrote stays without a new promotion
    again = X.updated_patterns(X.updated_patterns(rules, changes), changes.where("pattern_id = 'b' and action = 'dismiss'"))
    assert {r.pattern_id: r.promoted_action for r in again.collect()} == {k: v[4] for k, v in told.items()}
    assert X.updated_patterns(rules, changes.where(F.lit(False))).where("status = 'active'").count() == 6


def test_shortest_paths_search_from_the_side_with_fewer_ends(spark, monkeypatch):
    """All leaves of a hub asked for the way to one node: a row of depth a node, not one for every two leaves; the first paths by order are kept."""
    held, save = [], G.saved
    monkeypatch.setattr(G, "saved", lambda df, name: held.append((name, save(df, name))) or held[-1][1])
    leaves = list(range(100, 120))
    edges = spark.createDataFrame([(k, 1) for k in leaves] + [(k, 2) for k in leaves[:10]] + [(1, 3), (2, 3), (3, 0)], "src int, dst int")
    pairs = spark.createDataFrame([(k, 0) for k in leaves], "src int, dst int")
    found = {(r.src, tuple(r.path)) for r in G.shortest_paths(edges, pairs, 3).collect()}
    assert found == {(k, (k, 1, 3, 0)) for k in leaves} | {(k, (k, 2, 3, 0)) for k in leaves[:10]}
    assert sum(df.count() for name, df in held if name == "depths") <= len(leaves) + 4
    one = G.shortest_paths(edges, pairs, 3, 1).where("src < 110").collect()
    assert {tuple(r.path) for r in one} == {(k, 1, 3, 0) for k in leaves[:10]}


def test_chain_labels_count_every_root(spark):
    """Four roots that meet, one of them also inside a chain, are counted as four; a label goes to what its root alone reaches."""
    from loam.operators import chunks as K

    rows = [("a", 1, [], True, "A"), ("b", 2, [], True, "B"), ("c", 3, [], True, None), ("d", 4, [1], None, None), ("e", 5, [2, 3, 4], True, "E"), ("f", 6, [5], None, None), ("g", 7, [], None, None)]
    c = spark.createDataFrame([(1, k, i, back, root, label) for k, i, back, root, label in rows], "source_id long, chunk_id string, sequence_index int, predecessor_indices array<int>, chain_root boolean, chain_label string")
    found = {r.chunk_id: (r.chain_label, r.n_roots) for r in K.chain_labels(c).collect()}
    assert found == {"a": ("A", 1), "b": ("B", 1), "c": ("chain", 1), "d": ("A", 1), "e": ("E", 4), "f": ("", 4), "g": ("", 0)}


def test_counted_starts_of_small_and_large_groups_equal_plain_walks(spark, monkeypatch):
    rng = random.Random(6)
    edges = [(g, f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for g, n, m in ((1, 12, 14), (2, 40, 44), (3, 5, 9), (4, 30, 40), (7, 3, 1)) for _ in range(m)]
    starts = [(g, f"n{k}", f"v{g}.{k}") for g in (1, 2, 3, 4, 9) for k in (0, 2, 3)]
    want = {}
    for g, s, v in starts:
        seen, front = {s}, [s]
        while front:
            front = [d for h, a, d in edges if h == g and a in front and d not in seen]
            seen.update(front)
        for node in seen:
            want.setdefault((g, node), []).append(v)
    e = spark.createDataFrame([*edges, (None, "n0", "n1"), (1, "n0", None), (1, None, "n0")], "group long, src string, dst string").repartition(3)
    s = spark.createDataFrame([*starts, (None, "n0", "x"), (1, None, "x"), (1, "n0", "w")], "group long, node string, value string")
    for small in (2000, 20, 0):  # all where they lie; both ways; all over joins
        monkeypatch.setattr(G, "SMALL", small)
        found = G.counted_starts(e, s).collect()
        assert {(r.group, r.node): (r.n, r.value) for r in found} == {k: (len(v), v[0] if len(v) == 1 else None) for k, v in want.items()} and len(found) == len(want)


def test_chains_of_small_sources_take_no_round_of_joins(spark, monkeypatch):
    from loam.operators import chunks as K

    def fails(*_):
        raise AssertionError("walked by joins")

    monkeypatch.setattr(G, "all_starts", fails)
    rows = [("s", f"c{k}", k, [k - 1], k == 1, "A" if k == 1 else None) for k in range(1, 40)]
    c = spark.createDataFrame(rows, "source_id string, chunk_id string, sequence_index int, predecessor_indices array<int>, chain_root boolean, chain_label string")
    assert {(r.chain_label, r.n_roots) for r in K.chain_labels(c).collect()} == {("A", 1)}
