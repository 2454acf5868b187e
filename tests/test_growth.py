"""Plans that must not grow with what they repeat: chains step by step, one grouping instead of joins, paths dealt over many roots."""

from loam.operators import relationships as R, schemas
from loam.plans import flow_queries, sql_queries


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_detection_chain_is_followed_step_by_step(spark):
    links = lambda a, b, *rows: spark.createDataFrame(list(rows), f"{a}_id long, {b}_id long")
    strategies, analytics = links("technique", "strategy", (1, 10), (1, 10), (2, 10), (2, None), (9, 19)), links("strategy", "analytic", (10, 5), (10, 6), (19, 7))
    nodes, edges = R.detection_chain(spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "technique_id long"), strategies, analytics, links("analytic", "log_source", (5, 1), (6, 1), (7, 2)), links("log_source", "component", (2, 8)))
    assert sorted((r.id, r.label) for r in nodes.collect()) == [("1", "log-source"), ("10", "detection-strategy"), ("5", "analytic"), ("6", "analytic")]
    assert sorted((r.src, r.verb, r.dst) for r in edges.collect()) == [("10", "detects", "1"), ("10", "detects", "2"), ("10", "uses-analytic", "5"), ("10", "uses-analytic", "6"), ("5", "reads", "1"), ("6", "reads", "1")]
    assert "LeftOuter" not in plan(edges) and plan(edges).count("Join") == 1 + 2 + 3 + 4


def test_analyst_edges_are_settled_by_one_grouping(spark, sf_dir):
    found = flow_queries.analyst_edges(spark, sf_dir)
    assert "Join" not in plan(found) and plan(found).count("Aggregate") == 1


def test_paths_of_a_root_are_dealt_over_many(spark, sf_dir):
    found = sql_queries.sql_source_paths(spark, sf_dir)
    assert "pmod(hash(" in plan(found)
    assert found.where("p_brand not like 'Brand#%'").count() == 0


def test_a_value_is_looked_through_once_by_a_schema(spark):
    known = {"t": {"required": ["a", "b", "c"], "properties": {f: {"type": "string", "minLength": 2} for f in "abc"}, "anyOf": [{"required": ["a"]}, {"required": ["z"]}], "additionalProperties": False}}
    found = schemas.schema_errors(spark.createDataFrame([(1, 0, '{"id": "x", "type": "t", "a": "no", "b": "n", "c": 1}')], "bundle long, position long, body string"), known)
    assert plan(found).lower().count("schemaofvariant(") == 4
    assert sorted(r.error for r in found.collect()) == ["short:b", "type:c", "unknown:id", "unknown:type"]


def test_repeated_items_are_those_of_equal_json(spark):
    known = {"t": {"properties": {"a": {"uniqueItems": True}}}}
    bodies = ['[1, "1"]', '[{"x": 1, "y": 2}, {"y": 2, "x": 1}]', '["{\\"x\\":1}", {"x": 1}]', "[null, null]", "[null]", "[]", '"a"', "[[1], [1.0]]"]
    raw = spark.createDataFrame([(k, 0, f'{{"type": "t", "a": {a}}}') for k, a in enumerate(bodies)], "bundle long, position long, body string")
    assert sorted((r.bundle, r.error) for r in schemas.schema_errors(raw, known).collect()) == [(1, "repeated:a"), (3, "repeated:a"), (7, "repeated:a")]


def test_edges_of_verbs_that_nobody_removes_or_adds_are_not_shuffled(spark):
    row = "source_id long, source_ref string, verb string, target_ref string"
    edges = spark.createDataFrame([(1, "a", "uses", "x"), (1, "a", "uses", "y"), (1, "b", "uses", "x"), (2, "a", "uses", "x"), (1, "a", "targets", "x"), (1, "a", None, "x")], row)
    names = spark.createDataFrame([(s, k, "same" if k in "xy" else k, "t") for s in (1, 2) for k in "abxy"], "source_id long, stix_id string, name string, object_type string")
    shown = R.preview(edges.where("verb = 'uses'"), names)
    whole = {(r.source_id, r.id, r.source_ref, r.verb, r.target_ref) for r in R.preview(edges, names).where("verb = 'uses'").collect()}
    assert {(r.source_id, r.id, r.source_ref, r.verb, r.target_ref) for r in shown.collect()} == whole  # ids are those of the whole preview
    kept = R.without_removed(edges, shown, spark.createDataFrame([(1, "a|uses|same|t|t")], "source_id long, id string"))
    physical = kept._jdf.queryExecution().executedPlan().toString()
    assert physical.count("BroadcastHashJoin [verb") == 2  # by verb first
    assert sorted(map(str, kept.collect())) == sorted(map(str, edges.where("not (source_id = 1 and source_ref = 'a' and verb <=> 'uses')").collect()))
    rows = spark.createDataFrame([(1, 1, "a", "t", "Targets", "b", "t"), (1, 2, "a", "t", "uses", "b", "t"), (1, 3, "b", "t", "uses", "a", ""), (1, 4, "b", "t", "", "a", "t")], "source_id long, row int, source_name string, source_type string, verb string, target_name string, target_type string")
    new, skipped = R.added(rows, names, edges.union(spark.createDataFrame([(1, "a", "targets", "b")], row)))
    assert sorted((r.source_ref, r.verb, r.target_ref) for r in new.collect()) == [("a", "uses", "b"), ("b", "uses", "a")] and [r.row for r in skipped.collect()] == [4]


def test_analyst_rows_names_only_what_the_analyst_reads(spark, sf_dir, monkeypatch):
    from loam.plans import source_queries

    verbs, preview = [], R.preview
    monkeypatch.setattr(R, "preview", lambda edges, names: (verbs.extend(r.verb for r in edges.select("verb").distinct().collect()), preview(edges, names))[1])
    assert source_queries.analyst_rows(spark, sf_dir).count() > 0 and verbs == ["uses"]
