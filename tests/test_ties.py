"""Ids that stay apart, and ties that are settled whatever the rows' order."""

from pyspark.sql import functions as F

from loam.operators import drafts as D, picks as P


def test_best_of_chunk_settles_equal_picks_by_row(spark):
    schema = "chunk_id string, position int, technique_id string, confidence_bucket string, confidence double"
    rows = [("c", 1, "T1", "definite", None), ("c", 1, "T1", "definite", 0.5)]
    for order in (rows, rows[::-1]):
        best = P.best_of_chunk(spark.createDataFrame(order, schema).coalesce(1)).collect()
        assert [(r.position, r.confidence) for r in best] == [(1, None)]


def test_best_orphans_settles_equal_picks_by_id(spark):
    schema = "chunk_id string, position int, technique_id string, confidence double, lane string"
    rows = [("c", 1, "T1", 0.5, "review"), ("c", 1, "T2", None, "review")]
    for order in (rows, rows[::-1]):
        picks = spark.createDataFrame(order, schema).coalesce(1)
        assert [(r.chunk_id, r.technique_id) for r in P.best_orphans(picks, picks.select("chunk_id")).collect()] == [("c", "T2")]


def test_drafts_with_equal_starts_of_their_hash_stay_apart(spark):
    """The hashes of both drafts begin with f9513614; an edit of one leaves the other as it is."""
    chunks = spark.createDataFrame([(5700004987, "5700007385"), (1200013172, "1200064725")], "source_id long, chunk_id string")
    none = F.array().cast("array<string>")
    told = chunks.withColumns({"text": F.lit("t"), "source_excerpt": F.lit(""), "sequence_index": F.lit(1), "behavioral_confidence": F.lit(0.5)})
    raw = chunks.withColumns({"position": F.lit(0), "name": F.lit("n"), "description": F.lit("d"), **{c: none for c in ("platforms", "tools_used", "malware_used", "attributed_actors", "command_lines")}})
    picks = spark.createDataFrame([], "chunk_id string, position int, technique_id string, technique_name string, tactic string, stix_id string")
    made = D.assembled(raw, told, picks)
    assert made.select("draft_id").distinct().count() == 2
    out = D.edited(made, made.where("source_id = 5700004987").select("draft_id", F.lit("edit").alias("action"), F.lit("new").alias("name")))
    assert sorted((r.chunk_id, r.name) for r in out.collect()) == [("1200064725", "n"), ("5700007385", "new")]


def test_products_of_a_source_are_not_gathered_where_they_are_joined(spark, sf_dir):
    """The rows of all parts are dealt by their whole key before the last distinct(): no aggregate stands between the joins of a source and that exchange."""
    from loam.operators import relationships as R
    from loam.plans import source_queries as Q

    plan = R.relationships(Q._procedures(spark, sf_dir), Q._entities(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    nodes = [line.lstrip(" :+-") for line in plan.splitlines()]
    at = next(k for k, node in enumerate(nodes) if "Union" in node)
    above = [node.split("(")[0] for node in nodes[:at]]
    assert [node for node in above if "Aggregate" in node or "Exchange" in node] == ["HashAggregate", "HashAggregate", "Exchange hashpartitioning"]
