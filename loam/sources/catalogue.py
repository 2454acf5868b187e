"""The technique catalogue as tables: active techniques, worked examples, redirects, and its graph with flat properties."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: Types that are no nodes, labels of those that are, and names of edges.
SKIP_TYPES = ("extension-definition", "marking-definition", "x-mitre-matrix", "x-mitre-collection")
LABELS = {
    "attack-pattern": "AttackPattern", "x-mitre-tactic": "Tactic", "intrusion-set": "IntrusionSet", "malware": "Malware", "tool": "Tool", "course-of-action": "CourseOfAction",
    "x-mitre-data-source": "DataSource", "x-mitre-data-component": "DataComponent", "campaign": "Campaign", "identity": "Identity", "x-mitre-asset": "Asset",
    "x-mitre-analytic": "Analytic", "x-mitre-detection-strategy": "DetectionStrategy",
}
VERBS = {
    "uses": "USES", "mitigates": "MITIGATES", "subtechnique-of": "SUBTECHNIQUE_OF", "detects": "DETECTS", "attributed-to": "ATTRIBUTED_TO", "targets": "TARGETS",
    "revoked-by": "REVOKED_BY", "related-to": "RELATED_TO", "has-analytic": "HAS_ANALYTIC", "uses-data-component": "USES_DATA_COMPONENT",
}
_FLAGS = ("x_mitre_is_subtechnique", "revoked", "x_mitre_deprecated")


def active_techniques(techniques: DataFrame) -> DataFrame:
    """Techniques (technique_id, ..., revoked, deprecated) that may be picked, in order of their ids."""
    return techniques.where(~F.col("revoked") & ~F.col("deprecated")).orderBy("technique_id")


def redirects(objects: DataFrame, techniques: DataFrame) -> DataFrame:
    """(technique_id, target_id): what a revoked technique was replaced by, over ``revoked-by`` relationships of the catalogue."""
    links = objects.where("type = 'relationship' and relationship_type = 'revoked-by'").select("source_ref", "target_ref")
    by = lambda c, name: techniques.select(F.col("stix_id").alias(c), F.col("technique_id").alias(name))
    found = links.join(by("source_ref", "technique_id"), "source_ref").join(by("target_ref", "target_id"), "target_ref")
    return found.groupBy("technique_id").agg(F.max("target_id").alias("target_id"))


def procedure_examples(objects: DataFrame, techniques: DataFrame) -> DataFrame:
    """(technique_id, technique_stix_id, source_actor_name, source_actor_type, description) of ``uses`` links onto techniques that say how."""
    links = objects.where("type = 'relationship' and relationship_type = 'uses'").where(F.coalesce(F.trim("description") != "", F.lit(False))).select("source_ref", "target_ref", "description")
    of = techniques.select(F.col("stix_id").alias("target_ref"), "technique_id")
    by = objects.where("type <> 'relationship'").select(F.col("id").alias("source_ref"), F.coalesce("name", F.lit("")).alias("source_actor_name"), F.col("type").alias("source_actor_type"))
    return links.join(of, "target_ref").join(by, "source_ref").select("technique_id", F.col("target_ref").alias("technique_stix_id"), "source_actor_name", "source_actor_type", "description")


def by_stix_id(refs: DataFrame, techniques: DataFrame) -> DataFrame:
    """(ref, technique_id, name) for references (ref) to techniques of the catalogue."""
    return refs.select("ref").distinct().join(techniques.select(F.col("stix_id").alias("ref"), "technique_id", "name"), "ref")


def flat_props(body: Column, fields: list[str], nested: list[str]) -> Column:
    """A map of an object's fields as text: plain ones as they are, nested ones as JSON, flags as true or false; absent ones left out.

    The public id of the catalogue, its first reference's, becomes ``mitre_id``.
    """
    plain = [x for f in (*fields, *nested) for x in (F.lit(f), F.get_json_object(body, f"$.{f}"))]
    flags = [x for f in _FLAGS for x in (F.lit(f), F.get_json_object(body, f"$.{f}"))]
    refs = F.from_json(F.get_json_object(body, "$.external_references"), "array<struct<source_name: string, external_id: string>>")
    first = F.get(F.filter(refs, lambda r: (r.source_name == "mitre-attack") & F.coalesce(r.external_id != "", F.lit(False))), F.lit(0))["external_id"]
    return F.map_filter(F.create_map(*plain, *flags, F.lit("mitre_id"), first), lambda _, v: v.isNotNull())


def nodes(raw: DataFrame, fields: list[str], nested: list[str]) -> DataFrame:
    """(stix_id, label, props) of the catalogue's objects (id, type, body: JSON text); types without a label are no nodes."""
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    kept = raw.where(~F.col("type").isin(*SKIP_TYPES) & (F.col("type") != "relationship")).withColumn("label", F.try_element_at(labels, F.col("type")))
    return kept.where("label is not null").select(F.col("id").alias("stix_id"), "label", flat_props(F.col("body"), fields, nested).alias("props"))


def edges(objects: DataFrame) -> DataFrame:
    """(src, verb, dst), each once, both ends being objects: relationships by their verb, and what objects say about one another.

    ``objects`` (id, type, source_ref, target_ref, relationship_type, shortname, tactics, analytic_refs, component_refs): a
    technique belongs to the tactics of its phases, a strategy has analytics, an analytic uses components.
    """
    verbs = F.create_map(*[F.lit(x) for pair in VERBS.items() for x in pair])
    links = objects.where("type = 'relationship'").select(F.col("source_ref").alias("src"), F.try_element_at(verbs, F.col("relationship_type")).alias("verb"), F.col("target_ref").alias("dst")).where("verb is not null")
    tactics = objects.where("type = 'x-mitre-tactic'").select(F.col("shortname").alias("tactic"), F.col("id").alias("dst"))
    of_tactics = objects.where("type = 'attack-pattern'").select(F.col("id").alias("src"), F.explode("tactics").alias("tactic")).join(tactics, "tactic").select("src", F.lit("BELONGS_TO_TACTIC").alias("verb"), "dst")
    exploded = lambda kind, c, verb: objects.where(F.col("type") == kind).select(F.col("id").alias("src"), F.lit(verb).alias("verb"), F.explode(c).alias("dst"))
    parts = [links, of_tactics, exploded("x-mitre-detection-strategy", "analytic_refs", "HAS_ANALYTIC"), exploded("x-mitre-analytic", "component_refs", "USES_DATA_COMPONENT")]
    known = objects.where("type <> 'relationship'").select("id").distinct()
    found = reduce(DataFrame.unionByName, parts).distinct()
    return found.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "verb", "dst")
