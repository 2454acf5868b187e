"""Relationships of a source: who used what, built from procedures and entities, with the analyst's removals and additions.

Entities are rows: source_id, entity_id, position, entity_type, value, edited_value, edited_type, gate_action, confidence,
organization_role, location_role, attributed_to (array), is_maas, stix_id. Procedures are rows: source_id, draft_id, chunk_id,
position, name, stix_id, techniques (array of structs with technique_id, technique_name, tactic, stix_id), components_refs,
observable_refs, vulnerability_refs, attributed_actors, malware_used, tools_used (arrays). Everything is joined within a source by
equi-joins; a source's actors and targets are few, so their products stay within what a report names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from loam.functions.keys import relationship_key
from loam.sources.shared import saved

#: Entity type -> the type of its object.
OBJECT_TYPES = {
    "intrusion_set": "intrusion-set", "threat_actor": "threat-actor", "malware": "malware", "tool": "tool", "campaign": "campaign", "vulnerability": "vulnerability",
    "organization": "identity", "location": "location", "victim_sector": "identity", "infrastructure": "infrastructure", "ioc_hash": "file", "ioc_ip": "ipv4-addr",
    "ioc_domain": "domain-name", "ioc_url": "url", "ioc_email": "email-addr", "ioc_file_path": "file", "ioc_registry_key": "windows-registry-key", "ioc_mutex": "mutex",
    "ioc_process_name": "file", "software": "software", "user_account": "user-account",
}
OBSERVABLE_TYPES = ("file", "ipv4-addr", "ipv6-addr", "domain-name", "url", "email-addr", "windows-registry-key", "mutex", "process", "software", "user-account")
#: Below this confidence a cluster gets no campaign where all malware is rented.
LEAST_CONFIDENCE = 0.8


def entity_name(value: Column, edited: Column) -> Column:
    """The analyst's edit, else the value, trimmed."""
    return F.trim(F.coalesce(F.nullif(edited, F.lit("")), value, F.lit("")))


def named(entities: DataFrame) -> DataFrame:
    """Entities that were not removed, with ``name``, lower-cased ``key``, ``kind`` (the edited type wins) and ``object_type``."""
    kind = F.coalesce(F.nullif(F.col("edited_type"), F.lit("")), F.col("entity_type"))
    types = F.create_map(*[F.lit(x) for pair in OBJECT_TYPES.items() for x in pair])
    kept = entities.where(F.coalesce(F.col("gate_action") != "remove", F.lit(True)))
    kept = kept.withColumn("name", entity_name(F.col("value"), F.col("edited_value"))).withColumn("kind", kind)
    return kept.withColumn("key", F.lower("name")).withColumn("object_type", F.coalesce(F.try_element_at(types, F.col("kind")), F.lit("")))


def resolved_names(rows: DataFrame, names: str, entities: DataFrame) -> DataFrame:
    """(row columns without ``names``, stix_id): names of an array column as ids of the source's entities, letter case aside, each once."""
    asked = rows.withColumn("key", F.explode(F.array_distinct(F.transform(names, lambda n: F.lower(F.trim(n)))))).drop(names)
    known = named(entities).where("key <> '' and stix_id is not null").select("source_id", "key", F.col("stix_id").alias("to_id")).distinct()
    return asked.where("key <> ''").join(known, ["source_id", "key"]).drop("key").distinct()


def observables(entities: DataFrame) -> DataFrame:
    """(source_id, value, stix_id): lower-cased values and edits of observable entities; of equal values the first entity's."""
    kept = named(entities).where(F.col("object_type").isin(*OBSERVABLE_TYPES) & F.col("stix_id").isNotNull())
    told = kept.select("source_id", "position", "stix_id", F.posexplode(F.array("edited_value", "value")).alias("k", "v")).select("source_id", "stix_id", F.struct("position", "k").alias("at"), F.lower(F.trim("v")).alias("value"))
    return told.where("value <> ''").groupBy("source_id", "value").agg(F.min_by("stix_id", "at").alias("stix_id"))


def observable_links(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """(source_id, chunk_id, category, stix_id): artifacts (map of category to values) of chunks that are observable entities."""
    values = chunks.select("source_id", "chunk_id", F.explode("artifacts").alias("category", "values")).select("source_id", "chunk_id", "category", F.explode("values").alias("v"))
    asked = values.select("source_id", "chunk_id", "category", F.lower(F.trim("v")).alias("value")).distinct()
    return asked.join(observables(entities), ["source_id", "value"]).select("source_id", "chunk_id", "category", "stix_id").distinct()


def _attributed(rows: DataFrame, key: list[str], names: str, targets: DataFrame, alone: Column) -> DataFrame:
    """Per row the targets it names; where it names none that is known, the only one if ``alone`` holds."""
    asked = rows.select("source_id", *key, F.explode(F.array_distinct(F.transform(names, lambda n: F.lower(F.trim(n))))).alias("key")).where("key <> ''")
    told = asked.join(targets.select("source_id", "key", F.col("stix_id").alias("to_id")), ["source_id", "key"]).select("source_id", *key, "to_id").distinct()
    only = targets.groupBy("source_id").agg(F.count("*").alias("n"), F.first("stix_id").alias("to_id")).where("n = 1").select("source_id", "to_id")
    others = rows.where(alone).select("source_id", *key).join(told.select("source_id", *key), ["source_id", *key], "left_anti").join(only, "source_id")
    return told.unionByName(others.select("source_id", *key, "to_id"))


def actors_of_procedures(procedures: DataFrame, entities: DataFrame) -> DataFrame:
    """(source_id, draft_id, to_id): the clusters a procedure names, else the source's only cluster, else none."""
    sets = named(entities).where("entity_type = 'intrusion_set'")
    return _attributed(procedures, ["draft_id"], "attributed_actors", sets, F.lit(True)).where("to_id is not null")


def sponsors_of_actors(entities: DataFrame) -> DataFrame:
    """(source_id, from_id, to_id): the threat actors a cluster names, else the only pair of a source with one of each."""
    sets = named(entities).where("entity_type = 'intrusion_set'")
    alone = sets.withColumn("n_sets", F.count("*").over(Window.partitionBy("source_id"))).withColumn("from_id", F.col("stix_id"))
    found = _attributed(alone, ["from_id"], "attributed_to", named(entities).where("entity_type = 'threat_actor'"), F.col("n_sets") == 1)
    return found.where("from_id is not null and to_id is not null")


def rented_only(entities: DataFrame) -> DataFrame:
    """(source_id, rented): whether a source names malware and all of it is rented."""
    malware = named(entities).where("entity_type = 'malware'")
    return malware.groupBy("source_id").agg(F.bool_and(F.coalesce("is_maas", F.lit(False))).alias("rented"))


def relationships(procedures: DataFrame, entities: DataFrame, precedes: DataFrame | None = None) -> DataFrame:
    """(source_id, source_ref, verb, target_ref), each once.

    Of procedures: uses techniques, malware and tools, is made of components, has observables, exploits vulnerabilities, and
    the cluster it is attributed to uses it. Of clusters and campaigns: attribution, targets (victim organisations for
    clusters, victim places and software for both), exploits, and what their procedures use, rolled up; a campaign uses what
    any procedure of its source does. ``precedes`` (source_id, source_ref, target_ref) is added as it is.
    """
    p = procedures.where("stix_id is not null")
    e = named(entities).where("stix_id is not null")
    kind = lambda name: e.where(F.col("entity_type") == name).select("source_id", "stix_id")
    edge = lambda df, s, verb, t: df.select("source_id", F.col(s).alias("source_ref"), F.lit(verb).alias("verb"), F.col(t).alias("target_ref"))
    each = lambda c: p.select("source_id", "draft_id", F.col("stix_id").alias("proc"), F.explode(c).alias("ref")).where("ref <> ''")
    tech = p.select("source_id", "draft_id", F.col("stix_id").alias("proc"), F.explode(F.transform("techniques", lambda t: t.stix_id)).alias("ref")).where("ref <> ''")
    used = lambda c, name: resolved_names(p.select("source_id", "draft_id", F.col("stix_id").alias("proc"), c), c, entities.where(F.col("entity_type") == name)).withColumnRenamed("to_id", "ref")
    columns = ["source_id", "draft_id", "proc", "ref"]
    uses = tech.select(columns).unionByName(used("malware_used", "malware").select(columns)).unionByName(used("tools_used", "tool").select(columns)).distinct()
    known = e.select("source_id", F.col("entity_id").alias("ref"), F.col("stix_id").alias("known")).distinct()
    exploited = each("vulnerability_refs").join(known, ["source_id", "ref"], "left").select("source_id", "proc", F.coalesce("known", "ref").alias("ref"))
    acts = actors_of_procedures(p, entities)
    of_proc = acts.join(p.select("source_id", "draft_id", F.col("stix_id").alias("proc")), ["source_id", "draft_id"])
    sets, campaigns = kind("intrusion_set"), kind("campaign")
    both = sets.unionByName(campaigns).withColumnRenamed("stix_id", "actor")
    victims = e.where("entity_type = 'organization' and organization_role = 'victim'").select("source_id", F.col("stix_id").alias("ref"))
    places = e.where("entity_type = 'location' and location_role = 'victim'").select("source_id", F.col("stix_id").alias("ref"))
    software = kind("software").withColumnRenamed("stix_id", "ref")
    sure = e.where("entity_type = 'intrusion_set'").join(rented_only(entities), "source_id", "left").where(~F.coalesce("rented", F.lit(False)) | (F.coalesce("confidence", F.lit(1.0)) >= LEAST_CONFIDENCE))
    parts = [
        edge(uses, "proc", "uses", "ref"), edge(each("components_refs"), "ref", "component-of", "proc"), edge(each("observable_refs"), "proc", "has-observable", "ref"),
        edge(exploited, "proc", "exploits", "ref"), edge(of_proc, "to_id", "uses", "proc"),
        edge(campaigns.withColumnRenamed("stix_id", "campaign").join(sure.select("source_id", "stix_id"), "source_id"), "campaign", "attributed-to", "stix_id"),
        edge(sponsors_of_actors(entities), "from_id", "attributed-to", "to_id"),
        edge(sets.withColumnRenamed("stix_id", "actor").join(victims, "source_id"), "actor", "targets", "ref"), edge(both.join(places.unionByName(software), "source_id"), "actor", "targets", "ref"),
        edge(acts.join(uses, ["source_id", "draft_id"]), "to_id", "uses", "ref").distinct(), edge(campaigns.join(uses.select("source_id", "ref").distinct(), "source_id"), "stix_id", "uses", "ref"),
        edge(both.join(exploited.select("source_id", "ref").distinct(), "source_id"), "actor", "exploits", "ref"),
    ]
    if precedes is not None:
        parts.append(edge(precedes, "source_ref", "precedes", "target_ref"))
    # Products of a source's actors and targets leave the task that joins them as they are made: a first distinct() there would hold a whole source's.
    return reduce(DataFrame.unionByName, parts).repartition("source_id", "source_ref", "verb", "target_ref").distinct()


def name_index(procedures: DataFrame, entities: DataFrame) -> DataFrame:
    """(source_id, stix_id, name, object_type) for entities, procedures and their techniques; of several names the first by order."""
    of_entities = named(entities).where("stix_id is not null").select("source_id", "stix_id", F.trim("name").alias("name"), "object_type")
    p = procedures.where("stix_id is not null")
    of_procedures = p.select("source_id", "stix_id", F.coalesce("name", "draft_id").alias("name"), F.lit("x-procedure").alias("object_type"))
    t = p.select("source_id", F.explode("techniques").alias("t")).where("t.stix_id <> ''")
    of_techniques = t.select("source_id", "t.stix_id", F.coalesce("t.technique_name", "t.technique_id").alias("name"), F.lit("attack-pattern").alias("object_type"))
    every = of_entities.unionByName(of_procedures).unionByName(of_techniques)
    return every.groupBy("source_id", "stix_id").agg(F.min(F.struct("name", "object_type")).alias("n")).select("source_id", "stix_id", "n.name", "n.object_type")


def preview(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Relationships by name for the analyst: source_id, id, verb, source_name, source_type, target_name, target_type.

    The id follows from what the row says; the second and later rows that say the same get _2, _3 and so on.
    """
    end = lambda c: names.select("source_id", F.col("stix_id").alias(f"{c}_ref"), F.col("name").alias(f"{c}_name"), F.col("object_type").alias(f"{c}_type"))
    told = edges.join(end("source"), ["source_id", "source_ref"]).join(end("target"), ["source_id", "target_ref"])
    key = relationship_key(F.col("source_name"), F.col("verb"), F.col("target_name"), F.col("source_type"), F.col("target_type"))
    n = F.row_number().over(Window.partitionBy("source_id", "key").orderBy("source_ref", "target_ref"))
    told = told.withColumn("key", key).withColumn("n", n)
    return told.select("source_id", F.when(F.col("n") > 1, F.concat_ws("_", "key", F.col("n").cast("string"))).otherwise(F.col("key")).alias("id"), "verb", "source_name", "source_type", "target_name", "target_type", "source_ref", "target_ref")


def without_removed(edges: DataFrame, shown: DataFrame, removed: DataFrame) -> DataFrame:
    """Edges without those whose preview rows the analyst removed (source_id, id), by what the rows say, so equal rows go together.

    Edges of a verb that no removed row has stay where they are: they aren't shuffled to be compared.
    """
    says = ["source_id", "verb", "source_name", "source_type", "target_name", "target_type"]
    gone = shown.join(removed.select("source_id", "id").distinct(), ["source_id", "id"], "left_semi").select(says).distinct()
    refs = saved(shown.join(gone, says, "left_semi").select("source_id", "source_ref", "verb", "target_ref").distinct(), "removed-edges")
    verbs = F.broadcast(refs.select("verb").distinct())  # as few as edges have
    touched = edges.join(verbs, "verb", "left_semi").select(edges.columns).join(refs, ["source_id", "source_ref", "verb", "target_ref"], "left_anti")
    return edges.join(verbs, "verb", "left_anti").select(edges.columns).unionByName(touched.select(edges.columns))


def added(rows: DataFrame, names: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges of rows that the analyst added or edited, and the rows that lead nowhere.

    ``rows`` have source_id, row, source_name, source_type, verb, target_name, target_type. An end is found by name and type;
    without a type by the name alone if only one object has it. Rows without a verb, with a missing end or onto themselves
    are skipped; edges that exist are not doubled, and only those of verbs that rows have are compared.
    """
    clean = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    index = names.select("source_id", F.lower(F.trim("name")).alias("name"), F.col("object_type").alias("type"), "stix_id").where("name <> ''")
    typed = index.groupBy("source_id", "name", "type").agg(F.min("stix_id").alias("stix_id"))
    single = typed.groupBy("source_id", "name").agg(F.count("*").alias("n"), F.min("stix_id").alias("stix_id")).where("n = 1").select("source_id", "name", F.lit("").alias("type"), "stix_id")
    known = typed.where("type <> ''").unionByName(single)
    asked = rows.select("source_id", "row", clean("verb").alias("verb"), *[clean(f"{c}_{k}").alias(f"{c}_{k}") for c in ("source", "target") for k in ("name", "type")])
    for c in ("source", "target"):
        end = known.select("source_id", F.col("name").alias(f"{c}_name"), F.col("type").alias(f"{c}_type"), F.col("stix_id").alias(f"{c}_ref"))
        asked = asked.join(end, ["source_id", f"{c}_name", f"{c}_type"], "left")
    good = F.coalesce((F.col("verb") != "") & (F.col("source_ref") != F.col("target_ref")), F.lit(False))
    new = asked.where(good).select("source_id", "source_ref", "verb", "target_ref").distinct()
    verbs = F.broadcast(edges.select("verb").distinct().join(new.select("verb").distinct(), "verb", "left_semi"))  # as few as edges have
    there = edges.join(verbs, "verb", "left_semi").select("source_id", "source_ref", "verb", "target_ref")
    return new.join(there, ["source_id", "source_ref", "verb", "target_ref"], "left_anti"), asked.where(~good).select("source_id", "row")


def vulnerability_refs(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """(source_id, draft_id, refs): entities of the identifiers that texts (source_id, draft_id, text) name, by first mention."""
    from loam.functions.text import cve_ids

    said = texts.select("source_id", "draft_id", F.posexplode(cve_ids(F.col("text"))).alias("place", "key"))
    known = named(entities).where("entity_type = 'vulnerability'").select("source_id", F.upper("name").alias("key"), "entity_id", "position")
    first = known.groupBy("source_id", "key").agg(F.min_by("entity_id", "position").alias("entity_id"))
    found = said.join(first, ["source_id", "key"]).groupBy("source_id", "draft_id").agg(F.array_sort(F.collect_list(F.struct("place", "entity_id"))).alias("r"))
    return found.select("source_id", "draft_id", F.array_distinct(F.transform("r", lambda r: r.entity_id)).alias("refs"))


def log_source_names(links: DataFrame, components: DataFrame, strategies: DataFrame) -> DataFrame:
    """Log sources (id, component_id, strategy_id) named by their component, else by their strategy, else not at all."""
    by_component = links.join(components.select(F.col("id").alias("component_id"), F.col("name").alias("component")), "component_id", "left")
    return by_component.join(strategies.select(F.col("id").alias("strategy_id"), F.col("name").alias("strategy")), "strategy_id", "left").select("id", F.coalesce("component", "strategy").alias("name"))


def detection_chain(techniques: DataFrame, strategies: DataFrame, analytics: DataFrame, log_sources: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label) and edges (src, verb, dst) behind techniques; every step may be missing, nothing comes twice.

    ``strategies`` (technique_id, strategy_id), ``analytics`` (strategy_id, analytic_id), ``log_sources`` (analytic_id,
    log_source_id), ``components`` (log_source_id, component_id). Each step keeps the links of what the one before reached, so whole chains are never made.
    """
    reached, nodes, edges = techniques.select(F.col("technique_id").alias("of")), [], []
    steps = (
        (strategies, "technique_id", "strategy_id", "detection-strategy", "detects"), (analytics, "strategy_id", "analytic_id", "analytic", "uses-analytic"),
        (log_sources, "analytic_id", "log_source_id", "log-source", "reads"), (components, "log_source_id", "component_id", "data-component", "provides"),
    )
    for links, source, target, label, verb in steps:
        links = links.select(F.col(source).alias("of"), F.col(target).alias("to")).where("to is not null").distinct().join(reached, "of", "left_semi")
        reached = links.select(F.col("to").alias("of")).distinct()
        nodes.append(reached.select(F.col("of").cast("string").alias("id"), F.lit(label).alias("label")))
        ends = ("to", "of") if verb == "detects" else ("of", "to")
        edges.append(links.select(F.col(ends[0]).cast("string").alias("src"), F.lit(verb).alias("verb"), F.col(ends[1]).cast("string").alias("dst")))
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)
