"""Bundles of linked objects: what a bundle must satisfy, what is mended in it, and what each check tells.

Objects of any number of bundles are rows: bundle, position, id, type, created, modified, name, description (strings but for
position), ``single`` (map of reference field to id), ``lists`` (map of reference field to ids), ``props`` (map of other fields
to strings), ``extensions`` (map of declared id to its extension_type), and the lists sectors, labels, platforms and tactics.
objects_from_json() reads them from JSON; any other way to the same columns does as well. A missing field is null or absent.

A check gives correction records: bundle, rule, severity, ref_id, ref_field, holder_id, holder_type, before, after.
Ids are looked up within a bundle, by equi-joins on (bundle, id); no bundle is ever collected into one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from loam.functions.text import fingerprint
from loam.operators.graph import clean_edges, core
from loam.sources.shared import saved

#: Reference fields of one id and of several, those of operators and conditions, and what a procedure must have.
SINGLE_REFS = ("created_by_ref", "source_ref", "target_ref")
LIST_REFS = ("x_technique_refs", "x_source_refs", "x_vulnerability_refs", "x_components_refs", "x_log_source_refs", "object_refs", "object_marking_refs", "start_refs")
FLOW_REFS = ("effect_refs", "on_true_refs", "on_false_refs")
PROCEDURE_REQUIRED = ("name", "x_technique_refs", "x_source_refs")
#: Observable types, which need no dates; marking definitions that need not be in a bundle.
OBSERVABLES = ("ipv4-addr", "ipv6-addr", "domain-name", "url", "email-addr", "file", "windows-registry-key", "network-traffic", "process", "directory", "mutex", "software", "user-account")
MARKINGS = (
    "marking-definition--613f2e26-407d-48c7-9eca-b8e91df99dc9", "marking-definition--34098fce-860f-48ae-8e50-ebd3cc5e41da", "marking-definition--f88d31f6-486f-44da-b317-01333bde0b82",
    "marking-definition--5e57c739-391a-4eb3-b6be-7d15ca92d5ed", "marking-definition--bab4a63c-aed9-4cf5-a766-dfca5abac2bb", "marking-definition--55d920b0-5e8b-4f79-9ee9-91f868d9b421",
)
#: The extensions that custom types must declare.
PROCEDURE_EXTENSION, FLOW_EXTENSION = "extension-definition--b422519e-c47a-439d-9195-0f16b94fa889", "extension-definition--fb9c968a-745b-4ade-9b25-c324172197f4"
FLOW_TYPES = ("attack-flow", "attack-operator", "attack-condition")
#: Verb -> types that may stand at its source and at its target.
DIRECTIONS = {
    "uses": (("intrusion-set", "campaign", "x-procedure", "threat-actor"), ("tool", "malware", "attack-pattern", "infrastructure", "x-procedure")),
    "implements-technique": (("x-procedure",), ("attack-pattern",)),
    "attributed-to": (("campaign", "x-procedure", "intrusion-set"), ("intrusion-set", "threat-actor")),
    "targets": (("campaign", "tool", "malware", "x-procedure", "intrusion-set"), ("identity", "location", "software", "infrastructure")),
    "exploits": (("x-procedure", "intrusion-set", "campaign"), ("vulnerability",)),
    "describes": (("report",), ("x-procedure",)),
    "mitigates": (("course-of-action",), ("attack-pattern",)),
}
#: The roles of organisations and of places, and other names of sectors.
ORGANISATION_ROLES, LOCATION_ROLES = ("victim", "sponsor", "publisher", "author", "other"), ("victim", "origin", "context")
SECTOR_ALIASES = {
    "defence": "defense", "pharmaceutical": "pharmaceuticals", "real-estate": "commercial", "media": "entertainment", "maritime": "transportation",
    "legal": "commercial", "legal-services": "commercial", "professional-services": "commercial", "legal-and-professional-services": "commercial",
}
#: The public vocabulary of industry sectors.
SECTORS = (
    "agriculture", "aerospace", "automotive", "chemical", "commercial", "communications", "construction", "defense", "education", "energy", "engineering", "entertainment",
    "financial-services", "government", "emergency-services", "government-local", "government-national", "government-public-services", "government-regional",
    "healthcare", "hospitality-leisure", "infrastructure", "dams", "nuclear", "water", "insurance", "manufacturing", "mining", "non-profit", "pharmaceuticals",
    "retail", "technology", "telecommunications", "transportation", "utilities",
)

COLUMNS = ["bundle", "position", "id", "type", "created", "modified", "name", "description", "single", "lists", "props", "extensions", "sectors", "labels", "platforms", "tactics"]
RECORD = ["bundle", "rule", "severity", "ref_id", "ref_field", "holder_id", "holder_type", "before", "after"]
_TEXT_PROPS = ("relationship_type", "operator", "pattern", "pattern_type", "organization_role", "location_role", "x_fingerprint")


def objects_from_json(raw: DataFrame) -> DataFrame:
    """Objects of (bundle, position, body: JSON text of one object); text that is no object gives a row without type and id."""
    lists = ", ".join(f"{f}: array<string>" for f in (*LIST_REFS, *FLOW_REFS, "sectors", "labels", "x_platforms"))
    texts = ", ".join(f"{f}: string" for f in (*SINGLE_REFS, *_TEXT_PROPS, "id", "type", "created", "modified", "name", "description"))
    schema = f"struct<{texts}, {lists}, extensions: map<string, struct<extension_type: string>>, kill_chain_phases: array<struct<kill_chain_name: string, phase_name: string>>>"
    o = raw.select("bundle", "position", F.from_json("body", schema).alias("o"))
    table = lambda fields: F.map_filter(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f"o.{f}"))]), lambda _, v: v.isNotNull())
    phases = F.filter("o.kill_chain_phases", lambda p: p.kill_chain_name == "mitre-attack")
    return o.select(
        "bundle", "position", "o.id", "o.type", "o.created", "o.modified", "o.name", "o.description", table(SINGLE_REFS).alias("single"), table((*LIST_REFS, *FLOW_REFS)).alias("lists"),
        table(_TEXT_PROPS).alias("props"), F.transform_values("o.extensions", lambda _, v: v.extension_type).alias("extensions"), "o.sectors", "o.labels",
        F.col("o.x_platforms").alias("platforms"), F.transform(phases, lambda p: p.phase_name).alias("tactics"),
    )


def _get(table: str, key: str) -> Column:
    return F.try_element_at(F.col(table), F.lit(key))


def _blank(value: Column) -> Column:
    return F.coalesce(value == "", F.lit(True))


def _told(bad: DataFrame, rule: str | Column, severity: str = "hard_fail", **fields: Column) -> DataFrame:
    given = {"rule": rule if isinstance(rule, Column) else F.lit(rule), "severity": F.lit(severity)} | fields
    return bad.select("bundle", *[given.get(c, F.lit(None)).cast("string").alias(c) for c in RECORD[1:]])


def all_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is as large as its bundles. Planned by the size of its compressed columns it would be broadcast at many times that size."""
    return df.hint("merge")


def ids(objects: DataFrame, name: str = "ref") -> DataFrame:
    return _shuffled(objects.where(~_blank(F.col("id"))).select("bundle", F.col("id").alias(name)).distinct())


def references(objects: DataFrame) -> DataFrame:
    """(bundle, holder_id, holder_type, ref_field, place, ref) for every id in a reference field; blank ones are none."""
    of_one = F.transform(F.map_entries(F.coalesce("single", F.create_map().cast("map<string,string>"))), lambda e: F.struct(e.key.alias("ref_field"), F.lit(0).alias("place"), e.value.alias("ref")))
    of_list = F.flatten(F.transform(F.map_entries(F.coalesce("lists", F.create_map().cast("map<string,array<string>>"))), lambda e: F.transform(F.coalesce(e.value, F.array()), lambda r, k: F.struct(e.key.alias("ref_field"), k.alias("place"), r.alias("ref")))))
    held = objects.select("bundle", F.col("id").alias("holder_id"), F.col("type").alias("holder_type"), F.explode(F.concat(of_one, of_list)).alias("r"))
    return held.select("bundle", "holder_id", "holder_type", "r.*").where(~_blank(F.col("ref")))


# --- checks ---------------------------------------------------------------------------------------------------------


def ref_field_types(raw: DataFrame) -> DataFrame:
    """malformed_ref_type for (bundle, position, body) whose reference fields hold other things than ids and lists of them."""
    v = F.try_parse_json("body")
    kind = lambda f: F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant"))
    one = [F.when(kind(f).isNotNull() & ~kind(f).isin("STRING", "VOID"), F.array(F.lit(f))) for f in SINGLE_REFS]

    def several(f: str) -> Column:
        entries = F.transform(F.try_variant_get(v, f"$.{f}", "array<variant>"), F.schema_of_variant)
        wrong = F.transform(F.filter(entries, lambda e: F.coalesce(e != "STRING", F.lit(True))), lambda _: F.lit(f))
        return F.when(kind(f).isNull() | (kind(f) == "VOID"), F.array().cast("array<string>")).when(F.startswith(kind(f), F.lit("ARRAY")), wrong).otherwise(F.array(F.lit(f)))

    fields = F.flatten(F.array(*[F.coalesce(c, F.array().cast("array<string>")) for c in (*one, *map(several, LIST_REFS))]))
    bad = raw.select("bundle", F.try_variant_get(v, "$.id", "string").alias("id"), F.try_variant_get(v, "$.type", "string").alias("type"), F.explode(fields).alias("field"))
    return _told(bad, "malformed_ref_type", ref_field=F.col("field"), holder_id=F.coalesce("id", F.lit("<no-id>")), holder_type=F.coalesce("type", F.lit("<no-type>")))


def object_schema(objects: DataFrame) -> DataFrame:
    """Type and id of all, dates of all but observables and relationships, and a relationship's three fields."""
    typed, named = ~_blank(F.col("type")), ~_blank(F.col("id"))
    plain = typed & named & ~F.col("type").isin(*OBSERVABLES, "relationship")
    linked = typed & named & (F.col("type") == "relationship")
    rules = F.array(
        F.when(~typed, F.struct(F.lit("object_missing_type").alias("rule"), F.lit(None).cast("string").alias("field"))),
        F.when(typed & ~named, F.struct(F.lit("object_missing_id").alias("rule"), F.lit(None).cast("string").alias("field"))),
        *[F.when(plain & _blank(F.col(f)), F.struct(F.lit(f"sdo_missing_{f}").alias("rule"), F.lit(None).cast("string").alias("field"))) for f in ("created", "modified")],
        *[F.when(linked & _blank(_get("single" if f != "relationship_type" else "props", f)), F.struct(F.lit("relationship_missing_required_field").alias("rule"), F.lit(f).alias("field"))) for f in ("source_ref", "target_ref", "relationship_type")],
    )
    bad = objects.select("bundle", "id", "type", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r"))
    return _told(bad, F.col("r.rule"), ref_id=F.col("id"), ref_field=F.col("r.field"), holder_type=F.when(F.col("r.rule") == "object_missing_id", F.col("type")))


def id_uniqueness(objects: DataFrame) -> DataFrame:
    """One record per id that several objects of a bundle have."""
    again = objects.where(~_blank(F.col("id"))).groupBy("bundle", "id").agg(F.count("*").alias("n")).where("n > 1")
    return _told(again, "duplicate_object_id", ref_id=F.col("id"))


def procedure_fields(objects: DataFrame) -> DataFrame:
    missing = F.array(*[F.when(_blank(F.col("name")) if f == "name" else F.coalesce(F.size(_get("lists", f)), F.lit(0)) <= 0, F.lit(f)) for f in PROCEDURE_REQUIRED])
    bad = objects.where("type = 'x-procedure'").select("bundle", "id", F.explode(F.filter(missing, lambda f: f.isNotNull())).alias("field"))
    return _told(bad, "x_procedure_missing_required_field", ref_id=F.coalesce("id", F.lit("<no-id>")), ref_field=F.col("field"), holder_type=F.lit("x-procedure"))


def extension_declarations(objects: DataFrame) -> DataFrame:
    """Custom types declare their extension as a new type, and the bundle holds every extension that is declared."""
    wanted = F.when(F.col("type") == "x-procedure", F.lit(PROCEDURE_EXTENSION)).when(F.col("type").isin(*FLOW_TYPES), F.lit(FLOW_EXTENSION))
    declared = F.coalesce(F.try_element_at("extensions", wanted) == "new-sdo", F.lit(False))
    rule = F.when(F.col("type") == "x-procedure", F.lit("x_procedure_extension_undeclared")).otherwise("attack_flow_extension_undeclared")
    undeclared = _told(objects.where(wanted.isNotNull() & ~declared), rule, ref_id=F.coalesce("id", F.lit("<no-id>")), ref_field=F.lit("extensions"), holder_type=F.col("type"))
    keys = objects.select("bundle", "type", F.explode(F.map_keys("extensions")).alias("ref")).where(F.startswith("ref", F.lit("extension-definition--")))
    absent = keys.join(ids(objects), ["bundle", "ref"], "left_anti")
    return undeclared.unionByName(_told(absent, "extension_definition_missing", ref_id=F.col("ref"), ref_field=F.lit("extensions"), holder_type=F.col("type")))


def dangling_references(objects: DataFrame) -> DataFrame:
    """(bundle, holder_id, holder_type, ref_field, place, ref) of references to nothing, but for catalogue techniques and public markings."""
    held = references(objects).where(F.col("ref_field").isin(*SINGLE_REFS, *LIST_REFS) & ~F.startswith("ref", F.lit("attack-pattern--")) & ~F.col("ref").isin(*MARKINGS))
    return held.join(ids(objects), ["bundle", "ref"], "left_anti")


def dangling_checks(objects: DataFrame) -> DataFrame:
    return _told(dangling_references(objects), "dangling_ref_unrecoverable", ref_id=F.col("ref"), ref_field=F.col("ref_field"), holder_id=F.col("holder_id"), holder_type=F.col("holder_type"))


def flow_edges(objects: DataFrame) -> DataFrame:
    """(bundle, src, dst): what precedes what, over relationships, operators and conditions."""
    precedes = objects.where((F.col("type") == "relationship") & (_get("props", "relationship_type") == "precedes")).select("bundle", _get("single", "source_ref").alias("src"), _get("single", "target_ref").alias("dst"))
    held = references(objects).where((F.col("holder_type") == "attack-operator") & (F.col("ref_field") == "effect_refs") | (F.col("holder_type") == "attack-condition") & F.col("ref_field").isin("on_true_refs", "on_false_refs"))
    return precedes.unionByName(held.select("bundle", F.col("holder_id").alias("src"), F.col("ref").alias("dst"))).where(~_blank(F.col("src")) & ~_blank(F.col("dst")))


def flow_cycles(objects: DataFrame) -> DataFrame:
    """One record per bundle whose flow has a cycle. All bundles are searched at once, nodes being (bundle, id); which nodes lie on it is not asked."""
    node = lambda c: F.struct(F.col("bundle"), F.col(c).alias("id"))
    edges = saved(flow_edges(objects).select(node("src").alias("src"), node("dst").alias("dst")), "flow-edges")
    loops = edges.where(F.col("src") == F.col("dst"))
    return _told(loops.union(core(clean_edges(edges))).select("src.bundle").distinct(), "precedes_cycle")


def operator_integrity(objects: DataFrame) -> DataFrame:
    operators = objects.where("type = 'attack-operator'")
    kind = _told(operators.where(~F.coalesce(_get("props", "operator").isin("AND", "OR", "XOR"), F.lit(False))), "attack_operator_invalid_kind", ref_id=F.col("id"))
    empty = _told(operators.where(F.coalesce(F.size(_get("lists", "effect_refs")), F.lit(0)) <= 0), "attack_operator_no_effect_refs", ref_id=F.col("id"))
    targets = operators.select("bundle", "id", F.explode(_get("lists", "effect_refs")).alias("ref")).join(ids(objects), ["bundle", "ref"], "left_anti")
    return all_of([kind, empty, _told(targets, "attack_operator_dangling_effect_ref", ref_id=F.col("id"))])


def condition_integrity(objects: DataFrame) -> DataFrame:
    conditions = objects.where("type = 'attack-condition'")
    pattern, kind = _get("props", "pattern"), _get("props", "pattern_type")
    size = lambda f: F.coalesce(F.greatest(F.size(_get("lists", f)), F.lit(0)), F.lit(0))
    unpaired = ~_blank(pattern) & ~F.coalesce(kind.isin("stix", "regex", "plain"), F.lit(False))
    rules = F.array(
        F.when(F.coalesce(F.rlike("description", F.lit(r"\A\s*\z")), F.lit(True)), F.lit("attack_condition_no_description")),
        F.when(size("on_true_refs") + size("on_false_refs") == 0, F.lit("attack_condition_no_refs")),
        F.when(unpaired, F.lit("attack_condition_invalid_pattern_type")),
        F.when(_blank(pattern) & ~_blank(kind), F.lit("attack_condition_pattern_type_without_pattern")),
    )
    told = conditions.select("bundle", "id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))
    branches = F.concat(*[F.coalesce(_get("lists", f), F.array().cast("array<string>")) for f in ("on_true_refs", "on_false_refs")])
    targets = conditions.select("bundle", "id", F.explode(branches).alias("ref")).join(ids(objects), ["bundle", "ref"], "left_anti")
    return _told(told, F.col("rule"), ref_id=F.col("id")).unionByName(_told(targets, "attack_condition_dangling_ref", ref_id=F.col("id")))


def brand_as_malware(objects: DataFrame, brands: DataFrame) -> DataFrame:
    """Malware whose name holds a brand (brand: string) that names a technique; see operators.brands for the matching."""
    from loam.operators.brands import brand_hits

    named = objects.where((F.col("type") == "malware") & ~_blank(F.col("name"))).select("bundle", "id", F.col("name").alias("text"))
    hits = brand_hits(named.select(F.struct("bundle", "id").alias("id"), "text"), brands).select("id.*").distinct()
    return _told(hits, "brand_misclassified_as_malware", ref_id=F.col("id"), holder_type=F.lit("malware"))


def tuple_semantics(objects: DataFrame, confidence: DataFrame, uncovered: DataFrame) -> DataFrame:
    """(bundle, id, errors, warnings, valid) of procedures by which of techniques (AP), log sources (LS) and components (C) they lack.

    ``confidence`` (bundle, id, confidence; 0 if missing). At 70 and more a lack is an error, but of components, which is
    always a warning, and of log sources where nothing covers the techniques (``uncovered``: bundle, id).
    """
    size = lambda f: F.coalesce(F.size(_get("lists", f)), F.lit(0))
    p = objects.where("type = 'x-procedure'").select("bundle", "id", (size("x_technique_refs") <= 0).alias("ap"), (size("x_log_source_refs") <= 0).alias("ls"), (size("x_components_refs") <= 0).alias("c"))
    told = p.join(confidence.select("bundle", "id", "confidence"), ["bundle", "id"], "left").join(uncovered.select("bundle", "id", F.lit(True).alias("excused")).distinct(), ["bundle", "id"], "left")
    sure, excused = F.coalesce("confidence", F.lit(0)) >= 70, F.coalesce("excused", F.lit(False))
    listed = lambda *tests: F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests]), lambda x: x.isNotNull())
    errors = listed(("AP", F.col("ap") & sure), ("LS", F.col("ls") & sure & ~excused))
    warnings = listed(("AP", F.col("ap") & ~sure), ("LS", F.col("ls") & (~sure | excused)), ("C", F.col("c")))
    return told.select("bundle", "id", errors.alias("errors"), warnings.alias("warnings"), (F.size(errors) == 0).alias("valid"))


def single_flow(objects: DataFrame) -> DataFrame:
    several = objects.where("type = 'attack-flow'").groupBy("bundle").agg(F.count("*").alias("n")).where("n > 1")
    return _told(several, "multiple_attack_flows")


def validated(objects: DataFrame, brands: DataFrame | None = None) -> DataFrame:
    """The corrections of all checks over typed objects."""
    objects = saved(objects.select(COLUMNS), "bundle-objects", "zstd")
    parts = [object_schema, id_uniqueness, procedure_fields, extension_declarations, dangling_checks, flow_cycles, operator_integrity, condition_integrity, single_flow]
    found = [check(objects) for check in parts]
    return all_of(found + ([brand_as_malware(objects, brands)] if brands is not None else []))


def verdicts(objects: DataFrame, corrections: DataFrame) -> DataFrame:
    """(bundle, passed, error) for every bundle: passed without a hard failure; error tells them by rule, in one line."""
    fails = corrections.where("severity = 'hard_fail'").groupBy("bundle", "rule").agg(F.count("*").alias("n"))
    told = fails.groupBy("bundle").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.concat_ws("=", "rule", F.col("n").cast("string")))).alias("parts"))
    line = F.concat(F.lit("validate_bundle failed: "), F.col("n").cast("string"), F.lit(" issue(s) — "), F.array_join("parts", ", "))
    return objects.select("bundle").distinct().join(told, "bundle", "left").select("bundle", F.col("n").isNull().alias("passed"), F.when(F.col("n").isNotNull(), line).alias("error"))


# --- mends ----------------------------------------------------------------------------------------------------------
# auto_fixed() runs them in their order. Those of relationships go over their ends alone, a narrow row each; those of single
# objects note what they change in the object's own column ``told``, so that one pass over the objects gives both.

_NOTE = f"struct<{', '.join(f'{c}: string' for c in RECORD[1:])}>"


def _note(rule: str | Column, severity: str | Column = "auto_fix", **fields: Column) -> Column:
    given = {"rule": rule if isinstance(rule, Column) else F.lit(rule), "severity": severity if isinstance(severity, Column) else F.lit(severity)} | fields
    return F.struct(*[given.get(c, F.lit(None)).cast("string").alias(c) for c in RECORD[1:]])


def _noted(notes: Column) -> Column:
    """What was told so far and ``notes``, an array or null."""
    return F.concat("told", F.coalesce(notes, F.array().cast(f"array<{_NOTE}>")))


def _notes(objects: DataFrame) -> DataFrame:
    return objects.select("bundle", F.explode_outer("told").alias("n")).where("n is not null").select("bundle", "n.*")  # before an inner explode Spark would make the notes once more, to filter


def flipped_relationships(links: DataFrame, objects: DataFrame) -> DataFrame:
    """Links with ``turned``: those whose ends fit their verb only the other way round have them changed; both ends must be in the bundle."""
    kinds = objects.where(~_blank(F.col("id"))).groupBy("bundle", "id").agg(F.max_by("type", "position").alias("kind"))
    end = lambda ref, kind: _shuffled(kinds.select("bundle", F.col("id").alias(ref), F.col("kind").alias(kind)))
    typed = links.where(F.col("verb").isin(*DIRECTIONS)).join(end("src", "sk"), ["bundle", "src"], "left").join(end("dst", "dk"), ["bundle", "dst"], "left")
    turns = F.lit(False)
    for verb, (sources, targets) in DIRECTIONS.items():
        turns = turns | ((F.col("verb") == verb) & ~F.col("sk").isin(*sources) & F.col("sk").isin(*targets) & F.col("dk").isin(*sources))
    typed = typed.withColumn("turned", F.coalesce(turns, F.lit(False)))
    ends = [F.when(F.col("turned"), F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("src", "dst"), ("dst", "src"))]
    others = links.where(~F.coalesce(F.col("verb").isin(*DIRECTIONS), F.lit(False))).withColumn("turned", F.lit(False))
    return typed.select("bundle", "position", "id", "verb", *ends, "turned").unionByName(others)


def deduplicated_relationships(links: DataFrame) -> DataFrame:
    """Links with ``fate``: of those with equal ends and verb all but the first by position are duplicates; those that lack one of the three all stay."""
    whole = links.where(~_blank(F.col("src")) & ~_blank(F.col("dst")) & ~_blank(F.col("verb")))
    first = whole.groupBy("bundle", "src", "dst", "verb").agg(F.min("position").alias("first"), F.max("position").alias("last")).where("last > first").drop("last")
    later = F.coalesce(F.col("position") > F.col("first"), F.lit(False))
    return links.join(_shuffled(first), ["bundle", "src", "dst", "verb"], "left").withColumn("fate", F.when(later, "duplicate")).drop("first")


def without_loops(links: DataFrame) -> DataFrame:
    loop = F.coalesce((F.col("verb") == "precedes") & F.col("src").eqNullSafe(F.col("dst")), F.lit(False))
    return links.withColumn("fate", F.coalesce("fate", F.when(loop, "loop")))


def without_order(links: DataFrame, sequential: DataFrame) -> DataFrame:
    """Bundles that ``sequential`` (bundle, is_sequential) marks as unordered lose what precedes what; null means ordered."""
    unordered = sequential.where("not is_sequential").select("bundle", F.lit(True).alias("unordered")).distinct()
    return links.join(unordered, "bundle", "left").withColumn("fate", F.coalesce("fate", F.when(F.col("unordered") & (F.col("verb") == "precedes"), "unordered"))).drop("unordered")


def mended_links(objects: DataFrame, sequential: DataFrame) -> DataFrame:
    """(bundle, position, id, verb, src, dst, turned, fate) of relationships that the mends change or drop, and of all that tell what a procedure uses."""
    links = objects.where("type = 'relationship'").select("bundle", "position", "id", _get("props", "relationship_type").alias("verb"), _get("single", "source_ref").alias("src"), _get("single", "target_ref").alias("dst"))
    done = without_order(without_loops(deduplicated_relationships(flipped_relationships(links, objects))), sequential)
    return done.where(F.col("turned") | F.col("fate").isNotNull() | (F.col("verb") == "uses"))


def link_records(links: DataFrame) -> DataFrame:
    """The corrections of mended links: a record per link, but one per bundle for those that were dropped as unordered."""
    ends = lambda a, b: F.concat_ws(" ", a, b)
    turned = F.when(F.col("turned"), _note("sro_direction_flipped", ref_id=F.col("id"), before=ends("dst", "src"), after=ends("src", "dst")))
    rule = F.when(F.col("fate") == "duplicate", "sro_duplicate_dropped").when(F.col("fate") == "loop", "precedes_self_loop_dropped")
    single = links.withColumn("told", F.filter(F.array(turned, F.when(rule.isNotNull(), _note(rule, ref_id=F.col("id")))), lambda n: n.isNotNull()))
    counted = links.where("fate = 'unordered'").groupBy("bundle").agg(F.count("*").alias("n"))
    return _notes(single).unionByName(_told(counted, "precedes_dropped_non_sequential", "auto_fix", before=F.col("n")))


def deduplicated_refs(objects: DataFrame) -> DataFrame:
    """Lists of references without blanks and repeats, in order."""
    clean = F.transform_values("lists", lambda k, v: F.when(k.isin(*LIST_REFS), F.array_distinct(F.filter(v, lambda r: F.coalesce(r != "", F.lit(False))))).otherwise(v))
    changed = F.map_keys(F.map_filter(F.map_zip_with("lists", "clean", lambda _, a, b: F.size(a) != F.size(b)), lambda _, c: c))
    told = F.transform(changed, lambda field: _note("embedded_refs_deduplicated", ref_field=field, holder_id=F.col("id")))
    return objects.withColumn("clean", clean).withColumn("told", _noted(told)).withColumn("lists", F.col("clean")).drop("clean")


def synced_techniques(procedures: DataFrame, links: DataFrame) -> DataFrame:
    """Procedures that ``uses`` relationships give techniques get those they do not list, sorted, behind their own."""
    uses = links.where((F.col("verb") == "uses") & F.col("fate").isNull()).select("bundle", F.col("src").alias("id"), F.col("dst").alias("t"))
    of = uses.where(F.startswith("id", F.lit("x-procedure--")) & F.startswith("t", F.lit("attack-pattern--"))).groupBy("bundle", "id").agg(F.array_sort(F.collect_set("t")).alias("used"))
    own = F.coalesce(_get("lists", "x_technique_refs"), F.array().cast("array<string>"))
    marked = procedures.join(_shuffled(of), ["bundle", "id"], "left").withColumn("more", F.array_except(F.coalesce("used", F.array().cast("array<string>")), own))
    more = F.size("more") > 0
    lists = F.map_concat(F.map_filter(F.coalesce("lists", F.create_map().cast("map<string,array<string>>")), lambda k, _: k != "x_technique_refs"), F.create_map(F.lit("x_technique_refs"), F.concat(own, F.col("more"))))
    told = F.when(more, F.array(_note("embedded_technique_refs_synced", ref_field=F.lit("x_technique_refs"), holder_id=F.col("id"), after=F.size("more"))))
    return marked.withColumn("told", _noted(told)).withColumn("lists", F.when(more, lists).otherwise(F.col("lists"))).select(*COLUMNS, "told")


def backfilled_sources(procedures: DataFrame) -> DataFrame:
    """Procedures without sources get the one that created them."""
    author = _get("single", "created_by_ref")
    bad = F.coalesce((F.coalesce(F.size(_get("lists", "x_source_refs")), F.lit(0)) <= 0) & ~_blank(author), F.lit(False))
    lists = F.map_concat(F.map_filter(F.coalesce("lists", F.create_map().cast("map<string,array<string>>")), lambda k, _: k != "x_source_refs"), F.create_map(F.lit("x_source_refs"), F.array(author)))
    told = F.when(bad, F.array(_note("x_source_refs_backfilled", "repaired", ref_field=F.lit("x_source_refs"), holder_id=F.col("id"), after=author)))
    return procedures.withColumn("told", _noted(told)).withColumn("lists", F.when(bad, lists).otherwise(F.col("lists")))


def recomputed_fingerprints(procedures: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    right = fingerprint(F.coalesce(_get("lists", "x_technique_refs"), none), F.coalesce("platforms", none), F.coalesce("tactics", none))
    own = _get("props", "x_fingerprint")
    bad = ~own.eqNullSafe(F.col("right"))
    props = F.map_concat(F.map_filter(F.coalesce("props", F.create_map().cast("map<string,string>")), lambda k, _: k != "x_fingerprint"), F.create_map(F.lit("x_fingerprint"), F.col("right")))
    told = F.when(bad, F.array(_note("fingerprint_recomputed", ref_field=F.lit("x_fingerprint"), holder_id=F.col("id"), before=own, after=F.col("right"))))
    return procedures.withColumn("right", right).withColumn("told", _noted(told)).withColumn("props", F.when(bad, props).otherwise(F.col("props"))).drop("right")


def coerced_roles(objects: DataFrame) -> DataFrame:
    """Roles outside their vocabulary: ``other`` for organisations, ``context`` for places."""
    field = F.when(F.col("type") == "identity", F.lit("organization_role")).when(F.col("type") == "location", F.lit("location_role"))
    role = F.try_element_at("props", field)
    known = F.when(F.col("type") == "identity", role.isin(*ORGANISATION_ROLES)).otherwise(role.isin(*LOCATION_ROLES))
    bad = F.coalesce(field.isNotNull() & ~_blank(role) & ~known, F.lit(False))
    to = F.when(F.col("type") == "identity", F.lit("other")).otherwise("context")
    told = F.when(bad, F.array(_note("invalid_role_coerced", ref_field=field, holder_id=F.col("id"), before=role, after=to)))
    return objects.withColumn("told", _noted(told)).withColumn("props", F.when(bad, F.transform_values("props", lambda k, v: F.when(k == field, to).otherwise(v))).otherwise(F.col("props")))


def coerced_sectors(objects: DataFrame, vocabulary: tuple[str, ...] = SECTORS) -> DataFrame:
    """Sectors of identities in the vocabulary's words: other names mapped, the original kept as a label; unknown ones dropped."""
    aliases = F.create_map(*[F.lit(x) for pair in SECTOR_ALIASES.items() for x in pair])
    raw = F.transform("sectors", lambda s: F.lower(F.regexp_replace(s, r"\A\s+|\s+\z", "")))
    to = F.transform(raw, lambda s: F.struct(s.alias("from"), F.when(s.isin(*vocabulary), s).otherwise(F.try_element_at(aliases, s)).alias("to")))
    marked = objects.withColumn("read", F.when((F.col("type") == "identity") & (F.size("sectors") > 0), to))
    wrong = F.filter("read", lambda t: ~t["from"].eqNullSafe(t.to))
    rule = lambda t: F.when(t.to.isNotNull(), F.lit("invalid_sector_coerced")).otherwise("invalid_sector_dropped")
    told = F.transform(wrong, lambda t: _note(rule(t), F.when(t.to.isNotNull(), "auto_fix").otherwise("warn"), ref_field=F.lit("sectors"), holder_id=F.col("id"), before=t["from"], after=t.to))
    kept = F.array_distinct(F.filter(F.transform("read", lambda t: t.to), lambda s: s.isNotNull()))
    renamed = F.transform(F.filter("read", lambda t: t.to.isNotNull() & (t["from"] != t.to)), lambda t: F.concat(F.lit("sector:"), t["from"]))
    changed = F.coalesce(F.exists("read", lambda t: ~t["from"].eqNullSafe(t.to)), F.lit(False))
    sectors = F.when(changed, F.when(F.size(kept) > 0, kept)).otherwise(F.col("sectors"))
    labels = F.when(changed & (F.size(renamed) > 0), F.array_union(F.coalesce("labels", F.array().cast("array<string>")), renamed)).otherwise(F.col("labels"))
    return marked.withColumn("told", _noted(told)).withColumn("sectors", sectors).withColumn("labels", labels).select(*COLUMNS, "told")


def auto_fixed(objects: DataFrame, sequential: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All mends in their order; the next one sees what the one before left.

    The objects are written once, and of their relationships what the mends change. Of the objects themselves only
    procedures are shuffled, to what they use, and only once, and relationships where the mended ones are asked for.
    """
    objects = saved(objects.select(COLUMNS), "bundle-objects", "zstd")
    links = saved(mended_links(objects, sequential), "bundle-links", "zstd")
    kind = F.col("type")
    clean = lambda rows: deduplicated_refs(rows.withColumn("told", F.array().cast(f"array<{_NOTE}>")))
    procedures = recomputed_fingerprints(backfilled_sources(synced_techniques(clean(objects.where(kind == "x-procedure")), links)))
    others = coerced_sectors(coerced_roles(clean(objects.where(~F.coalesce(kind.isin("x-procedure", "relationship"), F.lit(False))))))
    relationships = clean(objects.where(kind == "relationship"))
    fates = links.where(F.col("turned") | F.col("fate").isNotNull()).select("bundle", "position", "turned", "fate")
    ends = F.create_map(F.lit("source_ref"), _get("single", "target_ref"), F.lit("target_ref"), _get("single", "source_ref"))
    single = F.when(F.col("turned"), F.map_concat(F.map_filter("single", lambda k, _: ~k.isin("source_ref", "target_ref")), ends)).otherwise(F.col("single"))
    fixed = relationships.join(_shuffled(fates), ["bundle", "position"], "left").where("fate is null").withColumn("single", single)
    noted = relationships.where(F.size("told") > 0).join(_shuffled(fates.where("fate = 'duplicate'")), ["bundle", "position"], "left_anti")
    mended = all_of([part.select(COLUMNS) for part in (procedures, others, fixed)])
    return mended, all_of([link_records(links), *map(_notes, (procedures, others, noted))])


def recovered(objects: DataFrame, upstream: DataFrame, rounds: int = 5) -> tuple[DataFrame, DataFrame]:
    """Dangling references filled from ``upstream`` objects, which may dangle in turn: at most ``rounds`` rounds, fewer without progress.

    ``upstream`` has the same columns; an object of any bundle may be taken into the bundle that lacks it.
    """
    told = None
    for _ in range(rounds):
        lost = dangling_references(objects).select("bundle", F.col("ref").alias("id")).distinct()
        offer = upstream.where(~_blank(F.col("id"))).groupBy("id").agg(F.min_by(F.struct(*[c for c in COLUMNS if c not in ("bundle", "id")]), "position").alias("o"))
        filled = saved(lost.join(offer, "id").select("bundle", "id", "o.*").select(COLUMNS), "recovered")
        if filled.isEmpty():
            break
        records = _told(filled, "dangling_ref_recovered", "repaired", ref_id=F.col("id"))
        told = records if told is None else told.unionByName(records)
        objects = objects.select(COLUMNS).unionByName(filled)
    return objects, told if told is not None else _told(objects.limit(0), "dangling_ref_recovered", "repaired")


def relationships_of(objects: DataFrame) -> DataFrame:
    """(bundle, source, field, target): edges of a bundle's picture, of any reference field and of relationships by verb; both ends present, each once."""
    objects = saved(objects.select("bundle", "id", "type", "single", "lists", "props"), "bundle-objects", "zstd")
    of_links = objects.where("type = 'relationship'").select("bundle", _get("single", "source_ref").alias("source"), _get("props", "relationship_type").alias("field"), _get("single", "target_ref").alias("target"))
    of_fields = references(objects.where("type <> 'relationship'")).select("bundle", F.col("holder_id").alias("source"), F.regexp_replace("ref_field", r"_refs?$", "").alias("field"), F.col("ref").alias("target"))
    known = ids(objects, "source")
    return of_links.unionByName(of_fields).join(known, ["bundle", "source"], "left_semi").join(known.withColumnRenamed("source", "target"), ["bundle", "target"], "left_semi").select("bundle", "source", "field", "target").distinct()


def report_refs(objects: DataFrame) -> DataFrame:
    """(bundle, id): what a bundle's report lists: all but relationships, reports, markings and extensions with what only they use."""
    meta = references(objects.where("type = 'extension-definition'")).select("bundle", F.col("ref").alias("id"))
    listed = objects.where(~F.col("type").isin("relationship", "report", "marking-definition", "extension-definition")).select("bundle", "id")
    return listed.where(~_blank(F.col("id"))).join(meta.distinct(), ["bundle", "id"], "left_anti").distinct()


def bundle_counts(objects: DataFrame) -> DataFrame:
    """Objects, relationships and procedures of each bundle."""
    n = lambda kind: F.count_if(F.coalesce(F.col("type") == kind, F.lit(False)))
    return objects.groupBy("bundle").agg(F.count("*").alias("objects"), n("relationship").alias("relationships"), n("x-procedure").alias("procedures"))


def last_position(objects: DataFrame) -> DataFrame:
    """Positions counted on within each bundle, by the positions as they are."""
    return objects.withColumn("position", F.row_number().over(Window.partitionBy("bundle").orderBy("position")).cast("long") - 1)
