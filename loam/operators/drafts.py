"""Drafts of procedures: putting them together, what the analyst edits, and what goes into the bundle.

A draft is a row: source_id, draft_id, chunk_id, name, description, platforms, tools_used, malware_used, attributed_actors,
raw_command_lines, techniques (array of structs), phases, confidence, sequence_index, gate_action.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loam.functions.scores import completeness, composite_confidence
from loam.functions.text import fingerprint, normal_command


def evidenced(names: Column, *texts: Column) -> Column:
    """Names that stand in any of the texts, letter case aside."""
    hay = F.lower(F.concat_ws("\n", *texts))
    return F.filter(names, lambda n: F.coalesce((F.trim(n) != "") & F.contains(hay, F.lower(F.trim(n))), F.lit(False)))


def window_commands(captured: Column, chunk: Column, excerpt: Column, text: Column, start: Column, before: int = 500, after: int = 1500) -> Column:
    """Captured commands that stand in the chunk, its excerpt, or the source around the excerpt's place (from 0; null for none)."""
    around = F.when(start.isNotNull(), F.substring(text, F.greatest(start - before, F.lit(0)) + 1, start + after - F.greatest(start - before, F.lit(0)))).otherwise("")
    hay = F.concat_ws("\n", chunk, excerpt, around)
    return F.filter(captured, lambda c: F.coalesce((c != "") & F.contains(hay, c), F.lit(False)))


def assembled(raw: DataFrame, chunks: DataFrame, picks: DataFrame) -> DataFrame:
    """Drafts of what a model wrote (source_id, position, chunk_id, name, description, platforms, tools_used, malware_used,
    attributed_actors, command_lines) for known chunks (source_id, chunk_id, text, source_excerpt, sequence_index,
    behavioral_confidence), with the chunk's picks (chunk_id, position, technique_id, technique_name, tactic, stix_id).

    Names that nothing evidences are dropped, phases are the picks' tactics in order, each once, confidence is a whole
    percentage cut off. The draft's id follows from source, chunk and position; its 128 bits keep ids apart at any number of drafts.
    """
    of = picks.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("position", "technique_id", "technique_name", "tactic", "stix_id"))).alias("t"))
    of = of.select("chunk_id", F.transform("t", lambda t: F.struct(t.technique_id.alias("technique_id"), t.technique_name.alias("technique_name"), t.tactic.alias("tactic"), t.stix_id.alias("stix_id"))).alias("techniques"))
    told = raw.join(chunks.select("source_id", "chunk_id", F.col("text").alias("c_text"), F.col("source_excerpt").alias("c_excerpt"), "sequence_index", "behavioral_confidence"), ["source_id", "chunk_id"]).join(of, "chunk_id", "left")
    key = F.substring(F.sha2(F.concat_ws("|", F.col("source_id").cast("string"), "chunk_id", F.col("position").cast("string")), 256), 1, 32)
    texts = (F.col("c_text"), F.col("c_excerpt"), F.array_join(F.coalesce("command_lines", F.array().cast("array<string>")), "\n"), F.col("description"))
    phases = F.array_distinct(F.filter(F.transform("techniques", lambda t: t.tactic), lambda t: F.coalesce(t != "", F.lit(False))))
    actors = F.filter(F.transform("attributed_actors", F.trim), lambda a: a != "")
    return told.select(
        "source_id", F.concat(F.lit("dft-"), key).alias("draft_id"), "chunk_id", "name", "description", "platforms", evidenced(F.col("tools_used"), *texts).alias("tools_used"), evidenced(F.col("malware_used"), *texts).alias("malware_used"),
        actors.alias("attributed_actors"), F.array_distinct(F.filter("command_lines", lambda c: F.contains(F.concat_ws("\n", *texts[:2]), c))).alias("raw_command_lines"), "techniques", F.coalesce(phases, F.array().cast("array<string>")).alias("phases"),
        (F.coalesce("behavioral_confidence", F.lit(0.5)) * 100).cast("int").alias("confidence"), "sequence_index",
    )


def distinct_commands(commands: Column) -> Column:
    """Commands in order, each once by its normal form."""
    return F.aggregate(
        F.coalesce(commands, F.array().cast("array<string>")), F.array().cast("array<string>"),
        lambda kept, c: F.when(F.exists(kept, lambda k: normal_command(k) == normal_command(c)), kept).otherwise(F.concat(kept, F.array(c))),
    )


def edited(drafts: DataFrame, reviews: DataFrame, fields: tuple[str, ...] = ("name", "description", "platforms", "raw_command_lines", "techniques")) -> DataFrame:
    """Drafts with the analyst's edits (draft_id, action, and any of the ``fields``); only these may change, and edited techniques give new phases."""
    given = [c for c in fields if c in reviews.columns]
    told = drafts.join(reviews.select("draft_id", "action", *[F.col(c).alias(f"new_{c}") for c in given]), "draft_id", "left")
    edit = F.col("action") == "edit"
    new = {c: F.when(edit, F.coalesce(f"new_{c}", c)).otherwise(F.col(c)) for c in given}
    out = told.select(*[new[c].alias(c) if c in new else F.col(c) for c in drafts.columns if c != "gate_action"], F.coalesce("action", F.lit("approve")).alias("gate_action"))
    phases = F.array_distinct(F.filter(F.transform("techniques", lambda t: t.tactic), lambda t: F.coalesce(t != "", F.lit(False))))
    return out.withColumn("phases", F.coalesce(phases, F.col("phases")))


def normalised(drafts: DataFrame, approved: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, draft_id, completeness, composite_confidence, fingerprint) of approved drafts (source_id, draft_id).

    ``sources`` (source_id, source_reliability); drafts have first_observed, source_refs and detail_gap besides.
    """
    kept = drafts.join(approved.select("source_id", "draft_id").distinct(), ["source_id", "draft_id"], "left_semi").join(sources, "source_id", "left")
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    complete = completeness(F.col("description"), n("raw_command_lines"), n("techniques"), F.col("first_observed"), n("source_refs"), n("platforms"), F.col("detail_gap"))
    none = F.array().cast("array<string>")
    from loam.functions.entities import technique_refs

    told = kept.withColumn("completeness", complete)
    whole = composite_confidence(F.col("source_reliability"), F.col("completeness"), F.col("confidence"))
    return told.select("source_id", "draft_id", "completeness", whole.alias("composite_confidence"), fingerprint(F.coalesce(technique_refs(F.col("techniques")), none), F.coalesce("platforms", none), F.coalesce("phases", none)).alias("fingerprint"))


def procedures(drafts: DataFrame, identity: Column) -> DataFrame:
    """Objects of drafts as operators.bundle has them: one procedure each, its id made from source and draft."""
    none = F.array().cast("array<string>")
    key = F.sha2(F.concat_ws("|", F.col("source_id").cast("string"), "draft_id"), 256)
    uuid = F.concat_ws("-", *[F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    refs = F.filter(F.transform("techniques", lambda t: t.stix_id), lambda r: F.coalesce(r != "", F.lit(False)))
    lists = F.create_map(F.lit("x_technique_refs"), F.coalesce(refs, none), F.lit("x_source_refs"), F.array(identity))
    return drafts.select("source_id", "draft_id", F.concat(F.lit("x-procedure--"), uuid).alias("id"), F.lit("x-procedure").alias("type"), "name", "description", lists.alias("lists"), F.col("phases").alias("tactics"), "platforms")


def entity_edits(entities: DataFrame, reviews: DataFrame, additions: DataFrame) -> DataFrame:
    """Entities with the analyst's edits, and those the analyst added, approved as such.

    ``reviews`` (entity_id, action, edited_value, edited_type, role): a role goes to organisations or places by the type that
    holds then. ``additions`` (entity_id, value, entity_type). ``entities`` has organization_role and location_role.
    """
    told = entities.join(reviews.select("entity_id", F.col("action").alias("r_action"), F.col("edited_value").alias("r_value"), F.col("edited_type").alias("r_type"), F.col("role").alias("r_role")), "entity_id", "left")
    kind = F.coalesce(F.nullif(F.col("r_type"), F.lit("")), F.nullif(F.col("edited_type"), F.lit("")), F.col("entity_type"))
    role = F.nullif(F.col("r_role"), F.lit(""))
    new = {
        "gate_action": F.coalesce("r_action", "gate_action", F.lit("approve")), "edited_value": F.coalesce(F.nullif(F.col("r_value"), F.lit("")), F.col("edited_value")),
        "edited_type": F.coalesce(F.nullif(F.col("r_type"), F.lit("")), F.col("edited_type")), "organization_role": F.when(kind == "organization", F.coalesce(role, "organization_role")).otherwise(F.col("organization_role")),
        "location_role": F.when(kind == "location", F.coalesce(role, "location_role")).otherwise(F.col("location_role")),
    }
    edits = told.select(*[new[c].alias(c) if c in new else F.col(c) for c in entities.columns], F.lit(False).alias("analyst_added"))
    own = {"entity_id", "value", "entity_type"}
    added = additions.select(*[F.col(c) if c in own else (F.lit("approve") if c == "gate_action" else F.lit(None)).cast(entities.schema[c].dataType).alias(c) for c in entities.columns], F.lit(True).alias("analyst_added"))
    return edits.unionByName(added)


def ordered(sources: DataFrame, reviews: DataFrame) -> DataFrame:
    """Sources (source_id, is_sequential, rationale) with the analyst's word (source_id, is_sequential) on whether they are ordered; null says nothing."""
    said = reviews.where("is_sequential is not null").groupBy("source_id").agg(F.bool_and("is_sequential").alias("said"))
    told = sources.join(said, "source_id", "left")
    note = F.when(F.col("said").isNotNull(), F.lit("set by the analyst"))
    return told.select("source_id", F.coalesce("said", "is_sequential").alias("is_sequential"), F.concat_ws("; ", F.nullif(F.col("rationale"), F.lit("")), note).alias("rationale"))


def rerun_feedback(corrections: DataFrame, chunks: DataFrame, reason: str = "bad_boundary") -> DataFrame:
    """(source_id, chunk_id, text, rationale): rejected chunks with their text, for the next pass."""
    asked = corrections.where((F.col("action") != "approve") & (F.col("reason") == reason)).select("source_id", "chunk_id", "rationale")
    return asked.join(chunks.select("source_id", "chunk_id", "text"), ["source_id", "chunk_id"], "left").select("source_id", "chunk_id", "text", "rationale")


def reviewer_submission(advice: DataFrame, drafts: DataFrame) -> DataFrame:
    """(draft_id, action, confidence, techniques): what a reviewer's advice (draft_id, action, confidence: tier, remove_technique_ids) does unattended.

    Only known fields are taken; the tier becomes a number; removals that would leave a draft without any technique are not done.
    """
    from loam.functions.values import tier_confidence

    told = advice.join(drafts.select("draft_id", "techniques"), "draft_id")
    left = F.filter("techniques", lambda t: ~F.array_contains(F.coalesce("remove_technique_ids", F.array().cast("array<string>")), t.technique_id))
    return told.select("draft_id", "action", tier_confidence(F.col("confidence")).alias("confidence"), F.when(F.size(left) > 0, left).otherwise(F.col("techniques")).alias("techniques"))


def process_objects(commands: DataFrame, files: DataFrame) -> DataFrame:
    """(source_id, command_line, id, image_ref, exe_name): a process per command line, with the file it was started from.

    ``files`` (source_id, name, stix_id). The executable's name is looked up as it stands, and with .exe behind a name without
    a dot; what is not among the files keeps its name as a label.
    """
    from loam.functions.values import executable

    key = F.substring(F.sha2(F.concat_ws("|", F.col("source_id").cast("string"), "command_line"), 256), 1, 12)
    told = commands.select("source_id", "command_line", F.concat(F.lit("process--"), key).alias("id"), executable(F.col("command_line")).alias("exe"))
    known = files.select("source_id", F.lower(F.trim("name")).alias("name"), "stix_id").groupBy("source_id", "name").agg(F.min("stix_id").alias("stix_id"))
    asked = told.withColumn("as_is", F.lower("exe")).withColumn("with_exe", F.when(~F.contains("exe", F.lit(".")), F.concat(F.lower("exe"), F.lit(".exe"))))
    one = asked.join(known.select("source_id", F.col("name").alias("as_is"), F.col("stix_id").alias("first")), ["source_id", "as_is"], "left")
    two = one.join(known.select("source_id", F.col("name").alias("with_exe"), F.col("stix_id").alias("second")), ["source_id", "with_exe"], "left")
    image = F.coalesce("first", "second")
    return two.select("source_id", "command_line", "id", image.alias("image_ref"), F.when(image.isNull(), F.col("exe")).alias("exe_name"))


def indicators(rules: DataFrame, identity: Column) -> DataFrame:
    """Objects of detection rules (source_id, rule_type, rule_content, description): an indicator each, its id made from its content."""
    key = F.substring(F.sha2(F.concat_ws("|", "rule_type", "rule_content"), 256), 1, 12)
    return rules.select("source_id", F.concat(F.lit("indicator--"), key).alias("id"), F.lit("indicator").alias("type"), F.concat_ws(" ", "rule_type", F.lit("rule")).alias("name"), "description", F.col("rule_content").alias("pattern"), F.col("rule_type").alias("pattern_type"), identity.alias("created_by_ref"))


def log_sources(components: DataFrame) -> DataFrame:
    """Objects of data components (name, description, stix_id): a log source each, its id made from its name."""
    key = F.substring(F.sha2(F.col("name"), 256), 1, 12)
    return components.where("name is not null").select(F.concat(F.lit("x-log-source--"), key).alias("id"), F.lit("x-log-source").alias("type"), "name", F.coalesce(F.nullif(F.col("description"), F.lit("")), F.concat(F.lit("Log source: "), F.col("name"))).alias("description"), F.coalesce("stix_id", F.lit("")).alias("x_mitre_data_component_ref"))


def extension_objects(objects: DataFrame) -> DataFrame:
    """(bundle, id, type): the definitions of the extensions whose types a bundle's objects have and that it lacks."""
    from loam.operators.bundle import FLOW_EXTENSION, FLOW_TYPES, PROCEDURE_EXTENSION

    wanted = F.when(F.col("type") == "x-procedure", F.lit(PROCEDURE_EXTENSION)).when(F.col("type").isin(*FLOW_TYPES), F.lit(FLOW_EXTENSION))
    found = objects.select("bundle", wanted.alias("id")).where("id is not null").distinct()
    return found.join(objects.select("bundle", "id"), ["bundle", "id"], "left_anti").select("bundle", "id", F.lit("extension-definition").alias("type"))


def unembedded(rows: DataFrame, embed, column: str = "embedding") -> DataFrame:
    """Rows with the vectors that are missing filled by ``embed`` (a function from the rows that lack one to the same rows with it)."""
    return rows.where(F.col(column).isNotNull()).unionByName(embed(rows.where(F.col(column).isNull())))
