"""Chunks of a source, one behaviour each: their sections, features, overlaps, order, chains, conditions and analyst decisions.

A chunk is a row: source_id, chunk_id, sequence_index, text, source_excerpt, predecessor_indices and precedes_ids (arrays),
chain_root, chain_label, tactics, malware, tools (arrays), target, artifacts (map of lists), precondition (struct of description,
pattern, pattern_type, on_true_ids, on_false_ids). Operators read the columns they name. Joins stay within a source by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loam.functions.text import STOP_WORDS, jaccard, overlap_tokens, tokens
from loam.operators.graph import counted_starts, section_ranges, splice
from loam.sources.shared import saved

#: Words in capitals that name no entity.
CAPS_EXCLUDE = ("HTTP", "HTTPS", "EPMM", "SUID", "MYSQL", "BASE64", "WITH", "FROM", "JAVA", "LINUX", "GETS", "THAT")
#: Overlap of words that suffices alone, that which suffices with shared entities, how many those are; chunks from which on frequent entities are left out.
OVERLAP_HIGH, OVERLAP_LOW, OVERLAP_ENTITIES, MANY_CHUNKS = 0.40, 0.05, 2, 6
#: Fixed value: the order of tactics; those up to the third come before a compromise.
TACTIC_ORDER = (
    "reconnaissance", "resource-development", "initial-access", "execution", "persistence", "privilege-escalation", "defense-evasion", "credential-access",
    "discovery", "lateral-movement", "collection", "command-and-control", "exfiltration", "impact",
)
PRE_COMPROMISE = 2


# --- sections -------------------------------------------------------------------------------------------------------


def line_sections(texts: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc, first, last, kind, text): the lines of each text (doc, text) in its ranges (doc, first, last, kind), made disjoint and cut to the text.

    The lines are cut out of the one text by position, so no line is ever a row; sections without a word are left out.
    """
    lines = texts.select("doc", F.split("text", "\n").alias("lines")).withColumn("n", F.size("lines"))
    fitted = ranges.join(lines.select("doc", "n"), "doc").where((F.greatest("first", "last") >= 1) & (F.least("first", "last") <= F.col("n")))
    fitted = fitted.select("doc", F.greatest(F.least("first", "last"), F.lit(1)).alias("first"), F.least(F.greatest("first", "last"), F.col("n")).alias("last"), "kind")
    cut = section_ranges(fitted).join(lines, "doc")
    text = F.array_join(F.slice("lines", F.col("first").cast("int"), (F.col("last") - F.col("first") + 1).cast("int")), "\n")
    return cut.select("doc", "first", "last", "kind", text.alias("text")).where(F.rlike("text", F.lit(r"\S")))


def sections_text(sections: DataFrame, kept: Column, order: str, separator: str = "\n\n") -> DataFrame:
    """(doc, text): each document's sections that are ``kept``, in order; a document's sections are few and short beside it."""
    told = sections.where(kept).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), "text"))).alias("s"))
    return told.select("doc", F.array_join(F.transform("s", lambda s: s.text), separator).alias("text"))


def text_without(texts: DataFrame, sections: DataFrame, left_out: list[str]) -> DataFrame:
    """(doc, text): the sections but those of some kinds, or the whole text if that leaves nothing."""
    kept = sections_text(sections, ~F.col("kind").isin(left_out), "first")
    return texts.join(kept.withColumnRenamed("text", "kept"), "doc", "left").select("doc", F.coalesce(F.nullif(F.col("kept"), F.lit("")), F.col("text")).alias("text"))


def grounding_words(texts: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc, words): distinct words of four letters or more that advice on a document may quote: of its sections but reference lists and detection logic."""
    return text_without(texts, sections, ["technique_reference", "detection_logic"]).select("doc", tokens(F.col("text"), 4).alias("words"))


# --- features and overlaps ------------------------------------------------------------------------------------------


def entity_features(text: Column, malware: Column, tools: Column, target: Column) -> Column:
    """Distinct lower-cased names in a chunk: malware, tools, target, identifiers, slashed paths and words in capitals; never the actor."""
    none = F.array().cast("array<string>")
    own = F.concat(F.coalesce(malware, none), F.coalesce(tools, none), F.when(F.coalesce(target, F.lit("")) != "", F.array(target)).otherwise(none))
    found = lambda p: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({p})"), F.lit(1))
    cves, paths = found(r"(?i:CVE)-\d{4}-\d{4,}"), F.transform(found(r"/[a-zA-Z0-9_./-]{4,}"), lambda p: F.regexp_replace(p, r"[.,;:]+$", ""))
    caps = F.array_except(found(r"\b[A-Z][A-Z0-9]{3,}\b"), F.array(*map(F.lit, CAPS_EXCLUDE)))
    return F.array_distinct(F.transform(F.concat(own, cves, paths, caps), F.lower))


def frequent(features: DataFrame) -> DataFrame:
    """(source_id, entity): names in over half of a source's chunks (source_id, chunk_id, entities), if it has MANY_CHUNKS or more."""
    sizes = features.groupBy("source_id").agg(F.count("*").alias("n")).where(F.col("n") >= MANY_CHUNKS)
    counts = features.select("source_id", F.explode(F.array_distinct("entities")).alias("entity")).groupBy("source_id", "entity").agg(F.count("*").alias("held"))
    return counts.join(sizes, "source_id").where("held > n / 2").select("source_id", "entity")


def overlaps(chunks: DataFrame) -> DataFrame:
    """(source_id, chunk_id, other, score, shared_tokens, shared_entities, detection) for every pair of a source that overlaps, both ways round.

    lexical: words overlap by OVERLAP_HIGH. entity: by OVERLAP_LOW, with OVERLAP_ENTITIES shared names that are not
    frequent; the score is then lifted by their number. Pairs meet over shared rare words or shared names: two sets of that
    overlap share one of their first words, rarest first, so no source's chunks are all paired.
    """
    told = chunks.select("source_id", "chunk_id", overlap_tokens(F.col("text"), list(STOP_WORDS)).alias("words"), entity_features(F.col("text"), F.col("malware"), F.col("tools"), F.col("target")).alias("entities"))
    common = frequent(told).groupBy("source_id").agg(F.collect_set("entity").alias("common"))  # fewer than twice a chunk's names
    told = saved(told.join(common, "source_id", "left").withColumn("entities", F.array_except("entities", F.coalesce("common", F.array().cast("array<string>")))).drop("common"), "chunk-features")
    each = told.select("source_id", "chunk_id", F.explode("words").alias("word"))
    counts = each.groupBy("source_id", "word").agg(F.count("*").alias("n"))
    ranked = each.join(counts, ["source_id", "word"]).groupBy("source_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("r"))
    first = F.slice("r", F.lit(1), F.size("r") - F.ceil(F.size("r") * F.lit(OVERLAP_HIGH)).cast("int") + 1)
    by_word = ranked.select("source_id", "chunk_id", F.explode(F.transform(first, lambda x: F.concat(F.lit("w:"), x.word))).alias("key"))
    by_name = told.select("source_id", "chunk_id", F.explode(F.transform("entities", lambda e: F.concat(F.lit("e:"), e))).alias("key"))
    keys = by_word.unionByName(by_name)
    pairs = keys.join(keys.withColumnRenamed("chunk_id", "other"), ["source_id", "key"]).where("chunk_id < other").select("source_id", "chunk_id", "other").distinct()
    other = told.select("source_id", F.col("chunk_id").alias("other"), F.col("words").alias("words2"), F.col("entities").alias("entities2"))
    both = pairs.join(told, ["source_id", "chunk_id"]).join(other, ["source_id", "other"])
    shared = F.array_intersect("entities", "entities2")
    both = both.withColumn("j", jaccard(F.col("words"), F.col("words2"))).withColumn("names", shared)
    kind = F.when(F.col("j") >= OVERLAP_HIGH, "lexical").when((F.col("j") >= OVERLAP_LOW) & (F.size("names") >= OVERLAP_ENTITIES), "entity")
    boost = F.least(F.lit(0.70), 0.30 + F.size("names") * 0.10)
    score = F.when(F.col("detection") == "entity", F.greatest("j", boost)).otherwise(F.col("j"))
    found = both.withColumn("detection", kind).where("detection is not null").select(
        "source_id", "chunk_id", "other", F.round(score, 3).alias("score"), F.slice(F.array_sort(F.array_intersect("words", "words2")), 1, 20).alias("shared_tokens"),
        F.slice(F.array_sort("names"), 1, 10).alias("shared_entities"), "detection",
    )
    return found.unionByName(found.select("source_id", F.col("other").alias("chunk_id"), F.col("chunk_id").alias("other"), "score", "shared_tokens", "shared_entities", "detection"))


# --- order ----------------------------------------------------------------------------------------------------------


def primary_tactic(tactics: Column) -> Column:
    return F.lower(F.trim(F.get(tactics, F.lit(0))))


def tactic_rank(name: Column) -> Column:
    """A tactic's place in the order, from 0; null for any other name."""
    return F.nullif(F.array_position(F.array(*map(F.lit, TACTIC_ORDER)), F.lower(F.trim(name))), F.lit(0)) - 1


def successors(chunks: DataFrame) -> DataFrame:
    """(source_id, src, dst): chunk ids by predecessor_indices, each pair once; indices of no chunk are left out.

    Of several chunks with one index the last id stands for it.
    """
    ids = chunks.groupBy("source_id", "sequence_index").agg(F.max("chunk_id").alias("src"))
    back = chunks.select("source_id", F.col("chunk_id").alias("dst"), F.explode("predecessor_indices").alias("sequence_index"))
    return back.join(ids, ["source_id", "sequence_index"]).select("source_id", "src", "dst").distinct()


def resynced(chunks: DataFrame) -> DataFrame:
    """Chunks with predecessor_indices rebuilt from precedes_ids: sorted, each once, ids of no chunk left out."""
    index = chunks.schema["sequence_index"].dataType
    edges = chunks.where("sequence_index is not null").select("source_id", F.col("sequence_index").alias("before"), F.explode("precedes_ids").alias("chunk_id"))
    back = edges.groupBy("source_id", "chunk_id").agg(F.array_sort(F.collect_set("before")).alias("back"))
    told = chunks.join(back, ["source_id", "chunk_id"], "left").withColumn("predecessor_indices", F.coalesce("back", F.array().cast(f"array<{index.simpleString()}>")))
    return told.select(chunks.columns)


def next_index(chunks: DataFrame) -> DataFrame:
    """(source_id, next): the index after a source's last."""
    return chunks.groupBy("source_id").agg((F.max(F.coalesce("sequence_index", F.lit(0))) + 1).alias("next"))


def order_warnings(chunks: DataFrame) -> DataFrame:
    """(source_id, src, dst, src_tactic, dst_tactic) of edges that lead from a later tactic to one before a compromise."""
    of = chunks.select("source_id", "chunk_id", primary_tactic(F.col("tactics")).alias("tactic")).withColumn("rank", tactic_rank(F.col("tactic")))
    src, dst = (of.select("source_id", F.col("chunk_id").alias(e), F.col("tactic").alias(f"{e}_tactic"), F.col("rank").alias(f"{e}_rank")) for e in ("src", "dst"))
    edges = successors(chunks).join(dst.where(F.col("dst_rank") <= PRE_COMPROMISE), ["source_id", "dst"]).join(src, ["source_id", "src"])
    return edges.where("src_rank > dst_rank").select("source_id", "src", "dst", "src_tactic", "dst_tactic")


def chain_labels(chunks: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """(source_id, chunk_id, chain_label, n_roots): labels of the chains' roots handed down to what they alone reach.

    A root without a label is ``chain``. A chunk that two roots or more reach is shared: it keeps its own label, and no label
    goes past it. A chunk with a label keeps it. n_roots counts all roots that reach a chunk, itself included: counted_starts() finds them
    over many sources at once. ``skipped`` (source_id, src, dst by id) are edges that do not count.
    """
    chunks = saved(chunks.select("source_id", "chunk_id", "sequence_index", "predecessor_indices", "chain_root", "chain_label"), "chain-chunks")
    edges = successors(chunks)
    if skipped is not None:
        edges = edges.join(skipped, ["source_id", "src", "dst"], "left_anti")
    root = F.coalesce("chain_root", F.lit(False))
    own = F.when(F.coalesce("chain_label", F.lit("")) != "", F.col("chain_label")).when(root, "chain")
    labels = chunks.select("source_id", "chunk_id", own.alias("own"), root.alias("root"))
    source = F.col("source_id").alias("group")
    found = counted_starts(edges.select(source, "src", "dst"), labels.where("root").select(source, F.col("chunk_id").alias("node"), F.col("own").alias("value")))
    reach = found.select(F.col("group").alias("source_id"), F.col("node").alias("chunk_id"), F.col("n").alias("n_roots"), F.col("value").alias("label"))
    told = labels.join(reach, ["source_id", "chunk_id"], "left")
    return told.select("source_id", "chunk_id", F.coalesce("own", "label", F.lit("")).alias("chain_label"), F.coalesce("n_roots", F.lit(0).cast("long")).alias("n_roots"))


def shape(chunks: DataFrame) -> DataFrame:
    """A row per source: chunks, edges, roots (no way in), declared roots, roots that are not declared, and steps back in the tactics' order."""
    edges = successors(chunks)
    n = lambda df, name: df.groupBy("source_id").agg(F.count("*").alias(name))
    rootless = chunks.select("source_id", "chunk_id", F.coalesce("chain_root", F.lit(False)).alias("root")).join(edges.select("source_id", F.col("dst").alias("chunk_id")), ["source_id", "chunk_id"], "left_anti")
    parts = [n(edges, "n_edges"), n(rootless, "n_roots"), n(chunks.where("chain_root"), "n_declared"), n(rootless.where("not root"), "n_undeclared"), n(order_warnings(chunks), "n_warnings")]
    out = n(chunks, "n_chunks")
    for part in parts:
        out = out.join(part, "source_id", "left")
    return out.na.fill(0)


# --- operators and conditions ---------------------------------------------------------------------------------------


def conditions(chunks: DataFrame, sequential: DataFrame) -> DataFrame:
    """(source_id, anchor, description, pattern, pattern_type, on_true_ids, on_false_ids): preconditions that say something.

    Branches keep only ids that the chunk leads to; a condition without a description or without any branch is none; sources
    that ``sequential`` (source_id, is_sequential) marks as unordered have none.
    """
    own = lambda ids: F.array_intersect(F.coalesce(ids, F.array().cast("array<string>")), F.coalesce("precedes_ids", F.array().cast("array<string>")))
    told = chunks.where("precondition is not null").select(
        "source_id", F.col("chunk_id").alias("anchor"), F.trim(F.coalesce("precondition.description", F.lit(""))).alias("description"), "precondition.pattern", "precondition.pattern_type",
        own(F.col("precondition.on_true_ids")).alias("on_true_ids"), own(F.col("precondition.on_false_ids")).alias("on_false_ids"),
    )
    unordered = sequential.where("not is_sequential").select("source_id")
    return told.where((F.col("description") != "") & (F.size("on_true_ids") + F.size("on_false_ids") > 0)).join(unordered, "source_id", "left_anti")


def led_to(edges: DataFrame, at: str = "src", to: str = "dst") -> DataFrame:
    """(source_id, ``at``, ways): the other ends of a chunk's edges, sorted, each once, loops left out. Edges are shuffled as they are, not as arrays of one."""
    other = F.when(F.col(at) != F.col(to), F.col(to))
    return edges.select("source_id", at, to).repartition("source_id", at).groupBy("source_id", at).agg(F.array_sort(F.collect_set(other)).alias("ways"))


def operators(edges: DataFrame) -> DataFrame:
    """(source_id, anchor, role, kind, inputs, outputs): converge (AND) where several edges end, branch (OR) where several begin."""
    into = led_to(edges, "dst", "src").select("source_id", F.col("dst").alias("anchor"), F.col("ways").alias("inputs"), F.size("ways").alias("n"))
    out = led_to(edges).select("source_id", F.col("src").alias("anchor"), F.col("ways").alias("outputs"), F.size("ways").alias("n"))
    joins = into.where("n >= 2").select("source_id", "anchor", F.lit("converge").alias("role"), F.lit("AND").alias("kind"), "inputs", F.array("anchor").alias("outputs"))
    return joins.unionByName(out.where("n >= 2").select("source_id", "anchor", F.lit("branch").alias("role"), F.lit("OR").alias("kind"), F.array("anchor").alias("inputs"), "outputs"))


def operator_objects(found: DataFrame, procedures: DataFrame) -> DataFrame:
    """Operators with an id made from what they join, and effect_refs: the outputs that are procedures (source_id, chunk_id, stix_id).

    An operator without one is left out, and a branch with fewer than two.
    """
    from loam.functions.keys import joint_id

    told = found.withColumn("id", joint_id("attack-operator--", F.col("role"), F.col("inputs"), F.col("outputs")))
    own = ["source_id", "id", "anchor", "role", "kind"]
    each = told.select(*own, F.posexplode("outputs").alias("place", "chunk_id")).join(procedures.select("source_id", "chunk_id", "stix_id"), ["source_id", "chunk_id"])
    refs = each.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("place", "stix_id"))).alias("r"))
    return refs.select(*own, F.transform("r", lambda r: r.stix_id).alias("effect_refs")).where((F.size("effect_refs") >= 2) | (F.col("role") == "converge"))


def condition_objects(found: DataFrame, procedures: DataFrame) -> DataFrame:
    """Conditions with an id and the branches' procedures; a condition without any is left out."""
    p = procedures.select("source_id", F.col("chunk_id").alias("to"), "stix_id")
    own = ["source_id", "anchor", "description", "pattern", "pattern_type"]
    ends = lambda c: F.transform(c, lambda to, place: F.struct(F.lit(c).alias("side"), place.alias("place"), to.alias("to")))
    each = found.select(*own, F.explode(F.concat(ends("on_true_ids"), ends("on_false_ids"))).alias("e")).select(*own, "e.*").join(p, ["source_id", "to"])
    told = each.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("side", "place", "stix_id"))).alias("r"))
    refs = lambda c: F.transform(F.filter("r", lambda r: r.side == c), lambda r: r.stix_id).alias(c.replace("_ids", "_refs"))
    told = told.select(*own, refs("on_true_ids"), refs("on_false_ids"))
    key = F.substring(F.sha2(F.concat_ws("|", "source_id", "anchor", "description"), 256), 1, 12)
    return told.select("source_id", F.concat(F.lit("attack-condition--"), key).alias("id"), "anchor", "description", "pattern", "pattern_type", "on_true_refs", "on_false_refs")


def routed(edges: DataFrame, procedures: DataFrame, joints: DataFrame, conds: DataFrame) -> DataFrame:
    """(source_id, source_ref, target_ref): what precedes what among procedures, operators and conditions, each once.

    Chunks without a procedure are bridged. An edge leaves through its chunk's condition, else its branch, else the procedure
    itself, and arrives through the other chunk's converge, if it has one. What is known of one end is joined before what is known of the other.
    """
    node = lambda c: F.struct("source_id", F.col(c).alias("chunk_id"))
    p = procedures.select("source_id", "chunk_id", "stix_id")
    spliced = splice(edges.select(node("src").alias("src"), node("dst").alias("dst")), p.select(F.struct("source_id", "chunk_id").alias("node")))
    e = spliced.select("src.source_id", F.col("src.chunk_id").alias("src"), F.col("dst.chunk_id").alias("dst"))
    at = lambda df, c, name: df.select("source_id", F.col("anchor").alias(c), F.col("id").alias(name))
    of = lambda c, name: p.select("source_id", F.col("chunk_id").alias(c), F.col("stix_id").alias(name))
    e = e.join(of("src", "from_id"), ["source_id", "src"]).join(at(joints.where("role = 'branch'"), "src", "branch"), ["source_id", "src"], "left").join(at(conds, "src", "cond"), ["source_id", "src"], "left")
    e = e.select("source_id", "dst", "from_id", F.coalesce("cond", "branch").alias("leave"))
    e = e.join(of("dst", "to_id"), ["source_id", "dst"]).join(at(joints.where("role = 'converge'"), "dst", "converge"), ["source_id", "dst"], "left")
    leave = F.col("leave")
    pairs = F.array(
        F.when(leave.isNotNull(), F.struct(F.col("from_id").alias("source_ref"), leave.alias("target_ref"))),
        F.struct(F.coalesce("leave", "from_id").alias("source_ref"), F.coalesce("converge", "to_id").alias("target_ref")),
        F.when(F.col("converge").isNotNull(), F.struct(F.col("converge").alias("source_ref"), F.col("to_id").alias("target_ref"))),
    )
    return e.select("source_id", F.explode(F.filter(pairs, lambda x: x.isNotNull())).alias("p")).select("source_id", "p.source_ref", "p.target_ref").distinct()


def without_removed_edges(edges: DataFrame, joints: DataFrame, removed: DataFrame, procedures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and operators without what the analyst removed by procedure names (source_id, source_name, target_name).

    Names lead to chunks over procedures (source_id, chunk_id, name), letter case aside. Only branches lose outputs.
    """
    fold = lambda c: F.lower(F.trim(c))
    of = lambda c, k: procedures.select("source_id", fold("name").alias(f"{c}_name"), F.col("chunk_id").alias(k)).where(F.col(f"{c}_name") != "")
    asked = removed.select("source_id", fold("source_name").alias("source_name"), fold("target_name").alias("target_name"))
    pairs = asked.join(of("source", "src"), ["source_id", "source_name"]).join(of("target", "dst"), ["source_id", "target_name"]).select("source_id", "src", "dst").distinct()
    lost = pairs.groupBy("source_id", F.col("src").alias("anchor")).agg(F.collect_set("dst").alias("lost"))
    kept = joints.join(lost, ["source_id", "anchor"], "left")
    outputs = F.when((F.col("role") == "branch") & F.col("lost").isNotNull(), F.array_except("outputs", "lost")).otherwise(F.col("outputs"))
    return edges.join(pairs, ["source_id", "src", "dst"], "left_anti"), kept.withColumn("outputs", outputs).select(joints.columns)


# --- analyst decisions ----------------------------------------------------------------------------------------------


def decided(chunks: DataFrame, decisions: DataFrame, additions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks after the analyst's decisions, and the records of what was not simply approved.

    ``decisions`` (source_id, chunk_id, action, text, source_excerpt, merge_with: ids, rationale): approve, edit, drop (or
    remove) and merge; who is not mentioned is approved. A merge joins the texts of the survivor and of those it absorbs in
    the order of their index, unless a text is given, takes the first excerpt there is, and drops the absorbed; one without
    any known partner approves. Edges into a dropped chunk lead on to what it led to, over any number of dropped ones.
    ``additions`` (source_id, chunk_id, text, source_excerpt) follow behind the last index.
    """
    none = F.array().cast("array<string>")
    by_id = chunks.select("source_id", "chunk_id", "sequence_index", F.trim(F.coalesce("text", F.lit(""))).alias("part"), F.trim(F.coalesce("source_excerpt", F.lit(""))).alias("piece"))
    merges = decisions.where("action = 'merge'").join(chunks.select("source_id", "chunk_id"), ["source_id", "chunk_id"], "left_semi")
    absorbs = merges.select("source_id", F.col("chunk_id").alias("survivor"), F.explode(F.array_distinct("merge_with")).alias("chunk_id")).where("chunk_id <> survivor").join(by_id.select("source_id", "chunk_id"), ["source_id", "chunk_id"], "left_semi")
    absorbs = saved(absorbs, "absorbed-chunks")
    survivors = absorbs.select("source_id", "survivor").distinct()
    members = absorbs.unionByName(survivors.withColumn("chunk_id", F.col("survivor"))).join(by_id, ["source_id", "chunk_id"])
    ordered = members.groupBy("source_id", "survivor").agg(F.array_sort(F.collect_list(F.struct("sequence_index", "chunk_id", "part", "piece"))).alias("m"))
    merged = ordered.select(
        "source_id", F.col("survivor").alias("chunk_id"), F.array_join(F.filter(F.transform("m", lambda m: m.part), lambda t: t != ""), " ").alias("m_text"),
        F.coalesce(F.get(F.filter(F.transform("m", lambda m: m.piece), lambda t: t != ""), F.lit(0)), F.lit("")).alias("m_excerpt"),
    )
    gone = absorbs.select("source_id", "chunk_id", F.lit(True).alias("absorbed")).distinct()
    told = chunks.join(decisions.select("source_id", "chunk_id", "action", F.col("text").alias("d_text"), F.col("source_excerpt").alias("d_excerpt"), "rationale"), ["source_id", "chunk_id"], "left")
    told = told.join(merged, ["source_id", "chunk_id"], "left").join(gone, ["source_id", "chunk_id"], "left")
    action = (
        F.when(F.col("absorbed") | F.col("action").isin("drop", "remove"), "remove").when((F.col("action") == "edit") | F.col("m_text").isNotNull(), "edit").otherwise("approve")
    )
    told = told.withColumn("action", action)
    edits = F.col("action") == "edit"
    records = told.where("action <> 'approve'").select("source_id", "chunk_id", "action", F.substring(F.coalesce("text", F.lit("")), 1, 300).alias("original_text"), "rationale")
    told = told.withColumn("text", F.when(edits, F.coalesce("d_text", "m_text", "text")).otherwise(F.col("text"))).withColumn("source_excerpt", F.when(edits, F.coalesce("d_excerpt", "m_excerpt", "source_excerpt")).otherwise(F.col("source_excerpt")))
    kept = saved(told.where("action <> 'remove'").select(chunks.columns), "decided-chunks")
    node = lambda c: F.struct("source_id", F.col(c).alias("chunk_id"))
    edges = chunks.select("source_id", "chunk_id", F.explode("precedes_ids").alias("to"))
    spliced = splice(edges.select(node("chunk_id").alias("src"), node("to").alias("dst")), kept.select(F.struct("source_id", "chunk_id").alias("node")))
    ways = spliced.groupBy("src.source_id", "src.chunk_id").agg(F.array_sort(F.collect_set("dst.chunk_id")).alias("ways"))
    kept = kept.join(ways, ["source_id", "chunk_id"], "left").withColumn("precedes_ids", F.coalesce("ways", none)).select(chunks.columns)
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("chunk_id"))
    new = additions.join(next_index(chunks), "source_id", "left").withColumn("sequence_index", (F.coalesce("next", F.lit(1)) + place - 1).cast(chunks.schema["sequence_index"].dataType))
    rest = {"precedes_ids": none, "chain_root": F.lit(False)}
    new = new.select(*[F.col(c) if c in ("source_id", "chunk_id", "text", "source_excerpt", "sequence_index") else rest.get(c, F.lit(None)).cast(chunks.schema[c].dataType).alias(c) for c in chunks.columns])
    return resynced(kept.unionByName(new)), records


def mirrored(chunks: DataFrame, drafts: DataFrame) -> DataFrame:
    """Chunks with the order of their approved drafts (source_id, chunk_id, sequence_index, predecessor_indices, chain_root, chain_label).

    Predecessors are cleaned (known, not the chunk itself) and turned into precedes_ids.
    """
    given = drafts.select("source_id", "chunk_id", *[F.col(c).alias(f"d_{c}") for c in ("sequence_index", "predecessor_indices", "chain_root", "chain_label")])
    told = chunks.join(given, ["source_id", "chunk_id"], "left")
    for c in ("sequence_index", "predecessor_indices", "chain_root", "chain_label"):
        told = told.withColumn(c, F.coalesce(F.col(f"d_{c}").cast(chunks.schema[c].dataType), F.col(c)))
    told = told.withColumn("predecessor_indices", F.array_distinct(F.filter("predecessor_indices", lambda i: i != F.col("sequence_index")))).select(chunks.columns)
    ways = successors(told).groupBy("source_id", F.col("src").alias("chunk_id")).agg(F.array_sort(F.collect_set("dst")).alias("ways"))
    return resynced(told.join(ways, ["source_id", "chunk_id"], "left").withColumn("precedes_ids", F.coalesce("ways", F.array().cast("array<string>"))).select(chunks.columns))


def occurrences(chunks: DataFrame, texts: DataFrame) -> DataFrame:
    """(source_id, chunk_id, start, end): where a chunk's excerpt stands in its source's text, from 0, the end left out.

    The k-th chunk with one excerpt, by index, takes its k-th occurrence (occurrences may overlap); null if there is none.
    """
    k = F.row_number().over(Window.partitionBy("source_id", "source_excerpt").orderBy("sequence_index", "chunk_id"))
    told = chunks.where("source_excerpt <> ''").select("source_id", "chunk_id", "source_excerpt", k.alias("k")).join(texts.select("source_id", F.col("text").alias("whole")), "source_id")
    at = F.aggregate(F.sequence(F.lit(1), F.col("k")), F.lit(0), lambda at, _: F.when(at < 0, at).otherwise(F.call_function("locate", F.col("source_excerpt"), F.col("whole"), at + 1)).cast("int"), lambda at: at)
    found = told.withColumn("at", F.when(at > 0, at - 1))
    return found.select("source_id", "chunk_id", F.col("at").alias("start"), (F.col("at") + F.length("source_excerpt")).alias("end"))
