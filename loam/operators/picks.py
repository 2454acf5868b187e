"""Technique picks of chunks: taking them in, resolving, correcting and recalibrating them, and sorting them into lanes.

A pick is a row: chunk_id, position, technique_id, technique_name, tactic, confidence, confidence_bucket, source_quote,
rationale, stix_id, provenance. The catalogue has technique_id, stix_id, name, description, tactics, revoked, deprecated, a
row per technique. Catalogue joins are equi-joins that Spark broadcasts when the catalogue is small and shuffles when not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loam.functions.entities import parent_of, recalibrated
from loam.functions.text import clamp, is_technique_id, jaccard, tokens

PICK = ["chunk_id", "position", "technique_id", "technique_name", "tactic", "confidence", "confidence_bucket", "source_quote", "rationale", "stix_id", "provenance"]
#: By how much, and to what at least, a sub-technique must overlap more to take its parent's place.
PROMOTE_GAP, PROMOTE_LEAST = 0.05, 0.20
BUCKETS = ("definite", "probable", "possible")


def active(catalogue: DataFrame) -> DataFrame:
    return catalogue.where(~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("deprecated", F.lit(False)))


def taken_in(raw: DataFrame, decisions: DataFrame, matches: DataFrame, chunks: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Picks from a model's answers and its decisions on verbatim matches.

    ``raw`` (chunk_id, position, technique_id, technique_name, tactic, confidence, confidence_bucket, source_quote, rationale),
    ``decisions`` (chunk_id, position, technique_id, decision, rejection_reason) and ``matches`` (chunk_id, technique_id,
    matched_substring, source_actor_name). A confirmed match is definite at 0.95, a rejected one possible at 0.3; a decision
    on nothing is left out. Raw picks need a well-formed id that was not decided on; confidence is clamped, an unknown bucket
    is probable. Rows of unknown chunks are left out.
    """
    known = chunks.select("chunk_id").distinct()
    facts = catalogue.select("technique_id", F.col("name").alias("known_name"), F.get("tactics", F.lit(0)).alias("first_tactic"))
    decided = decisions.withColumn("technique_id", F.trim("technique_id")).where(is_technique_id(F.col("technique_id"))).join(matches, ["chunk_id", "technique_id"]).join(known, "chunk_id", "left_semi")
    yes = F.col("decision") == "confirm"
    quote = F.concat(F.lit('"'), F.col("matched_substring"), F.lit('"'))
    reason = F.coalesce(F.nullif(F.trim("rejection_reason"), F.lit("")), F.lit("no reason given"))
    told = F.when(yes, F.concat(F.lit("Matches a known example of "), F.col("source_actor_name"), F.lit(": "), quote)).otherwise(F.concat(F.lit("Match with an example of "), F.col("source_actor_name"), F.lit(" rejected: "), reason, F.lit("; "), quote))
    of_matches = decided.where(F.col("decision").isin("confirm", "reject")).join(facts, "technique_id", "left").select(
        "chunk_id", "position", "technique_id", F.coalesce("known_name", F.lit("")).alias("technique_name"), F.coalesce("first_tactic", F.lit("")).alias("tactic"),
        F.when(yes, 0.95).otherwise(0.3).alias("confidence"), F.when(yes, "definite").otherwise("possible").alias("confidence_bucket"), F.col("matched_substring").alias("source_quote"),
        told.alias("rationale"), F.lit(None).cast("string").alias("stix_id"), F.when(yes, "verbatim_match").otherwise("verbatim_match_rejected").alias("provenance"),
    )
    own = raw.withColumn("technique_id", F.trim("technique_id")).where(is_technique_id(F.col("technique_id"))).join(known, "chunk_id", "left_semi")
    own = own.join(decided.select("chunk_id", "technique_id").distinct(), ["chunk_id", "technique_id"], "left_anti")
    of_model = own.select(
        "chunk_id", "position", "technique_id", F.coalesce("technique_name", F.lit("")).alias("technique_name"), F.coalesce("tactic", F.lit("")).alias("tactic"),
        clamp(F.coalesce("confidence", F.lit(0.5))).alias("confidence"), F.when(F.col("confidence_bucket").isin(*BUCKETS), F.col("confidence_bucket")).otherwise("probable").alias("confidence_bucket"),
        F.trim(F.coalesce("source_quote", F.lit(""))).alias("source_quote"), F.coalesce("rationale", F.lit("")).alias("rationale"), F.lit(None).cast("string").alias("stix_id"), F.lit("llm").alias("provenance"),
    )
    return of_matches.unionByName(of_model)


def unanswered(chunks: DataFrame, picks: DataFrame) -> DataFrame:
    """Chunks that no pick names."""
    return chunks.select("chunk_id").distinct().join(picks.select("chunk_id"), "chunk_id", "left_anti")


def resolved(picks: DataFrame, catalogue: DataFrame, redirects: DataFrame) -> DataFrame:
    """Picks with the catalogue's id and name, ``redirected_from``, ``is_deprecated`` and ``outcome``.

    active: found as it is. redirected: revoked, and ``redirects`` (technique_id, target_id) lead to an active one.
    deprecated: kept with a flag for the reviewer. unresolved: none of them; the pick stays without an id.
    """
    now = active(catalogue).select("technique_id", F.col("stix_id").alias("now_id"), F.col("name").alias("now_name"))
    to = redirects.select("technique_id", "target_id").join(now.select(F.col("technique_id").alias("target_id"), F.col("now_id").alias("to_id"), F.col("now_name").alias("to_name")), "target_id")
    old = catalogue.where(F.coalesce("deprecated", F.lit(False))).select("technique_id", F.col("stix_id").alias("old_id"), F.col("name").alias("old_name"))
    found = picks.join(now, "technique_id", "left").join(to, "technique_id", "left").join(old, "technique_id", "left")
    outcome = F.when(F.col("now_name").isNotNull(), "active").when(F.col("to_name").isNotNull(), "redirected").when(F.col("old_name").isNotNull(), "deprecated").otherwise("unresolved")
    is_ = lambda name: F.col("outcome") == name
    name = F.when(is_("active") & (F.col("now_name") != ""), F.col("now_name")).when(is_("redirected"), F.col("to_name")).when(is_("deprecated"), F.col("old_name")).otherwise(F.col("technique_name"))
    stix = F.when(is_("active"), F.col("now_id")).when(is_("redirected"), F.col("to_id")).when(is_("deprecated"), F.col("old_id")).otherwise(F.col("stix_id"))
    told = found.withColumn("outcome", outcome).withColumn("technique_name", name).withColumn("stix_id", stix)
    told = told.withColumn("redirected_from", F.when(is_("redirected"), F.col("technique_id"))).withColumn("technique_id", F.when(is_("redirected"), F.col("target_id")).otherwise(F.col("technique_id")))
    return told.select(*picks.columns, "redirected_from", is_("deprecated").alias("is_deprecated"), "outcome")


def proposals(ids: DataFrame, catalogue: DataFrame, redirects: DataFrame, hops: int = 10) -> DataFrame:
    """(id, outcome, final_id): what becomes of each proposed id, redirects being followed to an active one.

    kept_active, redirected, dropped_revoked_no_redirect, dropped_deprecated or dropped_hallucinated. A chain that is longer
    than ``hops`` or goes round leads nowhere.
    """
    from loam.operators.records import resolve

    state = F.when(F.coalesce("revoked", F.lit(False)), "revoked").when(F.coalesce("deprecated", F.lit(False)), "deprecated").otherwise("active")
    states = catalogue.select("technique_id", state.alias("state"))
    ends = resolve(ids.select("id").distinct(), redirects.select(F.col("technique_id").alias("from_id"), F.col("target_id").alias("to_id")), hops)
    told = ends.join(states.select(F.col("technique_id").alias("id"), "state"), "id", "left").join(states.select(F.col("technique_id").alias("final_id"), F.col("state").alias("final_state")), "final_id", "left")
    reached = (F.col("hops") > 0) & (F.col("final_state") == "active")
    outcome = (
        F.when(F.col("state").isNull(), "dropped_hallucinated").when(F.col("state") == "active", "kept_active")
        .when(F.col("state") == "deprecated", "dropped_deprecated").when(reached, "redirected").otherwise("dropped_revoked_no_redirect")
    )
    final = F.when(outcome == "kept_active", F.col("id")).when(outcome == "redirected", F.col("final_id"))
    return told.select("id", outcome.alias("outcome"), final.alias("final_id"))


def candidates(retrieved: DataFrame, proposed: DataFrame, hits: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(technique_id, name, n_sources): active techniques that retrieval, kept proposals (final_id) or brand hits name."""
    names = retrieved.select("technique_id", F.lit("retrieved").alias("by"))
    names = names.unionByName(proposed.where("final_id is not null").select(F.col("final_id").alias("technique_id"), F.lit("proposed").alias("by")))
    names = names.unionByName(hits.select("technique_id", F.lit("brand").alias("by")))
    found = names.groupBy("technique_id").agg(F.count_distinct("by").alias("n_sources"))
    return found.join(active(catalogue).select("technique_id", "name"), "technique_id").select("technique_id", "name", "n_sources")


def corrected_tactics(picks: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Techniques of one tactic have that tactic, whatever was picked."""
    one = catalogue.where(F.size("tactics") == 1).select("technique_id", F.element_at("tactics", 1).alias("only"))
    return picks.join(one, "technique_id", "left").withColumn("tactic", F.coalesce("only", "tactic")).select(picks.columns)


def promoted(picks: DataFrame, chunks: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Parents whose sub-technique overlaps the chunk clearly more become that sub-technique.

    A sub-technique takes its place in the order of the catalogue (technique_id): the next one must beat the one taken
    before by PROMOTE_GAP and reach PROMOTE_LEAST. Verbatim picks stay.
    """
    now = active(catalogue)
    # Few sub-techniques have one parent, so a parent's are carried along in one array and walked in order.
    subs = now.where(F.contains("technique_id", F.lit("."))).groupBy(parent_of(F.col("technique_id")).alias("technique_id"))
    subs = subs.agg(F.array_sort(F.collect_list(F.struct(F.col("technique_id").alias("sub"), "name", "stix_id", tokens(F.col("description")).alias("words")))).alias("subs"))
    own = now.select("technique_id", tokens(F.col("description")).alias("own_words"))
    texts = chunks.select("chunk_id", tokens(F.col("text")).alias("text_words"))
    with_words = picks.join(subs, "technique_id", "left").join(own, "technique_id", "left").join(texts, "chunk_id", "left")
    nothing = F.array().cast("array<string>")
    text = F.coalesce("text_words", nothing)
    start = F.struct(jaccard(text, F.coalesce("own_words", nothing)).alias("best"), F.lit(None).cast("string").alias("sub"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("stix_id"))

    def walk(held: Column, s: Column) -> Column:
        overlap = jaccard(text, s.words)
        better = (overlap > held.best + PROMOTE_GAP) & (overlap >= PROMOTE_LEAST)
        return F.when(better, F.struct(overlap.alias("best"), s["sub"].alias("sub"), s["name"].alias("name"), s["stix_id"].alias("stix_id"))).otherwise(held)

    verbatim = F.startswith(F.coalesce("provenance", F.lit("")), F.lit("verbatim_match"))
    found = with_words.withColumn("to", F.when(~verbatim & F.col("subs").isNotNull(), F.aggregate("subs", start, walk)))
    moved = F.col("to.sub").isNotNull()
    pick = lambda c, to: F.when(moved, F.col(f"to.{to}")).otherwise(F.col(c)).alias(c)
    new = {"technique_id": pick("technique_id", "sub"), "technique_name": pick("technique_name", "name"), "stix_id": pick("stix_id", "stix_id")}
    return found.select(*[new.get(c, F.col(c)) for c in picks.columns])


def recalibrated_picks(picks: DataFrame, chunks: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Promoted picks with their confidence after its checks, and ``confidence_raw``; verbatim picks stay as they are."""
    moved = promoted(picks, chunks, catalogue)
    facts = active(catalogue).select("technique_id", F.col("name").alias("known_name"), F.col("description").alias("known_text"))
    told = moved.join(facts, "technique_id", "left").join(chunks.select("chunk_id", F.col("text").alias("chunk_text")), "chunk_id", "left")
    after = recalibrated(F.coalesce("confidence", F.lit(0.5)), F.col("confidence_bucket"), F.col("technique_id"), F.col("known_name"), F.col("known_text"), F.coalesce("chunk_text", F.lit("")), F.coalesce("rationale", F.lit("")))
    verbatim = F.startswith(F.coalesce("provenance", F.lit("")), F.lit("verbatim_match"))
    told = told.withColumn("confidence_raw", F.col("confidence")).withColumn("confidence", F.when(verbatim, F.col("confidence")).otherwise(after))
    return told.select(*picks.columns, "confidence_raw")


def reconciled(picks: DataFrame, hits: DataFrame, listed: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Picks against definitional brand hits (chunk_id, brand, technique_id, strength) and ids that the source lists.

    A pick that a hit expects is tagged, brand or brand+vendor. Where a chunk has another sub-technique of the expected one's
    parent in its place, that pick goes to possible at 0.5 at most, and the expected one is added beside it; where there is
    none it is added alone. A hit on a parent is met by any of its family. Several hits on one technique count once, by the
    first brand.
    """
    firm = hits.where("strength = 'definitional'").groupBy("chunk_id", "technique_id").agg(F.min("brand").alias("brand"))
    firm = firm.join(active(catalogue).select("technique_id", F.col("name").alias("e_name"), F.get("tactics", F.lit(0)).alias("e_tactic"), F.col("stix_id").alias("e_stix")), "technique_id")
    firm = firm.join(listed.select("technique_id", F.lit(True).alias("vendor")).distinct(), "technique_id", "left")
    firm = firm.select("chunk_id", F.col("technique_id").alias("expected"), parent_of(F.col("technique_id")).alias("parent"), "brand", F.when(F.coalesce("vendor", F.lit(False)), "brand+vendor").otherwise("brand").alias("by"), "e_name", "e_tactic", "e_stix")
    family = picks.withColumn("parent", parent_of(F.col("technique_id"))).join(firm, ["chunk_id", "parent"])
    same, of_parent = F.col("technique_id") == F.col("expected"), F.col("expected") == F.col("parent")
    met = family.groupBy("chunk_id", "expected").agg(F.bool_or(same).alias("picked"), F.array_sort(F.collect_set(F.when(~same & (F.col("technique_id") != F.col("parent")), F.col("technique_id")))).alias("others"))
    told = firm.join(met, ["chunk_id", "expected"], "left").withColumn("picked", F.coalesce("picked", F.lit(False))).withColumn("others", F.coalesce("others", F.array().cast("array<string>")))
    stands = F.col("picked") | (of_parent & (F.size("others") > 0))
    tags = told.where("picked").select("chunk_id", F.col("expected").alias("technique_id"), "by")
    whole = told.where(~F.col("picked") & of_parent & (F.size("others") > 0)).select("chunk_id", F.explode("others").alias("technique_id"), "by")
    tags = tags.unionByName(whole).groupBy("chunk_id", "technique_id").agg(F.max("by").alias("curated_provenance"))
    added = told.where(~stands)
    wrong = added.where(~of_parent).select("chunk_id", F.explode("others").alias("technique_id"), "expected").groupBy("chunk_id", "technique_id").agg(F.min("expected").alias("brand_mismatch"))
    kept = picks.join(tags, ["chunk_id", "technique_id"], "left").join(wrong, ["chunk_id", "technique_id"], "left")
    bad = F.col("brand_mismatch").isNotNull()
    kept = kept.withColumn("confidence_bucket", F.when(bad, "possible").otherwise(F.col("confidence_bucket"))).withColumn("confidence", F.when(bad, F.least(F.coalesce("confidence", F.lit(0.5)), F.lit(0.5))).otherwise(F.col("confidence")))
    kept = kept.select(*picks.columns, "curated_provenance", "brand_mismatch")
    last = picks.groupBy("chunk_id").agg(F.max("position").alias("last"))
    place = F.row_number().over(Window.partitionBy("chunk_id").orderBy("expected"))
    why = F.concat(F.lit("The text names "), F.col("brand"), F.lit(", which is "), F.col("expected"), F.when(F.col("by") == "brand+vendor", "; the source lists it too").otherwise(""), F.when(~of_parent & (F.size("others") > 0), F.concat(F.lit("; picked in its place: "), F.array_join("others", ", "))).otherwise(""))
    new = added.join(last, "chunk_id", "left").select(
        "chunk_id", (F.coalesce("last", F.lit(-1)) + place).cast(picks.schema["position"].dataType).alias("position"), F.col("expected").alias("technique_id"), F.col("e_name").alias("technique_name"), F.coalesce("e_tactic", F.lit("unknown")).alias("tactic"),
        F.lit(0.5).alias("confidence"), F.lit("possible").alias("confidence_bucket"), F.lit("").alias("source_quote"), why.alias("rationale"), F.col("e_stix").alias("stix_id"), F.lit("brand_inferred").alias("provenance"),
        F.col("by").alias("curated_provenance"), F.lit(None).cast("string").alias("brand_mismatch"),
    )
    return kept.unionByName(new)


def quote_capped(picks: DataFrame, chunks: DataFrame, least: float = 0.5) -> DataFrame:
    """Picks with ``quote_unsupported``: a quote of four long words or more of which under ``least`` stand in the chunk makes a definite pick probable."""
    from loam.functions.text import support

    told = picks.join(chunks.select("chunk_id", F.col("text").alias("chunk_text")), "chunk_id", "left")
    bad = F.coalesce(support(F.col("source_quote"), tokens(F.col("chunk_text"), 4)) < least, F.lit(False))
    bucket = F.when(bad & (F.col("confidence_bucket") == "definite"), "probable").otherwise(F.col("confidence_bucket"))
    return told.withColumn("quote_unsupported", bad).withColumn("confidence_bucket", bucket).select(*picks.columns, "quote_unsupported")


def demoted(picks: DataFrame, chunks: DataFrame, platforms: DataFrame) -> DataFrame:
    """Picks with ``platform_mismatch``: a technique none of whose platforms (technique_id, platforms) the chunk (chunk_id, platforms) has goes to possible at 0.5.

    A chunk or a technique that names no platform gives no signal and is left alone.
    """
    has = platforms.select("technique_id", F.col("platforms").alias("of_technique"))
    told = picks.join(chunks.select("chunk_id", F.col("platforms").alias("of_chunk")), "chunk_id", "left").join(has, "technique_id", "left")
    clash = F.coalesce((F.size("of_technique") > 0) & (F.size("of_chunk") > 0) & ~F.arrays_overlap("of_technique", "of_chunk"), F.lit(False))
    told = told.withColumn("platform_mismatch", clash).withColumn("confidence", F.when(F.col("platform_mismatch"), F.least("confidence", F.lit(0.5))).otherwise(F.col("confidence")))
    return told.withColumn("confidence_bucket", F.when(F.col("platform_mismatch"), "possible").otherwise(F.col("confidence_bucket"))).select(*picks.columns, "platform_mismatch")


def expanded(chosen: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(technique_id): the chosen ids, the parents of sub-techniques among them, and all sub-techniques of what is chosen then."""
    selected = chosen.select("technique_id").union(chosen.select(parent_of(F.col("technique_id")).alias("technique_id"))).distinct()
    subs = catalogue.select("technique_id").where(F.contains("technique_id", F.lit(".")))
    found = subs.join(selected.select(F.col("technique_id").alias("chosen_parent")), parent_of(F.col("technique_id")) == F.col("chosen_parent"), "left_semi")
    return selected.union(found).distinct()


def in_play(**sources: DataFrame) -> DataFrame:
    """(technique_id, n_sources): ids that any of some tables with a technique_id names, and how many do."""
    from functools import reduce

    each = [df.select("technique_id", F.lit(name).alias("by")) for name, df in sources.items()]
    return reduce(DataFrame.unionByName, each).where("technique_id <> ''").groupBy("technique_id").agg(F.count_distinct("by").cast("int").alias("n_sources"))


def verbatim_strings(examples: DataFrame, most: int = 3, least: int = 8) -> DataFrame:
    """(string, techniques): strings (technique_id, string) that at most ``most`` techniques share; longer lists say nothing."""
    each = examples.select(F.lower(F.trim("string")).alias("string"), "technique_id").where(F.length("string") >= least)
    return each.groupBy("string").agg(F.array_sort(F.collect_set("technique_id")).alias("techniques")).where(F.size("techniques") <= most)


def best_of_chunk(picks: DataFrame) -> DataFrame:
    """One pick per chunk and technique: the better bucket, then the higher confidence, then the earlier place; a missing confidence before one told, then the larger row."""
    from loam.operators.records import best_wins

    rank = F.array_position(F.array(*map(F.lit, ("possible", "probable", "definite"))), F.coalesce("confidence_bucket", F.lit("probable")))
    return best_wins(picks, ["chunk_id", "technique_id"], [rank, F.coalesce("confidence", F.lit(0.5))], "position", "first_position", (F.col("confidence").isNull(),)).select(picks.columns)


def lanes(picks: DataFrame) -> DataFrame:
    """Picks with their lane: bundle for definite and probable ones, review for possible ones; a missing bucket is probable."""
    return picks.withColumn("lane", F.when(F.coalesce("confidence_bucket", F.lit("probable")) == "possible", "review").otherwise("bundle"))


def denied(picks: DataFrame, denylist: DataFrame) -> DataFrame:
    """Picks (with lane) that the denylist (technique_id, pattern_id) names are flagged and go to review; the first pattern is told."""
    first = denylist.groupBy("technique_id").agg(F.min("pattern_id").alias("denied_by"))
    told = picks.join(first, "technique_id", "left")
    return told.withColumn("lane", F.when(F.col("denied_by").isNotNull(), "review").otherwise(F.col("lane"))).select(*picks.columns, "denied_by")


def denylist_terms(patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of promoted patterns (pattern_id, status, values, entity_types, technique_ids): values with their scope, and ids.

    A value that any pattern denies for all types has a null scope, else the union of the types; ids have the first pattern.
    """
    on = patterns.where("status = 'promoted'")
    values = on.select("entity_types", F.explode("values").alias("v")).select("entity_types", F.lower(F.trim("v")).alias("value")).where("value <> ''")
    free = F.bool_or(F.coalesce(F.size("entity_types"), F.lit(0)) <= 0)
    scopes = values.groupBy("value").agg(free.alias("free"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("entity_types", F.array().cast("array<string>")))))).alias("all"))
    ids = on.select("pattern_id", F.explode("technique_ids").alias("technique_id")).groupBy("technique_id").agg(F.min("pattern_id").alias("pattern_id"))
    return scopes.select("value", F.when(~F.col("free"), F.col("all")).alias("scope")), ids


def moved_up(picks: DataFrame, promotions: DataFrame, least: float = 0.7) -> DataFrame:
    """Review picks (with lane) that a reviewer promotes (chunk_id, technique_id) go to the bundle lane as probable at 0.7 or more.

    A technique that the chunk's bundle lane already has is not doubled: the review pick stays where it is.
    """
    asked = promotions.select("chunk_id", "technique_id", F.lit(True).alias("asked")).distinct()
    there = picks.where("lane = 'bundle'").select("chunk_id", "technique_id", F.lit(True).alias("there")).distinct()
    told = picks.join(asked, ["chunk_id", "technique_id"], "left").join(there, ["chunk_id", "technique_id"], "left")
    moves = F.coalesce("asked", F.lit(False)) & ~F.coalesce("there", F.lit(False)) & (F.col("lane") == "review")
    told = told.withColumn("moved", moves).withColumn("lane", F.when(moves, "bundle").otherwise(F.col("lane")))
    told = told.withColumn("confidence_bucket", F.when(F.col("moved") & (F.col("confidence_bucket") == "possible"), "probable").otherwise(F.col("confidence_bucket")))
    return told.withColumn("confidence", F.when(F.col("moved"), F.greatest(F.coalesce("confidence", F.lit(0.5)), F.lit(least))).otherwise(F.col("confidence"))).select(*picks.columns, "moved")


def best_orphans(picks: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, technique_id): for chunks without a bundle pick the best review pick, by confidence, then place, then the larger id."""
    bare = chunks.select("chunk_id").distinct().join(picks.where("lane = 'bundle'").select("chunk_id"), "chunk_id", "left_anti")
    order = F.struct(F.coalesce("confidence", F.lit(0.5)), -F.col("position"), "technique_id")
    return picks.where("lane = 'review'").join(bare, "chunk_id", "left_semi").groupBy("chunk_id").agg(F.max_by("technique_id", order).alias("technique_id"))


def overridden(drafts: DataFrame, chunks: DataFrame, overrides: DataFrame) -> DataFrame:
    """Drafts (draft_id, chunk_id, techniques: array of structs with tactic, ...) whose chunk's text was overridden before get those techniques.

    ``overrides`` has text_hash (of the trimmed, lower-cased text) and techniques; ``phases`` are rebuilt from what stands then.
    """
    from loam.functions.text import short_hash

    keyed = drafts.join(chunks.select("chunk_id", short_hash(F.col("text")).alias("text_hash")), "chunk_id", "left")
    told = keyed.join(overrides.select("text_hash", F.col("techniques").alias("given")), "text_hash", "left")
    told = told.withColumn("was_overridden", F.col("given").isNotNull()).withColumn("techniques", F.coalesce("given", "techniques"))
    phases = F.array_distinct(F.filter(F.transform("techniques", lambda t: t.tactic), lambda t: F.coalesce(t != "", F.lit(False))))
    return told.withColumn("phases", phases).select(*[c for c in drafts.columns if c != "phases"], "phases", "was_overridden")
