"""What analysts decided, kept as rules and examples: comparing advice with decisions, scoring rules that were shown, ranking them.

Patterns (rules) are rows: pattern_id, category, pattern, status, occurrence_count, hit_count, miss_count, salience, embedding,
technique_ids, entity_types, tactics (arrays), last_seen_at. Corrections are rows: source_id, area, position and the columns an
operator names. Gates of a source are rows: source_id, gate_key, enabled, mode.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from loam.functions.scores import rate, salience
from loam.functions.text import cosine, jaccard, tokens
from loam.operators.brands import anchors

#: The area that a rule's category belongs to, and the gate where an area is reviewed.
AREA_OF = {
    "defender_ioc": "entities", "brand_as_malware": "entities", "false_positive_entity": "entities", "mis_attribution": "entities", "over_chunked": "chunks",
    "under_chunked": "chunks", "missing_procedure": "chunks", "wrong_predecessor": "chunks", "parallel_capability_misordered": "chunks", "artifact_loss": "chunks",
    "missing_tactic": "techniques", "wrong_technique": "techniques", "thin_initial_access": "techniques", "orphan_ioc": "techniques", "wrong_relationship": "relationships",
}
GATE_OF = {"entities": "entities", "chunks": "chunks", "techniques": "procedures", "relationships": "bundle"}
GATE_ORDER, TIERS = ("entities", "chunks", "procedures", "bundle"), ("high", "medium", "low")
#: Cosine that matches, word overlap that a merge needs besides, weights of the hybrid score, and how many rules are looked at and told.
MATCH, LEXICAL, SALIENCE_WEIGHT, CEILING, TOLD, PINNED, MOST_AGE_DAYS = 0.55, 0.20, 0.15, 80, 15, 25, 90
KEYWORD, TECHNIQUE, ENTITY_TYPE, TACTIC = 0.3, 0.5, 0.2, 0.2
EXAMPLE_CEILING, EXAMPLES_TOLD, MOST_OVERRIDES = 120, 6, 25
#: Terms of a kind that a denylist looks at, and the longest value.
MOST_TERMS, LONGEST_TERM = 200, 256
#: The longest rationale and context that an example keeps.
MOST_RATIONALE, MOST_CONTEXT = 400, 300


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def attended(gates: DataFrame) -> DataFrame:
    """(source_id, gate_key) of gates where a person decided: enabled and not left to the reviewer alone."""
    return gates.where(F.coalesce("enabled", F.lit(True)) & (F.coalesce("mode", F.lit("review")) != "auto")).select("source_id", "gate_key").distinct()


# --- advice and decisions -------------------------------------------------------------------------------------------


def advice_outcomes(advice: DataFrame, decisions: DataFrame, rejected: DataFrame | None = None) -> DataFrame:
    """(source_id, gate_key, kind, ref, recommended, actual, agreed, moot) for every piece of advice.

    ``advice`` (source_id, gate_key, kind, ref, recommended): kinds entity, chunk, draft and relationship are met by the
    action on the same ref, and silence is approval; addition, edge, promotion and technique by a row with the same ref, else
    not_added, not_applied, left_in_review and kept; rerun by a rejection. ``decisions`` (source_id, gate_key, kind, ref,
    action). A rejection (source_id, gate_key) makes all other advice at its gate moot: neither agreed nor overridden.
    """
    spark_types = ["source_id", "gate_key", "kind", "ref"]
    said = decisions.groupBy(*spark_types).agg(F.max("action").alias("action"))
    told = advice.join(said, spark_types, "left")
    if rejected is not None:
        told = told.join(rejected.select("source_id", "gate_key", F.lit(True).alias("rejected")).distinct(), ["source_id", "gate_key"], "left")
    else:
        told = told.withColumn("rejected", F.lit(False))
    gone = F.coalesce("rejected", F.lit(False))
    absent = _lookup({"addition": "not_added", "edge": "not_applied", "promotion": "left_in_review", "technique": "kept"}, F.col("kind"))
    done = _lookup({"addition": "add", "promotion": "promote", "technique": "remove"}, F.col("kind"))
    actual = F.when(F.col("kind") == "rerun", F.when(gone, "rerun").otherwise("kept_this_pass")).when(gone, "moot_rerun")
    actual = actual.when(absent.isNull(), F.coalesce("action", F.lit("approve"))).when(F.col("action").isNull(), absent).otherwise(F.coalesce(done, F.col("action")))
    told = told.withColumn("actual", actual).withColumn("moot", gone & (F.col("kind") != "rerun"))
    return told.select(*spark_types, "recommended", "actual", (~F.col("moot") & F.coalesce(F.col("recommended") == F.col("actual"), F.lit(False))).alias("agreed"), "moot")


def _counted(items: DataFrame, by: list[str]) -> DataFrame:
    found = items.groupBy(*by).agg(F.count_if("agreed").alias("agreed"), F.count("*").alias("total"))
    return found.withColumn("rate", rate(F.col("agreed"), F.col("total")))


def agreement(turns: DataFrame) -> dict[str, DataFrame]:
    """What the reviewer's advice was worth, by gate.

    ``turns`` (source_id, gate_key, status, auto, created_at, items: array of structs with kind, ref, recommended, actual,
    confidence, agreed, moot, quote_unsupported; null items are no outcome). The opening read counts nowhere, failed turns only as
    failures; unattended ones and those without outcome not at all. Tables: gates (gate_key, reviews, sources, agreed, total,
    rate, unsupported_quotes, failures, place), tiers (all three for every gate), kinds, and the newest overrides.
    """
    real = turns.where("gate_key <> 'initial_read'")
    failures = real.where("status = 'failed'").groupBy("gate_key").agg(F.count("*").alias("failures"))
    counted = real.where("status <> 'failed'").where(~F.coalesce("auto", F.lit(False)) & F.col("items").isNotNull())
    reviews = counted.groupBy("gate_key").agg(F.count("*").alias("reviews"), F.count_distinct("source_id").alias("sources"))
    items = counted.select("source_id", "gate_key", "created_at", F.posexplode("items").alias("place", "i")).select("source_id", "gate_key", "created_at", "place", "i.*").where(~F.coalesce("moot", F.lit(False)))
    items = items.withColumn("agreed", F.coalesce("agreed", F.lit(False))).withColumn("kind", F.coalesce("kind", F.lit("unknown")))
    quotes = items.groupBy("gate_key").agg(F.count_if(F.coalesce("quote_unsupported", F.lit(False))).alias("unsupported_quotes"))
    keys = real.select("gate_key").distinct()
    gates = keys.join(reviews, "gate_key", "left").join(_counted(items, ["gate_key"]), "gate_key", "left").join(quotes, "gate_key", "left").join(failures, "gate_key", "left")
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, GATE_ORDER)), F.col("gate_key")), F.lit(0)) - 1, F.lit(len(GATE_ORDER)))
    gates = gates.na.fill(0, ["reviews", "sources", "agreed", "total", "unsupported_quotes", "failures"]).withColumn("place", place)
    tiers = keys.withColumn("confidence", F.explode(F.array(*map(F.lit, TIERS)))).join(_counted(items, ["gate_key", "confidence"]), ["gate_key", "confidence"], "left").na.fill(0, ["agreed", "total"])
    newest = F.row_number().over(Window.partitionBy("gate_key").orderBy(F.desc("created_at"), "source_id", "place"))
    overrides = items.where("not agreed").withColumn("n", newest).where(F.col("n") <= MOST_OVERRIDES).drop("n")
    return {"gates": gates, "tiers": tiers, "kinds": _counted(items, ["gate_key", "kind"]), "overrides": overrides}


def override_feedback(outcomes: DataFrame) -> DataFrame:
    """(source_id, gate_key, text): for the reviewer's next pass, a line for each piece of advice that was neither followed nor moot."""
    line = F.concat_ws(" ", F.concat("kind", F.lit(":")), "ref", F.lit("advised"), "recommended", F.lit("but"), "actual")
    told = outcomes.where("not agreed and not moot").groupBy("source_id", "gate_key").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return told.select("source_id", "gate_key", F.array_join("lines", "\n").alias("text"))


def passes(turns: DataFrame) -> DataFrame:
    """Turns (source_id, gate_key, created_at, turn_id) with pass_number, from 1 per source and gate."""
    n = F.row_number().over(Window.partitionBy("source_id", "gate_key").orderBy("created_at", "turn_id"))
    return turns.withColumn("pass_number", n)


def with_outcomes(turns: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes (source_id, gate_key, outcome) attached to the newest turn of theirs that did not fail."""
    latest = turns.where("status <> 'failed'").groupBy("source_id", "gate_key").agg(F.max_by("turn_id", F.struct("created_at", "turn_id")).alias("turn_id"))
    new = outcomes.join(latest, ["source_id", "gate_key"]).select("turn_id", F.col("outcome").alias("new_outcome"))
    return turns.join(new, "turn_id", "left").withColumn("outcome", F.coalesce("new_outcome", "outcome")).select(turns.columns)


def grounded_advice(advice: DataFrame, quote: str, known: DataFrame, least: float = 0.5) -> DataFrame:
    """Advice (source_id, confidence, a quote) whose quote the source's words (source_id, words) do not support is of low confidence."""
    from loam.functions.text import support

    told = advice.join(known, "source_id", "left")
    bad = F.coalesce(support(F.col(quote), F.coalesce("words", F.array().cast("array<string>"))) < least, F.lit(False))
    return told.withColumn("quote_unsupported", bad).withColumn("confidence", F.when(bad, "low").otherwise(F.col("confidence"))).select(*advice.columns, "quote_unsupported")


def known_types(advice: DataFrame, types: list[str]) -> DataFrame:
    """Advice (kind, entity_type) that names no unknown type; only an addition must name one."""
    kind = F.nullif(F.col("entity_type"), F.lit(""))
    return advice.where(F.when(kind.isNull(), F.col("kind") != "addition").otherwise(kind.isin(types)))


# --- corrections ----------------------------------------------------------------------------------------------------


def deltas(ledger: DataFrame, latest: DataFrame) -> DataFrame:
    """Decisions that were no plain approval, by source and area; the ledger of all passes counts where it has any, else the latest pass.

    Both have source_id, area, position, action and further equal columns.
    """
    from_ledger = ledger.where(F.coalesce(F.col("action") != "approve", F.lit(True)))
    held = from_ledger.select("source_id", "area").distinct()
    return from_ledger.unionByName(latest.where(F.coalesce(F.col("action") != "approve", F.lit(True))).join(held, ["source_id", "area"], "left_anti"))


def appended(ledger: DataFrame, entries: DataFrame, key: list[str]) -> DataFrame:
    """A ledger that only grows: entries that it has already (by ``key``) are not taken again."""
    return ledger.unionByName(entries.dropDuplicates(key).join(ledger.select(key), key, "left_anti"))


def reviewed(channels: DataFrame) -> DataFrame:
    """(source_id, was_reviewed): whether any channel (source_id, n) of a source holds a decision."""
    return channels.groupBy("source_id").agg((F.sum(F.coalesce("n", F.lit(0))) > 0).alias("was_reviewed"))


def digest_text(rows: DataFrame, line: Column) -> DataFrame:
    """(source_id, text): a source's corrections as text, a heading per area and a line per correction, in order."""
    told = rows.withColumn("line", line).groupBy("source_id", "area").agg(F.array_sort(F.collect_list(F.struct("position", "line"))).alias("l"))
    block = F.concat(F.upper("area"), F.lit("\n"), F.array_join(F.transform("l", lambda x: F.concat(F.lit("- "), x.line)), "\n"))
    each = told.select("source_id", F.struct("area", block.alias("block")).alias("b")).groupBy("source_id").agg(F.array_sort(F.collect_list("b")).alias("b"))
    return each.select("source_id", F.array_join(F.transform("b", lambda x: x.block), "\n\n").alias("text"))


def digest(*parts: Column) -> Column:
    """The first 24 characters of the sha256 of the parts, folded and joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.lower(F.trim(F.coalesce(p, F.lit("")))) for p in parts]), 256), 1, 24)


def examples(entities: DataFrame, chunks: DataFrame, techniques: DataFrame, gates: DataFrame) -> DataFrame:
    """(source_id, dedup_key, position, area, action, before, after, rationale, technique_ids, entity_types): corrections as examples, each once a source.

    ``entities`` (source_id, position, action, value, entity_type, edited_value, edited_type, rationale), ``chunks`` (source_id,
    position, kind: analyst_added, wholesale_reject or null, action, original_text, new_text, rationale) and ``techniques``
    (source_id, position, kind: promotion or null, technique_id, technique_name, name, change: removed or added, rationale), a
    row per technique. Only gates that a person attended give examples; rows without the value that matters give none.
    """
    none, text = F.array().cast("array<string>"), lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    value, kind = F.trim(F.coalesce("value", F.lit(""))), F.trim(F.coalesce("entity_type", F.lit("")))
    act = F.coalesce("action", F.lit("remove"))
    edited = F.when(F.col("edited_value").isNotNull() | F.col("edited_type").isNotNull(), F.concat_ws(" ", F.coalesce("edited_value", value), F.coalesce("edited_type", kind))).otherwise("")
    of_entities = entities.where(value != "").select(
        "source_id", "position", F.lit("entities").alias("area"), act.alias("action"), F.concat_ws(" ", value, kind).alias("before"), edited.alias("after"), text(F.col("rationale"), MOST_RATIONALE).alias("rationale"),
        F.concat_ws("|", F.lit("entities"), act, digest(kind, value)).alias("dedup_key"), none.alias("technique_ids"), F.when(kind != "", F.array(kind)).otherwise(none).alias("entity_types"),
    )
    what = F.when(F.col("kind") == "wholesale_reject", "reject").when(F.col("kind") == "analyst_added", "add").otherwise(F.coalesce("action", F.lit("")))
    old, new = text(F.col("original_text"), MOST_CONTEXT), text(F.col("new_text"), MOST_CONTEXT)
    said = text(F.col("rationale"), MOST_RATIONALE)
    key = F.when(F.col("kind") == "wholesale_reject", digest(said)).when(F.col("kind") == "analyst_added", digest(new)).otherwise(digest(old))
    holds = F.when(F.col("kind") == "wholesale_reject", said != "").when(F.col("kind") == "analyst_added", new != "").otherwise((old != "") & (what != ""))
    of_chunks = chunks.where(holds).select(
        "source_id", "position", F.lit("chunks").alias("area"), what.alias("action"), F.when(what.isin("reject", "add"), "").otherwise(old).alias("before"), new.alias("after"), said.alias("rationale"),
        F.concat_ws("|", F.lit("chunks"), what, key).alias("dedup_key"), none.alias("technique_ids"), none.alias("entity_types"),
    )
    tid, name = F.coalesce("technique_id", F.lit("")), F.trim(F.coalesce("name", F.lit("")))
    change = F.when(F.col("kind") == "promotion", "promote").when(F.col("change") == "removed", "remove").otherwise("add")
    of_techniques = techniques.where(tid != "").select(
        "source_id", "position", F.lit("techniques").alias("area"), change.alias("action"), F.when(change == "add", name).otherwise(F.concat_ws(" ", tid, F.coalesce("technique_name", F.lit("")))).alias("before"),
        F.when(change == "remove", "").otherwise(tid).alias("after"), said.alias("rationale"), F.concat_ws("|", F.lit("techniques"), change, F.when(change == "promote", digest(tid)).otherwise(digest(tid, name))).alias("dedup_key"),
        F.array(tid).alias("technique_ids"), none.alias("entity_types"),
    )
    rows = of_entities.unionByName(of_chunks).unionByName(of_techniques)
    seen = attended(gates).select("source_id", F.col("gate_key").alias("gate"))
    rows = rows.withColumn("gate", _lookup(GATE_OF, F.col("area"))).join(seen, ["source_id", "gate"], "left_semi").drop("gate")
    whole = F.struct("area", "action", "before", "after", "rationale", "technique_ids", "entity_types")
    first = rows.groupBy("source_id", "dedup_key").agg(F.min_by(whole, F.struct("position", whole)).alias("e"), F.min("position").alias("position"))
    return first.select("source_id", "dedup_key", "position", "e.*")


def upserted_examples(old: DataFrame, new: DataFrame) -> DataFrame:
    """(dedup_key, occurrence_count, rationale, sources): counts added up, the first rationale that says something kept.

    ``old`` (dedup_key, occurrence_count, rationale, sources: array) and ``new`` (dedup_key, rationale, source_id, position).
    """
    before = old.select("dedup_key", "occurrence_count", F.nullif(F.col("rationale"), F.lit("")).alias("rationale"), F.col("sources").cast("array<string>").alias("sources"), F.lit(-1).cast("long").alias("position"))
    now = new.select("dedup_key", F.lit(1).cast("long").alias("occurrence_count"), F.nullif(F.col("rationale"), F.lit("")).alias("rationale"), F.array(F.col("source_id").cast("string")).alias("sources"), F.col("position").cast("long").alias("position"))
    said = F.min_by("rationale", F.when(F.col("rationale").isNotNull(), F.col("position")))
    found = before.unionByName(now).groupBy("dedup_key").agg(F.sum("occurrence_count").alias("occurrence_count"), F.coalesce(said, F.lit("")).alias("rationale"), F.flatten(F.collect_list("sources")).alias("sources"))
    return found.withColumn("sources", F.array_sort(F.array_distinct("sources")))


# --- scoring what was shown -----------------------------------------------------------------------------------------


def recorrected(shown: DataFrame, patterns: DataFrame, corrections: DataFrame) -> DataFrame:
    """(source_id, pattern_id) of shown rules that a correction of their area in the same source contradicts.

    ``corrections`` (source_id, area, removed_technique_ids, embedding). It does by a removed technique that the rule names,
    or by a cosine of MATCH or more. A rule of no known area looks at all areas.
    """
    known = patterns.select("pattern_id", _lookup(AREA_OF, F.col("category")).alias("area"), "technique_ids", F.col("embedding").alias("rule"))
    asked = shown.select("source_id", "pattern_id").distinct().join(known, "pattern_id")
    said = corrections.select("source_id", F.col("area").alias("in_area"), "removed_technique_ids", F.col("embedding").alias("vec"))
    both = asked.join(said, "source_id").where(F.col("area").isNull() | (F.col("area") == F.col("in_area")))
    none = F.array().cast("array<string>")
    same = F.arrays_overlap(F.coalesce("technique_ids", none), F.coalesce("removed_technique_ids", none))
    return both.where(F.coalesce(same, F.lit(False)) | (cosine(F.col("rule"), F.col("vec")) >= MATCH)).select("source_id", "pattern_id").distinct()


def surfacing_outcomes(surfacings: DataFrame, patterns: DataFrame, gates: DataFrame, corrections: DataFrame, attributed: DataFrame | None = None) -> DataFrame:
    """(source_id, pattern_id, outcome, n): hit, miss or unscored for each rule shown to a source and not scored yet.

    Only a gate that a person attended can tell: everything else is unscored. ``attributed`` (source_id, pattern_id), if
    given, says which rules a correction was laid to; else recorrected() does.
    """
    open_ = surfacings.where("outcome is null").groupBy("source_id", "pattern_id").agg(F.count("*").alias("n"))
    known = patterns.select("pattern_id", _lookup(GATE_OF, _lookup(AREA_OF, F.col("category"))).alias("gate_key"))
    told = open_.join(known, "pattern_id", "left").join(attended(gates).withColumn("seen", F.lit(True)), ["source_id", "gate_key"], "left")
    missed = (attributed if attributed is not None else recorrected(open_, patterns, corrections)).select("source_id", "pattern_id", F.lit(True).alias("missed")).distinct()
    told = told.join(missed, ["source_id", "pattern_id"], "left")
    outcome = F.when(~F.coalesce("seen", F.lit(False)), "unscored").when(F.coalesce("missed", F.lit(False)), "miss").otherwise("hit")
    return told.select("source_id", "pattern_id", outcome.alias("outcome"), "n")


def scored_patterns(patterns: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Patterns with their hits and misses counted up, once per source, and salience anew where anything was counted."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    counted = outcomes.groupBy("pattern_id").agg(n("hit").alias("h"), n("miss").alias("m"))
    told = patterns.join(counted, "pattern_id", "left").na.fill(0, ["h", "m"])
    told = told.withColumn("hit_count", F.coalesce("hit_count", F.lit(0)) + F.col("h")).withColumn("miss_count", F.coalesce("miss_count", F.lit(0)) + F.col("m"))
    new = salience(F.col("hit_count"), F.col("miss_count"), F.coalesce("occurrence_count", F.lit(1)), F.col("last_seen_at"), now)
    return told.withColumn("salience", F.when(F.col("h") + F.col("m") > 0, new).otherwise(F.col("salience"))).select(patterns.columns)


# --- taking rules in and choosing them ------------------------------------------------------------------------------


def upserted_patterns(old: DataFrame, new: DataFrame, scan: int = 300) -> DataFrame:
    """(new_id, pattern_id, how): for each new rule the known one it repeats, or itself.

    exact: same category and text. similar: of the ``scan`` rules of its category that occurred most the one with the best
    cosine (first by id among equals), if that is MATCH or more and their words overlap by LEXICAL. new: neither. ``old``
    (pattern_id, category, pattern, occurrence_count, embedding), ``new`` (new_id, category, pattern, embedding). New rules
    are judged against what was known before; equal ones among them go to the smallest new_id. A category's ``scan`` rules
    bound what a new rule is compared with.
    """
    text = ["category", "pattern"]
    exact = new.join(old.groupBy(*text).agg(F.min("pattern_id").alias("pattern_id")), text).select("new_id", "pattern_id")
    rest = new.join(exact.select("new_id"), "new_id", "left_anti")
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("occurrence_count"), "pattern_id"))
    scanned = old.where("embedding is not null").withColumn("place", place).where(F.col("place") <= scan).select("category", "pattern_id", F.col("pattern").alias("known"), F.col("embedding").alias("vec"))
    close = rest.where("embedding is not null").join(scanned, "category").withColumn("sim", cosine(F.col("embedding"), F.col("vec"))).where("sim > 0")
    best = close.groupBy("new_id", "pattern").agg(F.min_by(F.struct("pattern_id", "known", "sim"), F.struct(-F.col("sim"), F.col("pattern_id"))).alias("b"))
    fits = (F.col("b.sim") >= MATCH) & (jaccard(tokens(F.col("pattern")), tokens(F.col("b.known"))) >= LEXICAL)
    similar = best.where(fits).select("new_id", "b.pattern_id")
    own = rest.join(similar.select("new_id"), "new_id", "left_anti")
    firsts = own.withColumn("first", F.min("new_id").over(Window.partitionBy(*text))).select("new_id", F.col("first").alias("pattern_id"))
    tell = lambda df, how: df.select("new_id", F.col("pattern_id").cast("string").alias("pattern_id"), F.lit(how).alias("how"))
    return tell(exact, "exact").unionByName(tell(similar, "similar")).unionByName(tell(firsts, "new"))


def merged_terms(a: Column, b: Column) -> Column:
    """Terms of both in order, each once."""
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(a, none), F.coalesce(b, none))


def hybrid_score(vector: Column, embedding: Column, keywords: Column, own_keywords: Column, shared: dict[str, tuple[Column, Column, float]], weight: Column) -> Column:
    """Cosine, and a lift for shared keywords and each kind of shared terms, and the weighted salience; missing parts give nothing."""
    overlap = lambda a, b: F.coalesce(F.arrays_overlap(a, b), F.lit(False))
    score = cosine(vector, embedding) + F.when(overlap(keywords, own_keywords), KEYWORD).otherwise(0.0)
    for a, b, worth in shared.values():
        score = score + F.when(overlap(a, b), worth).otherwise(0.0)
    return score + weight


def fetched(patterns: DataFrame, categories: list[str], statuses: list[str], now: Column | None, limit: int | None, least: int = 1) -> DataFrame:
    """Patterns of some categories and statuses that occurred often enough and, with ``now``, not too long ago, the most frequent first."""
    kept = patterns.where(F.col("category").isin(categories) & F.col("status").isin(statuses) & (F.coalesce("occurrence_count", F.lit(0)) >= least))
    if now is not None:
        kept = kept.where(F.col("last_seen_at") >= now - F.make_dt_interval(F.lit(MOST_AGE_DAYS)))
    if limit is None:
        return kept
    return kept.orderBy(F.desc("occurrence_count"), F.desc("last_seen_at"), "pattern_id").limit(limit)


def ranked_patterns(sources: DataFrame, patterns: DataFrame, categories: list[str], tools: list[str], now: Column, told: int = TOLD) -> DataFrame:
    """(source_id, pattern_id, score, rank, pinned) of the rules to tell each source.

    ``sources`` (source_id, vector, keywords, technique_ids, entity_types, tactics). The CEILING most frequent rules that are
    not too old compete, whatever the number of rules; pinned ones are told besides, PINNED at most, without a score.
    """
    pool = fetched(patterns, categories, ["active", "promoted_to_denylist"], now, CEILING)
    words = F.concat_ws(" ", "pattern", F.array_join(F.coalesce("technique_ids", F.array().cast("array<string>")), " "), F.array_join(F.coalesce("tactics", F.array().cast("array<string>")), " "))
    own = pool.select("pattern_id", "embedding", "occurrence_count", "last_seen_at", "salience", anchors(words, tools).alias("p_keywords"), *[F.col(c).alias(f"p_{c}") for c in ("technique_ids", "entity_types", "tactics")])
    both = sources.join(F.broadcast(own))  # at most CEILING rules, every source against each
    shared = {c: (F.col(c), F.col(f"p_{c}"), worth) for c, worth in (("technique_ids", TECHNIQUE), ("entity_types", ENTITY_TYPE), ("tactics", TACTIC))}
    score = hybrid_score(F.col("vector"), F.col("embedding"), F.col("keywords"), F.col("p_keywords"), shared, SALIENCE_WEIGHT * F.coalesce("salience", F.lit(0.0)))
    scored = both.withColumn("score", score)
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("score"), F.desc("occurrence_count"), F.desc("last_seen_at"), "pattern_id"))
    top = scored.withColumn("rank", rank).where(F.col("rank") <= told).select("source_id", "pattern_id", "score", "rank", F.lit(False).alias("pinned"))
    always = fetched(patterns, categories, ["promoted_to_prompt"], None, PINNED).select("pattern_id", F.lit(None).cast("double").alias("score"), F.lit(0).alias("rank"), F.lit(True).alias("pinned"))
    return top.unionByName(sources.select("source_id").join(F.broadcast(always)).select("source_id", "pattern_id", "score", "rank", "pinned"))


def ranked_examples(sources: DataFrame, found: DataFrame, areas: list[str], tools: list[str], told: int = EXAMPLES_TOLD) -> DataFrame:
    """(source_id, example_id, score, rank): the examples to tell each source, of the EXAMPLE_CEILING newest active ones of some areas."""
    pool = found.where(F.col("area").isin(areas) & (F.col("status") == "active")).orderBy(F.desc("last_seen_at"), "example_id").limit(EXAMPLE_CEILING)
    own = pool.select("example_id", "embedding", "occurrence_count", "last_seen_at", anchors(F.concat_ws(" ", "before", "after", "rationale"), tools).alias("p_keywords"), *[F.col(c).alias(f"p_{c}") for c in ("technique_ids", "entity_types")])
    both = sources.join(F.broadcast(own))  # at most EXAMPLE_CEILING examples, every source against each
    shared = {c: (F.col(c), F.col(f"p_{c}"), worth) for c, worth in (("technique_ids", TECHNIQUE), ("entity_types", ENTITY_TYPE))}
    scored = both.withColumn("score", hybrid_score(F.col("vector"), F.col("embedding"), F.col("keywords"), F.col("p_keywords"), shared, F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("score"), F.desc("occurrence_count"), F.desc("last_seen_at"), "example_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= told).select("source_id", "example_id", "score", "rank")


def told_rules(rows: DataFrame) -> DataFrame:
    """(source_id, text): rules (source_id, category, pattern, pinned, rank) as text, permanent ones first, then by category."""
    block = rows.groupBy("source_id", "pinned", F.when(F.col("pinned"), "").otherwise(F.col("category")).alias("category")).agg(F.array_sort(F.collect_list(F.struct("rank", "pattern"))).alias("l"))
    head = F.when(F.col("pinned"), "PERMANENT RULES").otherwise(F.upper("category"))
    text = F.concat(head, F.lit("\n"), F.array_join(F.transform("l", lambda x: F.concat(F.lit("- "), x.pattern)), "\n"))
    each = block.select("source_id", F.struct((~F.col("pinned")).alias("later"), "category", text.alias("text")).alias("b")).groupBy("source_id").agg(F.array_sort(F.collect_list("b")).alias("b"))
    return each.select("source_id", F.array_join(F.transform("b", lambda x: x.text), "\n\n").alias("text"))


def denylist_terms(values: Column, technique_ids: Column, entity_types: Column) -> Column:
    """Terms that a denylist enforces, as a struct of three arrays in order, each term once: values trimmed, without control signs and of 256 signs at most
    (letter case aside; the first spelling stays), ids of techniques in capitals, types in small letters. At most MOST_TERMS of each are looked at."""
    some = lambda c: F.filter(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, MOST_TERMS), lambda x: x.isNotNull())
    first = lambda c, key: F.filter(c, lambda x, k: F.array_position(F.transform(c, key), key(x)) == k + 1)
    clean = F.filter(F.transform(some(values), lambda x: F.trim(x)), lambda x: (x != "") & (F.length(x) <= LONGEST_TERM) & ~F.rlike(x, F.lit(r"[\x00-\x1F\x7F]")))
    ids = F.array_distinct(F.filter(F.transform(some(technique_ids), lambda x: F.upper(F.trim(x))), lambda x: F.rlike(x, F.lit(r"^T\d{4}(\.\d{3})?$"))))
    types = F.array_distinct(F.filter(F.transform(some(entity_types), lambda x: F.lower(F.trim(x))), lambda x: (x != "") & (F.length(x) <= 64) & ~F.rlike(x, F.lit(r"[\x00-\x1F\x7F]"))))
    return F.struct(first(clean, lambda x: F.lower(x)).alias("values"), ids.alias("technique_ids"), types.alias("entity_types"))


def updated_patterns(patterns: DataFrame, changes: DataFrame) -> DataFrame:
    """Patterns after changes (pattern_id, at, action, by, text, category, terms: struct of values, technique_ids, entity_types), each kind apart and by time.

    promote_to_prompt, promote_to_denylist, dismiss and archive set the status, the last of them counts; a dismissal leaves what the last promotion wrote:
    promoted_at, promoted_by, promoted_action and denylist_terms. A promotion to the denylist takes its terms and names them, in 255 signs
    at most; one to the prompt clears terms and names the category that the pattern had then. An edit sets the text and the category where it has
    one, the last of each counts. Changes of one time go by action, then by who made them. Patterns without changes keep what they have; changes of unknown
    patterns and with unknown actions do nothing.
    """
    promotions, kinds = ("promote_to_prompt", "promote_to_denylist"), {"promote_to_prompt": "promoted_to_prompt", "promote_to_denylist": "promoted_to_denylist", "dismiss": "dismissed", "archive": "archived"}
    when = F.struct("at", "action", "by", "text", "category")
    known = changes.join(patterns.select("pattern_id", F.col("category").alias("own")).dropDuplicates(["pattern_id"]), "pattern_id")
    edits = F.when(F.col("action") == "edit", F.col("category"))
    then = F.coalesce(F.last(edits, ignorenulls=True).over(Window.partitionBy("pattern_id").orderBy("at", "action", "by", "text", "category")), "own")
    terms = denylist_terms(F.col("terms.values"), F.col("terms.technique_ids"), F.col("terms.entity_types"))
    none = denylist_terms(F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"))
    listed = F.col("action") == "promote_to_denylist"
    told = known.withColumn("then", then).withColumn("clean", F.when(listed, terms).otherwise(none))
    enforced = F.concat(F.col("clean.values"), F.col("clean.technique_ids"))
    note = F.when(~listed, F.concat(F.lit("prompt:"), F.col("then"))).when(F.size(enforced) == 0, "denylist:(no enforceable terms — advisory only)").otherwise(F.substring(F.concat(F.lit("denylist:"), F.array_join(enforced, ", ")), 1, 255))
    promoted = F.struct(F.col("at").alias("promoted_at"), F.col("by").alias("promoted_by"), note.alias("promoted_action"), F.col("clean").alias("denylist_terms"))
    last = lambda value, test: F.max_by(value, F.when(test, when)).alias
    is_edit = F.col("action") == "edit"
    one = told.groupBy("pattern_id").agg(
        last(_lookup(kinds, F.col("action")), F.col("action").isin(*kinds))("new_status"), last(promoted, F.col("action").isin(*promotions))("promotion"),
        last(F.col("text"), is_edit & F.col("text").isNotNull())("new_text"), last(F.col("category"), is_edit & F.col("category").isNotNull())("new_category"),
    )
    out = patterns.join(one, "pattern_id", "left")
    new = {"status": F.coalesce("new_status", "status"), "pattern": F.coalesce("new_text", "pattern"), "category": F.coalesce("new_category", "category")}
    written = ("promoted_at", "promoted_by", "promoted_action", "denylist_terms")
    kept = lambda c: F.when(F.col("promotion").isNotNull(), F.col(f"promotion.{c}")).otherwise(F.col(c)) if c in patterns.columns else F.col(f"promotion.{c}")
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in patterns.columns if c not in written], *[kept(c).alias(c) for c in written])


def searched(patterns: DataFrame, search: str | None = None, category: str | None = None, status: str | None = None, least: float | None = None) -> DataFrame:
    """Patterns by category, status, least salience and a text they hold, letter case aside."""
    tests = [(search, F.contains(F.lower("pattern"), F.lit((search or "").lower()))), (category, F.col("category") == category), (status, F.col("status") == status), (least, F.col("salience") >= (least or 0.0))]
    return reduce(lambda df, t: df.where(t[1]) if t[0] is not None else df, tests, patterns)


def synthesised(rules: DataFrame, least: float = 0.5, shortest: int = 10) -> DataFrame:
    """Proposed rules (confidence, pattern) that are sure and long enough."""
    return rules.where((F.col("confidence") >= least) & (F.length(F.trim("pattern")) >= shortest))
