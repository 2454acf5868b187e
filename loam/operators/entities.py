"""Entities of a source: taking in what a model found, denying known noise, and what happens without a review.

Raw entities are rows: source_id, position, value, entity_type, confidence, organization_role, location_role.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loam.functions.entities import is_victims, without_placeholder
from loam.functions.text import clamp, looks_like_rule, refang, trimmed
from loam.operators.bundle import LOCATION_ROLES, ORGANISATION_ROLES
from loam.operators.records import first_wins
from loam.operators.relationships import OBJECT_TYPES

#: Types whose defanged values are written out, types that may name a victim, and the least confidence that needs no look.
REFANG_TYPES, VICTIM_TYPES, LOW_CONFIDENCE = ("ioc_domain", "ioc_ip", "ioc_url"), ("ioc_email", "user_account"), 0.4
#: Fixed value: types whose values stand for indicators, which must not hold placeholders.
INDICATOR_TYPES = ("ioc_domain", "ioc_url", "ioc_email", "ioc_ip", "ioc_hash", "ioc_file_path", "ioc_process_name", "ioc_registry_key", "ioc_mutex")
TYPES = (*OBJECT_TYPES, "ioc_command_line")
#: Fixed value: kinds of detection rules.
RULE_TYPES = ("sigma", "yara", "snort", "suricata", "kql", "cql", "spl", "stix-pattern")


def taken_in(raw: DataFrame, types: tuple[str, ...] = TYPES) -> DataFrame:
    """Entities with a cleaned value, one per source, lower-cased value and type, the first by position.

    Unknown types and blank values go, addresses are refanged, indicators lose a leading placeholder or go if they hold another
    one, accounts of victims go. Confidence is clamped, 0.5 if missing, and flagged when low; roles outside their vocabulary
    become ``other`` for organisations and ``context`` for places, and other types have none.
    """
    kind = F.col("entity_type")
    kept = raw.withColumn("value", trimmed(F.coalesce("value", F.lit("")))).where((F.col("value") != "") & kind.isin(*types))
    kept = kept.withColumn("value", F.when(kind.isin(*REFANG_TYPES), refang(F.col("value"))).otherwise(F.col("value")))
    kept = kept.withColumn("value", F.when(kind.isin(*INDICATOR_TYPES), without_placeholder(F.col("value"))).otherwise(F.col("value")))
    kept = kept.where(F.col("value").isNotNull() & ~(kind.isin(*VICTIM_TYPES) & is_victims(F.col("value"))))
    one = first_wins(kept.withColumn("folded", F.lower("value")), ["source_id", "folded", "entity_type"], "position").drop("folded")
    sure = clamp(F.coalesce("confidence", F.lit(0.5)))
    organisation, place = F.coalesce("organization_role", F.lit("other")), F.coalesce("location_role", F.lit("context"))
    return (
        one.withColumn("confidence", sure).withColumn("low_confidence", F.col("confidence") < LOW_CONFIDENCE)
        .withColumn("organization_role", F.when(F.col("entity_type") == "organization", F.when(organisation.isin(*ORGANISATION_ROLES), organisation).otherwise("other")))
        .withColumn("location_role", F.when(F.col("entity_type") == "location", F.when(place.isin(*LOCATION_ROLES), place).otherwise("context")))
    )


def denied(entities: DataFrame, terms: DataFrame) -> DataFrame:
    """Entities with ``denylisted``: their refanged, lower-cased value is a term (value, scope: types, null for any).

    A scoped term does not match an entity without a type. The terms are joined by value, so they may be many.
    """
    scopes = terms.select(F.lower(F.trim("value")).alias("term"), F.coalesce("scope", F.array(F.lit("*"))).alias("scope")).groupBy("term").agg(F.flatten(F.collect_list("scope")).alias("scope"))
    told = entities.withColumn("term", F.lower(refang(F.col("value")))).join(scopes, "term", "left")
    hit = F.array_contains("scope", "*") | F.array_contains("scope", F.col("entity_type"))
    return told.withColumn("denylisted", F.coalesce(hit, F.lit(False))).drop("term", "scope")


def unreviewed_actions(entities: DataFrame, reviews: DataFrame) -> DataFrame:
    """Entities with gate_action: the review's (entity_id, action), else remove if denylisted or of low confidence, else approve; and the reason of a removal."""
    told = entities.join(reviews.select("entity_id", F.col("action").alias("said")), "entity_id", "left")
    reason = F.when(F.col("said").isNull(), F.when(F.col("denylisted"), "denylisted").when(F.col("low_confidence"), "low confidence"))
    return told.withColumn("removal_reason", reason).withColumn("gate_action", F.coalesce("said", F.when(reason.isNotNull(), "remove").otherwise("approve"))).drop("said")


def detection_rules(raw: DataFrame) -> DataFrame:
    """Rules (source_id, rule_type, rule_content) of a known type whose content is a body, not a name."""
    content = trimmed(F.coalesce("rule_content", F.lit("")))
    return raw.where((content != "") & looks_like_rule(content) & F.col("rule_type").isin(*RULE_TYPES)).withColumn("rule_content", content)
