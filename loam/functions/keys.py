"""Stable keys and ids made from content, and small fixed mappings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def folded(value: Column) -> Column:
    """Lower case, trimmed; empty for null."""
    return F.lower(F.trim(F.coalesce(value, F.lit(""))))


def relationship_key(source: Column, verb: Column, target: Column, source_type: Column, target_type: Column) -> Column:
    """Five parts joined by bars; null parts are empty, so that they are not skipped."""
    return F.concat_ws("|", *map(folded, (source, verb, target, source_type, target_type)))


def relationship_id(key: Column) -> Column:
    return F.concat(F.lit("relp_"), F.substring(F.sha2(key, 256), 1, 12))


def joint_id(prefix: str, role: Column, inputs: Column, outputs: Column) -> Column:
    """An operator's id: the same for the same role and the same ends in any order."""
    ends = [F.array_join(F.array_sort(a.cast("array<string>")), ",") for a in (inputs, outputs)]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", role, *ends), 256), 1, 12))


def cache_key(**parts: Column) -> Column:
    """sha256 of the parts as JSON with keys in order; nulls are written, so a missing part and an empty one differ."""
    ordered = F.struct(*[parts[k].alias(k) for k in sorted(parts)])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def published(date: Column, now: Column) -> Column:
    """A date with time as it is, a bare date at midnight, anything else now; ISO with milliseconds."""
    return F.when(F.contains(date, F.lit("T")), date).when(F.rlike(date, F.lit(r"\A[^-]*-[^-]*-[^-]*\z")) & (F.length(date) == 10), F.concat(date, F.lit("T00:00:00.000Z"))).otherwise(now)


def ref_label(ref: Column, name: Column) -> Column:
    """The name, or the reference's type and its last eight characters."""
    return F.coalesce(name, F.concat(F.substring_index(ref, "--", 1), F.lit(" "), F.right(ref, F.lit(8))))
