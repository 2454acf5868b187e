"""Expressions over entities, names, platforms and picks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from loam.functions.text import TECHNIQUE, jaccard, one_space, tokens

#: Signs of a placeholder that stands for a victim; what may stand in brackets in a defanged address.
VICTIM_SIGNS = ("victim.user", "victim_user", "redacted", "<user", "[user", "example.com", "organization.com", "company.com", "yourcompany", "pseudorandom", "unique alphanumeric")
DEFANG_SIGNS = (".", ":", "at", "@", "dot", "://", "//")
#: What stands in brackets, what of it may lead a value, and a GUID.
_BRACKETED = r"(<[^<>]{1,40}>|\[[^\[\]]{1,40}\]|\{[^{}]{1,40}\})"
_LEADING = r"\A(?:<[^<>]{1,40}>|\[[^\[\]]{1,40}\]|\{[^{}]{1,40}\})[.\-_]+"
_GUID = r"\A[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\z"


def has_placeholder(value: Column) -> Column:
    """Whether a bracketed part is neither a defang sign nor a GUID."""
    inner = F.transform(F.regexp_extract_all(value, F.lit(_BRACKETED), F.lit(1)), lambda t: F.trim(F.substring(t, F.lit(2), F.length(t) - 2)))
    return F.coalesce(F.exists(inner, lambda t: ~F.lower(t).isin(*DEFANG_SIGNS) & ~F.rlike(t, F.lit(_GUID))), F.lit(False))


def without_placeholder(value: Column) -> Column:
    """The value, or what follows a leading placeholder; null if a placeholder remains or nothing does."""
    rest = F.trim(F.regexp_replace(value, _LEADING, ""))
    return F.when(~has_placeholder(value), value).when((rest != "") & ~has_placeholder(rest), rest)


def is_victims(value: Column) -> Column:
    lowered, found = F.lower(value), F.lit(False)
    for sign in VICTIM_SIGNS:
        found = found | F.contains(lowered, F.lit(sign))
    return F.coalesce(found, F.lit(False))


def platforms(names: Column, aliases: dict[str, str], known_roots: list[str]) -> Column:
    """Names by alias, of known roots, distinct in order, without a parent whose child is there."""
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    filled = F.filter(names, lambda n: F.coalesce(F.trim(n) != "", F.lit(False)))
    written = F.transform(filled, lambda n: F.coalesce(F.try_element_at(table, F.lower(F.trim(n))), F.trim(n)))
    known = F.array_distinct(F.filter(written, lambda n: F.substring_index(n, "::", 1).isin(known_roots)))
    return F.filter(known, lambda n: ~F.exists(known, lambda other: F.startswith(other, F.concat(n, F.lit("::")))))


def recalibrated(confidence: Column, bucket: Column, tid: Column, name: Column, description: Column, chunk: Column, rationale: Column) -> Column:
    """A pick's confidence after its checks, two places: a name or id in the text lifts it to 0.85; a possible pick is
    blended with the overlap of text and description, and held at 0.5 if its rationale shares no word with the text."""
    lowered = F.lower(chunk)
    anchored = (F.coalesce(name, F.lit("")) != "") & F.contains(lowered, F.lower(name)) | F.contains(lowered, F.lower(tid))
    lifted = F.when(F.coalesce(anchored, F.lit(False)) & (confidence < 0.85), F.lit(0.85)).otherwise(confidence)
    possible = F.coalesce(bucket, F.lit("probable")) == "possible"
    blended = lifted * 0.7 + jaccard(tokens(chunk), tokens(description)) * 0.3
    described = possible & (F.coalesce(description, F.lit("")) != "")
    mixed = F.when(described & (F.abs(blended - lifted) > 0.01), blended).otherwise(lifted)
    grounded = F.size(F.array_intersect(tokens(rationale, 4), tokens(chunk, 4))) > 0
    capped = F.when(possible & (mixed > 0.5) & ~grounded, F.lit(0.5)).otherwise(mixed)
    return F.least(F.greatest(F.bround(capped, 2), F.lit(0.0)), F.lit(1.0))


def repaired_json(text: Column) -> Column:
    """One more backslash where an odd run of them stands before a character that JSON does not escape."""
    return F.regexp_replace(text, r'(?<!\\)((?:\\\\)*)\\(?!["\\/bfnrtu]|\z)', r"$1\\\\")


def operative(text: Column, patterns: list[str], banned: list[str], least: int = 8) -> Column:
    """Sorted distinct command-like strings: matches of the patterns, normal spaces, lower case, with a digit or sign."""
    found = F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({p})"), F.lit(1)) for p in patterns]))
    normal = F.transform(found, lambda s: F.lower(one_space(s)))
    clean = lambda s: (F.length(s) >= least) & F.rlike(s, F.lit(r"[0-9\\/.:_=\-]")) & ~F.exists(F.array(*map(F.lit, banned)), lambda b: F.contains(s, b))
    return F.array_sort(F.array_distinct(F.filter(normal, clean)))


def parent_of(tid: Column) -> Column:
    """The id before its sub-id."""
    return F.substring_index(tid, ".", 1)


def provenance(text: Column, start: Column, end: Column, opened: str = "[FIGURE", closed: str = "[/FIGURE]", fence: str = "```") -> Column:
    """figure, code, prose, or paraphrased without a span (0-based, end left out): both ends must lie in one kind."""
    last = lambda mark, upto: F.length(F.substring_index(F.concat(F.lit(mark), F.substring(text, F.lit(1), upto)), mark, -1))
    # The shorter the rest behind the last mark, the later the mark; a text without it leaves all.
    inside = lambda at: F.contains(F.substring(text, F.lit(1), at), F.lit(opened)) & (last(opened, at) + len(opened) < F.when(F.contains(F.substring(text, F.lit(1), at), F.lit(closed)), last(closed, at) + len(closed)).otherwise(F.lit(1 << 30)))
    fenced = lambda at: F.pmod(F.regexp_count(F.substring(text, F.lit(1), at), F.lit(fence)), F.lit(2)) == 1
    none = start.isNull() | (start < 0) | (end <= start) | (F.coalesce(text, F.lit("")) == "")
    return F.when(none, "paraphrased").when(inside(start) & inside(end), "figure").when(fenced(start) & fenced(end), "code").otherwise("prose")


def technique_refs(techniques: Column) -> Column:
    """Resolved ids, else the id behind its type; entries with neither are left out."""
    refs = F.transform(techniques, lambda t: F.when(F.coalesce(t["stix_id"], F.lit("")) != "", t["stix_id"]).when(F.coalesce(t["technique_id"], F.lit("")) != "", F.concat(F.lit("attack-pattern--"), t["technique_id"])))
    return F.filter(refs, lambda r: r.isNotNull())


def mentions(text: Column) -> Column:
    """Whether a technique id stands in the text."""
    return F.coalesce(F.rlike(text, F.lit(TECHNIQUE)), F.lit(False))
