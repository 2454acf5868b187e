"""Expressions over single values: places, processes, titles, JSON, props, advice and routing."""

from __future__ import annotations

import ipaddress
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

from loam.functions.text import ipv4, is_technique_id

#: Short names of regions with what they stand for, and the names of regions.
CANONICAL_REGIONS = {
    "EMEA": "Europe, Middle East and Africa", "APAC": "Asia-Pacific", "LATAM": "Latin America", "NA": "North America", "CIS": "Commonwealth of Independent States", "ANZ": "Australia and New Zealand",
}
M49_REGIONS = (
    "africa", "eastern africa", "middle africa", "northern africa", "southern africa", "western africa", "americas", "latin america",
    "latin america and the caribbean", "south america", "caribbean", "central america", "northern america", "asia", "central asia",
    "eastern asia", "southern asia", "south asia", "south-eastern asia", "southeast asia", "western asia", "europe", "eastern europe",
    "northern europe", "southern europe", "western europe", "oceania", "australia and new zealand", "melanesia", "micronesia", "polynesia",
    "antarctica", "middle east", "asia-pacific",
)
#: Fixed value: names of properties that a graph store takes.
SAFE_KEY = r"\A[a-zA-Z_][a-zA-Z0-9_]*\z"


def place(value: Column) -> Column:
    """Lower case, hyphens and underscores as spaces, one space at a time."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[-_]", " "), r"\s+", " "))


def is_region(value: Column) -> Column:
    """Whether a place is a region, by a short name, a name or a short name's expansion, whatever its separators."""
    flat = lambda name: " ".join(name.lower().replace("-", " ").replace("_", " ").split())
    letters = lambda name: re.sub(r"[^a-z0-9]", "", name.lower())
    named = F.upper(F.trim(value)).isin(*CANONICAL_REGIONS) | place(value).isin(*{flat(r) for r in M49_REGIONS})
    expanded = F.regexp_replace(place(value), r"[^\p{L}\p{N}]", "").isin(*{letters(e) for e in CANONICAL_REGIONS.values()})
    return F.coalesce(named | expanded, F.lit(False))


def executable(command: Column) -> Column:
    """The file name of a command's first word, without its folders; null for a blank command."""
    word = F.regexp_extract(F.coalesce(command, F.lit("")), r"(\S+)", 1)
    return F.nullif(F.substring_index(F.substring_index(word, "\\", -1), "/", -1), F.lit(""))


def ip_address(value: Column) -> Column:
    """Struct of kind (ipv4-addr, ipv6-addr) and address; a port and brackets are taken off; null for what is no address.

    Dotted addresses are read in the JVM; only values with two colons or more go to Python, for the canonical form.
    """

    def canonical(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([_ipv6(v) for v in batch], dtype=object)

    four = ipv4(F.regexp_replace(value, r"\A\s*\[([^\]]+)\](:\d{1,5})?\s*\z", "$1"))
    six = F.when(four.isNull() & (F.length(F.regexp_replace(value, "[^:]", "")) >= 2), F.pandas_udf(canonical, "string")(value))
    found = F.when(four.isNotNull(), F.struct(F.lit("ipv4-addr").alias("kind"), four.alias("address")))
    return found.when(six.isNotNull(), F.struct(F.lit("ipv6-addr").alias("kind"), six.alias("address")))


def _ipv6(value: str | None) -> str | None:
    text = (value or "").strip()
    bracketed = re.fullmatch(r"\[([^\]]+)\](?::\d{1,5})?", text)
    try:
        found = ipaddress.ip_address(bracketed.group(1) if bracketed else text)
    except ValueError:
        return None
    return str(found) if found.version == 6 else None


def technique_list(techniques: Column) -> Column:
    """Well-formed ids of an array of structs, joined by commas."""
    ids = F.transform(techniques, lambda t: t["technique_id"])
    return F.array_join(F.filter(ids, is_technique_id), ", ")


def display_title(title: Column, other: Column, default: str, sentinel: str = "Untitled Source") -> Column:
    """The title unless it is blank or the sentinel, else the other one unless blank, else the default."""
    first, second = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(other, F.lit("")))
    return F.when((first != "") & (first != sentinel), first).when(second != "", second).otherwise(F.lit(default))


def unwrapped_parameter(text: Column) -> Column:
    """A text without a leaked parameter tag around it."""
    opened = F.regexp_replace(text, r'\A\s*<parameter\s+name="[^"]*"\s*>', "")
    return F.regexp_replace(F.regexp_replace(opened, r"</parameter>\s*\z", ""), r"\A\s+|\s+\z", "")


def figures_filled(text: Column, blocks: Column, mark: str = "<!-- image -->") -> Column:
    """The k-th mark replaced by the k-th block; marks without a block stay, blocks without a mark are not used."""
    pieces = F.split(text, re.escape(mark))
    with_block = lambda p, k: F.when(k == 0, p).otherwise(F.concat(F.coalesce(F.get(blocks, k - 1), F.lit(mark)), p))
    return F.array_join(F.transform(pieces, with_block), "")


def figure_block(figure_id: Column, page: Column, caption: Column, kind: Column, text: Column) -> Column:
    """A figure as text between its opening and closing line, set off by empty lines."""
    where = F.concat(F.lit("page "), F.coalesce(page.cast("string"), F.lit("?")))
    said = F.when(F.coalesce(caption, F.lit("")) != "", F.concat(F.lit(', "'), caption, F.lit('"'))).otherwise("")
    head = F.concat(F.lit("[FIGURE "), figure_id, F.lit(" — "), kind, F.lit(", "), where, said, F.lit("]"))
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"\A\s+|\s+\z", "")
    return F.concat(F.lit("\n\n"), head, F.lit("\n"), body, F.lit("\n[/FIGURE "), figure_id, F.lit("]\n\n"))


def lenient_json(text: Column) -> Column:
    """Struct of value (JSON text or null), repaired and discarded (characters): as it is, else with odd backslashes doubled, else its longest readable start.

    Only texts that neither reading takes go to Python.
    """
    from loam.functions.entities import repaired_json

    def prefixes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_prefix(t) for t in batch], columns=["value", "discarded"])

    def whole(t: Column) -> Column:
        """The value of a text that holds one and nothing behind it, which the parser would pass over."""
        listed = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
        return F.when(F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1, F.try_variant_get(listed, "$[0]", "variant"))

    fixed = repaired_json(text)
    good, mended = whole(text), whole(fixed)
    rest = F.when(good.isNull() & mended.isNull() & text.isNotNull(), F.pandas_udf(prefixes, "value string, discarded int")(fixed))
    value = F.when(good.isNotNull(), F.to_json(good)).when(mended.isNotNull(), F.to_json(mended)).otherwise(rest["value"])
    return F.struct(value.alias("value"), (good.isNull() & text.isNotNull()).alias("repaired"), F.coalesce(rest["discarded"], F.lit(0)).alias("discarded"))


def _prefix(text: str | None) -> tuple[str | None, int]:
    body = (text or "").lstrip()
    try:
        value, end = json.JSONDecoder().raw_decode(body)
    except ValueError:
        return None, len(text or "")
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False), len(body) - end


def safe_props(props: Column) -> Column:
    """A map without keys that a graph store would not take."""
    return F.map_filter(props, lambda k, _: F.rlike(k, F.lit(SAFE_KEY)))


def salvaged(items: Column, is_good, most_bad: float = 0.25) -> Column:
    """The good items of an array, or null where more than a quarter are bad."""
    good = F.filter(items, is_good)
    return F.when(F.size(items) - F.size(good) <= most_bad * F.size(items), good)


def unnested(body: Column, field: str) -> Column:
    """JSON text of a record that a model has put under one more key, or whose ``field`` it has written as a string.

    A record of one key that is not ``field`` is that key's value; a string in ``field`` that is itself JSON is read.
    """
    v = F.try_parse_json(body)
    keys = F.json_object_keys(body)
    only = F.get(keys, F.lit(0))
    lifted = F.when((F.size(keys) == 1) & (only != field), F.call_function("get_json_object", body, F.concat(F.lit("$."), only))).otherwise(body)
    held = F.try_variant_get(v, f"$.{field}", "string")
    told = F.when(F.try_parse_json(held).isNotNull() & F.rlike(held, F.lit(r"\A\s*[\[{]")), F.concat(F.lit(f'{{"{field}":'), held, F.lit("}"))).otherwise(lifted)
    return F.when(v.isNotNull(), told)


def chunking_failed(n_chunks: Column, behaviour: Column, least: int = 200) -> Column:
    """Whether a text with enough behaviour gave no chunk."""
    return (F.coalesce(n_chunks, F.lit(0)) == 0) & (F.coalesce(F.length(behaviour), F.lit(0)) >= least)


def now_text(now: Column) -> Column:
    """A time as ISO text with milliseconds in UTC; the session's time zone must be UTC."""
    return F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def is_today(at: Column, now: Column) -> Column:
    return F.coalesce(F.to_date(at) == F.to_date(now), F.lit(False))


def next_after_parse(status: Column) -> Column:
    """A source that could not be read ends there."""
    return F.when(status == "failed", "end").otherwise("extract_figures")


def rejection_route(reasons: Column) -> Column:
    """Where rejected drafts send a source: to chunking if any boundary was bad, else to picking, nowhere without a rejection."""
    return F.when(F.array_contains(reasons, "bad_chunk_boundary"), "chunk_behaviors").when(F.size(reasons) > 0, "extract_techniques")


def tier_confidence(tier: Column) -> Column:
    """A reviewer's tier as a number; null for any other word."""
    return F.when(tier == "high", 0.9).when(tier == "medium", 0.7).when(tier == "low", 0.5)


def source_fingerprint(title: Column, text: Column, values: Column, ids: Column) -> Column:
    """Sixteen characters that are the same for the same title, start of the text, values and ids in any order."""
    part = lambda a: F.array_join(F.array_sort(F.coalesce(a, F.array().cast("array<string>"))), ",")
    return F.substring(F.sha1(F.concat_ws("|", F.coalesce(title, F.lit("")), F.substring(F.coalesce(text, F.lit("")), 1, 2000), part(values), part(ids))), 1, 16)


def representation(title: Column, chunks: Column, entities: Column, longest: int = 4000, most_chunks: int = 40, most_entities: int = 60) -> Column:
    """A bounded text that stands for a source when it is embedded."""
    parts = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.array_join(F.slice(entities, 1, most_entities), ", "), F.array_join(F.slice(chunks, 1, most_chunks), "\n"))
    return F.substring(parts, 1, longest)
