"""Names that stand for techniques: finding them in texts, how firmly they imply a technique, ids that a source itself lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loam.functions.text import technique_ids
from loam.operators.patterns import found_names, leftmost

#: Fixed value: the strength of a brand that is the technique; all others only suggest it.
DEFINITIONAL = "definitional"


def brand_hits(texts: DataFrame, brands: DataFrame) -> DataFrame:
    """(id, brand) for every brand (brand: string) that stands in a text (id, text) between signs that are no letters or digits.

    Matches are taken from left to right and do not overlap; of brands that begin at one place the first by ``place`` counts, a number that
    ``brands`` may have, and without it the longest. Letter case does not matter; a brand counts once per text; null texts hold
    none; there may be any number of brands.
    """
    place = F.col("place") if "place" in brands.columns else -F.length("brand")
    order = brands.where("brand is not null and brand <> ''").groupBy(F.lower("brand").alias("name")).agg(F.min(place).alias("place"))
    lowered = texts.select("id", F.lower("text").alias("text"))
    found = found_names(lowered, order, alone=True, settle=leftmost)
    return found.select("id", F.explode(F.array_distinct(F.transform("found", lambda m: m["name"]))).alias("brand"))


def brand_techniques(chunks: DataFrame, brands: DataFrame) -> DataFrame:
    """(chunk_id, brand, technique_id, strength) for chunks (chunk_id, text, source_excerpt) and brands (brand, technique_id, strength).

    The excerpt is read where the text is empty; a brand without a strength is suggestive.
    """
    text = F.coalesce(F.nullif(F.col("text"), F.lit("")), F.col("source_excerpt"))
    hits = brand_hits(chunks.select(F.col("chunk_id").alias("id"), text.alias("text")), brands)
    told = brands.select(F.lower("brand").alias("brand"), "technique_id", F.coalesce("strength", F.lit("suggestive")).alias("strength")).distinct()
    return hits.join(told, "brand").select(F.col("id").alias("chunk_id"), "brand", "technique_id", "strength")


def listed_techniques(sections: DataFrame, kind: str = "technique_reference") -> DataFrame:
    """(section_id, technique_id): ids that a source's own reference sections (section_id, classification, text) name."""
    return sections.where(F.col("classification") == kind).select("section_id", F.explode(technique_ids(F.col("text"))).alias("technique_id"))


def anchors(text: Column, tools: list[str]) -> Column:
    """Sorted anchor words of a text: identifiers of vulnerabilities, lower-cased, and the tools that occur in it as they are."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    cves = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(CVE-\d{4}-\d{4,})"), F.lit(1)), F.lower)
    known = F.filter(F.array(*map(F.lit, tools)), lambda t: F.contains(lowered, t)) if tools else F.array().cast("array<string>")
    return F.array_sort(F.array_union(cves, known))


def pool_labels(hits: DataFrame, listed: DataFrame) -> DataFrame:
    """(technique_id, labels): for the picker, which brands named a technique (brand hits) and whether the source lists it."""
    named = hits.select("technique_id", F.concat(F.lit("brand: "), F.col("brand")).alias("label"))
    own = listed.select("technique_id", F.lit("listed by the source").alias("label"))
    return named.unionByName(own).distinct().groupBy("technique_id").agg(F.array_sort(F.collect_list("label")).alias("labels"))
