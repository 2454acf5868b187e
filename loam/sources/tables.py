"""Reading and writing tables, and the shapes that the reference's records take over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_texts(spark: SparkSession, path: str, least: int = 10) -> DataFrame:
    """One row per text file: path, text, status and warnings. Bytes that are no UTF-8 become replacement signs."""
    files = spark.read.format("binaryFile").load(path)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    status = F.when(F.length(F.trim(text)) >= least, "parsed").otherwise("failed")
    warnings = F.when(words < 50, F.array(F.lit("fewer than 50 words"))).otherwise(F.array().cast("array<string>"))
    return files.select("path", text.alias("text"), status.alias("status"), warnings.alias("warnings"))


#: Source types that are read as text and as pages; documents and images need a layout model, which a caller passes.
TEXT_TYPES, PAGE_TYPES = ("markdown", "free_text"), ("html",)


def parsed(rows: DataFrame, layout=None, least: int = 10, few_words: int = 50) -> DataFrame:
    """(source_id, parsed_text, status, warnings) of sources (source_id, source_type, content: bytes), by type.

    Texts are decoded, bytes that are no UTF-8 become replacement signs; pages lose their tags; other types go through
    ``layout`` (a Column function of the bytes) or fail without one. Nothing raises: a source that gives under ``least``
    characters has failed and has an empty text.
    """
    decoded = F.make_valid_utf8(F.col("content").cast("string"))
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(decoded, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"<[^>]*>", " "), r"\s+", " "))
    other = layout(F.col("content")) if layout is not None else F.lit(None).cast("string")
    text = F.when(F.col("source_type").isin(*TEXT_TYPES), decoded).when(F.col("source_type").isin(*PAGE_TYPES), plain).otherwise(other)
    told = rows.select("source_id", F.coalesce(text, F.lit("")).alias("text"))
    good = F.length(F.trim("text")) >= least
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    warnings = F.when(~good, F.array(F.lit("nothing could be read"))).when(words < few_words, F.array(F.lit(f"fewer than {few_words} words"))).otherwise(F.array().cast("array<string>"))
    return told.select("source_id", F.when(good, F.col("text")).otherwise("").alias("parsed_text"), F.when(good, "parsed").otherwise("failed").alias("status"), warnings.alias("warnings"))


def write_figures(figures: DataFrame, path: str) -> None:
    """Figures (source_id, place, kind, content) in a folder per source; ids with other signs than letters, digits, hyphens and underscores are refused."""
    bad = figures.where(~F.rlike(F.col("source_id").cast("string"), F.lit(r"\A[A-Za-z0-9_-]+\z"))).limit(1).count()
    if bad:
        raise ValueError("a source's id is no safe folder name")
    figures.write.mode("overwrite").partitionBy("source_id").parquet(path)


def read_figures(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """A source's figures in their order."""
    return spark.read.option("basePath", path).parquet(f"{path}/source_id={source_id}").orderBy("place")


CATALOGUE = T.StructType([
    T.StructField("objects", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("name", T.StringType()), T.StructField("description", T.StringType()),
        T.StructField("revoked", T.BooleanType()), T.StructField("x_mitre_deprecated", T.BooleanType()), T.StructField("x_mitre_platforms", T.ArrayType(T.StringType())),
        T.StructField("external_references", T.ArrayType(T.StructType([T.StructField("source_name", T.StringType()), T.StructField("external_id", T.StringType())]))),
        T.StructField("kill_chain_phases", T.ArrayType(T.StructType([T.StructField("kill_chain_name", T.StringType()), T.StructField("phase_name", T.StringType())]))),
        T.StructField("source_ref", T.StringType()), T.StructField("target_ref", T.StringType()), T.StructField("relationship_type", T.StringType()),
    ])))
])


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The objects of a STIX bundle in one JSON document, a row each."""
    return spark.read.schema(CATALOGUE).option("multiLine", True).json(path).select(F.explode("objects").alias("o")).select("o.*")


def techniques(objects: DataFrame) -> DataFrame:
    """Attack patterns with an id of the public catalogue: technique_id, stix_id, name, tactics, platforms, flags."""
    first = F.element_at(F.filter("external_references", lambda r: r.source_name == "mitre-attack"), 1)
    tactics = F.transform(F.filter("kill_chain_phases", lambda p: p.kill_chain_name == "mitre-attack"), lambda p: p.phase_name)
    none = F.array().cast("array<string>")
    return (
        objects.where(F.col("type") == "attack-pattern")
        .select(
            first["external_id"].alias("technique_id"), F.col("id").alias("stix_id"), "name", F.coalesce("description", F.lit("")).alias("description"),
            F.coalesce(tactics, none).alias("tactics"), F.coalesce("x_mitre_platforms", none).alias("platforms"),
            F.coalesce("revoked", F.lit(False)).alias("revoked"), F.coalesce("x_mitre_deprecated", F.lit(False)).alias("deprecated"),
        )
        .where(F.col("technique_id").isNotNull())
    )


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes by label and edges by verb, each in folders of their own, so that a label is read alone."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("verb").parquet(f"{path}/edges")
