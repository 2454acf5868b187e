"""What finished sources leave behind: the property graph, bundles and the tables of sources, as rows that are rewritten by key.

Parquet has no updates, so a change gives the new table and the caller writes it; every function here is a DataFrame function
but upserted(), which takes a bundle into the graph on disk. Graph rows are nodes (stix_id, label, props, ingested_by) and edges (src, verb, dst).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import MapType

from loam.functions.values import SAFE_KEY, safe_props
from loam.operators.bundle import references, report_refs
from loam.sources.shared import exists, saved

#: Labels of object types and names of verbs in the graph.
LABELS = {
    "attack-pattern": "AttackPattern", "identity": "Identity", "intrusion-set": "IntrusionSet", "threat-actor": "ThreatActor", "malware": "Malware", "tool": "Tool",
    "campaign": "Campaign", "vulnerability": "Vulnerability", "location": "Location", "indicator": "Indicator", "infrastructure": "Infrastructure",
    "x-procedure": "Procedure", "course-of-action": "CourseOfAction", "report": "Report", "marking-definition": "MarkingDefinition", "x-log-source": "LogSource",
    "attack-flow": "AttackFlow", "attack-operator": "AttackOperator", "attack-condition": "AttackCondition", "x-mitre-detection-strategy": "DetectionStrategy",
    "x-mitre-analytic": "Analytic", "x-mitre-data-component": "DataComponent", "x-mitre-data-source": "DataSource", "ipv4-addr": "IPv4Addr", "ipv6-addr": "IPv6Addr",
    "domain-name": "DomainName", "url": "URL", "email-addr": "EmailAddr", "file": "File", "windows-registry-key": "WindowsRegistryKey",
    "network-traffic": "NetworkTraffic", "process": "Process", "directory": "Directory", "mutex": "Mutex", "software": "Software", "user-account": "UserAccount",
}
VERBS = {
    "uses": "USES", "precedes": "PRECEDES", "attributed-to": "ATTRIBUTED_TO", "indicates": "INDICATES", "related-to": "RELATED_TO", "targets": "TARGETS",
    "mitigates": "MITIGATES", "exploits": "EXPLOITS", "component-of": "COMPONENT_OF", "implements-technique": "IMPLEMENTS_TECHNIQUE",
    "belongs-to-tactic": "BELONGS_TO_TACTIC", "detects": "DETECTS", "has-analytic": "HAS_ANALYTIC", "uses-data-component": "USES_DATA_COMPONENT",
    "has-observable": "HAS_OBSERVABLE", "subtechnique-of": "SUBTECHNIQUE_OF", "authored-by": "AUTHORED_BY", "derived-from": "DERIVED_FROM",
    "duplicate-of": "DUPLICATE_OF", "located-at": "LOCATED_AT", "uses-technique": "IMPLEMENTS_TECHNIQUE",
}
CATALOGUE_TYPES = ("attack-pattern", "x-mitre-detection-strategy", "x-mitre-analytic", "x-mitre-data-component")
MARKER, LONGEST_VERB, MOST_DETAILS = "pipeline", 64, 20


def _mapped(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _type_of(ref: Column) -> Column:
    return F.substring_index(ref, "--", 1)


def verb_name(verb: Column, source: Column, target: Column) -> Column:
    """An edge's name in the graph; a procedure that uses a technique implements it; null for a name that no store takes."""
    known = F.coalesce(_mapped(VERBS, verb), F.replace(F.upper(verb), F.lit("-"), F.lit("_")))
    name = F.when((verb == "uses") & (_type_of(source) == "x-procedure") & (_type_of(target) == "attack-pattern"), "IMPLEMENTS_TECHNIQUE").otherwise(known)
    return F.when((F.length(name) <= LONGEST_VERB) & F.rlike(name, F.lit(SAFE_KEY)), name)


def graph_rows(objects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and report links of bundles' objects (as operators.bundle has them).

    The catalogue owns its objects: they get no node, and an edge between two of them is left out. Extension definitions,
    and the identities that only they name, are no graph data. A report describes each object it lists that is there.
    """
    meta = references(objects.where("type = 'extension-definition'")).select("bundle", F.col("ref").alias("id")).distinct()
    plain = objects.where(~F.col("type").isin("relationship", "extension-definition", *CATALOGUE_TYPES) & F.coalesce(F.col("id") != "", F.lit(False)))
    own = plain.join(meta, ["bundle", "id"], "left_anti").withColumn("label", _mapped(LABELS, F.col("type"))).where("label is not null")
    texts = F.create_map(*[x for c in ("name", "description", "created", "modified") for x in (F.lit(c), F.col(c))])
    props = F.map_filter(F.map_concat(texts, safe_props(F.coalesce("props", F.create_map().cast("map<string,string>")))), lambda _, v: v.isNotNull())
    lists = F.map_filter("lists", lambda k, v: F.rlike(k, F.lit(SAFE_KEY)) & (F.size(v) > 0))
    nodes = own.select("bundle", F.col("id").alias("stix_id"), "label", F.map_concat(props, F.transform_values(F.coalesce(lists, F.create_map().cast("map<string,array<string>>")), lambda _, v: F.to_json(v))).alias("props"), F.lit(MARKER).alias("ingested_by"))
    get = lambda t, k: F.try_element_at(F.col(t), F.lit(k))
    links = objects.where("type = 'relationship'").select("bundle", get("single", "source_ref").alias("src"), get("props", "relationship_type").alias("v"), get("single", "target_ref").alias("dst"))
    links = links.where(F.coalesce((F.col("src") != "") & (F.col("dst") != "") & ~(_type_of(F.col("src")).isin(*CATALOGUE_TYPES) & _type_of(F.col("dst")).isin(*CATALOGUE_TYPES)), F.lit(False)))
    edges = links.select("bundle", "src", verb_name(F.col("v"), F.col("src"), F.col("dst")).alias("verb"), "dst").where("verb is not null").distinct()
    present = objects.select("bundle", F.col("id").alias("ref")).where("ref <> ''").distinct()
    listed = references(objects.where("type = 'report'")).where((F.col("ref_field") == "object_refs") & (_type_of(F.col("ref")) != "relationship") & (F.col("ref") != F.col("holder_id")))
    describes = listed.join(present, ["bundle", "ref"], "left_semi").select("bundle", F.col("holder_id").alias("src"), F.lit("DESCRIBES").alias("verb"), F.col("ref").alias("dst")).distinct()
    return nodes, edges, describes


def merged(old_nodes: DataFrame, new_nodes: DataFrame) -> DataFrame:
    """Nodes after new ones: theirs where the pipeline owns the node or it is new; what the catalogue owns stays as it is."""
    fresh = new_nodes.groupBy("stix_id").agg(F.max_by(F.struct("label", "props", "ingested_by"), "bundle").alias("n"))
    both = old_nodes.select("stix_id", F.struct("label", "props", "ingested_by").alias("o")).join(fresh, "stix_id", "full_outer")
    keep = F.col("n").isNull() | F.coalesce(F.col("o.ingested_by").isNull() & F.col("o.label").isNotNull(), F.lit(False))
    return both.select("stix_id", F.when(keep, F.col("o")).otherwise(F.col("n")).alias("x")).select("stix_id", "x.*")


def writable(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges whose ends exist, how many do not by bundle (written, dropped), and the first ones dropped in detail."""
    known = nodes.select("stix_id").distinct()
    end = lambda c: known.select(F.col("stix_id").alias(c), F.lit(True).alias(f"has_{c}"))
    told = saved(edges.join(end("src"), "src", "left").join(end("dst"), "dst", "left").select(*edges.columns, (F.col("has_src").isNotNull() & F.col("has_dst").isNotNull()).alias("ok")), "graph-edges")
    counts = told.groupBy("bundle").agg(F.count_if("ok").alias("written"), F.count_if(~F.col("ok")).alias("dropped"))
    return told.where("ok").drop("ok"), counts, told.where("not ok").drop("ok").orderBy("bundle", "src", "verb", "dst").limit(MOST_DETAILS)


def _bucket(ref: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(ref), F.lit(buckets).cast("long")).cast("int").alias("bucket")


def _rewritten(spark: SparkSession, new: DataFrame, path: str, buckets: int, key: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> None:
    """Writes the buckets of ``key`` that ``new`` has rows for and that change by them; ``merge`` makes a bucket's rows of the old ones and the new."""
    touched = [r[0] for r in new.select(_bucket(key, buckets)).distinct().collect()]  # numbers below ``buckets``
    if not touched:
        return
    here = exists(spark, path)
    old = spark.read.parquet(path).where(F.col("bucket").isin(touched)) if here else None
    after = merge(old.drop("bucket") if old is not None else None, new).withColumn("bucket", _bucket(key, buckets))
    if old is not None:
        # what stands there already is not written again: a bucket counts as changed if its rows differ
        print_ = lambda df: df.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64(*[F.to_json(c) if isinstance(df.schema[c].dataType, MapType) else F.col(c) for c in sorted(df.columns) if c != "bucket"]).cast("decimal(38,0)")).alias("h"))
        after = saved(after.select(old.columns), "graph-buckets")
        changed = [r[0] for r in print_(after).join(print_(old), ["bucket", "n", "h"], "left_anti").select("bucket").collect()]  # at most one row a bucket
        if not changed:
            return
        after = after.where(F.col("bucket").isin(changed))
    after.repartition("bucket").sortWithinPartitions("bucket", key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def upserted(nodes: DataFrame, edges: DataFrame, path: str, buckets: int = 256) -> None:
    """A bundle's nodes (bundle, stix_id, label, props, ingested_by) and edges (bundle, src, verb, dst) taken into the graph under ``path``.

    Nodes are merged() with those there, an edge that is there already stays as it is. Both lie in folders by a hash of the node or of the
    edge's start; only the folders that a bundle changes are written, each by one task and as one file, so a repeated bundle writes
    nothing and a bundle costs its own buckets whatever the graph holds. Choose ``buckets`` for the graph's final size and keep it.
    Edges go last, so a run that is lost between the two leaves nodes without edges, which the next run mends.
    """
    spark = nodes.sparkSession
    fresh = saved(nodes.select("bundle", "stix_id", "label", "props", "ingested_by"), "graph-nodes")
    none = fresh.drop("bundle").limit(0)
    _rewritten(spark, fresh, f"{path}/nodes", buckets, "stix_id", lambda old, new: merged(old if old is not None else none, new))
    links = saved(edges.select("src", "verb", "dst").distinct(), "graph-links")
    _rewritten(spark, links, f"{path}/edges", buckets, "src", lambda old, new: new if old is None else old.unionByName(new).distinct())


def graph_at(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges that upserted() has written."""
    return spark.read.parquet(f"{path}/nodes").drop("bucket"), spark.read.parquet(f"{path}/edges").drop("bucket")


def reports(nodes: DataFrame, describes: DataFrame) -> DataFrame:
    """(stix_id, name, n) of reports with how many objects each describes, by name."""
    n = describes.groupBy(F.col("src").alias("stix_id")).agg(F.count_distinct("dst").alias("n"))
    told = nodes.where("label = 'Report'").select("stix_id", F.try_element_at("props", F.lit("name")).alias("name"))
    return told.join(n, "stix_id", "left").na.fill(0, ["n"]).orderBy("name", "stix_id")


def undone(nodes: DataFrame, edges: DataFrame, describes: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and report links without some reports (stix_id) and what only they describe; the catalogue's nodes stay."""
    theirs = describes.join(gone.select(F.col("stix_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("stix_id")).distinct()
    others = describes.join(gone.select(F.col("stix_id").alias("src")), "src", "left_anti").select(F.col("dst").alias("stix_id")).distinct()
    owned = nodes.where(F.coalesce(F.col("ingested_by") == MARKER, F.lit(False))).select("stix_id")
    lost = saved(theirs.join(others, "stix_id", "left_anti").join(owned, "stix_id", "left_semi").union(gone.select("stix_id")).distinct(), "undone")
    without = lambda df: df.join(lost.withColumnRenamed("stix_id", "src"), "src", "left_anti").join(lost.withColumnRenamed("stix_id", "dst"), "dst", "left_anti")
    return nodes.join(lost, "stix_id", "left_anti"), without(edges), without(describes)


def contributions(describes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, label, n): what each report describes, by label, the most frequent first."""
    told = describes.select("src", F.col("dst").alias("stix_id")).distinct().join(nodes.select("stix_id", "label"), "stix_id")
    return told.groupBy("src", "label").agg(F.count("*").alias("n")).orderBy("src", F.desc("n"), "label")


def observables_of(techniques: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(technique, procedure, values): procedures that implement a technique with their observables' names, also those without any."""
    procs = edges.where("verb = 'IMPLEMENTS_TECHNIQUE'").select(F.col("dst").alias("technique"), F.col("src").alias("procedure")).join(techniques.select("technique"), "technique", "left_semi").distinct()
    seen = edges.where("verb = 'HAS_OBSERVABLE'").select(F.col("src").alias("procedure"), F.col("dst").alias("stix_id"))
    named = seen.join(nodes.select("stix_id", F.try_element_at("props", F.lit("name")).alias("name")), "stix_id")
    return procs.join(named, "procedure", "left").groupBy("technique", "procedure").agg(F.array_sort(F.collect_set("name")).alias("values"))


def visible(nodes: DataFrame, edges: DataFrame, layers: dict[str, list[str]], on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes whose label lies in a layer that is on, or in none, and the edges between them."""
    hidden = [label for layer, labels in layers.items() if layer not in on for label in labels]
    kept = nodes.where(~F.coalesce(F.col("label").isin(hidden), F.lit(False))) if hidden else nodes
    ids = kept.select("stix_id").distinct()
    ends = edges.join(ids.withColumnRenamed("stix_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("stix_id", "dst"), "dst", "left_semi")
    return kept, ends


def display_names(nodes: DataFrame) -> DataFrame:
    """(stix_id, name, secondary): a node's name, or its type with the end of its id, and what tells it apart."""
    get = lambda k: F.try_element_at("props", F.lit(k))
    name = F.coalesce(F.nullif(get("name"), F.lit("")), F.nullif(get("value"), F.lit("")), F.concat("label", F.lit(" "), F.right("stix_id", F.lit(8))))
    secondary = F.when(F.col("label") == "AttackPattern", get("mitre_id")).when(F.col("label") == "AttackOperator", get("operator")).otherwise(F.substring(F.coalesce(get("description"), F.lit("")), 1, 80))
    return nodes.select("stix_id", name.alias("name"), F.coalesce(secondary, F.lit("")).alias("secondary"))


# --- tables of sources and bundles ----------------------------------------------------------------------------------


def bundle_rows(objects: DataFrame, titles: DataFrame) -> DataFrame:
    """(bundle, title, objects, relationships, procedures, listed): what is kept of a bundle beside its file."""
    from loam.operators.bundle import bundle_counts

    listed = report_refs(objects).groupBy("bundle").agg(F.count("*").alias("listed"))
    return titles.join(bundle_counts(objects), "bundle").join(listed, "bundle", "left").na.fill(0, ["listed"])


def created(rows: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """New sources (source_id, source_type, title, gate_modes: map, source_reliability) as they are queued: modes that exist, reliability from 0 to 100 or 50."""
    from loam.operators.turns import gate_modes

    modes = gate_modes(F.coalesce("gate_modes", F.create_map().cast("map<string,string>")), defaults)
    told = F.create_map(*[x for gate, mode in modes.items() for x in (F.lit(gate), mode)])
    sure = F.least(F.greatest(F.coalesce("source_reliability", F.lit(50)), F.lit(0)), F.lit(100))
    return rows.select("source_id", "source_type", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled Source")).alias("title"), F.lit("queued").alias("status"), told.alias("gate_modes"), sure.alias("source_reliability"))


def captured(state: DataFrame, path: str) -> None:
    """A state's rows (key, props: map) as JSON lines, secrets blotted out."""
    state.withColumn("props", redacted(F.col("props"))).write.mode("overwrite").json(path)


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> tuple[DataFrame, int]:
    """One page of a list in a given order, and how many rows there are in all; what makes the rows runs once."""
    rows = saved(rows, "listed")
    return rows.orderBy(*order).offset(offset).limit(limit), rows.count()


def claimed(sources: DataFrame, claims: DataFrame) -> DataFrame:
    """Sources (source_id, claimed_by) after claims (source_id, analyst): a free one or one's own is given, any other stays; of several claims the first by name."""
    one = claims.groupBy("source_id").agg(F.min("analyst").alias("analyst"))
    told = sources.join(one, "source_id", "left")
    may = F.col("claimed_by").isNull() | (F.col("claimed_by") == F.col("analyst"))
    return told.withColumn("claimed_by", F.when(F.col("analyst").isNotNull() & may, F.col("analyst")).otherwise(F.col("claimed_by"))).select(sources.columns)


def updated(rows: DataFrame, changes: DataFrame, key: str, may_clear: tuple[str, ...] = ()) -> DataFrame:
    """Rows with the columns of ``changes`` of the same key; null leaves a column alone, but those that may be cleared."""
    names = [c for c in changes.columns if c != key]
    told = rows.join(changes.select(key, *[F.col(c).alias(f"new_{c}") for c in names], F.lit(True).alias("is_told")), key, "left")
    new = {c: F.when(F.col("is_told"), F.col(f"new_{c}")).otherwise(F.col(c)) if c in may_clear else F.coalesce(f"new_{c}", c) for c in names}
    return told.select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns])


def deleted(tables: dict[str, DataFrame], gone: DataFrame, key: str = "source_id") -> dict[str, DataFrame]:
    """Every table without the rows of some keys."""
    return {name: df.join(gone.select(key).distinct(), key, "left_anti") for name, df in tables.items()}


def remembered(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """A cache (key, output) with answers to keys that it has not; of several answers to one key the smallest."""
    new = answers.join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.min("output").alias("output"))
    return cache.select("key", "output").unionByName(new)


def migrated(rows: DataFrame, schema: str) -> DataFrame:
    """Rows with the columns that a newer schema (DDL) has beside theirs, as null."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    wanted = _parse_datatype_string(schema)
    assert isinstance(wanted, StructType)
    have = {c.lower() for c in rows.columns}
    return rows.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in wanted.fields if f.name.lower() not in have])


def redacted(props: Column, secret: tuple[str, ...] = ("api_key", "token", "password", "authorization")) -> Column:
    """A map with the values of secret keys blotted out."""
    return F.transform_values(props, lambda k, v: F.when(F.lower(k).isin(*secret), F.lit("[redacted]")).otherwise(v))
