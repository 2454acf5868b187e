"""SimHash near-duplicates by multi-index hashing.

A fingerprint has two segments of 32 bits. Two fingerprints that differ in three bits or fewer differ in one bit or
none in at least one segment, so a table of each segment holds every fingerprint under that segment, and a query
enumerates the 33 values within one bit of its own, fetches the matches and verifies the complete distance. Copies
share a fingerprint and are one entry. Links are oriented, so each pair is met from one side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from loam.llm.components import connected_components, forest, heavy_keys, looked_up
from loam.llm.shared import saved

SHINGLE, SEED, SEGMENT_BITS = 3, 42, 32
#: Table entries under one segment value beyond which matches are verified in blocks instead of as joined rows, and
#: the entries in a block.
DENSE, BLOCK = 64, 1024
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACES = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash: a bit is 1 if set in over half the XXH64 hashes of the text's word shingles."""
    words = text.encode().lower().split() if text else []  # of bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    digest, normal = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle:
        return int(np.uint64(digest(normal, SEED)).astype(np.int64))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashes = np.array([digest(normal[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    bytes_of = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _PLACES).ravel(), minlength=2048).reshape(8, 256)
    return int(np.packbits((bytes_of @ _BITS).ravel() * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(text: str) -> Column:
    """The fingerprints of a column of texts."""

    def of_batches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([fingerprint(t) for t in batch], dtype="int64")

    return F.pandas_udf(of_batches, "long")(text)


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _dense_links(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links between a block of queries and a block of table entries."""
    values = np.unique(block["fp"].to_numpy())
    entries, queries = (np.searchsorted(values, block["fp"][block["entry"] == e].to_numpy()) for e in (True, False))
    x = values.view(np.uint64)
    found = np.bitwise_count(x[queries][:, None] ^ x[entries][None, :]) <= 3
    q, e = np.nonzero(found)
    root = forest(queries[q], entries[e], len(values))
    linked = root != np.arange(len(values))
    return pd.DataFrame({"a": values[linked], "b": values[root[linked]]})


def links(unique: DataFrame, distance: int = 3) -> DataFrame:
    """Edges (a, b) that connect all of ``unique`` (fp: long, distinct) within ``distance`` bits, 3 at most.

    Rows are joined where a segment value has few entries, at most DENSE a query. Values with more (their number is
    found by counting, map side first) are cut into blocks that hash on both sides, each pair of blocks is verified
    by one task with numpy, and only the forest of its links is kept, so neither rows nor a task grow as a group's
    square.
    """
    if not 0 <= distance <= 3:
        raise ValueError("two segments with one bit each find distances up to 3")
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", SEGMENT_BITS)
    segments = unique.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("seg"), low.alias("key")), F.struct(F.lit(1).alias("seg"), high.alias("key")))).alias("s")).select("fp", "s.seg", "s.key")
    masks = F.array(*[F.lit(m).cast("long") for m in [0, *(1 << b for b in range(SEGMENT_BITS))]])
    balls = segments.select("fp", "seg", "key", F.explode(masks).alias("mask")).select("fp", "seg", F.col("key").bitwiseXOR(F.col("mask")).alias("key"))
    counted = saved(segments.groupBy("seg", "key").agg(F.count("*").alias("entries")).where(F.col("entries") > DENSE), "dense-keys")
    entry = segments.select(F.col("fp").alias("other"), "seg", "key")
    dense = not counted.isEmpty()
    sparse = entry.join(counted, ["seg", "key"], "left_anti") if dense else entry
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance
    # neither side is broadcast: a ball has 33 rows where Spark's estimate counts one
    joined = balls.hint("merge").join(sparse.hint("merge"), ["seg", "key"]).where((F.col("fp") < F.col("other")) & near).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    if not dense:
        return joined
    blocks = F.ceil(F.col("entries") / F.lit(BLOCK)).cast("int")
    queries = balls.join(counted, ["seg", "key"])
    asked = queries.groupBy("seg", "key").agg(F.count("*").alias("asked"))
    sizes = saved(counted.join(asked, ["seg", "key"]).select("seg", "key", blocks.alias("eb"), F.ceil(F.col("asked") / F.lit(BLOCK)).cast("int").alias("qb")), "dense-sizes")
    own = F.pmod(F.xxhash64("fp"), F.when(F.col("entry"), F.col("eb")).otherwise(F.col("qb"))).cast("int")
    against = F.sequence(F.lit(0), F.when(F.col("entry"), F.col("qb")).otherwise(F.col("eb")) - 1)
    sides = segments.withColumn("entry", F.lit(True)).unionByName(balls.withColumn("entry", F.lit(False)))
    dealt = sides.join(sizes, ["seg", "key"]).select("seg", "key", "fp", "entry", own.alias("own"), F.explode(against).alias("against"))
    pair = [F.when(F.col("entry"), F.col("own")).otherwise(F.col("against")).alias("e"), F.when(F.col("entry"), F.col("against")).otherwise(F.col("own")).alias("q")]
    blocked = dealt.select("seg", "key", *pair, "fp", "entry").groupBy("seg", "key", "e", "q").applyInPandas(_dense_links, "a long, b long")
    return joined.unionByName(blocked)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id whose fingerprint is reachable over links of at most three differing bits. Null
    texts and texts without words have fingerprint 0, which links like any other. Null doc_ids are never the
    smallest while there is another; repeated rows each give a row; other columns are ignored.
    """
    prints = saved(docs.select("doc_id", fingerprints("text").alias("fp")), "fingerprints")
    unique = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "unique-fingerprints")
    component = connected_components(links(unique.select("fp")))
    named = unique.join(component.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_print = saved(named.join(smallest, "component").select("fp", "component_id"), "fingerprint-components")
    return looked_up(prints, "fp", of_print, heavy_keys(unique, "fp", "fp")).select("doc_id", "fp", "component_id")
