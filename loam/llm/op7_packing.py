"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are powers of two: as many of the longest as fit, then
the binary digits of the rest from high to low. Every piece is a sequence of its own in the bucket of its length, so
no sequence crosses documents and none needs padding. There is no shuffle: documents never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loam.llm.tokens import pieces

#: Pieces handed back to Spark at a time, in ids.
BATCH_IDS = 1 << 20


def lengths(n: int, longest: int) -> list[int]:
    """Powers of two, largest first, that add up to n; none above ``longest``, itself a power of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, longest: int = 2048) -> DataFrame:
    """Every piece of every whole text of ``docs`` (doc_id, text) as a sequence.

    Gives doc_id, start (ids of the document before the piece), length, doc_tokens, bucket (log2 of length),
    sequence_id (unique, one per piece), offset (always 0) and ids (unsigned 32-bit bytes). Null and empty texts
    give the end id alone, in the bucket of length 1. Null doc_ids and repeated rows are packed like any other;
    other columns are ignored; an empty table gives no sequence.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, end = pieces(vocabulary), end_id.to_bytes(4, "little")
        rows: list[tuple] = []
        held = 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = table.encode(text.as_py()) + end
                n, start = len(ids) // 4, 0
                for length in lengths(n, longest):
                    rows.append((name, start, length, n, ids[4 * start : 4 * (start + length)]))
                    start += length
                    held += length
                    if held >= BATCH_IDS:
                        yield batch_of()
                        rows, held = [], 0
        if rows:
            yield batch_of()

    cut_up = docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, ids binary")
    return cut_up.select(
        "doc_id", "start", "length", "doc_tokens", F.log2("length").cast("int").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids",
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """One folder per bucket, so that a trainer can batch sequences of equal length."""
    packed.write.partitionBy("bucket").parquet(path)
