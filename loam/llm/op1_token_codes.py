"""Token-ID output as directly addressable codes, and reading it back.

Ids are cut into chunks of eight bits. Level k holds the k-th chunk of every id that has one; a bitmap beside it
marks the ids that go on at the next level, and a rank directory counts the marks before every 512th place. An id
is found by its place alone: take its chunk, and while its mark is set go to place rank(mark) of the next level.
No block is ever decoded to reach a token inside it.

A shard is what one task writes: segments of whole documents in ascending doc_id order, stored as Parquet rows
whose ``codes`` column is the binary form above. Parquet is only the envelope, so that Spark's committer makes the
output survive lost executors and any store that Spark can write to will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from loam.llm.shared import new_path
from loam.llm.tokens import pieces

#: Ids in a segment, unless one document has more; and the places between two entries of a rank directory.
SEGMENT_IDS, RANK_EVERY = 1 << 17, 512
SEGMENTS = "shard int, segment int, shard_start long, n_ids long, doc_ids array<bigint>, doc_lengths array<bigint>, codes binary"


def encode_codes(ids: np.ndarray) -> bytes:
    """Unsigned 32-bit ids -> header (levels, then each level's length), and for each level chunks, bitmap, directory."""
    levels, rest = [], ids.astype("<u4")
    while True:
        more = rest > 255
        marks = np.packbits(more, bitorder="little")
        counts = np.add.reduceat(np.bitwise_count(marks), np.arange(0, len(marks), RANK_EVERY // 8), dtype=np.uint32) if len(marks) else np.zeros(0, np.uint32)
        before = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4") if len(counts) else counts.astype("<u4")
        levels.append((len(rest), rest.astype(np.uint8).tobytes() + marks.tobytes() + before.tobytes()))
        rest = rest[more] >> 8
        if not len(rest):
            break
    return np.array([len(levels), *(n for n, _ in levels)], dtype="<u4").tobytes() + b"".join(body for _, body in levels)


class Codes:
    """Reads ids from what encode_codes() made: one by its place, or a run of them."""

    def __init__(self, data: bytes):
        n_levels = int(np.frombuffer(data, "<u4", 1)[0])
        sizes = np.frombuffer(data, "<u4", n_levels, 4).tolist()
        self.levels, at = [], 4 * (1 + n_levels)
        for n in sizes:
            chunks = np.frombuffer(data, np.uint8, n, at)
            marks = np.frombuffer(data, np.uint8, -(-n // 8), at + n)
            before = np.frombuffer(data, "<u4", -(-len(marks) // (RANK_EVERY // 8)), at + n + len(marks))
            at += n + len(marks) + 4 * len(before)
            self.levels.append((chunks, marks, before))
        self.n_ids = sizes[0]

    def rank(self, level: int, place: int) -> int:
        """Marks of a level before a place."""
        _, marks, before = self.levels[level]
        block, byte = place // RANK_EVERY, place // 8
        if block == len(before):
            block -= 1
        n = int(before[block]) + int(np.bitwise_count(marks[block * (RANK_EVERY // 8) : byte]).sum())
        return n + int(marks[byte] & ((1 << place % 8) - 1)).bit_count() if place % 8 else n

    def __getitem__(self, place: int) -> int:
        if not 0 <= place < self.n_ids:
            raise IndexError(place)
        value = 0
        for level, (chunks, marks, _) in enumerate(self.levels):
            value |= int(chunks[place]) << 8 * level
            if not marks[place // 8] >> place % 8 & 1:
                break
            place = self.rank(level, place)
        return value

    def run(self, start: int, length: int) -> np.ndarray:
        """The ids of places start to start + length, with one rank a level."""
        ids, at, places = np.zeros(length, "<u4"), start, np.arange(length)
        for level, (chunks, marks, _) in enumerate(self.levels):
            n = len(places)
            if not n:
                break
            ids[places] |= chunks[at : at + n].astype(np.uint32) << np.uint32(8 * level)
            bits = np.unpackbits(marks[at // 8 : (at + n + 7) // 8], bitorder="little")[at % 8 : at % 8 + n].astype(bool)
            if bits.any():
                at = self.rank(level, at)
            places = places[bits]
        return ids


def write_codes(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0) -> None:
    """Encode every whole text of ``docs`` (doc_id, text) and write shards in ascending doc_id order.

    Null and empty texts give the end id alone; a null doc_id sorts first; repeated rows are written as often as
    they occur, ordered by text hash so that reruns agree and one id's many rows spread over several shards. Other
    columns are ignored. An empty table gives an empty file set. Rows reach the encoder range-partitioned as text,
    so nothing is encoded twice and a lost executor repeats its own ranges alone.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("shard_start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("codes", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, end = pieces(vocabulary), end_id.to_bytes(4, "little")
        shard, segment, written, ids, held = TaskContext.get().partitionId(), 0, 0, [], 0
        doc_ids: list = []

        def flush() -> pa.RecordBatch:
            data = np.frombuffer(b"".join(ids), "<u4")
            row = [[shard], [segment], [written], [len(data)], [doc_ids], [[len(x) // 4 for x in ids]], [encode_codes(data)]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            names = batch.column(0).to_pylist()
            for name, text in zip(names, batch.column(1), strict=True):
                doc_ids.append(name)
                ids.append(table.encode(text.as_py()) + end)
                held += len(ids[-1]) // 4
                if held >= SEGMENT_IDS:
                    yield flush()
                    written, segment, ids, doc_ids, held = written + held, segment + 1, [], [], 0
        if ids:
            yield flush()

    ordered.select("doc_id", "text").mapInArrow(encode, SEGMENTS).write.option("compression", "zstd").parquet(path)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the shards at ``path``; ids are unsigned 32-bit bytes.

    Only one total per shard is gathered to find where shards start, and there are no more shards than the writing
    stage had tasks, which bounds the broadcast.
    """
    shards = spark.read.schema(SEGMENTS).parquet(path)
    totals = shards.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    starts = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    placed = shards.join(F.broadcast(starts), "shard").select((F.col("before") + F.col("shard_start")).alias("start"), "doc_ids", "doc_lengths", "codes")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                start, names, lengths, codes = (c[k].as_py() for c in batch.columns)
                ids = Codes(codes).run(0, sum(lengths)).tobytes()
                ends = np.cumsum(lengths)
                firsts = ends - lengths
                cut = [ids[4 * a : 4 * b] for a, b in zip(firsts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(firsts + start, pa.int64()), pa.array(lengths, pa.int64()), pa.array(cut, pa.binary())], schema=schema)

    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def token_codes(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` as directly addressable codes to a new folder of the shared store and read them back."""
    path = new_path(docs.sparkSession, "token-codes")
    write_codes(docs, path, vocabulary, end_id)
    return read_codes(docs.sparkSession, path)
