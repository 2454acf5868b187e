"""Benchmark decontamination by suffix arrays over the training texts.

The words of benchmark items are numbered. A shard is what a task holds of the documents at a time: its words become
numbers too, runs of words that no item has part the rest (no match crosses one, and runs shorter than the shortest
window hold none), and the suffixes of what is left are sorted. Every test suffix is then searched in every shard by
binary search: the suffixes that begin with its window give all places of the window, and its neighbours give its longest
verbatim match.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from loam.llm.shared import saved
from loam.llm.words import word_lists, words

WINDOW = 10
#: Bytes of item texts that one broadcast holds, about; words in a shard; words compared at a time.
BLOCK_BYTES, SHARD_WORDS, STRIDE = 1 << 20, 1_000_000, 16
HITS = "n_words long, n_hit long, hits binary, items array<string>"


class Tests(NamedTuple):
    """Items as numbers: words (0 parts items), where each suffix with a window starts, its item, window and its words left."""

    numbers: dict[bytes, int]
    text: np.ndarray
    starts: np.ndarray
    left: np.ndarray
    item: np.ndarray
    window: np.ndarray
    names: list[str | None]
    shortest: int


def tests_of(rows: list[Row], window: int = WINDOW) -> Tests:
    numbers: dict[bytes, int] = {}
    text, starts, left, item, width, names = [], [], [], [], [], []
    for row in rows:
        ids = [numbers.setdefault(w, len(numbers) + 1) for w in words(row["text"])]
        if ids:
            size = min(window, len(ids))
            places = range(len(ids) - size + 1)
            starts += [len(text) + p for p in places]
            left += [len(ids) - p for p in places]
            item += [len(names)] * len(places)
            width += [size] * len(places)
            names.append(row["item_id"])
            text += [*ids, 0]
    as_array = lambda x: np.array(x, np.int64)
    return Tests(numbers, np.array(text + [0] * STRIDE, np.int32), as_array(starts), as_array(left), as_array(item), as_array(width), names, min(width, default=window))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``text`` by their first ``depth`` numbers at least, by doubling the numbers that ranks stand for."""
    rank, order, width = text.astype(np.int64), np.argsort(text, kind="stable"), 1
    while width < depth:
        after = np.zeros(len(rank), np.int64)
        after[:-width] = rank[width:] + 1
        key = rank * (int(after.max(initial=0)) + 1) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(len(order), np.int64)
        rank[order] = fresh
        width *= 2
        if len(fresh) == 0 or fresh[-1] == len(fresh) - 1:
            break
    return order


def compare(text: np.ndarray, at: np.ndarray, test: np.ndarray, start: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of places: the sign of the suffix of ``text`` against that of ``test`` over ``limit`` words, and
    how many words they share. ``text`` ends in STRIDE zeros, as ``test`` does."""
    sign, shared = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    going, ahead = np.nonzero(limit > 0)[0], np.arange(STRIDE)
    while len(going):
        done, room = shared[going], limit[going]
        x = text[np.minimum(at[going] + done, len(text) - STRIDE)[:, None] + ahead]
        y = test[np.minimum(start[going] + done, len(test) - STRIDE)[:, None] + ahead]
        apart = (x != y) & (done[:, None] + ahead < room[:, None])
        first = np.argmax(apart, 1)
        some = apart[np.arange(len(going)), first]
        sign[going] = np.where(some, np.sign(x[np.arange(len(going)), first].astype(np.int64) - y[np.arange(len(going)), first]), 0)
        shared[going] = np.where(some, done + first, np.minimum(done + STRIDE, room))
        going = going[~some & (done + STRIDE < room)]
    return sign, shared


class Shard:
    """The suffix array of some documents' words that items have, and where each of them stands."""

    def __init__(self, parts: list[tuple[int, np.ndarray]], shortest: int, depth: int):
        """parts: document and the numbers of its words, 0 where no item has the word."""
        sizes = np.array([len(ids) for _, ids in parts], np.int64)
        words_of = np.concatenate([x for _, ids in parts for x in (ids, np.zeros(1, np.int32))])
        known = words_of > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[0], known, [0]]).astype(np.int8)))
        first, last = edges[::2], edges[1::2]
        kept = last - first >= shortest
        first, last = first[kept], last[kept]
        # a run and the zero after it
        run = last - first + 1
        places = np.repeat(first - (np.cumsum(run) - run), run) + np.arange(run.sum())
        self.text = np.concatenate([words_of[places], np.zeros(STRIDE, np.int32)]).astype(np.int32)
        begins = np.concatenate([[0], np.cumsum(sizes + 1)])
        part = np.searchsorted(begins, places, side="right") - 1
        self.document = np.array([d for d, _ in parts], np.int64)[part]
        self.place = places - begins[part]
        order = suffix_array(self.text[: len(places)], depth)
        self.array = order[self.text[order] > 0]

    def _bound(self, tests: Tests, asked: np.ndarray, limit: np.ndarray, low: np.ndarray, high: np.ndarray, past: bool) -> np.ndarray:
        """By binary search in [low, high): the first suffix that is not below (past: that is above) each asked one's first words."""
        low, high = low.copy(), high.copy()
        going = np.nonzero(low < high)[0]
        while len(going):
            middle = (low[going] + high[going]) // 2
            sign, _ = compare(self.text, self.array[middle], tests.text, tests.starts[asked[going]], limit[going])
            below = (sign < 0) | (past & (sign == 0))
            low[going] = np.where(below, middle + 1, low[going])
            high[going] = np.where(below, high[going], middle)
            going = going[low[going] < high[going]]
        return low

    def occurrences(self, tests: Tests, asked: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with the first ``limit`` words of each asked test suffix."""
        zero, size = np.zeros(len(asked), np.int64), np.full(len(asked), len(self.array))
        low = self._bound(tests, asked, limit, zero, size, False)
        return low, self._bound(tests, asked, limit, low, size, True)

    def longest(self, tests: Tests, asked: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The words that each asked suffix shares with the suffix of its range [low, high) that shares most."""
        left = tests.left[asked]
        at = self._bound(tests, asked, left, low, high, False)
        best = np.zeros(len(asked), np.int64)
        for near in (at - 1, at):
            inside = (near >= low) & (near < high)
            _, shared = compare(self.text, self.array[np.where(inside, near, low)], tests.text, tests.starts[asked], left)
            best = np.where(inside, np.maximum(best, shared), best)
        return best


def _expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, place) for every place of the ranges."""
    size = high - low
    which = np.repeat(np.arange(len(low)), size)
    return which, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)


def shards(texts: Iterator[tuple[int, str | None]], tests: Tests, depth: int, counts: dict[int, int]) -> Iterator[Shard]:
    """Shards of about SHARD_WORDS words; a document is never split. counts: takes the words of every document."""
    parts, size = [], 0
    for document, text in texts:
        n, met = 0, []
        for some in word_lists(text):
            n += len(some)
            met.append(np.fromiter(map(tests.numbers.get, some, repeat(0)), np.int32, len(some)))
        counts[document] = n
        if n >= tests.shortest:
            parts.append((document, np.concatenate(met)))
            size += n
        if size >= SHARD_WORDS:
            yield Shard(parts, tests.shortest, depth)
            parts, size = [], 0
    if parts:
        yield Shard(parts, tests.shortest, depth)


def _merged(edges: np.ndarray) -> np.ndarray:
    """Ranges (first, end) as the fewest that cover the same words, in order."""
    edges = edges[np.lexsort((edges[:, 1], edges[:, 0]))]
    reach = np.maximum.accumulate(edges[:, 1])
    fresh = np.concatenate([[True], edges[1:, 0] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(fresh)[1:] - 1, [len(edges) - 1]])
    return np.stack([edges[fresh, 0], reach[last]], 1)


class Windows(NamedTuple):
    """The different windows of the tests: a test suffix that begins with each, its words, and the items that hold it."""

    suffix: np.ndarray
    width: np.ndarray
    items: list[frozenset[int]]


def windows_of(tests: Tests) -> Windows:
    by_words: dict[bytes, list[int]] = {}
    for k, (start, width) in enumerate(zip(tests.starts.tolist(), tests.window.tolist(), strict=True)):
        by_words.setdefault(tests.text[start : start + width].tobytes(), []).append(k)
    suffix = np.array([found[0] for found in by_words.values()], np.int64)
    return Windows(suffix, tests.window[suffix], [frozenset(tests.item[found].tolist()) for found in by_words.values()])


def _hit_by(tests: Tests) -> Callable:
    """A function of the texts of a batch: per text its words, its hit ranges and the items whose windows it holds."""
    windows = windows_of(tests)
    depth = int(tests.window.max(initial=1))

    def mark(texts: pd.Series) -> tuple[list[int], dict[int, np.ndarray], dict[int, set[int]]]:
        counts: dict[int, int] = {}
        hits: dict[int, list[np.ndarray]] = {}
        items: dict[int, set[int]] = {}
        for shard in shards(enumerate(texts), tests, depth, counts):
            low, high = shard.occurrences(tests, windows.suffix, windows.width)
            which, at = _expanded(low, high)
            at = shard.array[at]
            document, first = shard.document[at], shard.place[at]
            order = np.argsort(document, kind="stable")
            borders = np.flatnonzero(np.diff(document[order])) + 1
            for some in np.split(order, borders) if len(order) else []:
                number = int(document[some[0]])
                hits[number] = _merged(np.stack([first[some], first[some] + windows.width[which[some]]], 1))
                items[number] = set().union(*[windows.items[w] for w in np.unique(which[some]).tolist()])
        return [counts[k] for k in range(len(counts))], hits, items

    return mark


def _marker(tests: Tests, spark: SparkSession) -> Callable:
    """Text, hit ranges so far, items so far -> HITS."""
    sent = spark.sparkContext.broadcast(tests)

    def marked(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        tests = sent.value
        mark = _hit_by(tests)
        for texts, hits_before, items_before in batches:
            counts, hits, items = mark(texts)
            rows = []
            for k, (n, known, listed) in enumerate(zip(counts, hits_before, items_before, strict=True)):
                edges = np.concatenate([np.frombuffer(known, "<i8").reshape(-1, 2), hits.get(k, np.empty((0, 2), np.int64))])
                edges = _merged(edges) if len(edges) else edges
                named = {*listed, *(tests.names[i] for i in items.get(k, ()) if tests.names[i] is not None)}
                rows.append((n, int((edges[:, 1] - edges[:, 0]).sum()), edges.astype("<i8").tobytes(), sorted(named)))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "hits", "items"], dtype=object)

    return F.pandas_udf(marked, HITS)


def _blocks(items: DataFrame) -> list[list[Row]]:
    """The different items, as text ids, in lists of about BLOCK_BYTES of text."""
    named = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").distinct()
    size = named.agg(F.coalesce(F.sum(F.octet_length("text") + F.lit(1)), F.lit(0))).first()[0]
    n = -(-size // BLOCK_BYTES)
    return [named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n).cast("long")) == b).collect() for b in range(n)]


def contamination(docs: DataFrame, items: DataFrame, column: str = "found", window: int = WINDOW) -> DataFrame:
    """``docs`` (text) with the struct ``column`` after its own columns: n_words, n_hit (words inside an occurrence of an item's
    window), hits (their ranges, as pairs of little-endian longs) and items (the ids with occurring windows, as strings in order).

    ``items`` has item_id and text; an item of fewer words than a window is one window. Null and empty texts have no words, and
    such items no windows; an item without an id makes hits and is not listed; rows of one id are one item; repeated
    documents each give a row; texts are read whole, a piece at a time; other columns are not read. Empty tables give empty
    results, or no hits. What is broadcast is a block of items of about BLOCK_BYTES; more items take more passes over the
    texts, each of which adds to what the ones before have found. Nothing is shuffled.
    """
    found = F.struct(F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(b"").alias("hits"), F.array().cast("array<string>").alias("items"))
    marked = docs.withColumn(column, found)
    for block in _blocks(items) or [[]]:
        mark = _marker(tests_of(block, window), docs.sparkSession)
        marked = marked.withColumn(column, mark("text", F.col(column)["hits"], F.col(column)["items"]))
    return marked


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` whose texts hold no window of any item; rows are kept or go whole, by contamination()'s rules."""
    name = "found"
    while name in docs.columns:
        name = f"_{name}"
    return contamination(docs, items, name, window).where(F.col(name)["n_hit"] == 0).drop(name)


def longest_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, item_start, length, doc_id, doc_start): for every test suffix that begins with a window of the documents, its
    longest verbatim match in all of them, in words, and every place where a match of that length stands.

    Rows of equal ids and texts are one item. Shards give their longest matches; the longest of all stay, which takes one count a
    suffix and shard through a shuffle, and the places. Nulls, empty texts and tables as in contamination().
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    schema = f"item_id string, item_start long, length long, doc_id {kind.simpleString()}, named boolean, doc_start long"

    def matcher(tests: Tests) -> Callable:
        sent = spark.sparkContext.broadcast(tests)

        def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tests = sent.value
            every, depth = np.arange(len(tests.starts)), int(tests.left.max(initial=1))
            for batch in batches:
                ids, named = batch["doc_id"].to_numpy(), batch["named"].to_numpy()
                for shard in shards(enumerate(batch["text"]), tests, depth, {}):
                    low, high = shard.occurrences(tests, every, tests.window)
                    asked = every[low < high]
                    length = shard.longest(tests, asked, low[asked], high[asked])
                    which, at = _expanded(*shard.occurrences(tests, asked, length))
                    suffix, at = asked[which], shard.array[at]
                    first = np.searchsorted(tests.item, tests.item[suffix])
                    yield pd.DataFrame({
                        "item_id": pd.Series([tests.names[k] for k in tests.item[suffix]], dtype=object), "item_start": tests.starts[suffix] - tests.starts[first], "length": length[which],
                        "doc_id": ids[shard.document[at]], "named": named[shard.document[at]], "doc_start": shard.place[at],
                    })

        return match

    found, rows = None, docs.select(F.coalesce("doc_id", F.lit(0).cast(kind)).alias("doc_id"), F.col("doc_id").isNotNull().alias("named"), "text")
    for block in _blocks(items) or [[]]:
        some = rows.mapInPandas(matcher(tests_of(block, window)), schema)
        found = some if found is None else found.unionByName(some)
    found = saved(found.withColumn("doc_id", F.when(F.col("named"), F.col("doc_id"))).drop("named"), "matches")
    best = found.groupBy(F.col("item_id").alias("of"), F.col("item_start").alias("at")).agg(F.max("length").alias("most"))
    same = F.col("item_id").eqNullSafe(F.col("of")) & (F.col("item_start") == F.col("at")) & (F.col("length") == F.col("most"))
    return found.join(best, same).select("item_id", "item_start", "length", "doc_id", "doc_start")


#: Windows as joined strings: every length that an item's window has, against all windows of that length in the documents.
ORACLE_SQL = """
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), wanted AS (
  SELECT DISTINCT item_id, size, array_to_string(words[p:p + size - 1], ' ') AS run
  FROM (SELECT item_id, words, least(10, len(words)) AS size, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS p FROM items WHERE len(words) > 0)
), docs AS (
  SELECT row_number() OVER () AS k, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
  FROM documents
), runs AS (
  SELECT k, size, p, array_to_string(words[p:p + size - 1], ' ') AS run
  FROM (SELECT k, words, size, unnest(range(1, len(words) - size + 2)) AS p FROM docs, (SELECT DISTINCT size FROM wanted) WHERE len(words) >= size)
), met AS (
  SELECT k, p, w.size, item_id FROM runs r JOIN wanted w ON r.size = w.size AND r.run = w.run
), hit AS (
  SELECT k, count(DISTINCT place) AS n_hit FROM (SELECT k, unnest(range(p, p + size)) AS place FROM met) GROUP BY k
), listed AS (
  SELECT k, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS id FROM met) GROUP BY k
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (k) LEFT JOIN listed USING (k)
"""
