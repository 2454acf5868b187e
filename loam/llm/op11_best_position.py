"""Ranked lexical search by the Best Position Algorithm.

Documents are cut into segments. In a segment every term has an impact list: its documents by descending contribution
to a score. An item reads the lists of its terms together. The next access to a list always goes to the first position
whose document has not been seen, and a document's entries in all other lists are fetched directly, so what stands
before a list's best position has all been seen and is never read again. The contributions at the best positions
bound the score of every unseen document; an item stops once that bound is strictly below its k-th score, which is
carried on from segment to segment.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, Window, functions as F

from loam.llm.shared import dropped, saved
from loam.llm.words import word_lists, words

#: Bytes of item texts that one pass over the documents searches for, about; postings in a segment; positions that the first
#: and any later round reads of each list.
BLOCK_BYTES, SEGMENT, FIRST_STEP, MOST_STEP = 1 << 20, 2_000_000, 4, 256
POSTINGS = "n long, terms binary, counts binary"


def weight(n_docs: int, df: int) -> int:
    """A term's weight in thousandths."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norms(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """A document's m; products too large for 64 bits are taken in Python's numbers."""
    if len(n) and 75 * n_docs * int(n.max()) >= 1 << 63:
        return np.array([25 + 75 * int(x) * n_docs // n_terms for x in n], np.int64)
    return 25 + 75 * n * n_docs // n_terms


class Segment:
    """Impact lists over some documents, and each document's entries in them."""

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int):
        """sizes: entries of each document; terms and impacts: document by document; terms are below n_terms."""
        self.rows = np.concatenate([[0], np.cumsum(sizes)])
        self.terms, self.impacts, self.n_terms = terms, impacts, n_terms
        documents = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        order = np.lexsort((-impacts, terms))
        self.list_documents, self.list_impacts = documents[order], impacts[order]
        self.lists = np.searchsorted(terms[order], np.arange(n_terms + 1))

    def _scores(self, documents: np.ndarray, factors: np.ndarray) -> np.ndarray:
        """Direct accesses: a document's entries in all lists stand together."""
        first, sizes = self.rows[documents], self.rows[documents + 1] - self.rows[documents]
        offsets = np.cumsum(sizes) - sizes
        at = np.repeat(first - offsets, sizes) + np.arange(sizes.sum())
        return np.add.reduceat(factors[self.terms[at]] * self.impacts[at], offsets)

    def top(self, terms: np.ndarray, times: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that may be among the k best with at least ``floor``, their scores, and how many documents were seen."""
        at, end = self.lists[terms], self.lists[terms + 1]
        used = at < end
        used[used] = self.list_impacts[at[used]] > 0
        terms, times, at, end = terms[used], times[used], at[used], end[used]
        factors = np.zeros(self.n_terms, np.int64)
        factors[terms] = times
        seen = np.zeros(len(self.rows) - 1, bool)
        documents, scores, step = np.empty(0, np.int64), np.empty(0, np.int64), FIRST_STEP
        kth, n_seen = max(floor, 1), 0
        while len(at) and (times * self.list_impacts[at]).sum() >= kth:
            places = at[:, None] + np.arange(step)
            met = self.list_documents[places[places < end[:, None]]]
            fresh = np.unique(met[~seen[met]])
            seen[fresh] = True
            n_seen += len(fresh)
            found = self._scores(fresh, factors)
            good = found >= kth
            documents, scores = np.concatenate([documents, fresh[good]]), np.concatenate([scores, found[good]])
            if len(scores) >= k:
                kth = max(kth, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                good = scores >= kth
                documents, scores = documents[good], scores[good]
            at = np.minimum(at + step, end)
            at = self._first_unseen(at, end, seen)
            going = at < end
            times, at, end = times[going], at[going], end[going]
            step = min(2 * step, MOST_STEP)
        return documents, scores, n_seen

    def _first_unseen(self, at: np.ndarray, end: np.ndarray, seen: np.ndarray, look: int = 32) -> np.ndarray:
        """The best position of each list, moved on over what other lists have seen."""
        moving = np.nonzero(at < end)[0]
        while len(moving):
            places = at[moving, None] + np.arange(look)
            inside = places < end[moving, None]
            passed = inside & seen[self.list_documents[np.minimum(places, end[moving, None] - 1)]]
            run = np.where(passed.all(1), look, np.argmin(passed, 1))
            at[moving] += run
            moving = moving[(run == look) & (at[moving] < end[moving])]
        return at


def _posted(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of every document with a term: how many it has, and which of ``numbers`` how often."""

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                n, met = 0, [np.empty(0, np.int32)]
                for some in word_lists(text):
                    n += len(some)
                    ids = np.fromiter(map(numbers.get, some, repeat(-1)), np.int32, len(some))
                    met.append(ids[ids >= 0])
                terms, counts = np.unique(np.concatenate(met), return_counts=True)
                rows.append((n, terms.astype("<i4").tobytes(), counts.astype("<i8").tobytes()))
            out = pd.DataFrame(rows, columns=["n", "terms", "counts"])
            out.insert(0, "named", batch["named"].array)
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out[out["n"] > 0]

    kind = docs.schema["doc_id"].dataType
    rows = docs.select(F.coalesce("doc_id", F.lit(0).cast(kind)).alias("doc_id"), F.col("doc_id").isNotNull().alias("named"), "text")
    return rows.mapInPandas(post, f"doc_id {kind.simpleString()}, named boolean, {POSTINGS}")


def _document_counts(posted: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each term occurs, added up in every task first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            for terms in batch["terms"]:
                df[np.frombuffer(terms, "<i4")] += 1
        yield pd.DataFrame({"term": np.nonzero(df)[0], "df": df[df > 0]})

    df = np.zeros(n_terms, np.int64)
    for term, n in posted.select("terms").mapInPandas(count, "term int, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = n
    return df


def _segments(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A batch cut so that each part has about SEGMENT postings."""
    part = np.cumsum([len(t) // 4 for t in batch["terms"]]) // SEGMENT
    for _, some in batch.groupby(part, sort=False):
        yield some


def _searcher(bags: list[tuple[str, np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_words: int, k: int) -> Callable:
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[list[tuple]] = [[] for _ in bags]
        for batch in batches:
            for some in _segments(batch):
                sizes = np.array([len(t) // 4 for t in some["terms"]], np.int64)
                terms = np.frombuffer(b"".join(some["terms"]), "<i4")
                tf = np.frombuffer(b"".join(some["counts"]), "<i8")
                m = np.repeat(length_norms(some["n"].to_numpy(np.int64), n_docs, n_words), sizes)
                segment = Segment(sizes, terms, weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m)), len(weights))
                named, ids = some["named"].to_numpy(), some["doc_id"].to_numpy(object)
                for number, (_, asked, times) in enumerate(bags):
                    known = best[number]
                    documents, scores, _ = segment.top(asked, times, k, -known[-1][0] if len(known) == k else 0)
                    if len(documents):
                        fresh = [(-int(s), not named[d], ids[d]) for d, s in zip(documents.tolist(), scores.tolist(), strict=True)]
                        best[number] = heapq.nsmallest(k, known + fresh)
        rows = [(bags[q][0], doc_id, not missing, -minus) for q, some in enumerate(best) for minus, missing, doc_id in some]
        yield pd.DataFrame(rows, columns=["key", "doc_id", "named", "score"], dtype=object)

    return search


def _ranked_block(docs: DataFrame, texts: list[Row], k: int) -> DataFrame:
    """(key, doc_id, score): the k best documents of each task for some items."""
    bags, numbers = [], {}
    for r in texts:
        counts = Counter(numbers.setdefault(w, len(numbers)) for w in words(r["text"]))
        if counts:
            bags.append((r["key"], np.array(list(counts), np.int64), np.array(list(counts.values()), np.int64)))
    posted = saved(_posted(docs, numbers), "postings", "zstd")
    n_docs, n_words = posted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = _document_counts(posted, len(numbers))
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    schema = f"key string, doc_id {docs.schema['doc_id'].dataType.simpleString()}, named boolean, score long"
    found = saved(posted.mapInPandas(_searcher(bags, weights, n_docs, n_words, k), schema).select("key", F.when(F.col("named"), F.col("doc_id")).alias("doc_id"), "score"), "best-documents")
    dropped(posted)
    return found


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) for every row of ``items`` (item_id, text).

    Equal scores go by ascending doc_id, null ids last; every row of ``docs`` is a document of its own, so repeated rows
    take places of their own; documents without a score above 0 take none. A repeated row of ``items`` gives its
    ranking again. Null texts and texts without terms match nothing, and such documents do not count; empty tables give
    no rows; texts are read whole, a piece at a time; other columns are ignored.

    Items are searched in blocks of about BLOCK_BYTES of distinct texts, each a pass over all documents; what a pass ships to
    tasks is a block's terms. A task holds one segment of postings and k documents an item. Nothing of the postings is
    shuffled: each task's best documents alone are.
    """
    keyed = items.select("item_id", "text", F.sha2("text", 256).alias("key")).where("text is not null")
    size = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks, texts = -(-size // BLOCK_BYTES), keyed.select("key", "text").dropDuplicates(["key"])
    found = [_ranked_block(docs, texts.where(F.pmod(F.xxhash64("key"), F.lit(blocks).cast("long")) == b).collect(), k) for b in range(blocks)]
    if not found:
        return keyed.join(docs.select("doc_id"), F.lit(False)).select("item_id", F.lit(0).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score"))
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = best.withColumn("rank", place).where(F.col("rank") <= k)
    return keyed.select("item_id", "key").join(ranked, "key").select("item_id", "rank", "doc_id", "score")


#: The ranking by all scores, without lists or bounds.
ORACLE_SQL = """
WITH words AS (
  SELECT 'd' AS side, doc_id AS id, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 'q', item_id, unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) FROM benchmark
), lowered AS (
  SELECT side, id, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM words
), lengths AS (
  SELECT id, count(*) AS n FROM lowered WHERE side = 'd' GROUP BY id
), totals AS (
  SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths
), tf AS (
  SELECT id, term, count(*) AS tf FROM lowered WHERE side = 'd' GROUP BY id, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY term, n_docs
), impacts AS (
  SELECT tf.id, tf.term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) AS impact
  FROM tf JOIN lengths USING (id) JOIN weights USING (term), totals
), scores AS (
  SELECT q.id AS item_id, i.id AS doc_id, sum(impact)::BIGINT AS score FROM lowered q JOIN impacts i USING (term) WHERE side = 'q' GROUP BY q.id, i.id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
