"""Quality rules as a short-circuit cascade.

Every document gets the base measures. One that passes the base test meets further rules, and leaves at the
first that rejects it. A rule's cost and its share of rejections are estimated on a sample inside Spark tasks, and the
rules run in the order of rejections per cost. The order changes the time taken, never the verdict.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from loam.llm.shared import hashed_share

#: The signs counted, and a window's words.
SYMBOLS, WINDOW = "#*$%&|<>", 8
#: Documents in the sample that rules are measured on, about.
SAMPLE = 2000
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words in windows of 8 that occur twice or more in the text, the first of them too.

    Windows are told apart exactly: numbers of words are paired to numbers of 2, 4 and 8 words.
    """
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[str, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    if len(numbers) == n:
        return 0
    width = 1
    while width < window:
        ids = np.unique(ids[:-width] * (int(ids.max()) + 1) + ids[width:], return_inverse=True)[1]
        width *= 2
    again = np.bincount(ids)[ids] > 1
    if not again.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    at = np.nonzero(again)[0]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:n]) > 0).sum())


class Page:
    """A text with the measures that more than one rule needs."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.words = _WORDS.findall(self.text)
        self.n_words = len(self.words)
        self.word_chars = len(self.text) - sum(map(self.text.count, " \t\n\v\f\r"))
        self.n_symbols = sum(map(self.text.count, SYMBOLS))
        self.n_lines = self.n_dup_lines = 0
        seen = set()
        for line in self.text.split("\n"):
            if _WORDS.search(line):
                self.n_lines += 1
                self.n_dup_lines += line in seen
                seen.add(line)
        self.n_repeat_words = repeated_words(self.words)
        self.base_failed = self.n_words < 20 or 100 * self.n_repeat_words > 30 * self.n_words


#: A rule rejects a page. All compare whole numbers, so that SQL says the same.
RULES: dict[str, Callable[[Page], bool]] = {
    "symbols": lambda p: 10 * p.n_symbols > p.n_words,
    "short_words": lambda p: p.word_chars < 2 * p.n_words,
    "long_words": lambda p: p.word_chars > 15 * p.n_words,
    "repeated_lines": lambda p: p.n_dup_lines > 2 and 100 * p.n_dup_lines > 30 * p.n_lines,
    "exclamations": lambda p: 5 * p.text.count("!") > p.n_words,
    "capitals": lambda p: 2 * (len(b := p.text.encode("utf-8", "surrogatepass")) - len(b.translate(None, _CAPITALS))) > p.word_chars,
    "wordless": lambda p: 10 * sum(1 for w in p.words if w.isalpha() or any(map(str.isalpha, w))) < 7 * p.n_words,
    "one_word": lambda p: 5 * Counter(p.words).most_common(1)[0][1] > 2 * p.n_words,
}


def rejected(page: Page, order: list[str]) -> bool:
    """True at the first rule, in this order, that rejects the page."""
    return any(RULES[name](page) for name in order)


def measured_order(docs: DataFrame, sample: int = SAMPLE) -> list[str]:
    """The rules by rejections per second on a sample of about ``sample`` documents taken by hash."""
    share = hashed_share(docs.count(), sample)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cost, hits, pages = Counter(), Counter(), 0
        for batch in batches:
            for page in map(Page, batch["text"]):
                if page.base_failed:
                    continue
                pages += 1
                for name, rule in RULES.items():
                    began = time.perf_counter()
                    hits[name] += rule(page)
                    cost[name] += time.perf_counter() - began
        if pages:
            yield pd.DataFrame({"rule": list(RULES), "pages": pages, "rejected": [hits[r] for r in RULES], "seconds": [cost[r] for r in RULES]})

    taken = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1_000_000)) < share).select("text").where("text is not null")
    rows = taken.mapInPandas(measure, "rule string, pages long, rejected long, seconds double").groupBy("rule").agg(F.sum("rejected").alias("n"), F.sum("seconds").alias("s")).collect()
    worth = {r.rule: r.n / max(r.s, 1e-9) for r in rows}
    return sorted(RULES, key=lambda name: (-worth.get(name, 0.0), list(RULES).index(name)))


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def judge(order: list[str]):
    """Text -> struct of the base measures and the verdict. Null is a text without words, which fails the base test."""

    def measures(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for page in map(Page, batch):
                rows.append((page.n_words, page.word_chars, page.n_symbols, page.n_dup_lines, page.n_repeat_words, page.base_failed, not page.base_failed and not rejected(page, order)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MEASURES.split(", ")])

    return F.pandas_udf(measures, MEASURES)


def apply_rules(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, base measures, base_failed, kept) for every row of ``docs`` (doc_id, text).

    Null and empty texts have no words and fail the base test. A very long text is read whole, with a few integers a word.
    Null doc_ids and repeated rows each give a row; other columns are ignored; an empty table gives an empty result.
    """
    found = docs.select("doc_id", judge(measured_order(docs, sample))("text").alias("m"))
    return found.select("doc_id", "m.*")


ORACLE_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols
  FROM t
), places AS (
  SELECT k, n_words, unnest(range(1, n_words - 6)) AS p, words
  FROM (SELECT k, words, len(words) AS n_words FROM w) WHERE n_words > 8
), windows AS (
  SELECT k, p, count(*) OVER (PARTITION BY k, array_to_string(words[p:p + 7], ' ')) AS n FROM places
), repeats AS (
  SELECT k, count(DISTINCT p + d) AS n_repeat_words
  FROM (SELECT k, p FROM windows WHERE n > 1), (SELECT unnest(range(0, 8)) AS d) GROUP BY k
), base AS (
  SELECT w.k, doc_id, text, words, lines, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         n_symbols::BIGINT AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN repeats ON w.k = repeats.k
), judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         length(text) - length(replace(text, '!', '')) AS n_exclaims,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
         len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS n_lettered,
         coalesce(list_max(map_values(list_histogram(words))), 0) AS n_top
  FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
         OR n_dup_lines > 2 AND 100 * n_dup_lines > 30 * len(lines) OR 5 * n_exclaims > n_words OR 2 * n_capitals > word_chars
         OR 10 * n_lettered < 7 * n_words OR 5 * n_top > 2 * n_words) AS kept
FROM judged
"""
