"""Toxicity by non-negative positive-unlabelled learning.

The classifier sees documents confirmed toxic and documents of unknown kind, never a confirmed clean one. With the
class prior p, the risk of calling toxic text clean is p * R(confirmed, toxic); the risk on clean text is what remains of
R(unlabelled, clean) when p * R(confirmed, clean) is taken away. That difference cannot be negative in truth, so
when a step finds it so, the step goes the other way and undoes the overfitting (Kiryo et al., 2017).

Features are words and the first letters of words, present or not. Those that stand out in confirmed documents are
found by counting documents in Spark over all training documents. Then every training document is what it holds of them, so
equal ones are one row with a count. These rows are dealt out by hash, each task fits a classifier of its own to the
confirmed rows and its share of the unlabelled ones, and the model is the mean of the classifiers by documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from loam.llm.learning import Adam, fold, sigmoid
from loam.llm.shared import hashed_share, lean, saved

#: The most confirmed documents that are learned from (a parameter of train()), unlabelled rows for one classifier (about), and the
#: fewest confirmed documents a feature needs.
MOST_CONFIRMED, SHARE_ROWS, LEAST_DOCUMENTS = 40_000, 8000, 5
#: How many standard errors a feature must stand out by, and the least share of toxic documents among those that have it.
LEAST_Z, LEAST_SHARE = 5.0, 0.5
#: Different features a task counts before it passes them on.
MOST_COUNTED = 300_000
#: Words whose features a worker keeps.
MOST_WORDS = 200_000
STARTS, FOLDS = (3, 4, 5, 6), 5
_LETTERS = re.compile(r"[^\W\d_]+")


#: For texts of ASCII alone: letters lower-cased, all else blanks.
_ASCII = "".join(chr(c).lower() if chr(c).isalpha() else " " for c in range(128))


def words_of(text: str | None) -> set[str]:
    """The distinct runs of letters of a text, lower-cased."""
    if not isinstance(text, str):
        return set()
    return set(text.translate(_ASCII).split()) if text.isascii() else set(_LETTERS.findall(text.lower()))


def of_word(word: str) -> tuple[str, ...]:
    """A word as ``=word``, and the beginnings of a longer one."""
    return ("=" + word, *(word[:n] for n in STARTS if len(word) > n))


class WordTable(dict):
    """Word -> what ``make`` gives for it, kept for up to MOST_WORDS words."""

    def __init__(self, make: Callable[[str], tuple]):
        self.make = make

    def __missing__(self, word: str) -> tuple:
        if len(self) >= MOST_WORDS:
            self.clear()
        found = self[word] = self.make(word)
        return found

    def union(self, text: str | None) -> set:
        """What a text's words give, each once."""
        return set().union(*map(self.__getitem__, words_of(text)))

    def distinct(self, text: str | None) -> np.ndarray:
        """The same of numbers, in order."""
        return np.unique(np.fromiter(chain.from_iterable(map(self.__getitem__, words_of(text))), np.int64))


class Finder:
    """Finds those of some features that a text has, by their places in the list; most words are passed over at a glance."""

    def __init__(self, chosen: list[str]):
        self.whole = {f[1:]: k for k, f in enumerate(chosen) if f[:1] == "="}
        self.starts = {f: k for k, f in enumerate(chosen) if f[:1] != "="}
        self.first = {f[: STARTS[0]] for f in self.starts}

    def places(self, text: str | None) -> list[int]:
        words = words_of(text)
        found = {self.whole[w] for w in words & self.whole.keys()}
        for w in [w for w in words if w[: STARTS[0]] in self.first]:
            found.update([self.starts[w[:n]] for n in STARTS if len(w) > n and w[:n] in self.starts])
        return sorted(found)


def features(text: str) -> set[str]:
    """Distinct words as ``=word`` and beginnings of longer words, lower-cased."""
    return WordTable(of_word).union(text)


class Sparse:
    """0/1 rows by the places of their ones, each with how many documents it stands for."""

    def __init__(self, rows: list[list[int]], counts: np.ndarray, width: int):
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        self.of = np.repeat(np.arange(len(rows)), lengths)
        self.places = np.fromiter((p for row in rows for p in row), np.int64, int(lengths.sum()))
        self.share, self.width = np.asarray(counts, float) / np.sum(counts), width

    def sums(self, w: np.ndarray) -> np.ndarray:
        """Each row times the weights, bias last."""
        return np.bincount(self.of, w[self.places], len(self.share)) + w[-1]

    def back(self, values: np.ndarray) -> np.ndarray:
        """The mean gradient of a value per row."""
        v = values * self.share
        return np.append(np.bincount(self.places, v[self.of], self.width), v.sum())


def nnpu(confirmed: Sparse, unlabelled: Sparse, prior: float, steps: int = 400, rate: float = 0.05, l2: float = 1e-4) -> np.ndarray:
    """Weights, bias last, that lower the non-negative risk with logistic loss."""
    w = np.zeros(confirmed.width + 1)
    w[-1] = np.log(prior / (1 - prior))
    adam = Adam(len(w), rate)
    for _ in range(steps):
        sp, su = sigmoid(confirmed.sums(w)), sigmoid(unlabelled.sums(w))
        clean = -(unlabelled.share * np.log(1 - su + 1e-12)).sum() + prior * (confirmed.share * np.log(1 - sp + 1e-12)).sum()
        of_clean = unlabelled.back(su) - prior * confirmed.back(sp)
        of_toxic = prior * confirmed.back(sp - 1)
        w -= adam.step((of_toxic + of_clean if clean >= 0 else -of_clean) + l2 * np.append(w[:-1], 0))
    return w


def stand_out(outside: DataFrame, prior: float) -> list[str]:
    """The features of confirmed documents, by counts over all rows of ``outside`` (text, confirmed), best first.

    First the confirmed documents, whose number is bounded, are counted: what LEAST_DOCUMENTS of them have is a candidate.
    Then tasks count the candidates in all documents and pass on a row for each. Features that stand out by LEAST_Z, and by
    LEAST_SHARE are mostly toxic, come to the driver.
    """

    def of_confirmed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, table = Counter(), WordTable(of_word)
        for batch in batches:
            for text in batch["text"]:
                seen.update(table.union(text))
            if len(seen) > MOST_COUNTED:
                yield from passed_on(seen)
                seen = Counter()
        yield from passed_on(seen)

    confirmed = outside.where("confirmed = 1").select("text").mapInPandas(lean(of_confirmed), "feature string, n long").groupBy("feature").agg(F.sum("n").alias("c"))
    held = {r.feature: r.c for r in confirmed.where(F.col("c") >= LEAST_DOCUMENTS).collect()}
    if not held:
        return []
    names = sorted(held)
    place = {f: k for k, f in enumerate(names)}

    def of_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = WordTable(lambda word: tuple(place[f] for f in of_word(word) if f in place))
        counts = np.zeros(len(place), np.int64)
        for batch in batches:
            for text in batch["text"]:
                counts[table.distinct(text)] += 1
        some = np.nonzero(counts)[0]
        yield pd.DataFrame({"place": some, "n": counts[some]})

    n = outside.agg(F.sum("confirmed").alias("c"), F.count("*").alias("u")).first()
    nc, nu = max(1, n.c or 0), max(1, n.u)
    told = []
    for r in outside.select("text").mapInPandas(lean(of_all), "place int, n long").groupBy("place").agg(F.sum("n").alias("u")).collect():
        c, u = held[names[r.place]], r.u
        z = (c / nc - u / nu) / ((c + u + 1) / (nc + nu) * (1 / nc + 1 / nu)) ** 0.5
        if z > LEAST_Z and prior * c / nc >= LEAST_SHARE * u / nu:
            told.append((-z, names[r.place]))
    return [f for _, f in sorted(told)]


def passed_on(seen: Counter) -> Iterator[pd.DataFrame]:
    names = list(seen)
    for k in range(0, len(names), 50_000):
        some = names[k : k + 50_000]
        yield pd.DataFrame({"feature": pd.Series(some, dtype=object), "n": [seen[f] for f in some]})


def train(docs: DataFrame, labels: DataFrame, most_confirmed: int = MOST_CONFIRMED) -> dict[str, float]:
    """Feature -> weight, the bias under the empty string.

    Learns from documents outside fold 0: those with a label ``toxic`` = 1 are confirmed; the unlabelled are all
    documents, taken without a look at any label. The prior is the share of 1 among labels outside fold 0. Of the
    confirmed ones at most ``most_confirmed`` different rows are fitted to, the first by hash; nothing else is
    sampled. Without any confirmed document nothing is toxic.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n_toxic:
        return {"": -30.0}
    prior = min(0.9, n_toxic / n)
    bias = {"": float(np.log(prior / (1 - prior)))}
    outside = docs.select("doc_id", "text").where(F.col("text").isNotNull() & F.coalesce(fold(F.col("doc_id"), FOLDS) != 0, F.lit(False)))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000))
    toxic = known.where((F.col("toxic") == 1) & (draw < hashed_share(n_toxic, most_confirmed))).select(F.col("doc_id").alias("of"))  # bounded, so broadcast
    marked = outside.join(F.broadcast(toxic), F.col("doc_id") == F.col("of"), "left").select("text", F.col("of").isNotNull().cast("int").alias("confirmed"))
    chosen = stand_out(marked, prior)
    if not chosen:
        return bias
    finder = Finder(chosen)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"confirmed": batch["confirmed"], "columns": list(map(finder.places, batch["text"]))})

    rows = marked.mapInPandas(lean(encode), "confirmed int, columns array<int>").groupBy("columns").agg(F.sum("confirmed").alias("c"), F.count("*").alias("u"))
    rows = saved(rows, "toxicity-rows")
    first = rows.where("c > 0").orderBy(F.xxhash64("columns"), "columns").limit(most_confirmed).collect()
    if not first:
        return bias
    confirmed = [list(r["columns"]) for r in first], np.array([r.c for r in first])
    shares = -(-rows.count() // SHARE_ROWS)
    width = len(chosen)

    def fit(batch: pd.DataFrame) -> pd.DataFrame:
        own = Sparse([list(r) for r in batch["columns"]], batch["u"].to_numpy(), width)
        w = nnpu(Sparse(*confirmed, width), own, prior)
        return pd.DataFrame({"place": np.arange(width + 1), "weight": w, "documents": int(batch["u"].sum())})

    share = F.pmod(F.xxhash64("columns"), F.lit(shares))
    fitted = rows.withColumn("share", share).groupBy("share").applyInPandas(fit, "place int, weight double, documents long")
    mean = fitted.groupBy("place").agg((F.sum(F.col("weight") * F.col("documents")) / F.sum("documents")).alias("w"))
    w = {r.place: r.w for r in mean.collect()}
    return {"": w[width]} | {f: w[k] for k, f in enumerate(chosen)}


def scorer(model: dict[str, float]):
    """Text -> score from 0 to 1; null and empty texts get the bias alone."""
    names = [f for f in model if f]
    finder, weights = Finder(names), [model[f] for f in names]

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            sums = [model[""] + sum(map(weights.__getitem__, finder.places(text))) for text in batch]
            yield pd.Series(sigmoid(np.array(sums, np.float64)))

    return F.pandas_udf(lean(score), "double")


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    Fold 0 (crc32 of the id modulo 5) is held out of training. Null texts score as empty ones, which have the bias alone;
    very long texts are read whole, as the set of their words; a null doc_id is in fold 0; repeated rows each give a row;
    other columns are ignored; an empty table gives none. Only the text is an input of a score.
    """
    score = scorer(train(docs, labels))
    scored = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
