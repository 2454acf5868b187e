"""Quality classification by co-training.

Two classifiers look at different things: one at a text's content (the shapes of its words and how they repeat), the
other at its page's metadata (language, source, length, lines, shares of kinds of characters). Each starts from the
labelled documents. In every round both judge every unlabelled document, and of those it is sure of each hands some, with
its verdict, to the other. In the end both are calibrated on labelled documents that neither trained on, and a
document's score combines the two calibrated views.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from loam.llm.learning import fold, logistic, logit, sigmoid
from loam.llm.shared import hashed_share, lean, saved

#: The most labelled documents that are learned from (a parameter of train()); rounds; documents a view hands over in one;
#: how sure it must be of them.
MOST_LABELLED, ROUNDS, HANDED, SURE = 12_000, 5, 200, 0.9
FOLDS, CALIBRATION_FOLD = 5, 1
SHAPES, LANGS, SOURCES, LENGTHS = 128, 8, 32, 24
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _shape(word: str) -> int:
    kinds = re.sub(r"(.)\1+", r"\1", "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word))
    return zlib.crc32(kinds.encode("utf-8", "surrogatepass")) % SHAPES


_kept_shape = lru_cache(maxsize=200_000)(_shape)


def shape(word: str) -> int:
    """A whole word's place among the shapes: runs of capitals, small letters and digits count once, other signs as they are."""
    return _kept_shape(word) if len(word) <= 40 else _shape(word)  # only short words are kept in memory


def content_view(text: str) -> np.ndarray:
    """Shares of word shapes, and how words repeat."""
    words = _WORDS.findall(text)
    n = max(1, len(words))
    x = np.zeros(SHAPES + 5)
    if words:
        x[:SHAPES] = np.bincount(np.fromiter(map(shape, words), np.int64, n), minlength=SHAPES) / n
        counts = Counter(words)
        in_a_row = sum(map(str.__eq__, words[1:], words[:-1]))
        x[SHAPES:] = len(counts) / n, in_a_row / n, counts.most_common(1)[0][1] / n, math.log1p(n) / 10, min(1.0, 20 / n)
    return x


def metadata_view(text: str, lang: str | None, source: str | None, n_chars: float | None) -> np.ndarray:
    """Language and source by hash, the length's power of two, and the make-up of the page."""
    x = np.zeros(LANGS + SOURCES + LENGTHS + 8)
    x[zlib.crc32((lang or "").encode()) % LANGS] = 1
    x[LANGS + zlib.crc32((source or "").encode()) % SOURCES] = 1
    size = len(text) if n_chars is None or n_chars != n_chars else int(n_chars)
    x[LANGS + SOURCES + min(LENGTHS - 1, max(0, size).bit_length())] = 1
    n, raw = max(1, len(text)), text.encode("utf-8", "surrogatepass")
    lines = text.split("\n")
    distinct = len(set(lines))
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    x[-8:] = (
        count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / n, count(b"0123456789") / n, count(_SIGNS.encode()) / n, text.count("!") / n * 5,
        text.count("|") / n * 5, math.log1p(len(lines)) / 5, math.log1p(n / len(lines)) / 10, distinct / len(lines),
    )
    return x


class CoTraining:
    """Two views' classifiers, which learn from labelled rows and from what the other hands over."""

    def __init__(self, views: tuple[np.ndarray, np.ndarray], y: np.ndarray, calibrate: np.ndarray):
        """``views`` hold the labelled documents' features, ``calibrate`` marks those kept for calibration."""
        self.scale = [v.std(axis=0) + 0.02 for v in views]
        scaled = [v / s for v, s in zip(views, self.scale, strict=True)]
        self.own = [(v[~calibrate], y[~calibrate].astype(float)) for v in scaled]
        held = calibrate if calibrate.any() else ~calibrate
        self.held = ([v[held] for v in scaled], y[held].astype(float))
        self.share = float(self.own[0][1].mean())
        self.fit()

    def fit(self) -> None:
        self.scaled = [logistic(*o) for o in self.own]
        #: Weights for features as they are, bias last.
        self.weights = [np.append(w[:-1] / s, w[-1]) for w, s in zip(self.scaled, self.scale, strict=True)]

    def hand_over(self, view: int, features: np.ndarray, verdict: np.ndarray) -> None:
        """Gives ``view`` rows with the other view's verdicts."""
        x, y = self.own[view]
        self.own[view] = np.concatenate([x, features / self.scale[view]]), np.concatenate([y, verdict])

    def model(self) -> dict:
        """The two views' weights, their calibrations and the combination's."""
        views, y = self.held
        raw = np.stack([logit(w, v) for w, v in zip(self.scaled, views, strict=True)], axis=1)
        platt = [logistic(raw[:, [k]], y, l2=1e-4) for k in (0, 1)]
        calibrated = np.stack([logit(platt[k], raw[:, [k]]) for k in (0, 1)], axis=1)
        return {"weights": self.weights, "platt": platt, "both": logistic(calibrated, y, l2=1e-4)}


def _text(value: object) -> str:
    return value if isinstance(value, str) else ""


def stacked(rows: list, size: int) -> np.ndarray:
    """Features as they are stored, a row each."""
    return np.frombuffer(b"".join(map(bytes, rows)), np.float32).reshape(len(rows), size).astype(np.float64)


CONTENT, METADATA = SHAPES + 5, LANGS + SOURCES + LENGTHS + 8


def views(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    for text, lang, source, n_chars in batches:
        texts = list(map(_text, text))
        a = [content_view(t).astype(np.float32).tobytes() for t in texts]
        b = [metadata_view(t, _text(l), _text(s), n).astype(np.float32).tobytes() for t, l, s, n in zip(texts, lang, source, n_chars, strict=True)]
        yield pd.DataFrame({"a": a, "b": b})


def viewed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, lang, source, n_chars): the columns to ``keep`` as a struct ``doc``, its id, whether
    it has a text, and the features of its two views, 0.8 kB a row; written once, as every round reads them."""
    view = F.pandas_udf(lean(views), "a binary, b binary")("text", "lang", "source", F.col("n_chars").cast("double"))
    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("doc"), docs["doc_id"].alias("id"), F.col("text").isNotNull().alias("has_text"), view.alias("v"))
    return saved(rows.select("doc", "id", "has_text", "v.a", "v.b"), "quality-views")


def handed_over(unlabelled: DataFrame, weights: list[np.ndarray], counts: tuple[int, int], turn: int) -> list:
    """(view, verdict, features) of the documents each view is given: those the other is sure of, so many of verdict 0 and 1.

    Tasks judge whole batches and pass on no more of a batch than may be taken, in the order of the turn's hash.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.sort_values("draw", kind="stable", ignore_index=True)
            p = [sigmoid(logit(w, stacked(batch[c].tolist(), size))) for w, c, size in zip(weights, "ab", (CONTENT, METADATA), strict=True)]
            for view in (0, 1):
                for verdict, sure in ((0, p[1 - view] <= 1 - SURE), (1, p[1 - view] >= SURE)):
                    at = np.nonzero(sure)[0][: counts[verdict]]
                    yield pd.DataFrame({"view": view, "verdict": verdict, "draw": batch["draw"].to_numpy()[at], "features": batch["ab"[view]].to_numpy()[at]})

    rows = unlabelled.select("a", "b", F.xxhash64(F.lit(turn), "id", "a").alias("draw"))
    found = rows.mapInPandas(lean(judge), "view int, verdict int, draw long, features binary")
    ranked = found.withColumn("place", F.row_number().over(Window.partitionBy("view", "verdict").orderBy("draw", "features")))
    # a literal bound lets every task pass on no more rows than may be taken
    chosen = ranked.where(F.col("place") <= max(counts)).where(F.col("place") <= F.when(F.col("verdict") == 1, counts[1]).otherwise(counts[0]))
    return chosen.orderBy("view", "verdict", "place").select("view", "verdict", "features").collect()  # at most twice HANDED rows


def train(rows: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, rounds: int = ROUNDS, handed: int = HANDED) -> dict | None:
    """The co-trained model from viewed() rows; None without labels of both kinds among the training documents.

    Fold 0 (crc32 of the id modulo 5) is neither trained nor calibrated on, fold 1 calibrates. Labelled rows are a
    sample by hash of about ``most_labelled`` and never more than twice that; equal rows of an id count once. Each round
    judges every unlabelled document outside fold 0; of those that a view is sure of, ``handed`` are handed over, as
    many of either kind as the labels' share, in the order of a hash that is another one each round.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    inside = rows.where(F.col("id").isNotNull() & F.col("has_text") & (fold(F.col("id"), FOLDS) != 0)).select("id", "a", "b")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000))
    chosen = known.where(draw < hashed_share(known.count(), most_labelled))  # bounded, so broadcast
    of_known = inside.join(F.broadcast(chosen), inside["id"] == chosen["doc_id"]).dropDuplicates(["id", "a", "b"])
    marked = of_known.orderBy(F.xxhash64("id", "a", "b")).limit(2 * most_labelled).withColumn("calibrate", fold(F.col("id"), FOLDS) == CALIBRATION_FOLD)
    marked = sorted(marked.select("id", "quality", "calibrate", "a", "b").collect(), key=lambda r: (r.id, bytes(r.a), bytes(r.b)))
    y, calibrate = np.array([r.quality for r in marked]), np.array([r.calibrate for r in marked], bool)
    if len({*y[~calibrate].tolist()}) < 2:
        return None
    learner = CoTraining((stacked([r.a for r in marked], CONTENT), stacked([r.b for r in marked], METADATA)), y, calibrate)
    unlabelled = saved(inside.join(known.select(F.col("doc_id").alias("id")).hint("merge"), "id", "left_anti"), "quality-unlabelled")
    counts = (handed - round(handed * learner.share), round(handed * learner.share))
    for turn in range(rounds):
        given = handed_over(unlabelled, learner.weights, counts, turn)
        for view, size in ((0, CONTENT), (1, METADATA)):
            some = [r for r in given if r.view == view]
            learner.hand_over(view, stacked([r.features for r in some], size), np.array([float(r.verdict) for r in some]))
        learner.fit()
    return learner.model()


SCORES = "content_score double, metadata_score double, score double"


def scorer(model: dict | None):
    """(a, b) -> the calibrated views' scores and the combined one, whole batches at a time; all 1 without a model."""

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            if model is None:
                yield pd.DataFrame(np.ones((len(a), 3)), columns=["content_score", "metadata_score", "score"])
                continue
            raw = [logit(w, stacked(rows.tolist(), size)) for w, rows, size in zip(model["weights"], (a, b), (CONTENT, METADATA), strict=True)]
            z = np.stack([p[0] * r + p[1] for p, r in zip(model["platt"], raw, strict=True)], axis=1)
            content, metadata = sigmoid(z).T
            yield pd.DataFrame({"content_score": content, "metadata_score": metadata, "score": sigmoid(logit(model["both"], z))})

    return F.pandas_udf(lean(score), SCORES)


def scored(docs: DataFrame, labels: DataFrame, keep: list[str], most_labelled: int = MOST_LABELLED) -> DataFrame:
    """(doc: the columns to ``keep`` of a row of ``docs``, s: its scores) for every row."""
    rows = viewed(docs, keep)
    return rows.select("doc", scorer(train(rows, labels, most_labelled))("a", "b").alias("s"))


def good_documents(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose combined score is ``least`` or more, with their own columns."""
    return scored(docs, labels, docs.columns).where(F.col("s.score") >= least).select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def classify(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, content_score, metadata_score, score, kept) for every row of ``docs`` (doc_id, text, lang, source, n_chars).

    Scores are probabilities of quality 1; kept if the combined one is at least 0.5. Null texts count as empty, null
    lang and source as empty strings, a null n_chars as the text's length. Very long texts are read whole; their features
    are as many as any other's. A null doc_id teaches nothing. Repeated rows each give a row; other columns are ignored,
    whatever their names; an empty table gives none. Without labels of both kinds all is kept.
    """
    rows = scored(docs, labels, ["doc_id"], most_labelled)
    return rows.select("doc.doc_id", "s.*", (F.col("s.score") >= 0.5).alias("kept"))
