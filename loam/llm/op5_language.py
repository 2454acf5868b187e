"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of an n-gram binds its letters' vectors, each rotated by its
place, by multiplication; a text bundles the vectors of its n-grams by addition; a language bundles its texts. A
text is given the language whose bundle is closest by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

DIMENSIONS, NGRAM, SEED = 1024, 3, 11
#: Languages a model may hold (each is one vector), n-gram vectors kept per worker (1 kB each), characters bundled at a time
#: and n-gram vectors made at a time.
MOST_LANGUAGES, MOST_VECTORS, CHUNK, BLOCK = 1000, 60_000, 1 << 16, 4096


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """+1 and -1 by the letters' code points, a row each; 0 stands for anything between words.

    The bits are those of a counter that starts at the letter, mixed by the finalizer of SplitMix64.
    """
    z = (codes.astype(np.uint64)[:, None] * np.uint64(DIMENSIONS // 64) + np.arange(DIMENSIONS // 64, dtype=np.uint64) + np.uint64(SEED << 32)) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    bits = np.unpackbits((z ^ (z >> np.uint64(31))).view(np.uint8), axis=1)
    return bits.astype(np.int8) * 2 - 1


class Binder:
    """Vectors of n-grams, made when first met; those met first are kept, as bytes, up to MOST_VECTORS."""

    def __init__(self):
        self.codes = np.full(0x110000, -1, np.int32)
        self.keys, self.vectors = np.zeros(0, np.int64), np.zeros((0, DIMENSIONS), np.int8)

    def made(self, keys: np.ndarray) -> np.ndarray:
        """The letters' vectors, each rotated by its place, multiplied; n-gram keys have 21 bits a letter."""
        out = np.ones((len(keys), DIMENSIONS), np.int8)
        for k in range(NGRAM):
            letters, place = np.unique(keys >> 21 * k & 0x1FFFFF, return_inverse=True)
            out *= np.roll(letter_vectors(letters), k, axis=1)[place]
        return out

    def bound(self, keys: np.ndarray) -> np.ndarray:
        """Rows for sorted distinct n-gram keys, BLOCK of them at most."""
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        out = np.empty((len(keys), DIMENSIONS), np.int8)
        out[known] = self.vectors[at[known]]
        new = keys[~known]
        if len(new):
            out[~known] = made = self.made(new)
            if len(self.keys) + len(new) <= MOST_VECTORS:
                order = np.argsort(np.concatenate([self.keys, new]), kind="stable")
                self.keys, self.vectors = np.concatenate([self.keys, new])[order], np.concatenate([self.vectors, made])[order]
        return out

    def mapped(self, text: str, before: int) -> np.ndarray:
        """Code points of the lower-cased text with every run of other characters than letters made one 0, none after a
        ``before`` of 0."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        to = self.codes[codes]
        if (to < 0).any():
            for code in np.unique(codes[to < 0]).tolist():
                self.codes[code] = code if chr(code).isalpha() else 0
            to = self.codes[codes]
        return to[(to != 0) | (np.concatenate([[before], to[:-1]]) != 0)].astype(np.int64)

    def grams(self, text: str) -> Iterator[np.ndarray]:
        """The n-gram keys of a text, CHUNK characters at a time; the text stands between two 0s."""
        tail = np.zeros(1, np.int64)
        for start in range(0, len(text), CHUNK):
            tail = np.concatenate([tail, self.mapped(text[start : start + CHUNK], int(tail[-1]))])
            if start + CHUNK >= len(text) and tail[-1]:
                tail = np.append(tail, 0)
            if len(tail) >= NGRAM:
                yield sum(tail[k : len(tail) - NGRAM + 1 + k] << 21 * k for k in range(NGRAM))
                tail = tail[1 - NGRAM :]

    def bundles(self, texts: list[str], groups: np.ndarray, n_groups: int) -> np.ndarray:
        """The bundle of each group's texts; sums of whole numbers, so neither the order of texts nor how they are cut matters."""
        out, held, owners, n = np.zeros((n_groups, DIMENSIONS)), [], [], 0
        for text, group in zip(texts, groups.tolist(), strict=True):
            for keys in self.grams(text):
                held.append(keys)
                owners.append(np.full(len(keys), group, np.int64))
                n += len(keys)
                if n >= CHUNK:
                    self.add(out, np.concatenate(held), np.concatenate(owners))
                    held, owners, n = [], [], 0
        if n:
            self.add(out, np.concatenate(held), np.concatenate(owners))
        return out

    def add(self, out: np.ndarray, grams: np.ndarray, owner: np.ndarray) -> None:
        """Adds the vectors of n-grams to the rows of their owners, BLOCK different n-grams at a time."""
        keys, place = np.unique(grams, return_inverse=True)
        some, row = np.unique(owner, return_inverse=True)
        table = np.bincount(row * len(keys) + place, minlength=len(some) * len(keys)).reshape(len(some), -1).astype(np.float32)
        for k in range(0, len(keys), BLOCK):
            out[some] += table[:, k : k + BLOCK] @ self.bound(keys[k : k + BLOCK]).astype(np.float32)


@lru_cache(maxsize=1)
def binder() -> Binder:
    return Binder()


def _chunks(texts: list[str], most: int = 64):
    """Slices of few texts and not many characters; a longer text is alone."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        if k > start and (held + len(t) > CHUNK or k - start >= most):
            yield start, k
            start, held = k, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def held_out(doc_id: Column) -> Column:
    """Documents no model may learn from; never for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame) -> dict[str, np.ndarray]:
    """Language -> unit vector, from all of ``docs`` (text, lang) with both; bundled inside tasks, then added up by place.

    A task sends one vector per language, whatever its rows, so a language with most of the rows does no harm.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch["text"].tolist(), batch["lang"].tolist()
            for a, b in _chunks(texts):
                names, groups = np.unique(langs[a:b], return_inverse=True)
                made = binder().bundles(texts[a:b], groups, len(names))
                for name, v in zip(names.tolist(), made, strict=True):
                    sums[name] = sums.get(name, 0) + np.rint(v).astype(np.int64)
        for name, v in sums.items():
            yield pd.DataFrame({"lang": [name], "bundle": [v.tolist()]})

    parts = docs.select("text", "lang").where("text is not null and lang is not null").mapInPandas(partial, "lang string, bundle array<long>")
    summed = parts.select("lang", F.posexplode("bundle").alias("place", "value")).groupBy("lang", "place").agg(F.sum("value").alias("value"))
    rows = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("v")).select("lang", "v.value").limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    model = {r.lang: np.array(r.value, np.float64) for r in rows}
    return {k: v / n for k, v in sorted(model.items()) if (n := np.linalg.norm(v))}


def predictor(model: dict[str, np.ndarray]):
    """Text -> struct of lang_pred and score, the cosine with that language's vector, 0 at least.

    ``und`` and 0 for null, for a text without letters and for a model without languages. Equal cosines go to the
    first language by name.
    """
    names, vectors = list(model), np.array(list(model.values()), np.float32).reshape(-1, DIMENSIONS)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch]
            langs, scores = ["und"] * len(texts), np.zeros(len(texts))
            some = [k for k, t in enumerate(texts) if any(map(str.isalpha, t))] if names else []
            chosen = [texts[k] for k in some]
            for a, b in _chunks(chosen):
                v = binder().bundles(chosen[a:b], np.arange(b - a), b - a)
                close = v @ vectors.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                best = close.argmax(axis=1)
                for k, w, c in zip(some[a:b], best.tolist(), close.max(axis=1).tolist(), strict=True):
                    langs[k], scores[k] = names[w], min(1.0, max(0.0, c))
            yield pd.DataFrame({"lang_pred": langs, "score": scores})

    return F.pandas_udf(predict, "lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text, lang).

    Learns from the text and lang of rows that are not held out. Null langs teach nothing, null and empty texts are
    ``und``; a very long text is read whole, CHUNK characters at a time, in bounded memory; of equal cosines the first
    language by name wins; repeated rows each give a row; other columns are ignored; nothing to learn from makes all ``und``.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))))
    predict = predictor(model)
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict("text").alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")
