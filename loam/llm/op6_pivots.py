"""Embedding near-duplicates by a pivot-permutation index.

Reference points (pivots) are a bounded sample of the vectors, whose number grows as the root of the vectors. They stand
in as many groups as the root of the pivots, and a vector is compared with those of its GROUPS closest groups. A vector is
described by its ``nearest`` closest pivots, in order (equally close ones in the order of the sample), and stands in the
inverted list of each. Two vectors are candidates if they share at least ``shared`` pivots; a pair is counted in the list
of its smallest shared pivot alone, so no pair is seen twice, and a vector need not enter the list of its largest one.
Candidates are verified by cosine in double precision. Lists longer than a block are cut into blocks that hash, and each
pair of blocks is one group: what comes out of a group is a row for each linked vector (its number of links and the root of
its tree), never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from loam.llm.components import connected_components, forest
from loam.llm.shared import hashed_share, saved

#: Vectors in a block of an inverted list; bounds of the number of pivots, which is 4 times the root of the vectors; groups of
#: pivots that a vector is compared with.
BLOCK, LEAST_PIVOTS, MOST_PIVOTS, GROUPS = 256, 64, 16_384, 8
#: Copies of a vector beyond which they take its entry from a broadcast.
HEAVY = 100_000
#: The largest cosine between two pivots.
SPREAD = 0.8


def unit(rows: list) -> np.ndarray:
    """Rows as doubles of length one; divided by the largest component first, as squares of large ones would overflow."""
    x = np.array(rows, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(unique: DataFrame, n_unique: int) -> dict[int, np.ndarray]:
    """For each length of vectors unit vectors of a sample taken by hash, about MOST_PIVOTS in all, no two of a length with a cosine over SPREAD.

    A large group of near copies fills its share of any sample. Pivots so close together would be ordered by chance, so
    of such a crowd only the first one stays. A length gets pivots by its share of the sample; vectors of a length that
    the sample does not hold stand in one list for each label and length, in which all pairs are candidates.
    """
    wanted = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, 4 * n_unique**0.5)))
    share = hashed_share(n_unique, 2 * wanted)
    sample = unique.where(F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(1_000_000)) < share)
    rows = [r.embedding for r in sample.orderBy("rep", "label").select("embedding").limit(2 * wanted).collect()]
    pivots = {}
    for n in sorted(set(map(len, rows))):
        found = unit([v for v in rows if len(v) == n])
        most = -(-wanted * len(found) // len(rows))
        kept, held = np.empty((min(most, len(found)), n)), 0
        for v in found:
            if held == len(kept):
                break
            if not held or (kept[:held] @ v).max() <= SPREAD:
                kept[held] = v
                held += 1
        pivots[n] = kept[:held]
    return pivots


def grouped(pivots: np.ndarray) -> list[np.ndarray]:
    """Numbers of the pivots that are closest to each of the first ones, as many groups as the root of the pivots."""
    heads = pivots[: max(1, round(len(pivots) ** 0.5))]
    of = np.argmax(pivots @ heads.T, axis=1)
    return [np.nonzero(of == k)[0] for k in range(len(heads))]


def closest(x: np.ndarray, pivots: np.ndarray, groups: list[np.ndarray], nearest: int) -> np.ndarray:
    """Numbers of each row's ``nearest`` closest pivots among those of its GROUPS closest groups, closest first.

    A row whose groups hold fewer is compared with all pivots.
    """
    nearest, n_groups = min(nearest, len(pivots)), min(GROUPS, len(groups))
    top = np.argsort(-(x @ pivots[: len(groups)].T), axis=1, kind="stable")[:, :n_groups]
    close = np.full((len(x), n_groups * nearest), -np.inf)
    number = np.zeros(close.shape, np.int64)
    for g in np.unique(top).tolist():
        row, slot = np.nonzero(top == g)
        cosines = x[row] @ pivots[groups[g]].T
        m = min(nearest, cosines.shape[1])
        best = np.argsort(-cosines, axis=1, kind="stable")[:, :m]
        at = slot[:, None] * nearest + np.arange(m)
        close[row[:, None], at] = np.take_along_axis(cosines, best, axis=1)
        number[row[:, None], at] = groups[g][best]
    order = np.argsort(-close, axis=1, kind="stable")[:, :nearest]
    near = np.take_along_axis(number, order, axis=1)
    few = np.take_along_axis(close, order, axis=1)[:, -1] == -np.inf
    if few.any():
        near[few] = np.argsort(-(x[few] @ pivots.T), axis=1, kind="stable")[:, :nearest]
    return near


def _describe(pivots: dict[int, np.ndarray], nearest: int):
    """Embedding -> numbers of its closest pivots, closest first; numbers go on from length to length. None for a length without pivots."""
    first, groups, at = {}, {}, 0
    for n, p in pivots.items():
        first[n], groups[n], at = at, grouped(p), at + len(p)

    def nearest_pivots(embeddings: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in embeddings:
            order: list[list[int]] = [[]] * len(batch)
            length = np.fromiter(map(len, batch), np.int64, len(batch))
            for n in np.unique(length).tolist():
                at = np.nonzero(length == n)[0] if n in pivots else np.zeros(0, np.int64)
                for k in range(0, len(at), 2048):
                    some = at[k : k + 2048]
                    near = closest(unit(batch.iloc[some].tolist()), pivots[n], groups[n], nearest) + first[n]
                    for place, v in zip(some.tolist(), near.tolist(), strict=True):
                        order[place] = v
            yield pd.Series(order)

    return F.pandas_udf(nearest_pivots, "array<int>")


def _block_links(least: float, shared: int):
    def block_links(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """Links between the two blocks of a list (of one, with itself), as (rep, root, links)."""
        _, _, pivot, bi, bj = key
        rep, mult = rows["rep"].to_numpy(), rows["copies"].to_numpy()
        x = unit(rows["embedding"].tolist())
        first, second = (np.nonzero(rows["block"].to_numpy() == b)[0] for b in (bi, bj))
        here = np.ones((len(first), len(second)), bool)
        if pivot >= 0:
            near = np.array(rows["near"].tolist(), np.int64)
            known, column = np.unique(near, return_inverse=True)
            has = np.zeros((len(rows), len(known)), np.float32)
            has[np.arange(len(rows))[:, None], column.reshape(near.shape)] = 1
            lower = int(np.searchsorted(known, pivot))
            here = (has[first] @ has[second].T >= min(shared, near.shape[1])) & (has[first, :lower] @ has[second, :lower].T == 0)
        if bi == bj:
            here = np.triu(here, 1)
        a, b = np.nonzero(here)
        a, b = first[a], second[b]
        good = np.concatenate([(x[a[k : k + 65536]] * x[b[k : k + 65536]]).sum(axis=1) >= least for k in range(0, len(a), 65536)] or [np.zeros(0, bool)])
        a, b = a[good], b[good]
        n = np.bincount(a, mult[b], len(rows)) + np.bincount(b, mult[a], len(rows))
        root = forest(a, b, len(rows))
        some = n > 0
        return pd.DataFrame({"rep": rep[some], "root": rep[root[some]], "links": n[some].astype(np.int64)})

    return block_links


def near_vectors(vectors: DataFrame, least: float = 0.93, nearest: int = 10, shared: int = 2) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Vectors are compared only when their labels are equal and not null. A null, empty or zero vector, one that
    holds a null or non-finite component and one whose vec_id is null links with nothing: n_links 0, component_id
    its own vec_id. Vectors of different lengths never link; each length has pivots of its own. Components of any finite size are allowed. Exact copies are one entry of the index, however many
    they are: each copy links with all others and with all that the entry links with. Repeated vec_ids are vectors
    of their own. Other columns are ignored; an empty table gives an empty result.
    """
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind == "float" else "double"  # as they are stored, which halves what is shuffled; cosines are doubles
    rows = vectors.select("vec_id", "label", F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    usable = F.coalesce(finite & F.exists("embedding", lambda v: v != 0), F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    good = rows.where(usable)
    groups = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("rep", F.xxhash64("label", "embedding", "least"))
    unique = saved(groups, "unique-vectors")
    pivots = choose_pivots(unique, unique.count())
    described = unique
    if pivots:
        described = saved(unique.withColumn("near", _describe(pivots, nearest)("embedding")), "described-vectors")
        listed = described.withColumn("pivot", F.explode(F.when(F.size("near") == 0, F.array(F.lit(-1))).otherwise(F.slice(F.array_sort("near"), 1, F.size("near") - F.least(F.lit(shared), F.size("near")) + 1))))
        listed = listed.withColumn("dim", F.size("embedding"))
        counts = listed.groupBy("label", "dim", "pivot").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
        own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
        cut = listed.join(counts, ["label", "dim", "pivot"]).withColumn("block", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cut = cut.select("label", "dim", "pivot", F.least("block", "with").alias("bi"), F.greatest("block", "with").alias("bj"), "block", "rep", "copies", "embedding", "near")
        found = cut.groupBy("label", "dim", "pivot", "bi", "bj").applyInPandas(_block_links(least, shared), "rep long, root long, links long")
        found = saved(found, "vector-links")
    else:
        found = vectors.sparkSession.createDataFrame([], "rep long, root long, links long")
    component = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    entries = unique.join(linked, "rep", "left").join(component.select(F.col("node").alias("rep"), "component"), "rep", "left")
    entries = saved(entries.withColumn("component", F.coalesce("component", "rep")), "vector-entries")
    smallest = entries.groupBy("component").agg(F.min("least").alias("component_id"))
    entries = entries.join(smallest, "component").select("label", "embedding", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    often = F.col("copies") > HEAVY  # one entry in HEAVY vectors at most, so broadcast
    many = entries.where(often)
    joined = good.join(entries.where(~often), ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    if not many.isEmpty():
        joined = joined.unionByName(good.join(F.broadcast(many), ["label", "embedding"]).select("vec_id", "n_links", "component_id"))
    alone = rows.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
