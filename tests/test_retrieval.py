"""Names, phrases, token sets and centres by the thousand, against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.operators import brands, patterns, retrieval as M


def slow_hits(text, names):
    """Leftmost matches, of those at one place the first by order, as one alternation finds them."""
    pattern = re.compile(rf"(?<![a-z0-9])({'|'.join(map(re.escape, names))})(?![a-z0-9])")
    return {m.group(1) for m in pattern.finditer(text.lower())} if text else set()


@pytest.mark.parametrize("block", [4 << 20, 300])
def test_names_inside_names_go_by_order(spark, monkeypatch, block):
    monkeypatch.setattr(patterns, "BLOCK_BYTES", block)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("ab1.é") for _ in range(rng.randint(1, 3)))
    names = list(dict.fromkeys([" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(200)]))
    texts = [(k, " ".join(word() for _ in range(rng.randint(0, 60))).upper()) for k in range(80)] + [(100, None), (101, ""), (102, names[0] * 3), (102, names[0])]
    table = spark.createDataFrame(texts, "id long, text string")
    ordered = spark.createDataFrame([(n, k) for k, n in enumerate(names)] + [(names[3], 999), (None, 1), ("", 2)], "brand string, place int")
    found = {(r.id, r.brand) for r in brands.brand_hits(table, ordered).collect()}
    assert found == {(k, n) for k, t in texts for n in slow_hits(t, names)}
    longest = {(r.id, r.brand) for r in brands.brand_hits(table, ordered.select("brand")).collect()}
    assert longest == {(k, n) for k, t in texts for n in slow_hits(t, sorted(names, key=len, reverse=True))}


def test_a_hundred_thousand_names_over_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    texts = [(r.id, r.text) for r in docs.collect()]
    rng = random.Random(1)
    words = [w for _, t in texts for w in re.findall(r"[a-z0-9]{2,}", (t or "").lower())]
    names = list(dict.fromkeys([f"{rng.choice(words)} {rng.choice(words)}" for _ in range(105_000)] + words))[:100_000]
    assert len(names) == 100_000
    found = patterns.found_names(docs.select("id", F.lower("text").alias("text")), spark.createDataFrame([(n, 0) for n in names], "name string, place int"), alone=True, settle=patterns.first_of_each)
    got = {(r.id, r.name) for r in found.select("id", F.explode("found.name").alias("name")).collect()}
    known, expected = set(names), set()
    for k, text in texts:
        low = (text or "").lower()
        tokens = [(m.start(), m.end()) for m in re.finditer(r"[a-z0-9]+", low)]
        expected |= {(k, low[a:b]) for a, b in tokens if low[a:b] in known}
        expected |= {(k, low[a[0] : b[1]]) for a, b in zip(tokens, tokens[1:]) if low[a[0] : b[1]] in known}
    assert got == expected and len(got) > 10_000


@pytest.mark.parametrize("block", [4 << 20, 40])
def test_phrases_without_words_are_found_too(spark, monkeypatch, block):
    monkeypatch.setattr(patterns, "BLOCK_BYTES", block)
    texts = [(1, "We  SAW\nthe quick-brown fox"), (2, "?!"), (3, None), (4, ""), (5, "the quick"), (5, "the quick")]
    phrases = [(1, "the quick"), (1, "fox"), (2, " ?! "), (3, ""), (4, None), (5, "x"), (5, "THE  QUICK"), (6, "k-b")]
    folded = lambda t: " ".join((t or "").lower().split())
    expected = {(a, b, folded(p)) for a, t in texts for b, p in phrases if t is not None and folded(p) and folded(p) in folded(t)}
    found = M.contained(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(phrases, "item long, text string"))
    assert {tuple(r) for r in found.collect()} == expected


@pytest.mark.parametrize("items,block,dense", [(20_000, 8 << 20, 0), (600, 3000, 0), (600, 3000, 100)])
def test_best_items_of_a_large_catalogue(spark, monkeypatch, items, block, dense):
    monkeypatch.setattr(M, "BLOCK_BYTES", block)
    monkeypatch.setattr(M, "DENSE", dense)
    rng = random.Random(9)
    vocabulary = ["ww" + "".join(chr(97 + int(c)) for c in str(k)) for k in range(3000)]
    draw = lambda n: " ".join(vocabulary[min(2999, int(rng.paretovariate(0.5)))] for _ in range(n))
    catalogue = [(k, draw(rng.choice([2, 8, 30]))) for k in range(items)] + [(items, None), (items + 1, "")]
    catalogue += [(items + 2, catalogue[7][1]), (items + 3, catalogue[7][1])]
    texts = [(k, draw(rng.choice([0, 1, 5, 40, 200]))) for k in range(60)] + [(100, None), (101, "?"), (102, catalogue[7][1]), (102, catalogue[7][1])]
    found = M.best_by_tokens(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(catalogue, "item long, text string"), 3)
    sets = [(k, set((t or "").split())) for k, t in catalogue]
    expected = []
    for k, text in texts:
        own = set((text or "").split())
        scored = sorted((-len(own & s) / len(own | s), item) for item, s in sets if own & s)
        expected += [(k, item, round(-minus, 9), rank) for rank, (minus, item) in enumerate(scored[:3], 1)]
    assert sorted((r.id, r.item, round(r.score, 9), r["rank"]) for r in found.collect()) == sorted(expected)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_nearest_of_fifty_thousand_centres(spark, monkeypatch):
    monkeypatch.setattr(M, "VECTORS", 150)
    rng = np.random.default_rng(3)
    centres, vectors = rng.normal(size=(50_000, 8)), rng.normal(size=(300, 8))
    centres[40_000:40_010] = centres[11]
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)] + [(999, None)], "id long, vector array<double>")
    near = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(centres)], "item long, vector array<double>").repartition(4)
    close = vectors @ centres.T
    for some, n in ((near, 50_000), (near.where("item < 40"), 40)):
        found = sorted((r.id, r["rank"], r.item) for r in M.nearest_centres(table, some, 3).collect())
        order = np.lexsort((np.broadcast_to(np.arange(n), (300, n)), -np.round(close[:, :n], 12)), axis=1)[:, :3]
        assert found == [(k, j + 1, int(order[k, j])) for k in range(300) for j in range(3)]
    assert M.nearest_centres(table, near.where("false"), 3).count() == 0


def test_overlapping_ships_texts_by_block_and_no_pairs(spark, monkeypatch):
    """Pairs of groups of several blocks equal all pairs, one at exactly the bound; nothing is broadcast, and no rows but texts meet by keys."""
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [x + y + "q" for x in letters for y in letters]
    rows = [(g, k, " ".join(rng.choices(words[:60], k=rng.randint(1, 30)))) for g, n in ((1, 40), (2, 3)) for k in range(n)]
    rows += [(3, 1, " ".join(words[:70])), (3, 2, " ".join(words[:7])), (3, 3, None)]
    monkeypatch.setattr(M, "PAIR_BLOCK", 8)
    found = M.overlapping(spark.createDataFrame(rows, "group long, id int, text string"), 0.1)
    sets = {(g, k): set((t or "").split()) for g, k, t in rows}
    want = {(g, a, b): len(x & y) / len(x | y) for (g, a), x in sets.items() for (h, b), y in sets.items() if g == h and a < b and x and y and len(x & y) / len(x | y) >= 0.1}
    assert {(r.group, r.id, r.other): r.score for r in found.collect()} == want and (3, 1, 2) in want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "token" not in plan.replace("token-sets", "")
