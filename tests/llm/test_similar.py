"""SimHash and embedding near-duplicates against brute force, and components."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from loam.llm import op6_pivots, op10_simhash, shingles
from loam.llm.components import connected_components, forest


def roots(n, links):
    up = list(range(n))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def slow_print(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 60, 300]))]
        for _ in range(rng.randint(1, 12)):
            changed = list(base)
            for _ in range(rng.randint(0, 2)):
                changed[rng.randrange(len(changed))] = word()
            rows.append(" ".join(changed))
    rows += [None, "", " \t", "One", "one", "one TWO", "É é\xa0x", rows[0], rows[0].upper()]
    return list(enumerate(rng.sample(rows, len(rows))))


def test_fingerprints(texts):
    for _, t in texts:
        assert op10_simhash.fingerprint(t) % 2**64 == slow_print(t)


def test_simhash_components(spark, texts, monkeypatch):
    docs = spark.createDataFrame([*texts, (None, "one"), (3, texts[3][1])], "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(0))
    prints = [slow_print(t) for _, t in texts]
    want = roots(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3])
    for dense, block in ((64, 1024), (2, 3)):  # joined rows alone; blocks for nearly all
        monkeypatch.setattr(op10_simhash, "DENSE", dense)
        monkeypatch.setattr(op10_simhash, "BLOCK", block)
        found = op10_simhash.near_duplicates(docs).collect()
        assert len(found) == len(texts) + 2
        assert all(want[r.doc_id] == r.component_id and prints[r.doc_id] == r.fp % 2**64 for r in found if r.doc_id is not None)


def test_links_find_every_pair_of_a_dense_ball(spark, monkeypatch):
    rng = random.Random(8)
    center = rng.getrandbits(64)
    values = sorted({center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(300)})
    unique = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    want = roots(len(values), [(a, b) for a in range(len(values)) for b in range(a) if (values[a] ^ values[b]).bit_count() <= 3])
    place = {int(np.uint64(v).astype(np.int64)): k for k, v in enumerate(values)}
    monkeypatch.setattr(op10_simhash, "DENSE", 8)
    monkeypatch.setattr(op10_simhash, "BLOCK", 16)
    edges = [(place[r.a], place[r.b]) for r in op10_simhash.links(unique).collect()]
    assert roots(len(values), edges) == want


def test_empty_documents_table(spark):
    assert op10_simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(180)] + [(k, k + 1) for k in range(100, 160)]
    found = connected_components(spark.createDataFrame([*links, (5, 5), (None, 3)], "a long, b long")).collect()
    want = roots(400, links)
    assert {r.node: r.component for r in found} == {k: want[k] for a, b in links if a != b for k in (a, b)}
    a, b = np.array(links).T
    assert (forest(a, b, 400) == want).all()


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(10)
    rows, k = [], 0
    for label in (0, 1, 2):
        for _ in range(150):
            base = rng.normal(size=32)
            for _ in range(rng.integers(1, 5)):
                v = base / np.linalg.norm(base) + rng.normal(size=32) * 0.04
                rows.append((int(k), v.astype(np.float32).tolist(), label))
                k += 1
        base = rng.normal(size=32)
        for _ in range(300):  # one large group, so that lists are cut into blocks
            rows.append((int(k), (base + rng.normal(size=32) * 0.03).astype(np.float32).tolist(), label))
            k += 1
    rows += [(k + j, rows[5][1], rows[5][2]) for j in range(4)]
    return rows


def test_vector_links_equal_brute_force(spark, vectors):
    odd = [(90_000, None, 0), (90_001, [0.0] * 32, 0), (90_002, [float("nan")] + [1.0] * 31, 0), (90_003, vectors[0][1], None), (90_004, [], 1), (90_005, [None] + [1.0] * 31, 1), (None, vectors[0][1], 0), (90_006, [1.0, 2.0], 0)]
    table = spark.createDataFrame([*vectors, *odd], "vec_id long, embedding array<float>, label int").withColumn("kept", F.lit("clash")).repartition(4)
    found = op6_pivots.near_vectors(table).collect()
    assert len(found) == len(vectors) + len(odd)
    x = np.array([v for _, v, _ in vectors], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([lab for *_, lab in vectors])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    got = {r.vec_id: r for r in found}
    links = sum(got[k].n_links for k in range(len(x)))
    assert 0.98 * near.sum() <= links <= near.sum()  # the index may miss a pair, and makes none up
    want = roots(len(x), zip(*np.nonzero(near)))
    assert np.mean([got[k].component_id == want[k] for k in range(len(x))]) > 0.99
    assert all(got[k].n_links == 0 and got[k].component_id == k for k in range(90_000, 90_007))
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in found)


def test_no_vectors(spark):
    assert op6_pivots.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def slow_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


@pytest.fixture(scope="module")
def near_texts():
    """Copies with runs of changed words, so that similarities lie all over 0.6 to 1."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [None, "", "one two", "One  two", "one two three"]
    for k in range(60):
        base = [word() for _ in range(rng.choice([30, 80, 250]))]
        for _ in range(70 if k == 0 else rng.randint(1, 5)):
            at, n = rng.randrange(len(base)), rng.randint(0, len(base) // 9)
            rows.append(" ".join(base[:at] + [word() for _ in range(n)] + base[at + n :]))
    return rng.sample(rows, len(rows))


def test_pipeline_drops_all_near_copies_of_five_word_shingles(spark, near_texts, monkeypatch):
    sets = [slow_set(t) for t in near_texts]
    similar = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    near = [(a, b) for a in range(len(sets)) for b in range(a) if similar(sets[a], sets[b])]
    assert sum(len(sets[a] & sets[b]) < 0.95 * len(sets[a] | sets[b]) for a, b in near) > 50
    want = sorted(k for k, r in enumerate(roots(len(sets), near)) if k == r)
    docs = spark.createDataFrame(list(enumerate(near_texts)), "doc_id long, text string")
    for dense in (32, 3):
        monkeypatch.setattr(shingles, "DENSE", dense)
        assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want


def test_near_copies_meet_that_bands_of_minima_had_missed(spark):
    """Pairs of a similarity of exactly 0.8, found among 25,000 made ones, that shared no key of the 24 MinHash bands of before."""
    texts = []
    for k in (20_600, 21_720, 24_561):
        rng = random.Random(k)
        n = rng.choice([44, 49, 58, 67, 76])
        base, run = [f"w{k}x{j}" for j in range(n)], (n - 4) // 9 - 4
        at = rng.randrange(5, n - run - 5)
        texts += [" ".join(base), " ".join(base[:at] + [f"z{k}y{j}" for j in range(run)] + base[at + run :])]
        a, b = slow_set(texts[-2]), slow_set(texts[-1])
        assert a != b and len(a & b) == 0.8 * len(a | b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 2, 4]


def test_similar_sets_share_keys_whatever_is_frequent():
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(1, 80))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.random() * 0.2], rng.integers(0, 1 << 63, rng.integers(0, 1 + n // 8)).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if both == 0 or both < 0.8 * (len(a) + len(b) - both):
            continue
        values = np.unique(rng.choice(np.concatenate([a, b]), rng.integers(0, len(a) + len(b) + 1), replace=True))
        frequent = values, rng.integers(3, 9, len(values))
        shared = np.intersect1d(shingles.prefix_keys(a, frequent), shingles.prefix_keys(b, frequent))
        assert len(shared) >= min(shingles.LEAST_SHARED, np.ceil(0.8 * max(len(a), len(b)) - 1e-9))
        p, q = sorted((shingles.parities(a), shingles.parities(b)), key=len)
        assert len(q) <= 2 * len(p)
        q = q[: len(p)] ^ q[len(p) :] if len(q) > len(p) else q
        assert sum(int(w).bit_count() for w in (p ^ q).view(np.uint64)) <= len(a) + len(b) - 2 * both


def test_pipeline_keeps_a_row_of_every_group_whatever_the_ids(spark):
    rng = random.Random(15)
    text = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.random()) for _ in range(20)) for _ in range(8)]
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (None, text[2]), (4, text[2])]  # no id; one twice; one with a copy that has an id
    rows += [(5, text[3]), (5, text[4]), (5, text[4])]  # an id of two texts
    rows += [(6, text[5]), (7, text[6]), (7, text[5])]  # the second text of 7 is a copy of 6
    rows += [(8, None), (9, " "), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", F.lit("clash")).repartition(3)
    found = corpus_pipeline.near_duplicates(spark, docs, "")
    assert found.columns == docs.columns
    want = [(None, text[0]), (None, text[1]), (4, text[2]), (5, text[3]), (5, text[4]), (6, text[5]), (7, text[6]), (8, None)]
    assert sorted([(r.doc_id, r.text) for r in found.collect()], key=str) == sorted(want, key=str)


def test_vectors_of_a_rare_length_and_repeated_ids_link(spark, vectors):
    rare = [(80_000, [1.0, 0.0, 0.0], 0), (80_001, [1.0, 0.1, 0.0], 0), (80_002, [0.0, 1.0, 0.0], 0), (80_003, [1.0, 0.1, 0.0], 1)]
    same = [(-5, [1.0, 0.0, 0.0, 0.0], 1), (-5, [0.0, 1.0, 0.0, 0.0], 1), (80_010, [0.01, 1.0, 0.0, 0.0], 1)]
    table = spark.createDataFrame([*vectors, *rare, *same], "vec_id long, embedding array<float>, label int")
    found = op6_pivots.near_vectors(table).where("vec_id >= 80000 or vec_id < 0").collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == [(-5, 0, -5), (-5, 1, -5), (80_000, 1, 80_000), (80_001, 1, 80_000), (80_002, 0, 80_002), (80_003, 0, 80_003), (80_010, 1, -5)]


def test_vectors_of_several_lengths_and_any_size_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(21)
    rows, k = [], 0
    for n, scale in ((8, 1e200), (24, 1.0), (24, 1e-200), (40, 1.0)):
        for _ in range(60):
            base = rng.normal(size=n)
            for _ in range(rng.integers(1, 4)):
                rows.append((k, ((base + rng.normal(size=n) * 0.1) * scale).tolist(), int(k % 2 if n == 8 else 0)))
                k += 1
    found = {r.vec_id: r for r in op6_pivots.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    x = [op6_pivots.unit([v])[0] for _, v, _ in rows]
    near = np.array([[a != b and rows[a][2] == rows[b][2] and len(x[a]) == len(x[b]) and x[a] @ x[b] >= 0.93 for b in range(k)] for a in range(k)])
    assert near.sum() > 100 and sum(found[j].n_links for j in range(k)) >= 0.98 * near.sum()
    assert all(found[j].n_links <= near[j].sum() for j in range(k))
    few = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0)], "vec_id long, embedding array<double>, label int")
    assert [r.n_links for r in op6_pivots.near_vectors(few).collect()] == [1, 1]


def test_closest_pivots_over_groups():
    rng = np.random.default_rng(4)
    pivots = op6_pivots.unit(rng.normal(size=(400, 16)).tolist())
    x = op6_pivots.unit(rng.normal(size=(300, 16)).tolist())
    groups = op6_pivots.grouped(pivots)
    assert sorted(np.concatenate(groups).tolist()) == list(range(400)) and len(groups) == 20
    found = op6_pivots.closest(x, pivots, groups, 10)
    plain = np.argsort(-(x @ pivots.T), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(found.tolist(), plain.tolist(), strict=True)]) > 8
    few = op6_pivots.unit(rng.normal(size=(5, 16)).tolist())
    assert op6_pivots.closest(x, few, op6_pivots.grouped(few), 10).shape == (300, 5)
    assert (np.sort(op6_pivots.closest(x, few, op6_pivots.grouped(few), 5)) == np.arange(5)).all()


def test_links_among_vectors_made_from_the_given_ones(spark, sf_dir):
    """Each given vector with turned copies at cosines from 0.90 to 0.96; copies of one vector go by broadcast where they are many."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").limit(300).collect()
    rng = np.random.default_rng(4)
    made = []
    for r in rows:
        v = np.array(r.embedding, np.float64)
        v /= np.linalg.norm(v)
        away = rng.normal(size=len(v))
        away -= (away @ v) * v
        away /= np.linalg.norm(away)
        made += [(len(made) + k, (c * v + np.sqrt(1 - c * c) * away).tolist(), r.label) for k, c in enumerate((1.0, 0.90, 0.925, 0.935, 0.96))]
    made += [(10_000 + k, made[0][1], made[0][2]) for k in range(8)]
    table = spark.createDataFrame(made, "vec_id long, embedding array<double>, label int")
    before, op6_pivots.HEAVY = op6_pivots.HEAVY, 5
    try:
        found = {r.vec_id: (r.n_links, r.component_id) for r in op6_pivots.near_vectors(table).collect()}
    finally:
        op6_pivots.HEAVY = before
    x, label = np.array([e for _, e, _ in made]), np.array([lab for *_, lab in made])
    close = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(close, False)
    expected = close.sum(1)
    got = np.array([found[k][0] for k, *_ in made])
    assert (got <= expected).all() and got.sum() >= 0.98 * expected.sum() and expected.sum() > 1500
    assert all(found[10_000 + k] == found[0] for k in range(8))


def test_a_print_of_many_documents_goes_by_broadcast(spark, monkeypatch):
    from loam.operators import components

    monkeypatch.setattr(components, "HEAVY", 3)
    docs = spark.createDataFrame([(k, "" if k % 2 else f"word{k} and more words here {k}") for k in range(20)] + [(None, None)], "doc_id long, text string")
    found = op10_simhash.near_duplicates(docs).collect()
    assert len(found) == 21 and {r.component_id for r in found if r.fp == 0} == {1}
