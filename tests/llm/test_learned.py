"""The learned operators: held-out accuracy, null and empty inputs, and that nothing else than the text counts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm import op3_cotraining, op5_language, op9_toxicity

LETTERS = {"xx": "abcde", "yy": "vwxyz"}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def two_languages(spark):
    rng = random.Random(1)
    rows = [(k, words(rng, LETTERS[lang], 30), lang, "s", 0) for k, lang in enumerate(rng.choices(["xx", "yy"], k=120))]
    return spark.createDataFrame([*rows, (500, None, "xx", None, None), (501, "", None, "s", 0), (502, "123 !!", "xx", "s", 6), (None, "abc abd", None, "s", 7)], DOCS)


def test_language_of_held_out_texts(two_languages):
    found = op5_language.identify(two_languages.withColumn("score", F.lit("clash"))).join(two_languages.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out and r.doc_id < 500]
    assert held and all(r.lang_pred == r.lang for r in held)
    assert {r.lang_pred for r in found if r.doc_id >= 500} == {"und"}
    assert all(0 <= r.score <= 1 for r in found)


def test_language_rows_and_nothing_to_learn_from(spark, two_languages):
    assert op5_language.identify(two_languages.union(two_languages)).count() == 2 * two_languages.count()
    nothing = op5_language.identify(two_languages.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert op5_language.identify(spark.createDataFrame([], DOCS)).count() == 0


def slow_bundle(text):
    """One n-gram after the other."""
    letters = "".join(c if c.isalpha() else "\0" for c in text.lower())
    while "\0\0" in letters:
        letters = letters.replace("\0\0", "\0")
    letters = "\0" + letters.strip("\0") + "\0" if letters.strip("\0") else ""
    total = np.zeros(op5_language.DIMENSIONS, int)
    for k in range(len(letters) - 2):
        one = [np.roll(op5_language.letter_vectors(np.array([ord(c)]))[0].astype(int), j) for j, c in enumerate(letters[k : k + 3])]
        total += one[0] * one[1] * one[2]
    return total


@pytest.mark.parametrize("chunk", [1, 5, 7, 1 << 16])
def test_bundles_equal_one_gram_after_the_other(monkeypatch, chunk):
    monkeypatch.setattr(op5_language, "CHUNK", chunk)
    monkeypatch.setattr(op5_language, "BLOCK", 3)
    monkeypatch.setattr(op5_language, "MOST_VECTORS", 20)
    rng = random.Random(7)
    texts = ["", "a", " a ", "12 34", "abc", "cba", "日本語 テキスト", *("".join(rng.choice("abé 1.日\n") for _ in range(rng.randint(0, 60))) for _ in range(25))]
    groups = np.array([k % 4 for k in range(len(texts))])
    found = op5_language.Binder().bundles(texts, groups, 4)
    for g in range(4):
        assert np.array_equal(found[g], sum(slow_bundle(t) for t, of in zip(texts, groups, strict=True) if of == g))


def test_languages_equal_brute_force_and_held_out_ones_teach_nothing(spark, two_languages):
    docs = two_languages.unionByName(spark.createDataFrame([(900, "ab vw", "xx", "s", 5), (901, "abc", None, "s", 3), (902, "abc", None, "s", 3)], DOCS))
    rows = docs.select("*", op5_language.held_out(F.col("doc_id")).alias("held")).collect()
    model = {}
    for lang in ("xx", "yy"):
        v = sum(slow_bundle(r.text) for r in rows if not r.held and r.text is not None and r.lang == lang)
        model[lang] = v / np.linalg.norm(v)
    want = []
    for r in rows:
        v = slow_bundle(r.text or "")
        close = {lang: float(v @ m / max(np.linalg.norm(v), 1e-9)) for lang, m in model.items()}
        lang = min(close, key=lambda name: (-close[name], name)) if any(map(str.isalpha, r.text or "")) else "und"
        want.append((str(r.doc_id), lang, round(max(0.0, close.get(lang, 0.0)), 4)))
    found = op5_language.identify(docs).collect()
    assert sorted((str(r.doc_id), r.lang_pred, round(r.score, 4)) for r in found) == sorted(want)
    turned = docs.withColumn("lang", F.when(op5_language.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    key = lambda r: (str(r.doc_id), r.lang_pred, r.score)
    assert sorted(map(key, op5_language.identify(turned).collect())) == sorted(map(key, found))


def test_a_text_of_two_million_chinese_letters_takes_bounded_memory():
    code = (
        "import random, resource, numpy as np\nfrom loam.llm import op5_language\n"
        "rng = random.Random(1)\ntext = ''.join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(2_000_000))\n"
        "v = op5_language.Binder().bundles([text], np.zeros(1, int), 1)\n"
        "assert abs(v).max() > 0\nprint(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)\n"
    )
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True)
    assert int(done.stdout.split()[-1]) < 1024  # MB


def test_nnpu_finds_what_only_confirmed_texts_hold(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for k in range(900):
        bad = rng.random() < 0.25
        text = words(rng, "abcdefgh", 20) + (" zzrude" + rng.choice(["ly", "st", ""]) if bad else "")
        docs.append((k, text))
        if k % 2 == 0:
            labels.append((k, 1, int(bad)))
    docs = spark.createDataFrame([*docs, (9001, None), (9002, ""), (None, "ab cd")], "doc_id long, text string").withColumn("toxic", F.lit(5))
    labels = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    found = op9_toxicity.score_toxicity(docs, labels).join(docs, "doc_id").collect()
    wrong = [r for r in found if r.doc_id < 9000 and r.predicted != ("zzrude" in r.text)]
    assert len(wrong) <= 9 and {r.predicted for r in found if r.doc_id > 9000} == {0}
    assert all(0 <= r.score <= 1 for r in found)


def test_nothing_confirmed_is_nothing_toxic(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in op9_toxicity.score_toxicity(docs, labels).collect()} == {0}


@pytest.fixture(scope="module")
def rude(spark):
    """1500 documents, a quarter rude; labels of a third of them. Some rows repeat, one is very long."""
    rng = random.Random(5)
    docs = [(k, words(rng, "abcdefgh", 20) + (f" {rng.choice(['zzrude', 'vvbad', 'wwfoul'])}" if k % 4 == 0 else "")) for k in range(1500)]
    labels = [(k, 1, int(k % 4 == 0)) for k in range(1500) if k % 3 == 0]
    docs += [docs[8]] * 25 + [(7000, "abc def " * 200_000 + "zzrude"), (7001, None), (7002, ""), (None, "vvbad")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_features_that_stand_out_equal_brute_force(rude, monkeypatch):
    docs, labels = rude
    marked = docs.where("text is not null").join(labels.where("toxic = 1").select("doc_id", F.lit(1).alias("l")), "doc_id", "left").select("text", F.coalesce("l", F.lit(0)).alias("confirmed"))
    monkeypatch.setattr(op9_toxicity, "MOST_COUNTED", 50)
    got = op9_toxicity.stand_out(marked, 0.3)
    rows = [(op9_toxicity.features(r.text), r.confirmed) for r in marked.collect()]
    nu, nc = len(rows), sum(c for _, c in rows)
    want = []
    for f in set().union(*(fs for fs, _ in rows)):
        u, c = sum(f in fs for fs, _ in rows), sum(f in fs for fs, k in rows if k)
        z = (c / nc - u / nu) / ((c + u + 1) / (nc + nu) * (1 / nc + 1 / nu)) ** 0.5
        if c >= op9_toxicity.LEAST_DOCUMENTS and z > op9_toxicity.LEAST_Z and 0.3 * c / nc >= op9_toxicity.LEAST_SHARE * u / nu:
            want.append((-z, f))
    assert got == [f for _, f in sorted(want)] and "=zzrude" in got


def test_toxicity_scores_equal_brute_force_and_held_out_labels_teach_nothing(spark, rude):
    docs, labels = rude
    model = op9_toxicity.train(docs, labels)
    found = op9_toxicity.score_toxicity(docs, labels).collect()
    plain = lambda t: float(op9_toxicity.sigmoid(model[""] + sum(model.get(f, 0) for f in op9_toxicity.features(t or ""))))
    key = lambda d: -1 if d is None else d
    assert sorted((key(r.doc_id), round(r.score, 9)) for r in found) == sorted((key(r.doc_id), round(plain(r.text), 9)) for r in docs.collect())
    held = op9_toxicity.fold(F.col("doc_id"), op9_toxicity.FOLDS) == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert op9_toxicity.train(docs, turned) == model
    right = [(r.predicted == 1) == (r.doc_id % 4 == 0) for r in found if r.held_out and r.doc_id is not None and r.doc_id < 1500]
    assert len(right) > 200 and np.mean(right) > 0.97
    assert {r.predicted for r in found if r.doc_id == 7000} == {1}
    assert op9_toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_every_unlabelled_row_counts_whatever_the_shares(rude, monkeypatch):
    docs, labels = rude
    whole = op9_toxicity.train(docs, labels)
    monkeypatch.setattr(op9_toxicity, "SHARE_ROWS", 2)
    parts = op9_toxicity.train(docs, labels)
    assert parts.keys() == whole.keys() and parts != whole
    assert {f for f, w in parts.items() if f and w > 0} == {f for f, w in whole.items() if f and w > 0}


def test_nnpu_risk_correction_keeps_clean_risk_from_going_negative():
    rng = np.random.default_rng(3)
    confirmed = (rng.random((200, 5)) < [0.9, 0.1, 0.5, 0.5, 0.5]).astype(np.float32)
    clean = (rng.random((1600, 5)) < [0.05, 0.1, 0.5, 0.5, 0.5]).astype(np.float32)
    sparse = lambda x: op9_toxicity.Sparse([np.nonzero(r)[0].tolist() for r in x], np.ones(len(x)), 5)
    w = op9_toxicity.nnpu(sparse(confirmed), sparse(np.vstack([clean, confirmed])), 1 / 9)
    assert w[0] > 1 and w[0] > 3 * np.abs(w[1:5]).max()


def test_co_training_keeps_clean_pages(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for k in range(600):
        good = rng.random() < 0.7
        text = words(rng, "abcdefgh", 60)
        text = text if good else text.upper().replace(" ", "!! ")
        docs.append((k, text, "en", f"s{k % 3}", len(text)))
        if k % 3:
            labels.append((k, int(good), 0))
    docs = spark.createDataFrame([*docs, (9001, None, None, None, None), (9002, "", "en", "s", 0)], DOCS).withColumn("kept", F.lit(1))
    labels = spark.createDataFrame([*labels, (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    found = op3_cotraining.classify(docs, labels).join(docs.drop("kept"), "doc_id").collect()
    assert len(found) == 602
    assert all(r.kept == (r.text == r.text.lower()) for r in found if r.doc_id < 9000)


def test_co_training_without_labels_keeps_all(spark):
    docs = spark.createDataFrame([(1, "a b", None, None, None), (None, None, "en", "s", 1)], DOCS)
    found = op3_cotraining.classify(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert [r.kept for r in found] == [True, True]


def test_views_learn_from_what_the_other_is_sure_of():
    rng = np.random.default_rng(5)
    y = np.arange(60) % 2
    noisy = lambda y: np.stack([y + rng.normal(0, 0.3, len(y)), rng.normal(0, 1, len(y))], 1)
    truth = np.arange(400) % 2
    learner = op3_cotraining.CoTraining((noisy(y), noisy(y)), y, np.arange(60) % 5 == 0)
    pool = noisy(truth), noisy(truth)
    for _ in range(3):
        p = [op3_cotraining.sigmoid(op3_cotraining.logit(learner.weights[k], pool[k])) for k in (0, 1)]
        for k in (0, 1):
            sure = np.nonzero(abs(p[1 - k] - 0.5) > 0.4)[0][:40]
            learner.hand_over(k, pool[k][sure], (p[1 - k][sure] > 0.5).astype(float))
        learner.fit()
    assert len(learner.own[0][1]) > 48 and len(learner.own[1][1]) > 48
    model = learner.model()
    raw = [op3_cotraining.logit(model["weights"][k], noisy(truth)) for k in (0, 1)]
    z = np.stack([p[0] * r + p[1] for p, r in zip(model["platt"], raw, strict=True)], 1)
    assert ((op3_cotraining.logit(model["both"], z) > 0) == truth).mean() > 0.95


@pytest.fixture(scope="module")
def pages(spark):
    """400 pages, two thirds labelled, some many times, one very long; and the labels."""
    rng = random.Random(8)
    docs, labels = [], []
    for k in range(400):
        good = rng.random() < 0.6
        text = words(rng, "abcdefgh", 30)
        text = text if good else text.upper().replace(" ", "!! ")
        docs.append((k, text, "en", f"s{k % 3}", len(text)))
        if k % 3:
            labels.append((k, int(good), 0))
    docs += [docs[1]] * 30 + [(8000, "x" * 300_000, "en", "s", None), (None, docs[0][1], "en", "s", 1)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_what_is_handed_over_equals_brute_force(pages):
    docs, labels = pages
    rows = op3_cotraining.viewed(docs, ["doc_id"])
    rng = np.random.default_rng(3)
    weights = [rng.normal(0, 2, n + 1) for n in (op3_cotraining.CONTENT, op3_cotraining.METADATA)]
    got = op3_cotraining.handed_over(rows, weights, (3, 5), 2)
    every = rows.select("a", "b", F.xxhash64(F.lit(2), "id", "a").alias("draw")).collect()
    for view in (0, 1):
        column, other, size = "ab"[view], "ab"[1 - view], (op3_cotraining.METADATA, op3_cotraining.CONTENT)[view]
        p = op3_cotraining.sigmoid(op3_cotraining.logit(weights[1 - view], op3_cotraining.stacked([r[other] for r in every], size)))
        for verdict, n, sure in ((0, 3, p <= 0.1), (1, 5, p >= 0.9)):
            want = sorted((r.draw, bytes(r[column])) for r, s in zip(every, sure, strict=True) if s)[:n]
            assert [bytes(r.features) for r in got if (r.view, r.verdict) == (view, verdict)] == [f for _, f in want]


def test_co_training_scores_equal_brute_force(pages):
    docs, labels = pages
    rows = op3_cotraining.viewed(docs, ["doc_id"])
    model = op3_cotraining.train(rows, labels)
    found = op3_cotraining.classify(docs, labels).collect()
    assert len(found) == docs.count()
    views = {(r.doc_id, r.text): r for r in docs.collect()}
    want = []
    for r in docs.collect():
        raw = op3_cotraining.content_view(r.text or "").astype(np.float32), op3_cotraining.metadata_view(r.text or "", r.lang, r.source, r.n_chars).astype(np.float32)
        z = np.array([p[0] * op3_cotraining.logit(w, x.astype(float)) + p[1] for p, w, x in zip(model["platt"], model["weights"], raw, strict=True)])
        want.append((-1 if r.doc_id is None else r.doc_id, round(float(op3_cotraining.sigmoid(op3_cotraining.logit(model["both"], z))), 9)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, round(r.score, 9)) for r in found) == sorted(want) and views


def test_held_out_labels_teach_no_quality(pages):
    docs, labels = pages
    held = op3_cotraining.fold(F.col("doc_id"), op3_cotraining.FOLDS) == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = ({(r.doc_id, r.score) for r in op3_cotraining.classify(docs, some).collect()} for some in (labels, turned))
    assert one == two
    right = [r.kept == (r.text == r.text.lower()) for r in op3_cotraining.classify(docs, labels).join(docs, "doc_id").where(held).where("doc_id < 400").collect()]
    assert len(right) > 50 and np.mean(right) > 0.95


def test_shapes_see_whole_words_and_labelled_rows_are_bounded(spark, pages):
    assert op3_cotraining.shape("a" * 50 + "1") == op3_cotraining.shape("a1") != op3_cotraining.shape("a" * 51)
    docs, labels = pages
    many = docs.unionByName(docs.where("doc_id < 20").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(40)))).withColumn("text", F.concat("text", F.col("n").cast("string"))).drop("n"))
    assert op3_cotraining.classify(many, labels, most_labelled=50).count() == many.count()
    none = spark.createDataFrame([], DOCS)
    assert op3_cotraining.classify(none, labels).count() == 0


def test_a_task_hands_over_no_more_than_may_be_taken(spark, monkeypatch):
    """The plan of a round limits each view and verdict in its tasks, before anything is shuffled."""
    from loam.llm import op3_cotraining as op3

    frame = type(spark.range(1))
    plans, collect = [], frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: plans.append(self._jdf.queryExecution().executedPlan().toString()) or collect(self))
    weights = [np.zeros(op3.CONTENT + 1), np.zeros(op3.METADATA + 1)]
    weights[0][-1] = weights[1][-1] = 10.0
    rows = [(k, np.zeros(op3.CONTENT, np.float32).tobytes(), np.zeros(op3.METADATA, np.float32).tobytes()) for k in range(50)]
    given = op3.handed_over(spark.createDataFrame(rows, "id long, a binary, b binary"), weights, (2, 3), 0)
    assert sorted((r.view, r.verdict) for r in given) == [(0, 1)] * 3 + [(1, 1)] * 3
    assert plans[-1].count("WindowGroupLimit") >= 2
