"""Mixing, sharding and rules against plain versions; the pipeline's stages."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loam.llm import op2_mixing, op4_sharding, op8_rules, registry
from loam.llm.tokens import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    rows = []
    for k in range(1500):
        n = rng.choice([0, 1, 5, 40, 200])
        text = " ".join(rng.choice(["aa", "bb", "cc"]) for _ in range(n)) if n or k % 2 else None
        rows.append((k, text, rng.choice(["web", "web", "web", "web", "book", "Code", "é", None]), "en", n))
    rows += [rows[4]] * 3 + [(None, "no id here", "web", "en", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")


def test_targets_share_by_weight_up_to_the_cap():
    sizes = [("a", 10), ("b", 1000), ("c", 1000), (None, 30)]
    targets = op2_mixing.source_targets(sizes)
    assert sum(targets) == pytest.approx(2040)
    assert targets[0] == 30 and targets[3] == 90 and targets[1] == pytest.approx(1920 * 2 / 3) and targets[2] == pytest.approx(640)
    assert op2_mixing.source_targets([("a", 0), ("b", 0)]) == [0, 0] and op2_mixing.source_targets([]) == []


def test_splitting_tree_is_exact():
    blocks = np.array([100, 7, 0, 33])
    quotas = op2_mixing.splitting_tree(blocks, 13, 3)
    assert (quotas.sum(axis=1) == blocks).all() and (quotas >= 0).all()
    assert np.ptp(quotas.sum(axis=0)) <= 2
    assert (quotas == op2_mixing.splitting_tree(blocks, 13, 3)).all()


def test_mix_takes_the_targets(spark, docs, monkeypatch):
    monkeypatch.setattr(op2_mixing, "LEAST_BLOCK", 16)
    mixed = op2_mixing.mix(docs.withColumn("tie", F.lit(1)).withColumn("range", F.lit(1)), n_shards=8).cache()
    per_document = op2_mixing.taken_words(mixed).collect()
    rows = docs.collect()
    assert len(per_document) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, op2_mixing.source_targets([(s, sizes[s]) for s in order]), strict=True))
    taken = Counter()
    for r in mixed.collect():
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and r.target == target[r.source] and r.taken <= r.size
        assert (r.shard is None) == (r.taken == 0) and (r.shard is None or 0 <= r.shard < 8)
    assert all(taken[s] == round(target[s]) for s in order)
    assert all(r.taken <= 3 * r["size"] for r in per_document)
    blocks = mixed.where("taken > 0").groupBy("source", "shard").agg(F.sum("taken").alias("n")).collect()
    assert len({r.shard for r in blocks if r.source == "web"}) == 8
    key = lambda r: (-1 if r.doc_id is None else r.doc_id, r["size"], r.taken)
    again = op2_mixing.taken_words(op2_mixing.mix(docs.repartition(7), n_shards=8)).collect()
    assert sorted(map(key, again)) == sorted(map(key, per_document))


def test_mixed_documents_hold_the_taken_words(docs):
    docs = docs.withColumn("taken", F.lit("clash")).withColumn("size", F.lit("clash")).withColumn("count", F.lit(1)).withColumn("row", F.lit(1))
    mixed = op2_mixing.mixed_documents(docs, n_shards=4)
    assert mixed.columns == docs.columns
    whole = op2_mixing.taken_words(op2_mixing.mix(docs, n_shards=4)).agg(F.sum("taken")).first()[0]
    rows = mixed.collect()
    assert sum(len(WORD.findall(r.text)) for r in rows) == whole
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    assert all(texts[r.doc_id].startswith(r.text) for r in rows if r.doc_id is not None)


def test_the_tree_decides_what_is_taken(docs, monkeypatch):
    monkeypatch.setattr(op2_mixing, "LEAST_BLOCK", 16)
    key = lambda r: (-1 if r.doc_id is None else r.doc_id, r.size_, r.taken, tuple(r.shards), tuple(r.places))
    rows = lambda: sorted(map(key, op2_mixing.taken_words(op2_mixing.mix(docs, n_shards=8)).withColumnRenamed("size", "size_").collect()))
    before = rows()
    tree = op2_mixing.splitting_tree
    monkeypatch.setattr(op2_mixing, "splitting_tree", lambda *a: tree(*a)[:, ::-1])  # the same counts, dealt to other shards
    after = rows()
    assert [r[:3] for r in before] != [r[:3] for r in after]
    assert sum(r[2] for r in before) == sum(r[2] for r in after)
    monkeypatch.setattr(op2_mixing, "splitting_tree", tree)
    fewer = op2_mixing.taken_words(op2_mixing.mix(docs, n_shards=3)).withColumnRenamed("size", "size_").collect()
    assert [r[:3] for r in sorted(map(key, fewer))] != [r[:3] for r in before]


def test_shards_hold_the_blocks_that_the_tree_gave_them(docs, monkeypatch):
    monkeypatch.setattr(op2_mixing, "LEAST_BLOCK", 16)
    given = {}
    tree = op2_mixing.splitting_tree

    def watched(blocks, n_shards, seed):
        given["quotas"] = tree(blocks, n_shards, seed)
        return given["quotas"]

    monkeypatch.setattr(op2_mixing, "splitting_tree", watched)
    rows = op2_mixing.mix(docs, n_shards=8).where("taken > 0").collect()
    order = sorted({r.source for r in docs.collect()}, key=lambda s: (s is None, s or ""))
    drawn = {}
    for r in rows:
        drawn.setdefault((r.source, r.shard), set()).add(r.place >> 32)
    for k, source in enumerate(order):
        got = [len(drawn.get((source, s), ())) for s in range(8)]
        # Blocks of 16 words hold documents of up to 200, so a source's words end some blocks before or after its quota.
        assert abs(sum(got) - given["quotas"][k].sum()) <= 3 + 0.1 * given["quotas"][k].sum()
        assert (np.abs(np.array(got) - given["quotas"][k]) <= 2 + 0.2 * given["quotas"][k]).all()
    places = {}
    for r in rows:
        places.setdefault(r.place >> 32, set()).add((r.source, r.shard))
    assert all(len(v) == 1 for v in places.values())  # a block is in one shard


def test_mixed_documents_take_any_column_names_and_keep_the_order_of_shards(docs, monkeypatch):
    monkeypatch.setattr(op2_mixing, "LEAST_BLOCK", 64)
    names = ["tie", "_tie", "id", "_id", "doc", "taken", "_taken", "_copy", "shard", "place", "row", "range", "block", "copy", "words", "start"]
    odd = docs
    for k, name in enumerate(names):
        odd = odd.withColumn(name, F.lit(f"v{k}"))
    mixed = op2_mixing.mixed_documents(odd, n_shards=4)
    rows = mixed.collect()
    assert mixed.columns == odd.columns and all(r[name] == f"v{k}" for r in rows[:50] for k, name in enumerate(names))
    plain = op2_mixing.mixed_documents(docs, n_shards=4).collect()
    assert [(r.doc_id, r.text) for r in rows] == [(r.doc_id, r.text) for r in plain]
    shard = {(r.doc_id, r.copy): r.shard for r in op2_mixing.mix(docs, n_shards=4).where("taken > 0 and doc_id > 10").collect()}
    once = [r.doc_id for r in plain if (r.doc_id, 1) not in shard and (r.doc_id, 0) in shard and (r.doc_id, 2) not in shard]
    found = [shard[d, 0] for d in once]
    assert found == sorted(found) and len(set(found)) == 4


def test_a_very_long_document_is_mixed_whole(spark):
    docs = spark.createDataFrame([(1, "a " * 100_000, "x"), (2, "b c", "x"), (3, "d", "y")], "doc_id long, text string, source string")
    found = {r.doc_id: r for r in op2_mixing.taken_words(op2_mixing.mix(docs)).collect()}
    assert found[1]["size"] == 100_000 and found[3].taken == 3 and sum(r.taken for r in found.values()) == round(found[1].target) + round(found[3].target)


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert op2_mixing.taken_words(op2_mixing.mix(none)).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert [r.taken for r in op2_mixing.taken_words(op2_mixing.mix(blank)).collect()] == [0, 0]


def slow_table(shards, slots):
    import hashlib

    order = []
    for name in shards:
        d = hashlib.sha256(name.encode()).digest()
        offset, step = int.from_bytes(d[:8], "big") % slots, int.from_bytes(d[8:16], "big") % (slots - 1) + 1
        order.append([(offset + j * step) % slots for j in range(slots)])
    owner, k = {}, 0
    while len(owner) < slots:
        owner[next(s for s in order[k % len(shards)] if s not in owner)] = k % len(shards)
        k += 1
    return [owner[s] for s in range(slots)]


def test_lookup_table_is_filled_in_turns():
    names = [f"n{k}" for k in range(7)]
    assert op4_sharding.lookup_table(names, 101).tolist() == slow_table(names, 101)
    many = [f"n{k}" for k in range(40)]
    a, b = op4_sharding.lookup_table(many, 4001), op4_sharding.lookup_table(many[:-1], 4001)
    assert np.ptp(np.bincount(a)) <= 1
    assert (a != b).mean() < 0.08  # a fortieth has to move
    with pytest.raises(ValueError):
        op4_sharding.lookup_table(names, 100)


def test_documents_keep_to_their_shard(spark, docs):
    names = [f"n{k}" for k in range(5)]
    sharded = op4_sharding.shard_documents(docs.withColumn("slot", F.lit("clash")), names, slots=1009)
    rows = sharded.collect()
    assert len(rows) == docs.count() and len({(r.doc_id, r._shard) for r in rows}) == len({r.doc_id for r in rows})
    import hashlib

    table = slow_table(names, 1009)
    for r in rows[:200]:
        slot = 0 if r.doc_id is None else int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % 1009
        assert r._slot == slot and r._shard == names[table[slot]]
    assert op4_sharding.shard_documents(docs.limit(0), names, slots=1009).count() == 0


def test_sharded_columns_keep_their_names(docs, tmp_path):
    odd = docs.withColumn("_slot", F.lit("a")).withColumn("_SHARD", F.lit("b")).withColumn("of", F.lit("c")).withColumn("owner", F.lit("d"))
    sharded = op4_sharding.shard_documents(odd, ["p", "q"], slots=101)
    assert sharded.columns == [*odd.columns, "__slot", "__shard"]
    assert {(r._slot, r._SHARD, r.of, r.owner) for r in sharded.collect()} == {("a", "b", "c", "d")}
    op4_sharding.write_shards(op4_sharding.shard_documents(docs, ["p", "q"], slots=101), f"{tmp_path}/shards")
    assert docs.sparkSession.read.parquet(f"{tmp_path}/shards").count() == docs.count()


def test_sharding_equals_its_sql(spark):
    docs = spark.createDataFrame([(k, "é" * k) for k in range(400)] + [(None, None), (5, "twice")], "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.execute(op4_sharding.oracle_sql(registry.SHARDS)).fetchall()
    found = op4_sharding.shard_documents(docs, registry.SHARDS).select("doc_id", "_slot", "_shard", F.coalesce(F.octet_length("text"), F.lit(0)))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in found.collect())


def slow_repeats(words):
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    return len({k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)})


def test_repeated_words():
    rng = random.Random(12)
    for _ in range(300):
        words = [rng.choice("ab") for _ in range(rng.randint(0, 60))]
        assert op8_rules.repeated_words(words) == slow_repeats(words)


def test_rules_equal_sql_and_do_not_depend_on_order(spark):
    rng = random.Random(13)
    parts = ["the cat sat", "ON THE MAT!!", "a|b|c #", "12 34 56", "naïve　Straße", "\n", "x\ny", "wwwwwwwwwwwwwwwwwwwwwwwwwww", "it's\x0bfine."]
    texts = [None, "", " \n ", "é " * 30] + [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    found = op8_rules.apply_rules(docs).toPandas()
    con = duckdb.connect()
    documents = docs.select("doc_id", "text").toPandas()  # noqa: F841  read by name
    con.register("documents", docs.select("doc_id", "text").toArrow())
    want = con.execute(op8_rules.ORACLE_SQL).df()[list(found.columns)]
    key = list(found.columns)
    plain = lambda f: sorted(map(str, f[key].astype(object).where(f[key].notna(), None).astype(str).values.tolist()))
    assert plain(found.astype({"doc_id": "Int64"})) == plain(want.astype({"doc_id": "Int64"}))
    for t in texts:
        page = op8_rules.Page(t)
        if not page.base_failed:
            names = list(op8_rules.RULES)
            assert op8_rules.rejected(page, names) == op8_rules.rejected(page, names[::-1])
    assert op8_rules.apply_rules(docs.limit(0)).count() == 0


def test_queries_are_registered():
    names = list(registry.queries())
    assert [n.split("_")[0] for n in names] == [*(f"op{k}" for k in range(1, 11)), "pipeline"]
    assert set(registry.oracle_sql()) <= set(names)


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir).cache()
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        assert after.count() <= before.count() or name == "mixing"
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir)
    assert packed.agg(F.sum("length")).first()[0] >= before.count()
    ids = {r.doc_id for r in before.select("doc_id").collect()}
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small corpus with rude, shouting, equal and near-equal documents, nulls, empty texts, clashing names; and its labels."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    docs, labels = [], []
    for k in range(700):
        text = " ".join(word() for _ in range(rng.randint(40, 90)))
        toxic, good = k % 5 == 0, k % 7 > 1
        text = text + " zzrude zzvile" if toxic else text
        text = text if good else text.upper().replace(" ", "!! ")
        docs.append((k, text, "en", rng.choice(["web", "web", "book", None]), len(text), "x"))
        if k % 2:
            labels.append((k, int(good), int(toxic)))
    docs += [(1000 + k, docs[8 * k + 1][1], "en", "web", 1, "x") for k in range(20)]
    near = [docs[8 * k + 2][1].split() for k in range(20)]
    docs += [(2000 + k, " ".join([*w[:-1], "changed"]), "en", "book", 1, "x") for k, w in enumerate(near)]
    docs += [(3000, None, None, None, None, None), (3001, "", "en", "web", 0, "x"), (None, "no id " * 30, "en", "web", 1, "x"), docs[3], docs[3]]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, component string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_pipeline_stages_equal_plain_versions(spark, corpus):
    from loam.llm import op3_cotraining, op9_toxicity, shingles
    from loam.llm.tokens import vocabulary
    from tokenizers import Tokenizer

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    labels = spark.read.parquet(f"{corpus}/labels.parquet")
    rows = lambda df: Counter(map(tuple, df.collect()))
    clean = stages["toxicity"](spark, docs, corpus)
    model = op9_toxicity.train(docs, labels)
    score = lambda t: op9_toxicity.sigmoid(model[""] + sum(model.get(f, 0) for f in op9_toxicity.features(t or "")))
    assert rows(clean) == Counter(tuple(r) for r in docs.collect() if score(r.text) < 0.5)
    assert not any("zzrude" in (r.text or "").lower() for r in clean.collect()) and clean.count() > 500
    good = stages["quality"](spark, clean, corpus)
    model = op3_cotraining.train(op3_cotraining.viewed(clean, ["doc_id"]), labels)
    kept = Counter()
    for r in clean.collect():
        x = [op3_cotraining.content_view(r.text or ""), op3_cotraining.metadata_view(r.text or "", r.lang, r.source, r.n_chars)]
        z = np.array([p[0] * op3_cotraining.logit(w, v.astype(np.float32).astype(float)) + p[1] for p, w, v in zip(model["platt"], model["weights"], x, strict=True)])
        kept[tuple(r)] += op3_cotraining.sigmoid(op3_cotraining.logit(model["both"], z)) >= 0.5
    assert rows(good) == +kept
    apart = stages["near_duplicates"](spark, good, corpus)
    table = sorted(set(map(tuple, good.collect())), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    sets = [frozenset(shingles.shingles(r[1]).tolist()) for r in table]
    group = list(range(len(table)))
    for a in range(len(table)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if (not sets[a] and not sets[b]) or both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    assert apart.count() == len(set(group)) < len(table)
    assert {r.doc_id for r in apart.collect()} == {table[g][0] for g in set(group)}
    mixed = stages["mixing"](spark, apart, corpus)
    taken = op2_mixing.taken_words(op2_mixing.mix(apart)).groupBy("doc_id").agg(F.sum("taken").alias("n")).where("n > 0").collect()
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
    assert words == Counter({r.doc_id: r.n for r in taken})
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    packed = stages["packing"](spark, mixed, corpus).collect()
    ids = Counter()
    for r in packed:
        ids[r.doc_id] += r.length
        assert r.length & (r.length - 1) == 0
    assert ids == sum((Counter({r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) + 1}) for r in mixed.collect()), Counter())


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_vocabulary_paths_exist():
    assert vocabulary("word_bpe_49k.json").endswith(".json")
