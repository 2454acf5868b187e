"""Ranked search, conversation repair and decontamination against brute force."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm import op11_best_position as op11, op12_repair_search as op12, op13_suffix_arrays as op13, registry
from loam.llm.words import words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def slow_words(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text or "")]


@pytest.mark.parametrize("name", ["op11_best_position_search", "op12_conversation_repair", "op13_benchmark_decontamination"])
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')")
    found, told = registry.queries()[name](spark, sf_dir).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(told.columns)
    plain = lambda f: sorted(map(str, f[sorted(f.columns)].astype(object).to_numpy().tolist()))
    assert plain(found) == plain(told)


def test_words_of_any_text():
    rng = random.Random(3)
    texts = [None, "", "A_b-C9é İX\x80\x00z", "x" * 3_000_000 + " Y", "ab " * 1_000_000] + ["".join(chr(rng.choice([*range(0, 300), 0x4E00, 0x1F600])) for _ in range(200)) for _ in range(50)]
    for text in texts:
        assert [w.decode() for w in words(text)] == slow_words(text)


# Ranked search


def corpus(n=400):
    rng = random.Random(11)
    letters = [f"w{int(rng.paretovariate(0.7)) % 90}" for _ in range(5000)]
    texts = [" ".join(rng.choices(letters, k=rng.choice([1, 5, 30, 200]))) for _ in range(n)]
    texts += [None, "", " - ", texts[3], texts[3].upper(), texts[3], "w1 " * 120_000, "É w1", "é w2"]
    return [(k * 7 % 1009, t, "clash") for k, t in enumerate(texts)] + [(None, texts[5], None), (5, texts[5], None), (5, texts[5], None)]


def slow_ranking(docs, items, k=10):
    bags = [(d, Counter(slow_words(t))) for d, t, *_ in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(w for _, b, _ in bags for w in b)
    out = []
    for item, text in items:
        scored = []
        for doc, bag, n in bags:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * bag[w]) // (1000 * bag[w] + 8 * m)) for w in slow_words(text) if w in bag)
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if missing else doc, -minus) for rank, (minus, missing, doc) in enumerate(heapq.nsmallest(k, scored), 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block,segment", [(1 << 20, 2_000_000), (40, 300)])
def test_ranking_equals_all_scores(spark, monkeypatch, block, segment):
    monkeypatch.setattr(op11, "BLOCK_BYTES", block)
    docs = corpus()
    items = [(1, "w1 w2 w2 w40 w41"), (2, docs[3][1]), (3, None), (4, "?"), (5, "nowhere"), (6, "w7 w8 É"), (6, "w7 w8 É"), (None, "W1")]
    table = spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(3)
    found = op11.rank_documents(table, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted([tuple(r) for r in found.collect()], key=str) == slow_ranking(docs, items)
    if segment < 1000:
        parts = list(op11._segments(__import__("pandas").DataFrame({"terms": [b"0000" * 1_500_000] * 4})))
        assert [len(p) for p in parts] == [1, 1, 1, 1]


def test_ranking_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    some = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    for d, i in ((docs, items), (some, items.where("false")), (docs, items.where("false"))):
        assert op11.rank_documents(d, i).collect() == []
    assert op11.rank_documents(some, items).schema.simpleString() == op11.rank_documents(some, items.where("false")).schema.simpleString()


def test_positions_stop_below_the_kth_score_and_keep_ties():
    rng = np.random.default_rng(5)
    n, k = 3000, 10
    rows = [np.unique(rng.zipf(1.3, 20) % 50) for _ in range(n)]
    sizes, terms = np.array([len(r) for r in rows]), np.concatenate(rows)
    impacts = rng.integers(0, 30, len(terms)) ** 3
    segment = op11.Segment(sizes, terms, impacts, 50)
    matrix = np.zeros((n, 50), np.int64)
    matrix[np.repeat(np.arange(n), sizes), terms] = impacts
    met = []
    for _ in range(40):
        asked = rng.choice(50, 4, replace=False)
        times = rng.integers(1, 3, 4)
        every = matrix[:, asked] @ times
        kth = max(1, np.sort(every)[-k])
        documents, scores, seen = segment.top(asked, times, k, 0)
        assert sorted(documents) == np.flatnonzero(every >= kth).tolist() and (every[documents] == scores).all()
        assert sorted(segment.top(asked, times, k, int(kth) + 1)[0]) == np.flatnonzero(every > kth).tolist()
        met.append(seen / max(1, (every > 0).sum()))
    assert np.mean(met) < 0.5


def test_long_norms_do_not_overflow():
    assert op11.length_norms(np.array([10**8]), 10**12, 10**15).tolist() == [25 + 75 * 10**20 // 10**15]


# Conversation repair


def slow_repair(codes, begin=0, ends=(0, 3), inserts_last=True):
    """Cheapest (cost, path) by Dijkstra's order over (cost, path)."""
    heap, done = [(0, "", 0, begin)], set()
    while heap:
        cost, path, i, q = heapq.heappop(heap)
        if i == len(codes) and q in ends:
            return cost, path
        if (i, q) in done:
            continue
        done.add((i, q))
        if i < len(codes) or inserts_last:
            heapq.heappush(heap, (cost + 2, path + "I", i, 3 if q == 2 else 2))
        if i < len(codes):
            heapq.heappush(heap, (cost + 3, path + "D", i + 1, q))
            if codes[i] != "-":
                extra, c = int(codes[i].isupper()), codes[i].lower()
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, c))
                if to:
                    heapq.heappush(heap, (cost + extra, path + "K", i + 1, to))
                heapq.heappush(heap, (cost + 2 + extra, path + "R", i + 1, 3 if q == 2 else 2))
    return None


def test_search_finds_the_cheapest_and_least_path():
    for n in range(5):
        for codes in map("".join, itertools.product("suaxUA-", repeat=n)):
            assert op12.Search(codes, True).cheapest(0, None) == slow_repair(codes)
    rng = random.Random(1)
    for _ in range(300):
        codes = "".join(rng.choice("suauauauaxSUAX-") for _ in range(rng.randint(5, 25)))
        assert op12.Search(codes, True).cheapest(0, None) == slow_repair(codes)
        for begin, end in itertools.product(range(4), repeat=2):
            assert op12.Search(codes[:12], False).cheapest(begin, end) == slow_repair(codes[:12], begin, (end,), False)
            assert op12.Search(codes[:12], True).cheapest(begin, None) == slow_repair(codes[:12], begin)


def slow_conversations(rows):
    """The contract, row by row."""
    by_conv = {}
    for conv, turn, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        mine = by_conv.setdefault(conv, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, mine in by_conv.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        turns, seen, codes, counts = {t for t, _, _ in mine if t is not None}, set(), "", Counter()
        for _, role, text in mine:
            signs = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not signs else "duplicate" if (role, text) in seen else "truncated" if signs[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            letter = role[:1] if role[:1] and role[:1] in "sua" else "x"
            codes += "-" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit = slow_repair(codes)
        lines, at, q = [], 0, 0
        for edit in audit:
            added = ("assistant", 3) if q == 2 else ("user", 2)
            if edit == "I":
                lines.append(f"{added[0]}:")
            elif edit == "R":
                lines.append(f"{added[0]}:{mine[at][2]}")
            elif edit == "K":
                lines.append(f"{mine[at][1]}:{mine[at][2]}")
            q = q if edit == "D" else "sua".index(mine[at][1][0]) + 1 if edit == "K" else added[1]
            at += edit != "I"
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [128, 3])
def test_repair_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(op12, "BLOCK", block)
    rng = random.Random(8)
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "", None], ["Yes.", "no", " ", None, "", "Why?\n", "é!", "a.b", "x" * 100_000 + "."]
    rows = [(c, t, rng.choice(roles), rng.choice(texts), "clash") for c in [*range(60), None] for t in range(rng.choice([1, 2, 7, 15]))]
    rows += [(c, None, "user", "A.", None) for c in (1, 2, None)] + [(3, 2, "assistant", "A.", None)] * 3 + [(4, -5, "user", "B.", None), (2**53 + 1, 0, "user", "C.", None)]
    rows += [(77, t, ("user", "assistant")[t % 2 if t % 11 else 1], f"{t}.", None) for t in range(700)]
    # a conversation whose only row is dropped
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "Bye.", None))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, audit string").repartition(3)
    found = op12.repaired(op12.damaged(table), table)
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert found.columns == names
    assert sorted([tuple(r) for r in found.collect()], key=str) == slow_conversations(rows)
    assert (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) in {tuple(r) for r in found.collect()}


def test_repair_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert op12.repaired(op12.damaged(empty), empty).collect() == []


def test_a_long_conversation_is_searched_in_blocks(spark):
    rows = [(1, t, "tool" if t % 3 == 1 else ("user", "assistant")[t % 2], f"{t}", "") for t in range(3000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, x string")
    assert [tuple(r) for r in op12.repaired(op12.damaged(table), table).collect()] == slow_conversations(rows)


# Decontamination


def slow_contamination(docs, items, window=10):
    wanted = {}
    for item, text in items:
        w = slow_words(text)
        size = min(window, len(w))
        for p in range(len(w) - size + 1 if w else 0):
            wanted.setdefault(tuple(w[p : p + size]), set()).add(item)
    out = []
    for doc, text, *_ in docs:
        w, hit, named = slow_words(text), set(), set()
        for size in {len(x) for x in wanted}:
            for p in range(len(w) - size + 1):
                if tuple(w[p : p + size]) in wanted:
                    hit |= set(range(p, p + size))
                    named |= wanted[tuple(w[p : p + size])]
        out.append((doc, len(w), len(hit), sorted(str(x) for x in named if x is not None)))
    return sorted(out, key=str)


def passages():
    rng = random.Random(4)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta é9 ü".split())
    items = [(k, " ".join(word() for _ in range(rng.choice([0, 3, 10, 11, 40])))) for k in range(30)]
    items = [(k, t) for k, t in items if len(t.split()) != 3 or k < 3]
    items += [(100, "One lone WORD"), (101, None), (102, "?!"), (None, "nobody owns these words"), (7, "a second text of seven"), (100, "One lone WORD"), (103, items[4][1] or "x y")]
    docs = []
    for k in range(200):
        text = [word() if rng.random() < 0.8 else f"filler{rng.randint(0, 99)}" for _ in range(rng.randint(0, 60))]
        for _ in range(rng.choice([0, 0, 1, 3])):
            cut = slow_words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(cut) - 9))
            at = rng.randint(0, len(text))
            text[at:at] = [w.upper() for w in cut[a : a + rng.randint(5, 30)]]
        docs.append((k, ", ".join(text), k))
    docs += [(None, items[5][1], 0), (5, None, 0), (5, "", 0), (6, "nobody OWNS these-words; a second text of seven", 0), (8, "one " * 40_000 + "one lone word " * 2000, 0), (9, docs[3][1], 0), (9, docs[3][1], 0)]
    return docs, items


@pytest.mark.parametrize("block,shard", [(1 << 20, 1_000_000), (200, 50)])
def test_contamination_equals_brute_force(spark, monkeypatch, block, shard):
    monkeypatch.setattr(op13, "BLOCK_BYTES", block)
    docs, items = passages()
    table = spark.createDataFrame(docs, "doc_id long, text string, found int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = op13.contamination(table, bench, "_found").select("doc_id", "_found.n_words", "_found.n_hit", "_found.items").collect()
    expected = slow_contamination(docs, items)
    assert sorted([tuple(r) for r in got], key=str) == expected
    clean = op13.decontaminated(table, bench)
    assert clean.columns == table.columns and clean.count() == sum(r[2] == 0 for r in expected)


def test_shards_of_any_size_find_the_same(monkeypatch):
    docs, items = passages()
    rows = [{"item_id": str(k), "text": t} for k, t in items]
    tests = op13.tests_of(rows)
    results = []
    for size in (1, 60, 10**9):
        monkeypatch.setattr(op13, "SHARD_WORDS", size)
        counts, hits, named = op13._hit_by(tests)([t for _, t, _ in docs])
        results.append((counts, {k: v.tolist() for k, v in hits.items()}, named))
    assert results[0] == results[1] == results[2]


def test_suffixes_are_sorted():
    rng = np.random.default_rng(2)
    for alphabet, n in ((2, 300), (50, 300), (1, 40), (3, 1), (3, 0)):
        text = rng.integers(0, alphabet, n).astype(np.int32)
        got = op13.suffix_array(text, 400)
        assert got.tolist() == sorted(range(n), key=lambda p: text[p:].tolist())


def test_longest_matches_equal_brute_force(spark):
    docs, items = passages()
    docs = docs[:60] + [(None, items[5][1], 0)]
    items = [(str(k), t) for k, t in items if k is not None and k != 7][:25]
    items = [(k, t) for k, t in items if len(slow_words(t)) >= 10]
    texts = [(d, slow_words(t)) for d, t, *_ in docs]
    expected = set()
    for item, text in items:
        w = slow_words(text)
        for s in range(len(w) - 9):
            best, places = 0, []
            for doc, other in texts:
                for p in range(len(other)):
                    n = 0
                    while s + n < len(w) and p + n < len(other) and w[s + n] == other[p + n]:
                        n += 1
                    if n >= 10 and n >= best:
                        best, places = n, ([] if n > best else places) + [(doc, p)]
            expected |= {(item, s, best, doc, p) for doc, p in places}
    found = op13.longest_matches(spark.createDataFrame(docs, "doc_id long, text string, x int").repartition(3), spark.createDataFrame(items, "item_id string, text string"))
    assert expected and {tuple(r) for r in found.collect()} == expected


def test_decontamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert op13.contamination(docs.where("false"), items).collect() == [] and op13.decontaminated(docs, items).collect() == []
    assert op13.decontaminated(docs, items.where("false")).count() == 1 and op13.longest_matches(docs, items.where("false")).collect() == []
    assert op13.contamination(docs, items).select(F.col("found.n_hit")).first()[0] == 2
