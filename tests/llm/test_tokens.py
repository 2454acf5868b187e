"""Token output, its codes, and packing, against the tokenizers library used plainly."""

import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loam.llm import op1_token_codes, op7_packing
from loam.llm.shared import new_path
from loam.llm.tokens import pieces, vocabulary

BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
ODD = [None, "", " ", "\n\n a \t b", "it's DON'T  x", "héllo ǅ ß ﬁ ½² 12a", "<|endoftext|>", "中文 текст Σίσυφος", "a" * 5000, "w \xa0\n\n x  y\x85z", "é ́"]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list(" \n\t\x0b\x1c\x85\xa0 　aZé'sǅЖΣ1½²³.,!_-$中́​")), max_size=40))
def test_pieces_equal_the_whole_text(text):
    for path in (BYTE, WORD):
        table = pieces(path)
        assert np.frombuffer(table.encode(text), "<u4").tolist() == fresh_library(path).encode(text, add_special_tokens=False).ids


@lru_cache
def fresh_library(path):
    return Tokenizer.from_file(path)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "<", " ", "  ", "\n", "a", "Zé", "é", "́", "'s", "1", "."]), max_size=12))
def test_added_tokens_equal_a_fresh_library(parts):
    text = "".join(parts)
    for path in (BYTE, WORD):
        fresh = fresh_library(path)
        assert np.frombuffer(pieces(path).encode(text), "<u4").tolist() == fresh.encode(text, add_special_tokens=False).ids


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(list("İıŞ-.!'s a1_½²é\u0301\u0307ß\u0958ש\ufb2aΩ\u212b\u1fef;\u037eΣςǅ日ﬁ\t\n\x1c\x85\u3000") + ["<|endoftext|>", "don't", "AB"]), max_size=10))
def test_normalised_texts_equal_a_fresh_library(parts):
    text = "".join(parts)
    for path in (BYTE, WORD):
        assert np.frombuffer(pieces(path).encode(text), "<u4").tolist() == fresh_library(path).encode(text, add_special_tokens=False).ids


def test_added_tokens_have_their_ids():
    text = "a<|endoftext|> b<|startoftext|>"
    assert 50256 in np.frombuffer(pieces(BYTE).encode(text), "<u4")
    assert {49406, 49407} <= set(np.frombuffer(pieces(WORD).encode(text), "<u4").tolist())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 2**16), st.integers(0, 2**32 - 1)), max_size=1500))
def test_codes_give_back_every_id(ids):
    data = np.array(ids, "<u4")
    codes = op1_token_codes.Codes(op1_token_codes.encode_codes(data))
    assert codes.run(0, len(ids)).tolist() == ids
    rng = random.Random(0)
    for k in rng.sample(range(len(ids)), min(40, len(ids))):
        assert codes[k] == ids[k]
        n = rng.randint(0, len(ids) - k)
        assert codes.run(k, n).tolist() == ids[k : k + n]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(["the", "of", "Straße", "naïve", "x9", "end."]) for _ in range(rng.randint(0, 900)))) for k in rng.sample(range(10_000), 60)]
    rows += [(20_000 + k, t) for k, t in enumerate(ODD)] + [(7, "twice"), (7, "twice"), (7, "other"), (None, "no id")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("ids", F.lit(1)).withColumn("start", F.lit("clash"))


def plain(path, text, end):
    return fresh_library(path).encode(text or "", add_special_tokens=False).ids + [end]


def test_token_codes_round_trip(docs):
    found = op1_token_codes.token_codes(docs, BYTE).orderBy("start").collect()
    texts = docs.select("doc_id", "text").collect()
    want = sorted((r.doc_id if r.doc_id is not None else -1, zlib.crc32(np.array(plain(BYTE, r.text, 0), "<u4").tobytes())) for r in texts)
    assert sorted((r.doc_id if r.doc_id is not None else -1, zlib.crc32(bytes(r.ids))) for r in found) == want
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
    names = [-1 if r.doc_id is None else r.doc_id for r in found]
    assert names == sorted(names)


def test_codes_are_read_at_random_places(spark, docs):
    path = new_path(spark, "codes")
    op1_token_codes.write_codes(docs, path, BYTE)
    row = spark.read.parquet(path).orderBy(F.desc("n_ids")).first()
    codes = op1_token_codes.Codes(bytes(row.codes))
    assert [codes[k] for k in range(0, codes.n_ids, 97)] == codes.run(0, codes.n_ids)[::97].tolist()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert op1_token_codes.token_codes(none, BYTE).count() == 0 and op7_packing.pack(none, WORD).count() == 0


def test_packing_puts_every_id_in_one_piece(docs):
    rows = op7_packing.pack(docs, WORD).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    assert all(r.length == len(r.ids) // 4 == 1 << r.bucket <= 2048 for r in rows)
    together = {}
    for r in sorted(rows, key=lambda r: r.sequence_id):
        together.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    made = []
    for (_, n), some in together.items():
        ids = b"".join(bytes(r.ids) for r in some)
        made += [(some[0].doc_id, ids[k : k + 4 * n]) for k in range(0, len(ids), 4 * n)]
    key = lambda x: (-1 if x[0] is None else x[0], x[1])
    want = [(r.doc_id, np.array(plain(WORD, r.text, 1), "<u4").tobytes()) for r in docs.select("doc_id", "text").collect()]
    assert sorted(made, key=key) == sorted(want, key=key)


@given(st.integers(1, 100_000))
def test_lengths_add_up(n):
    cut = op7_packing.lengths(n, 2048)
    assert sum(cut) == n and cut == sorted(cut, reverse=True) and all(x & (x - 1) == 0 for x in cut)
