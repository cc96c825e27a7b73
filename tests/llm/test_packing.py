import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loamwork.llm import packing


def check_plan(lengths, window):
    sequences = packing.plan(lengths, window)
    held = defaultdict(list)
    for s in sequences:
        total = sum(n for _, _, n in s)
        assert total == window or total < window and total & (total - 1) == 0
        for k, a, n in s:
            assert n > 0
            held[k].append((a, n))
    for k, n in enumerate(lengths):
        at = 0
        for a, m in sorted(held[k]):
            assert a == at
            at += m
        assert at == n
    return sequences


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60), st.sampled_from([1, 7, 16, 32]))
def test_every_id_lies_in_one_piece(lengths, window):
    check_plan(lengths, window)


def test_few_documents_are_cut():
    lengths = np.random.default_rng(3).integers(1, 2048, 5000).tolist()
    sequences = check_plan(lengths, 2048)
    assert sum(map(len, sequences)) - len(lengths) < 0.15 * len(lengths)
    check_plan([1024] * 999 + [512] * 3, 2048)


def test_the_fit():
    histogram = np.zeros(17, int)
    histogram[[10, 6, 4, 8]] = [5, 3, 2, 4]
    combos = packing.combinations(histogram > 0, 16)
    x = packing.repeats(combos, histogram, 3000)
    got = {tuple(c): round(v, 2) for c, v in zip(combos.tolist(), x)}
    assert got[(10, 6, 0)] >= 3 and got[(8, 8, 0)] > 0 and (x >= 0).all()


@pytest.mark.parametrize("shard", [200, 10**6])
def test_packed_corpus(spark, shard):
    texts = ["a b c " * 900, "", None, "one", "Zwei drei", "x y"] * 5
    docs = spark.createDataFrame([(k if k != 3 else None, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, offset int").coalesce(2)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack(docs, path, 1, 64, shard).collect()
    t = Tokenizer.from_file(path)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for k, text in enumerate(texts):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(pieces[k if k != 3 else None], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 64 or at & (at - 1) == 0


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"), 1, 64).count() == 0
