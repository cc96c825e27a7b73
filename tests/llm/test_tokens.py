import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loamwork.llm import bitfile
from loamwork.llm.encoder import Encoder
from loamwork.llm.tokenfiles import read_corpus, write_corpus

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
TEXTS = ["", "Hello, world's end.\n\n  two  spaces \t tabs", "don't''s I'LL\n \n x", "éáő naïve Ünïcödé ｗｉｄｅ", "<|endoftext|> x <|startoftext|>", "日本語のテキスト 123 45", "a\x1cb\x85c　d   e", "x" * 3000, "ab́c'd", "THE!! END%%% | a$$$", "\U0001f600 ok\r\n\r\n", "Σας ΣΑΣ İi"]


def whole(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_pieces_give_the_ids_of_the_whole(name):
    e, w = Encoder(public_tokenizers.path(name), kept=7), whole(name)
    for _ in range(2):
        for t, got in zip(TEXTS, e.encode(TEXTS)):
            assert np.frombuffer(got, "<u4").tolist() == w(t), t


@pytest.mark.parametrize("name", FILES)
def test_any_text(name):
    e, w = Encoder(public_tokenizers.path(name)), whole(name)

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sdLm,.!é1ő́\x1c\x85\xa0"), st.characters(codec="utf-8")), max_size=30))
    def check(t):
        assert np.frombuffer(e.encode([t])[0], "<u4").tolist() == w(t)

    check()


@given(st.integers(1, 32).flatmap(lambda b: st.tuples(st.just(b), st.lists(st.integers(0, 2**b - 1), max_size=50))))
def test_packing_round_trip(case):
    bits, ids = case
    ids = np.array(ids, "<u4")
    data = bitfile.pack(ids, bits)
    assert len(data) == (len(ids) * bits + 7) // 8 and bitfile.unpack(data, bits, len(ids)).tolist() == ids.tolist()


def test_random_access():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 50_000, n, "u4") for n in (0, 5, 70, 3, 0, 200, 1)]
    out = io.BytesIO()
    w = bitfile.Writer(out, 17, block=16)
    for k, d in enumerate(docs):
        w.add(None if k == 0 else k, d.astype("<u4").tobytes())
    w.close()
    r = bitfile.Reader(out, len(out.getvalue()))
    assert [(i, x.tolist()) for i, _, x in r] == [(k or None, d.tolist()) for k, d in enumerate(docs)]
    everything = np.concatenate(docs)
    assert r.ids(37, 150).tolist() == everything[37:150].tolist()


def test_corpus_round_trip(spark):
    rows = [(9 - k, t, "k") for k, t in enumerate(TEXTS)] + [(None, None, "k"), (4, "again", "k"), (4, "again", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string")
    got = read_corpus(spark, write_corpus(docs, public_tokenizers.path(FILES[0]), 2, 50_257, files=3)).collect()
    w, want, at = whole(FILES[0]), [], 0
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(w(t or "") + [2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert read_corpus(spark, write_corpus(docs, public_tokenizers.path(FILES[0]), 2, 50_257)).count() == 0
