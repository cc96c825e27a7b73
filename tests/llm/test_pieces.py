import os
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from loamwork.llm.pieces import BLANK, Pieces, digests, encode_documents

PATH = public_tokenizers.path("piece_bpe_32k.model")
DOCUMENTS = "/root/testdata/sf0.01/documents.parquet"
TEXTS = ["", "Hello  world\n foo ", " lead", "two   blanks  ", "日本語 テキスト \U0001f600", f"literal {BLANK} sign{BLANK}{BLANK}", "a\x00b\x7f", "ñandú Straße", "x" * 500, "\n\n\t"]


@pytest.fixture(scope="module")
def p():
    return Pieces(PATH)


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def brute(p, stretch):
    """Merging the best pair, the leftmost of equal ones, until none is a piece; with no automaton and no cuts."""
    parts = list(stretch)
    while True:
        pairs = [(-p.score[x + y], k) for k, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in p.score]
        if not pairs:
            break
        k = min(pairs)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [k for x in parts for k in ([p.normal[x]] if x in p.normal else [p.bytes[b] for b in x.encode()])]


def ids(p, text):
    return np.frombuffer(p.encode(text), "<u4").tolist()


def test_round_trip_and_library_decoding(p, model):
    for t in TEXTS:
        ids = np.frombuffer(p.encode(t), "<u4").tolist()
        assert p.decode(p.encode(t)) == t
        if BLANK not in t:
            assert model.decode(ids) == t


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("theinganor ▁é,.\n"), st.characters(codec="utf-8")), max_size=40))
def test_any_text(t):
    p = test_any_text.p = getattr(test_any_text, "p", None) or Pieces(PATH)
    assert p.decode(p.encode(t)) == t


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="theinganorSé▁ロ日\U0001f600", min_size=1, max_size=14))
def test_against_brute_force(t):
    p = test_any_text.p = getattr(test_any_text, "p", None) or Pieces(PATH)
    assert p.segment(t) == brute(p, t)


def test_ids_are_the_models_own(p, model):
    r = random.Random(4)
    for alphabet in ("theinganorSé \n", "aaab  ", "日本語ロ\U0001f600 xé", " \n\t ab", "".join(map(chr, range(32, 0x250))), "0123456789.,- ", "=-_*# \n"):
        for _ in range(3000):
            t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
            assert ids(p, t) == model.encode(t), t
    for t in TEXTS:
        if BLANK not in t:
            assert ids(p, t) == model.encode(t), t


@pytest.mark.skipif(not os.path.exists(DOCUMENTS), reason="no tables")
def test_ids_of_all_documents(p, model):
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(DOCUMENTS, columns=["text"])["text"].to_pylist() if t and BLANK not in t]
    assert len(texts) > 900
    for t, want in zip(texts, model.encode(texts, num_threads=1)):
        assert ids(p, t) == want


def test_compatible_pairs_are_those_that_merging_leaves(p):
    r = random.Random(6)
    pieces = r.sample(sorted(p.normal), 400)
    for _ in range(4000):
        a, b = r.choice(pieces), r.choice(pieces)
        want = brute(p, a + b) == [p.normal[a], p.normal[b]]
        assert (p.merged(a)[1] and p.compatible(a, b)) == want, (a, b)


def test_cutting_changes_nothing(p):
    t = "the quick  brown fox's étude, 日本 \n end "
    whole = p.segment((" " + t).replace(" ", BLANK))
    assert np.frombuffer(p.encode(t), "<u4").tolist() == whole


def test_documents(spark, p):
    docs = spark.createDataFrame([(k if k else None, t or None, 1) for k, t in enumerate(TEXTS)] + [(1, TEXTS[1], 1)], "doc_id long, text string, ids int")
    rows = digests(docs, PATH).collect()
    assert len(rows) == len(TEXTS) + 1 and all(r.round_trip for r in rows)
    assert {r.doc_id: r.n_tokens for r in rows} == {k if k else None: len(p.encode(t)) // 4 for k, t in enumerate(TEXTS)}
    assert encode_documents(docs.limit(0), PATH).count() == 0
