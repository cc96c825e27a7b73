import os
import random

import numpy as np
import pytest

from loamwork.llm import jaccard, shared
from loamwork.llm.shingles import WordHashes, shingle_set


def sets_of(text, width):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))


def brute(rows, width, num, den):
    sets = [sets_of(t, width) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                    label[find(i)] = find(j)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        smallest[r] = min(smallest.get(r, (1 << 63) - 1), (1 << 63) - 1 if i is None else i)
    return [(i, len(s), None if smallest[find(k)] == (1 << 63) - 1 else smallest[find(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))]


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.choice([4, 12, 13, 30, 60, 200, 700]))] for _ in range(12)]
    texts = []
    for words in base:
        for _ in range(r.choice([1, 2, 6, 25])):
            w = list(words)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 8])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            if r.random() < 0.3:
                w = w[: int(len(w) * r.choice([0.9, 0.92, 0.95])) or 1]
            texts.append(" ".join(w))
    texts += ["", None, "  \n", "one", "ONE", "two words", "Two\twords", "a b c", "a b c d e f g h i j k l", "b c d e f g h i j k l"] * 2
    r.shuffle(texts)
    rows = [(3 * k % 997, t) for k, t in enumerate(texts)]
    return rows + [(None, texts[0]), (None, texts[5]), rows[7], (rows[8][0], texts[3])]


@pytest.mark.parametrize("seed,width,num,den,block,few", [(1, 3, 90, 100, 2048, 500_000), (2, 5, 8, 10, 3, 0)])
def test_against_brute_force(spark, monkeypatch, seed, width, num, den, block, few):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(shared, "BROADCAST_ROWS", few)
    monkeypatch.setattr(shared, "FEW", min(few, shared.FEW))
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n int, key string").repartition(3)
    got = jaccard.jaccard_groups(docs, width, num, den).collect()
    order = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(g)[:3] for g in got), key=order) == sorted(brute(rows, width, num, den), key=order)
    kept = [g.component_id for g in got if g.keeper and g.n_shingles]
    assert len(kept) == len(set(kept)) or None in kept


def test_chain_of_edits(spark):
    """A page with 450 successive edits: only neighbours are alike, and all are one component."""
    r = random.Random(3)
    words, texts = [f"w{k}" for k in range(60)], []
    for k in range(450):
        texts.append(" ".join(words))
        words[(7 * k) % 60] = f"v{k}"
    ids = list(range(450))
    r.shuffle(ids)
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = jaccard.jaccard_groups(docs, 3, 90, 100).collect()
    assert {tuple(g)[:3] for g in got} == set(brute(list(zip(ids, texts)), 3, 90, 100))
    assert {g.component_id for g in got} == {0}


def test_empty(spark):
    assert jaccard.jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_linked_sets_share_a_tile_and_pass_the_bound():
    r, words = random.Random(7), WordHashes()
    for _ in range(400):
        n = r.choice([9, 10, 11, 19, 20, 37, 100, 400])
        a = [f"x{r.randrange(10**6)}" for _ in range(n)]
        b = list(a)
        for _ in range(r.randrange(0, 1 + n // 20)):
            b[r.randrange(len(b))] = f"y{r.randrange(10**6)}"
        b = b[: r.randint(int(0.92 * n), n)]
        s, t = (shingle_set(" ".join(x), 3, words) for x in (a, b))
        if len(s) and len(t) and jaccard.linked(s, t, 90, 100) and s.tobytes() != t.tobytes():
            tiles = jaccard.Tiles(90, 100, np.random.default_rng(n).integers(0, 3, 64).astype(np.uint8))
            assert set(tiles.keys(s).tolist()) & set(tiles.keys(t).tolist())
            bits = [np.frombuffer(jaccard.bitmap(x), np.uint64)[None] for x in (s, t)]
            assert jaccard.may_link(*bits, np.array([len(s)]), np.array([len(t)]), 90, 100)[0]


def test_sql(spark):
    from oracle import compare

    from loamwork.llm import q2_jaccard as q

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    assert compare(spark, q.query, q.SQL, "/root/testdata/sf0.001") == []
