import math
import random

import pytest

from loamwork.llm import components as module
from loamwork.llm import shared


def labels(spark, pairs, partitions=4):
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(partitions)
    rows = module.components(edges).collect()
    assert len({r.node for r in rows}) == len(rows)
    return {r.node: r.label for r in rows}


def chain(n, seed):
    ids = list(range(10, 10 + n))
    if seed:
        random.Random(seed).shuffle(ids)
    return list(zip(ids, ids[1:]))


@pytest.fixture
def spread(spark, monkeypatch):
    """Forests of few links, no broadcast tables, and partitions that are not put together: as on large tables."""
    monkeypatch.setattr(module, "LINKS", 20)
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(shared, "FEW", 0)
    monkeypatch.setattr(shared, "PARTS", 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("n,seed", [(2, 0), (400, 1), (5_000, 2), (5_000, 0), (100_000, 3)])
def test_chains(spark, n, seed):
    assert set(labels(spark, chain(n, seed)).values()) == {10}


@pytest.mark.parametrize("n,seed", [(400, 1), (1_500, 0)])
def test_chains_by_rounds(spark, spread, monkeypatch, n, seed):
    rounds = []
    monkeypatch.setattr(module, "written", lambda df, name: rounds.append(name) or shared.written(df, name))
    found = labels(spark, chain(n, seed))
    assert len(found) == n and set(found.values()) == {10}
    assert rounds.count("links") <= 2 * math.log2(n)


@pytest.mark.parametrize("hub", [0, 10**6])
def test_star_clique_and_others(spark, spread, hub):
    star = [(hub, k) for k in range(1, 300)]
    clique = [(a, b) for a in range(2000, 2020) for b in range(2000, 2020)]
    pairs = star + clique + [(5000, 5000), (5001, 5002), (5002, 5001)]
    want = {k: min(hub, 1) for k in [hub, *range(1, 300)]} | {k: 2000 for k in range(2000, 2020)} | {5001: 5001, 5002: 5001}
    assert labels(spark, pairs) == want


def test_random_links(spark, spread):
    r = random.Random(5)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(260)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in pairs:
        p, q = sorted((find(a), find(b)))
        label[q] = p
    assert labels(spark, pairs) == {k: find(k) for p in pairs for k in p if p[0] != p[1] or any(k in q and q[0] != q[1] for q in pairs)}


def test_no_links(spark):
    assert labels(spark, []) == {}


def test_own_tables_go(spark):
    before = shared.mark()
    found = module.components(spark.createDataFrame(chain(50, 4), "a long, b long"))
    assert shared.mark() == before + 1 and found.count() == 50
    shared.drop_since(spark, before)
    assert shared.mark() == before


def test_lookup_splits_hot_keys(spark, spread):
    left = shared.written(spark.createDataFrame([(1 if k % 3 else k, k) for k in range(90)], "k long, v long"), "left")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(80)], "k long, w string")
    for how in ("inner", "left"):
        got = sorted(map(tuple, shared.lookup(left, right, "k", "v", how).select("k", "v", "w").collect()))
        assert got == sorted(map(tuple, left.join(right, "k", how).select("k", "v", "w").collect())), how
