import random
import zlib

import numpy as np

from loamwork.llm import nbsvm

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def corpus(n, seed=1):
    r, rows = random.Random(seed), []
    for k in range(n):
        w = [r.choice(WORDS) for _ in range(r.randint(3, 60))]
        bad = k % 4 == 0
        rows.append((k, " ".join(x.upper() + "!!" if bad and r.random() < 0.8 else x for x in w), int(not bad)))
    return rows


def test_held_out_accuracy_and_cases(spark):
    rows = corpus(400)
    extra = [(1000, None), (1001, ""), (None, "alpha beta"), (1002, "x" * 700_000), (5, rows[5][1])]
    docs = spark.createDataFrame([(i, t, 0.5, True) for i, t in [r[:2] for r in rows] + extra], "doc_id long, text string, score double, held_out boolean")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(7, None), (None, 1), (4, 0)], "doc_id long, quality int")
    out = nbsvm.classify(docs, labels)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(rows) + len(extra)
    truth = {i: y for i, _, y in rows}
    for r in got:
        assert 0 <= r[5] <= 1 and r[6] == int(r[5] >= 0.3) and r[4] == (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
    held = [r for r in got if r[4] and r[0] in truth]
    assert len(held) > 40 and np.mean([r[6] == truth[r[0]] for r in held]) > 0.97
    assert len({r[5] for r in got if not r[1]}) == 1


def test_one_class_and_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in nbsvm.classify(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert all(r.score > 0.9 for r in nbsvm.classify(docs, one).collect())
    assert nbsvm.classify(docs.limit(0), one).count() == 0


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows = corpus(120)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    scores = []
    for flip in (False, True):
        labels = spark.createDataFrame([(i, 1 - y if flip and zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows], "doc_id long, quality int")
        scores.append(sorted((r.doc_id, r.score) for r in nbsvm.classify(docs, labels).collect()))
    assert scores[0] == scores[1]


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(30) < 0.3) for _ in range(40)]
    labels = (rng.random(40) < 0.5).astype(int)
    ratio = np.zeros(1 << nbsvm.FEATURE_BITS)
    ratio[:30] = rng.normal(size=30)
    nbsvm_epochs, nbsvm.EPOCHS = nbsvm.EPOCHS, 3000
    try:
        w, b = nbsvm.hinge(rows, ratio, labels)
    finally:
        nbsvm.EPOCHS = nbsvm_epochs
    x = np.zeros((40, 31))
    for k, r in enumerate(rows):
        x[k, r] = ratio[r] / (np.sqrt((ratio[r] ** 2).sum()) or 1)
    x[:, 30] = 1
    y, v = np.where(labels == 1, 1, -1), np.append(w[:30], b)
    cost = nbsvm.COST * np.where(labels == 1, 1, labels.sum() / (1 - labels).sum())
    value = lambda u: 0.5 * u @ u + (cost * np.maximum(0, 1 - y * (x @ u))).sum()
    best = value(v)
    assert all(value(v + 0.01 * rng.normal(size=31)) >= best - 1e-6 for _ in range(300))


def test_repeated_rows_and_bytes_are_bounded(spark, monkeypatch):
    """A labelled doc_id in many rows is one document, and the features sent to the driver stay under the bound."""
    texts = [(k, f"good words number {k} and others" if k % 2 else f"zzz {k} xxx xxx xxx qqq") for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    once = spark.createDataFrame(texts, "doc_id long, text string")
    again = once.unionAll(spark.createDataFrame([texts[3]] * 500, "doc_id long, text string"))
    seen = []
    monkeypatch.setattr(nbsvm, "fit", lambda rows, labels: seen.append((len(rows), sum(4 * len(r) for r in rows))))
    for docs in (once, again):
        nbsvm.train(docs, labels)
    assert seen[0] == seen[1] and seen[0][0] == 40
    nbsvm.train(again, labels, most_bytes=4_000)
    assert 2 <= seen[2][0] < 20 and seen[2][1] <= 4_000
