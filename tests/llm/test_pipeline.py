import random

import pytest
from test_jaccard import brute as brute_groups
from test_linededup import brute as brute_lines

import corpus_pipeline
from loamwork.llm import nbsvm, secrets

HEX = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, where = random.Random(4), str(tmp_path_factory.mktemp("sf"))
    words = [a + b for a in "ba ce di fo gu la me ni po ru".split() for b in "ra se ti mo lu".split()]
    rows, labels = [], []
    common = "This very line is found in a great many documents"
    for k in range(160):
        w = [r.choice(words) for _ in range(r.randint(20, 80))]
        bad = k % 5 == 0
        text = " ".join(x.upper() + "!!" if bad else x for x in w)
        if k % 7 == 1:
            text += "\n" + common
        if k % 11 == 2:
            text += f' token = "{HEX}" end'
        rows.append((k, text))
        labels.append((k, int(not bad)))
        if k % 9 == 3:
            rows.append((1000 + k, text + " tail"))
    rows += [(3000, None), (3001, ""), (3001, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{where}/labels.parquet")
    return where


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    model = nbsvm.train(docs, spark.read.parquet(f"{folder}/labels.parquet").where(~nbsvm.held_out()))
    of = nbsvm.Features().of
    want = [x for x in texts(docs) if model.scores([of(x[1])])[0] >= 0.3]
    assert 100 < len(want) < len(texts(docs))
    stages = dict(corpus_pipeline.STAGES)
    docs = stages["quality classifier"](spark, docs, folder)
    assert texts(docs) == want and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = sorted(((i, t or None) for i, _, _, t in brute_lines(want)), key=str)
    docs = stages["line dedup"](spark, docs, folder)
    assert [(i, t or None) for i, t in texts(docs)] == want and any(t and "great many" in t for _, t in want)
    want = sorted({(i, t) for (i, t), (_, n, c) in zip(want, brute_groups(want, 5, 8, 10)) if n == 0 or c == i}, key=str)
    docs = stages["n-gram Jaccard join"](spark, docs, folder)
    assert [(i, t or None) for i, t in texts(docs)] == want
    docs = stages["secret scans"](spark, docs, folder)
    assert [(i, t or None) for i, t in texts(docs)] == sorted(((i, t.replace(HEX, "[secret]") if t else None) for i, t in want), key=str)
    assert all(r.n_chars == len(r.text or "") for r in docs.collect() if r.text is not None)
    packed = stages["packing"](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in want}
    assert secrets.THRESHOLD == 0.5


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder).collect()
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out[0].asDict())
    held = {}
    for r in out:
        held[r.doc_id] = held.get(r.doc_id, 0) + r.length
        assert held[r.doc_id] <= r.doc_tokens


@pytest.mark.parametrize("rows", [[], [(None, None), (1, None), (1, ""), (2, "w " * 60_000), (2, "w " * 60_000), (3, "a\nb"), (None, "a b c d e f g")]])
def test_edge_rows_and_clashing_columns(spark, folder, rows):
    names = ["score", "n_lines", "keeper", "key", "text_hash", "uid", "_merge", "held_out"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame([(i, t, None, None, None, *names) for i, t in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *names] and docs.count() <= before, name
        assert all(tuple(r)[5:] == tuple(names) for r in docs.collect())
    packed = corpus_pipeline.packing(spark, docs, folder)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


@pytest.mark.parametrize("stage", [corpus_pipeline.secret_scan, corpus_pipeline.packing])
def test_stages_begin_with_the_heap_given_back(spark, folder, stage):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Young" not in b.getName())
    docs, before = spark.read.parquet(f"{folder}/documents.parquet"), full()
    stage(spark, docs, folder)
    assert full() > before
