import hashlib
import unicodedata

import pytest
from pyspark.sql import functions as F

from loamwork.llm import fingerprint as fp

TEXTS = ["Hello  World", "hello world", "ＨＥＬＬＯ world ", "Straße", "STRASSE", "", None, "é", "é", "x", "a\n\tb", "long " * 4000, "long " * 4000, "𝔘nicode ﬁ", "unicode fi"]
SCHEMA = "doc_id long, text string, lang string, key string, n int"


def canon(t):
    fold = lambda s: unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", s or "").casefold())
    return " ".join(fold(t).split())


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "k", 1) for i, t in rows], SCHEMA)


def brute(rows):
    rows = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        e = t[: len(t) - half] + nxt[:half]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), canon(t), canon(e), float(canon(t) == canon(e)), float(canon(t) == canon(nxt))))
    return out


def weak(text):
    return F.length(text) % 3, F.lit(0)


@pytest.mark.parametrize("ranges", [1, 3, 7])
@pytest.mark.parametrize("hashes", [fp._hashes, weak])
def test_against_brute_force(spark, ranges, hashes):
    rows = list(enumerate(TEXTS * 2)) + [(None, "null id"), (3, "Straße"), (3, "again")]
    got = fp.edited_report(frame(spark, rows), ranges=ranges, slots=1 << 15, hashes=hashes).collect()
    want = brute(rows)
    key = lambda r: (-(1 << 63) if r[0] is None else r[0], r[1], r[2])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [tuple(g)[:3] + tuple(g)[5:] for g in got] == [w[:3] + w[5:] for w in want]
    seen = {}
    for g, w in zip(got, want):
        for f, c in ((g[3], w[3]), (g[4], w[4])):
            assert seen.setdefault(c, f) == f
    assert len(set(seen.values())) == len(seen)


def test_empty_and_single(spark):
    assert fp.edited_report(frame(spark, [])).count() == 0
    (row,) = fp.edited_report(frame(spark, [(5, "abcd")])).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and row.near_next == 1.0


def test_no_python_in_the_plan(spark):
    plan = fp.edited_report(frame(spark, [(1, "a"), (2, "b")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
