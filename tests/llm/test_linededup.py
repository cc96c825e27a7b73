from collections import defaultdict

import duckdb
import numpy as np
import pytest

from loamwork.llm import linededup as ld

LONG, OTHER = "A line that is long enough", "Ünïcödé line of twenty c"
ROWS = [
    (1, f"{LONG}\nown\n  {LONG.upper()}\t\nlast"), (2, f"x\n{LONG} \ny"), (3, LONG), (9, f"{LONG}\n{LONG}\nend"), (4, None), (5, ""), (6, "short\nshort"),
    (7, f"{OTHER}\nshort"), (8, OTHER), (10, f"{OTHER}\n\n"), (11, "only two of these lines exist"), (12, "only two of these lines exist"), (None, LONG),
    (13, "nineteen codepointÄ"), (14, "nineteen codepointÄ"), (15, "nineteen codepointÄ"), (16, "w" * 200_000 + "\n" + LONG), (16, f"{LONG}\nrepeated id"), (3, LONG),
]


def brute(rows):
    holders = defaultdict(set)
    for i, t in rows:
        keys = {k for k in (x.strip(" \t\n\r\x0b\x0c").encode().lower().decode() for x in (t or "").split("\n")) if len(k) >= 20}
        for k in keys:
            holders[k].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        key = lambda x: x.strip(" \t\n\r\x0b\x0c").encode().lower().decode()
        keeper = lambda k: max((h for h in holders[k] if h is not None), default=None)
        kept = [x for x in lines if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and keeper(key(x)) != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("most,keys,bits", [(64 << 20, 1 << 25, 16), (0, 4, 16), (64 << 20, 4, 1)])
def test_against_brute_force(spark, monkeypatch, most, keys, bits):
    """Filters broadcast and filters of many parts that wait for the lines; filters that are much too small."""
    monkeypatch.setattr(ld, "BROADCAST_BYTES", most)
    monkeypatch.setattr(ld, "FILTER_KEYS", keys)
    docs = spark.createDataFrame([(i, t, "k", 5, 1) for i, t in ROWS], "doc_id long, text string, key string, n_lines int, page int").repartition(3)
    out = ld.dedup_lines(docs, bits_per_key=bits)
    assert out.columns == ["doc_id", "text", "key", "n_lines", "page", "n_lines", "n_dropped"]
    got = [(r[0], r[5], r[6], r[1] or "") for r in out.collect()]
    order = lambda r: (-1 if r[0] is None else r[0], r[1:])
    assert sorted(got, key=order) == sorted(brute(ROWS), key=order)


def test_sql_with_repeated_and_null_ids(spark, tmp_path):
    from loamwork.llm import q5_line_dedup as q

    spark.createDataFrame([(i, t) for i, t in ROWS], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(q.SQL).fetchall(), key=str)
    assert sorted((tuple(r) for r in q.query(spark, str(tmp_path)).collect()), key=str) == want


def test_empty(spark):
    assert ld.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_filters_never_miss_a_repeat():
    rng = np.random.default_rng(5)
    hashes = rng.integers(0, 2**63, 5000).astype(np.uint64)
    one = np.zeros(5000, bool)
    for bits in (1 << 10, 1 << 16, 1 << 22):
        f = ld.Filters(bits)
        f.add(hashes[:3000], one[:3000])
        f.add(hashes[2500:], np.arange(2500) >= 2400)  # the last hundred stand for two each
        assert ld._holds(f.twice, ld.positions(np.concatenate([hashes[2500:3000], hashes[4900:]]), bits)).all()
    assert ld._holds(f.twice, ld.positions(hashes, 1 << 22)).sum() < 610


def test_suspects_stay_near_the_repeats_in_many_parts(spark, monkeypatch):
    """With a bound on a part's filters that is far below the corpus, suspects do not grow beyond the true repeats."""
    monkeypatch.setattr(ld, "FILTER_KEYS", 1000)
    lines = [f"line number {k} is met once alone" for k in range(20_000)]
    docs = [(k, "\n".join([*lines[20 * k : 20 * k + 20], f"a line that ten documents share: {k // 10}"])) for k in range(1000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for most in (64 << 20, 0):
        monkeypatch.setattr(ld, "BROADCAST_BYTES", most)
        parts, filters = ld.twice_seen(df, 20)
        assert parts.parts >= 20 and parts.bits <= 16 * 2048
        suspects = ld.suspected_lines(df, parts, filters, 20)
        assert 1000 <= suspects.count() < 2000
