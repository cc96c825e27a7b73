"""Comparison of a Spark query with its SQL run by DuckDB on the same tables."""

from __future__ import annotations

import datetime as dt
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute("SET threads=4")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else 0.0 if x == 0 else x
    if isinstance(x, (dt.datetime, dt.date)):
        return str(x)
    if isinstance(x, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return tuple(sorted((k, plain(v)) for k, v in x.asDict().items()))
    if isinstance(x, (list, tuple)) or hasattr(x, "tolist"):
        return tuple(plain(y) for y in x)
    if hasattr(x, "as_tuple"):
        return float(x)
    return x


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "FLOAT": "float", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp", "SMALLINT": "smallint", "TINYINT": "tinyint"}


def kind(name: str) -> str:
    name = name.upper()
    if name.endswith("[]"):
        return f"array<{kind(name[:-2])}>"
    return KINDS.get(name, name.lower())


def compare(spark, query, sql: str, sf_dir: str) -> list[str]:
    """What differs; empty if columns, types, row counts and values agree."""
    df = query(spark, sf_dir)
    rel = connection(sf_dir).sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return [f"columns {names} and {sorted(rel.columns)}"]
    found = []
    types, theirs = dict(df.dtypes), dict(zip(rel.columns, map(str, rel.types)))
    for n in names:
        if types[n].replace("timestamp_ntz", "timestamp") != kind(theirs[n]) and not types[n].startswith(("struct", "map", "array<struct")):
            found.append(f"type of {n}: {types[n]} and {theirs[n]}")
    ours = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    order = [rel.columns.index(n) for n in names]
    want = sorted((tuple(plain(r[k]) for k in order) for r in rel.fetchall()), key=repr)
    if len(ours) != len(want):
        found.append(f"rows {len(ours)} and {len(want)}")
    if ours != want:
        a, b = set(map(repr, ours)), set(map(repr, want))
        found.append(f"only in Spark {sorted(a - b)[:3]}; only in DuckDB {sorted(b - a)[:3]}")
    return found
