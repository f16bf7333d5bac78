"""Rows of a Spark frame against rows of a DuckDB query."""

import math
import os

import duckdb

EXACT = bool(os.environ.get("COMPARE_EXACT"))  # else floats to nine digits
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str = DATA):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0 if EXACT else float(f"{x:.9g}") + 0.0
    if isinstance(x, list | tuple):
        return tuple(plain(y) for y in x)
    if hasattr(x, "asDict"):
        return tuple(plain(y) for y in x)
    return x




def key(r):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)


def compare(df, sql: str, sf_dir: str = DATA, con=None) -> int:
    """Asserts equal columns and equal multisets of rows; returns how many there are."""
    c = con or connection(sf_dir)
    got = c.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    wide = sorted(names)
    want = sorted((tuple(plain(r[names.index(n)]) for n in wide) for r in got.fetchall()), key=key)
    have = sorted((tuple(plain(r[n]) for n in wide) for r in df.collect()), key=key)
    assert len(want) == len(have), (len(want), len(have))
    bad = [(a, b) for a, b in zip(have, want, strict=True) if a != b]
    assert not bad, (wide, len(bad), bad[:3])
    return len(have)
