"""Registered queries against their SQL twins, and the twins' hash against the published one."""

import glob
import os

import duckdb
import pytest

from pressmill.llm import registry, sql

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_equal_their_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    names = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(f'{n!s}' if n != 'rank' else '\"rank\"' for n in names)} FROM ({registry.oracle_sql()[name]})").fetchall()
    order = lambda rows: sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))
    assert order(map(tuple, got.select(*names).collect())) == order(want)


def test_hashes_in_sql():
    import xxhash

    texts = ["", "a", "abcd", "abcdefg", "abcdefgh", "hello world foo bar", "x" * 31, "y" * 32, "zé漢字 " * 9, "w" * 101, *("k" * n for n in range(33, 64))]
    con = duckdb.connect()
    con.execute("CREATE TABLE t(s VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [(t,) for t in set(texts)])
    rows = con.sql(f"WITH shingles AS (SELECT s FROM t), {sql._HASHES} SELECT s, h FROM hashes").fetchall()
    assert len(rows) == len(set(texts)) and all(h == xxhash.xxh64_intdigest(s.encode(), 42) for s, h in rows)
