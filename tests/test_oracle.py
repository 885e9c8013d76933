"""Every registered query against its DuckDB SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from spindrift.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


def nearly_all_pairs(duck, rows):
    """Approximate neighbours are true pairs, and at least nine in ten of them."""
    exact = duck.execute(
        """WITH v AS (SELECT vec_id AS i, label % 3 AS s, vec_id * 37 % 240 AS h, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
        SELECT a.i, b.i, list_cosine_similarity(a.e, b.e) FROM v a JOIN v b ON a.i < b.i AND a.s = b.s AND abs(a.h - b.h) <= 48 WHERE list_cosine_similarity(a.e, b.e) >= 0.35"""
    ).fetchall()
    exact = {(a, b): s for a, b, s in exact}
    assert all(abs(exact[r.a, r.b] - r.similarity) < 1e-3 for r in rows) and len(rows) >= 0.9 * len(exact)


PLAIN = {"neighbors_lsh": nearly_all_pairs, "neighbors_listed": nearly_all_pairs}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    if name not in registry.oracle_sql():
        PLAIN[name](duck, df.collect())
        return
    result = duck.execute(registry.oracle_sql()[name])
    have = [x[0] for x in result.description]
    assert sorted(have) == names
    expected = sorted((tuple(plain(r[have.index(c)]) for c in names) for r in result.fetchall()), key=repr)
    assert got == expected
