"""Every registered query of the library against its SQL, on the smallest tables."""

import glob
import os

import pytest

from pairloom.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


#: Tables too small for what these ask.
SMALL = {"geo_pairs", "geo_pair_invariants", "geo_pair_stats", "pair_type_breakdown"}


def test_pair_table_equals_the_walk_of_sql(spark):
    """On tables of 2,000 places: 1,000 pairs of all four kinds."""
    at = SF.replace("0.001", "0.01")
    c = pytest.importorskip("duckdb").connect()
    for p in glob.glob(f"{at}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got, want = registry.QUERIES["geo_pairs"](spark, at), c.sql(registry.ORACLE["geo_pairs"])
    cols = sorted(want.columns)
    rows = sorted(tuple(map(repr, r)) for r in got.select(cols).collect())
    assert rows == sorted(tuple(repr(r[want.columns.index(k)]) for k in cols) for r in want.fetchall()) and len(rows) == 1000


@pytest.mark.parametrize("name", sorted(set(registry.ORACLE) - SMALL))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLE[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(repr([r[c] for c in cols]) for r in got.collect()) == sorted(repr([r[i] for i in at]) for r in want.fetchall())
