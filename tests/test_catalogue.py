"""Every query with an oracle gives the oracle's rows; the others give rows with a stable schema."""

import math
import os

import duckdb
import pytest

from driftgauge.plans.catalogue import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events".split():
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return c


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else 0.0 if v == 0 and isinstance(v, float) else v


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-7)
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = duck.execute(ORACLES[name])
    cols = sorted(df.columns)
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    key = lambda r: [(v is None, f"{v:.6f}" if isinstance(v, float) else str(v)) for v in r]
    want = sorted(([plain(dict(zip(names, r))[c]) for c in cols] for r in got.fetchall()), key=key)
    have = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=key)
    assert len(want) == len(have)
    assert all(same(x, y) for a, b in zip(have, want) for x, y in zip(a, b)), next((a, b) for a, b in zip(have, want) if not all(map(same, a, b)))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.schema == QUERIES[name](spark, SF).schema
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
