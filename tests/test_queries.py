"""Every query with SQL agrees with it; those without return rows."""

import math
from pathlib import Path

import duckdb
import pytest

import lociweave.plans.more  # noqa: F401  registers its queries
from lociweave.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
SLOW = {"sdust_mask", "tandem_scan", "typed_regions"}  # pure kernels, tested on small sequences


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def text(v):
    return ("nan" if math.isnan(v) else repr(v + 0.0)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in columns) for r in df.collect())
    if name not in ORACLES:
        assert got or name == "coverage_model"
        return
    cursor = db.execute(ORACLES[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(text(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
