"""Every registered query beside its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from compare import rows_of

from tidewatch.plans.catalogue import FLAGSHIP, ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got, names = rows_of(df.columns, df.collect())
    if name in ORACLES:
        rel = con.sql(ORACLES[name])
        want, wanted = rows_of(rel.columns, rel.fetchall())
        assert names == wanted
        assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert FLAGSHIP in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
