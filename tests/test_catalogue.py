"""Every query of the library against its DuckDB SQL at the smallest scale."""

import duckdb
import pytest

from fathom.catalogue import ORACLES, QUERIES
from fathom.sources.tables import TABLES

from .conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def _plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if hasattr(v, "isoformat"):
            return v.isoformat()
        return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL)
    rows = _plain([tuple(r) for r in got.collect()], got.columns)
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert rows == _plain(want.fetchall(), want.columns)
