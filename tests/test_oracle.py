"""Every registered query against its DuckDB oracle on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from poi_analytics.plans import catalog
from poi_analytics.sources.tables import DRIVER_TABLES
from tools.check_oracle import _rows

ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def test_entry_runs(spark):
    df = entry(spark)
    assert df.count() > 0
    assert df.columns == ["poiId", "name", "score", "price", "heatScore", "imageUrl", "detailUrl", "city", "desc"]


def test_every_query_has_oracle_or_a_reason():
    """A core query without an oracle is listed in the catalog with the reason, and the list holds no others."""
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == set(catalog.NO_ORACLE)
    assert all(catalog.NO_ORACLE.values())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf_dir, con, name):
    sdf = queries()[name](spark, sf_dir)
    rel = con.sql(ORACLES[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert _rows(sdf.columns, [tuple(r) for r in sdf.collect()]) == _rows(rel.columns, rel.fetchall())
