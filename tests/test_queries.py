"""Every registered query with SQL gives the rows of its SQL."""

import math

import pytest

from noisegrid.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


#: Queries whose results once hung on the order of sums; they are compared on a larger table too.
SUMS = ["box_share", "pyramid_mean", "sample_nearest_cell", "sample_raster", "padded_pixels", "bin_surface"]


def tables(sf):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.fixture(scope="module")
def con(sf):
    return tables(sf)


def plain(frame, cols):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
            return "NULL"
        return f"{float(v):.9g}" if hasattr(v, "dtype") or isinstance(v, (int, float)) else str(v)

    return sorted(tuple(one(v) for v in r) for r in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    got, want = registry.QUERIES[name](spark, sf).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got, sorted(got.columns)) == plain(want, sorted(got.columns))


@pytest.mark.parametrize("name", SUMS)
def test_sums_are_the_same_in_any_order(spark, name):
    sf = "/root/testdata/sf0.01"
    want = tables(sf).execute(registry.ORACLES[name]).df()
    cols = sorted(want.columns)
    got = registry.QUERIES[name](spark, sf).toPandas()
    assert plain(got, cols) == plain(want, cols)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_gives_rows(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_entry_works_without_text_operators(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
