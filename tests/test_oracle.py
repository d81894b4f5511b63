"""Every registered query with a twin against it, on the smallest tables."""

import duckdb
import pytest

from vaultsieve.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    from pathlib import Path

    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_twin(spark, con, name):
    ours, theirs = registry.QUERIES[name](spark, DATA).toPandas(), con.sql(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_twin_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_the_whole_table_shows_every_finding(spark):
    shown = registry.QUERIES["r_table_all"](spark, DATA).toPandas()
    every = registry.QUERIES["r_api"](spark, DATA).count()
    assert len(shown) == every > 50 and shown["severity"].nunique() > 1


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
