"""Queries on texts that the given tables lack, against their SQL."""

import duckdb
import pytest

from vaultsieve.plans import registry

TEXTS = ["", None, "\n", "\n\n", "a", "a\n", "\na", "a\r\nb\r\n", "a\rb", "\x00", "a\x00b", "\x7f", "\t\n\r\f\x08", "\x85 ", "é" * 600, "a" * 1023 + "é", "a" * 1024 + "\x00", "日本語\n", "😀", "abcdefg\x01\x02\x03", "abcdef\x01\x02\x03", " "]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    for table, key in (("documents", "doc_id"), ("conversations", "conv_id")):
        spark.createDataFrame(list(enumerate(TEXTS)), f"{key} long, text string").coalesce(1).write.parquet(f"{at}/{table}.parquet")
    return at


def both(spark, folder, name):
    """Sorted rows of the query and of its SQL."""
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    made = registry.QUERIES[name](spark, str(folder))
    theirs = con.sql(registry.ORACLES[name])
    order = lambda rows: sorted(map(repr, rows))
    assert made.columns == theirs.columns
    return order(map(tuple, made.collect())), order(theirs.fetchall())


def test_binary_texts_are_those_of_the_sql(spark, folder):
    ours, theirs = both(spark, folder, "s_binary")
    assert ours == theirs


def test_lines_of_several_inputs_are_those_of_the_sql(spark, folder):
    ours, theirs = both(spark, folder, "s_multi")
    assert ours == theirs
