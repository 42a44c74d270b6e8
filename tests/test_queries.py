"""Every registered query against its SQL on the small tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, database

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return database(small)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, small, name):
    assert compare(spark, con, small, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["curate_labels_chain", "best_per_part", "six_way_split", "assembled_chains", "line_auc"])
def test_same_result_with_one_partition(spark, small, name):
    def rows():
        df = QUERIES[name](spark, small)
        return sorted(map(repr, df.select(*sorted(df.columns)).collect()))

    many = rows()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert rows() == many
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
