from __future__ import annotations

import pytest

import __spark_entry__ as entry
from readloom import queries
from tests.oracle import connect, rows_of, sql_rows


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, con, name):
    assert rows_of(queries.queries()[name](spark, sf)) == sql_rows(con, queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_without_sql_runs(spark, sf, name):
    assert queries.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["sim_reads", "sim_errors", "corrupt_reads"])
def test_generators_ignore_partitioning(spark, sf, name):
    from pyspark.sql import functions as F

    def digest(n):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", n)
        try:
            df = queries.queries()[name](spark, sf)
            return df.agg(F.sum(F.xxhash64("read_id", "sequence", "labels").cast("decimal(20,0)")), F.count("*")).first()
        finally:
            spark.conf.unset("spark.sql.leafNodeDefaultParallelism")

    assert digest(1) == digest(7)
