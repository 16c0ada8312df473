from __future__ import annotations

import pytest

from readloom.llm import queries
from tests.oracle import connect, rows_of, sql_rows


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    assert rows_of(queries.queries()[name](spark, sf)) == sql_rows(connect(sf), queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_covers_its_table(spark, sf, name):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    found = queries.queries()[name](spark, sf)
    assert found.select("doc_id").distinct().exceptAll(docs).count() == 0
    assert docs.exceptAll(found.select("doc_id").distinct()).count() == 0
