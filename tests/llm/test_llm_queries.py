import os

import pytest

from kinweave.llm import queries
from tests.oracle import DATA, compare


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_leak_and_size_queries(spark):
    assert queries.p9_found(spark, DATA).columns == ["item_id", "doc_id"]
    assert queries.p8_round_trip(spark, DATA).filter("not same").count() == 0
    pieces = queries.p10_pieces(spark, DATA).select("doc_id").distinct()
    assert sorted(r[0] for r in pieces.collect()) == sorted(r[0] for r in queries.p10_found(spark, DATA).collect())
