import pytest

import __spark_entry__ as entry
from judgelake.catalog import ORACLES, QUERIES
from judgelake.shipping import ship

from .conftest import SMALL, plain


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(agrees, name):
    agrees(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"progress_stream"}))
def test_query_without_sql_gives_rows(spark, name):
    ship(spark)
    assert QUERIES[name](spark, SMALL).count() > 0


def test_stream_equals_its_batch_twin(spark):
    ship(spark)
    stream, batch = QUERIES["progress_stream"](spark, SMALL), QUERIES["progress_tail"](spark, SMALL)
    assert plain(stream.select(*batch.columns).collect(), batch.columns) == plain(batch.collect(), batch.columns)


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
