"""Every query against its SQL twin, on the smallest tables."""

import pytest
from compare import connect, rows_of_spark, rows_of_sql

import __spark_entry__ as entry_module
from wardlake.catalogue.oracles import ORACLES
from wardlake.catalogue.queries import QUERIES


@pytest.fixture(scope="module")
def sql(folder):
    return connect(folder)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_as_sql(spark, folder, sql, name):
    columns, rows = rows_of_spark(QUERIES[name](spark, folder))
    wanted_columns, wanted = rows_of_sql(sql, ORACLES[name])
    assert columns == wanted_columns
    assert rows == wanted
    assert rows


def test_entry(spark):
    assert entry_module.entry(spark).columns == [
        "checkup_id",
        "department_name",
        "checkup_date",
        "namespace",
        "patient_id",
    ]
