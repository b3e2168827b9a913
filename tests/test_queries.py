"""Every registered query against its SQL counterpart on the smallest data set."""

import re

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

FOLDER, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
#: Queries whose case does not occur in the smallest tables.
RARE = {"regions_temporal"}
TEXTS = entry.oracle_sql()
#: The operators of the training-data pipeline have their own tests.
QUERIES = {k: f for k, f in entry.queries().items() if not re.match(r"op\d+_|pipeline$", k)}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con):
    folder = LARGER if name in RARE else FOLDER
    df = QUERIES[name](spark, folder)
    if name in TEXTS:
        problems = compare(df, connect(folder) if name in RARE else con, TEXTS[name])
        assert not problems, problems
    else:
        assert df.count() > 0


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"sheet_id", "table_no", "method", "column_labels"} <= set(df.columns)
