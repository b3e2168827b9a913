"""Words of a document are never shuffled: its text travels once, before it is split."""

import contextlib
import io

import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["words_to_rows", "tabular_row", "words_to_blocks", "line_cells", "column_edges", "exclusion_zones", "exclude_words"])
def test_text_is_the_only_thing_dealt(name, spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = entry.queries()[name](spark, "/root/testdata/sf0.001")
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            df.explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "REPARTITION_BY_NUM" in out.getvalue()
    assert "ENSURE_REQUIREMENTS" not in out.getvalue()
