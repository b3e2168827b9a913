"""Queries of pages do their whole work from the texts on, and every part of it shows in their result."""

import contextlib
import io

import pytest

import __spark_entry__ as entry
from sheetloom.operators import layout
from sheetloom.plans.inputs import Inputs

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("name", ["split_paragraphs", "sections", "section_type", "section_attrs", "toc", "document_summary", "quality_scores"])
def test_sections_are_made_of_the_texts(name, spark):
    assert "posexplode(split(text" in plan(entry.queries()[name](spark, FOLDER))


def test_words_one_space_apart_are_one_cell(spark):
    words, cells = Inputs(spark, FOLDER).words, entry.queries()["line_cells"](spark, FOLDER)
    assert cells.count() < words.count() / 10 and cells.filter("text like '% %'").count() > 0


def test_merged_tables_show_their_union_box(spark):
    rows = []
    for page in (1, 2):
        for r, vals in enumerate([("Name", "Qty"), (f"a{page}", "1"), (f"b{page}", "2")], 1):
            rows += [(1, page, 1, r, c, v, 10.0 * c + page, 10.0 * r, 10.0 * c + 8 + page, 10.0 * r + 8) for c, v in enumerate(vals, 1)]
    cells = spark.createDataFrame(rows, "doc_id BIGINT, page_no INT, table_no BIGINT, r BIGINT, c BIGINT, text STRING, x0 DOUBLE, top DOUBLE, x1 DOUBLE, bottom DOUBLE")
    merged = layout.merge_spanning(layout.table_summary(cells), cells)[0].first()
    assert (merged.parts, merged.x0, merged.top, merged.x1, merged.bottom) == (2, 11.0, 10.0, 30.0, 38.0)
    assert {"x0", "top", "x1", "bottom"} <= set(entry.queries()["merge_spanning"](spark, FOLDER).columns)
