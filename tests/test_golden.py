"""Small hand-made sheets, pages and texts with known results."""

import pytest
from pyspark.sql import functions as F

from sheetloom import schemas
from sheetloom.functions import scan
from sheetloom.operators import compare, encoding, headers, layout, normalize, numbers, profiles, routing, tables

SHEET = schemas.SHEET


def cells(spark, rows, sheet=1):
    """rows: {row: [values from column 1 on]}; None leaves a cell out."""
    out = []
    for r, vals in rows.items():
        for c, v in enumerate(vals, 1):
            if v is None:
                continue
            kind = "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string"
            out.append((1, sheet, r, c, kind, v if kind == "string" else None, float(v) if kind == "number" else None, v if kind == "boolean" else None, None, None, False, 0, False))
    return spark.createDataFrame(out, schemas.CELLS)


def sheets(spark, max_row, max_col, frozen=(0, 0), sheet=1):
    return spark.createDataFrame([(1, sheet, "S", 1, 1, max_row, max_col, *frozen)], schemas.SHEETS)


def found(spark, rows, max_row, max_col, frozen=(0, 0), **kw):
    df = tables.detect_tables(cells(spark, rows), sheets(spark, max_row, max_col, frozen), **kw)
    return [(x.r1, x.r2, x.method) for x in df.orderBy("table_no").collect()]


def spans(spark, rows, max_row, max_col):
    return [x[:2] for x in found(spark, rows, max_row, max_col)]


def test_numbers_only_after_gaps_stay_one_table(spark):
    rows = {r: [100 + r, 200, 300, 400] for r in (1, 2, 3, 6, 7, 10)}
    assert spans(spark, rows, 10, 4) == [(1, 10)]


def test_mixed_row_after_gap_opens_table(spark):
    rows = {1: [1, 2, 3], 2: [4, 5, 6], 5: ["Total", 5, 6], 6: [7, 8, 9]}
    assert spans(spark, rows, 8, 3) == [(1, 2), (5, 8)]


def test_text_labels_after_gaps_open_tables(spark):
    rows = {1: [1, 2, 3, 4], 2: [1, 2, 3, 4], 5: ["Name", "Price", "Amount", "Place"], 6: [1, 2, 3, 4], 7: [1, 2, 3, 4], 10: ["Other", "Labels", "Again", "Here"]}
    assert spans(spark, rows, 10, 4) == [(1, 2), (5, 7), (10, 10)]


def test_frozen_panes_give_one_region(spark):
    rows = {r: ["a", r, r] for r in range(1, 21)}
    assert found(spark, rows, 20, 8, (2, 1)) == [(1, 20, "frozen_panes")]


def test_single_cell_is_default_table(spark):
    assert found(spark, {1: ["only"]}, 1, 1) == [(1, 1, "default")]


def test_explicit_gap_split_runs_to_sheet_end(spark):
    rows = {r: ["x", r] for r in (*range(1, 6), *range(9, 14), *range(17, 22))}
    c, s = cells(spark, rows), sheets(spark, 25, 6)
    got = tables.regions_gaps(tables.stored_row_sequence(c, s), 2, "max_row").orderBy("r1").collect()
    assert [(g.r1, g.r2, g.c1, g.c2) for g in got] == [(1, 5, 1, 6), (9, 13, 1, 6), (17, 25, 1, 6)]


def test_labels_and_titles(spark):
    rows = {1: ["Report of sales"], 2: ["Name", None, "Amount"], 3: ["Anna", 5, 6], 4: ["Bert", 7, 8]}
    c, s = cells(spark, rows), sheets(spark, 4, 3)
    found_tables = headers.describe_tables(tables.detect_tables(c, s), c, s)
    t = found_tables.collect()[0]
    assert (t.title, t.title_row, t.r1) == ("Report of sales", 1, 2)
    assert [r.label for r in headers.column_labels(found_tables, c).orderBy("c").collect()] == ["Report of sales", "Column B", "Column C"]
    assert [r.label for r in headers.column_labels(found_tables, c, "plain").orderBy("c").collect()][1] == "unlabeled"
    assert [r.label for r in headers.row_labels(found_tables, c).orderBy("r").collect()] == ["Name", "Anna", "Bert"]


def test_thousand_nulls_are_one_run(spark):
    row = spark.range(1, 1001).select(
        F.lit(1).cast("long").alias("workbook_id"), F.lit(1).cast("long").alias("sheet_id"), F.lit(1).alias("r"), F.col("id").cast("int").alias("c"), F.lit("null").alias("vtype"),
        *[F.lit(None).cast(t).alias(n) for n, t in (("vtext", "string"), ("vnum", "double"), ("vbool", "boolean"), ("style", "string"), ("formula", "string"))],
    )
    runs = encoding.rle_encode(row)
    assert [(r.c, r.run_length) for r in runs.collect()] == [(1, 1000)]
    assert encoding.rle_decode(runs).count() == 1000


def test_run_thresholds(spark):
    narrow = encoding.rle_encode(cells(spark, {1: [7] * 20}))
    assert narrow.count() == 20
    wide = encoding.rle_encode(cells(spark, {1: [7, 7] + [8, 8, 8] + list(range(100, 118))}))
    assert sorted(x.run_length for x in wide.collect() if x.run_length > 1) == [3]
    very = encoding.rle_encode(cells(spark, {1: [7, 7] + list(range(100, 1101))}))
    assert sorted(x.run_length for x in very.collect() if x.run_length > 1) == [2]


@pytest.mark.parametrize(
    "text,flag",
    [("values must be of type", True), ("Invalid input", True), ("...", True), ("must be", True), ("???", True), ("Revenue", False), ("", False), ("   ", False), ("Q1 2024", False)],
)
def test_error_text(spark, text, flag):
    assert normalize.error_text_filter(spark.createDataFrame([(text,)], "text STRING")).collect()[0].is_error is flag


def test_number_cases(spark):
    texts = ["ratio improved to 1.80x from 2.31x", "seats 1500 and 12,345", "12024", "2X and 1ST", "share 3/0 and 1/2"]
    df = spark.createDataFrame([(i, 1, 1, t, 0.0, 0.0) for i, t in enumerate(texts)], schemas.SECTIONS)
    got = {}
    for x in numbers.resolve_overlaps(df).orderBy("doc_id", "start").collect():
        got.setdefault(x.doc_id, []).append((x.fmt, x.text, x.value))
    assert got[0] == [("ratio", "1.80x", 1.8), ("ratio", "2.31x", 2.31)]
    assert got[1] == [("integer", "12,345", 12345.0)]
    assert got[2] == [("date_number", "2024", 2024.0)]
    assert 3 not in got
    assert got[4][-1] == ("fraction", "1/2", 0.5)


def test_page_groups(spark):
    df = spark.createDataFrame([(1, p, "numeric_text" if p in (0, 1, 2, 4, 5) else "none_or_low_numbers") for p in range(6)], "doc_id BIGINT, page_no INT, category STRING")
    got = routing.page_groups(df, 2).orderBy("first_page").collect()
    assert [(g.first_page, g.last_page) for g in got] == [(0, 1), (2, 2), (4, 5)]


def test_complexity_golden(spark):
    c = cells(spark, {1: [1] * 10})
    m = spark.createDataFrame([(1, 1, 1, k, 3, k + 2) for k in (1, 4, 7)], schemas.MERGES)
    s = sheets(spark, 1, 10)
    facts = routing.sheet_facts(s, profiles.merge_profile(m), profiles.sheet_sparsity(c, s), profiles.formula_profile(c), profiles.column_inconsistency(c, s), profiles.header_levels(c, s))
    assert routing.complexity_metrics(facts).collect()[0].merged_cell_complexity == pytest.approx(0.6)
    s2, c2 = sheets(spark, 100, 50), cells(spark, {1: [1, 2, 3, 4, 5]})
    facts = routing.sheet_facts(s2, profiles.merge_profile(m.limit(0)), profiles.sheet_sparsity(c2, s2), profiles.formula_profile(c2), profiles.column_inconsistency(c2, s2), profiles.header_levels(c2, s2))
    assert routing.complexity_metrics(facts).collect()[0].sparsity_complexity == pytest.approx(0.1996)


def words(spark, items):
    return spark.createDataFrame([(1, 1, ln, k, t, x, y, x + 10.0, y + 10.0, 12.0, "Arial") for ln, k, t, x, y in items], schemas.WORDS)


def test_grid_of_two_lines(spark):
    w = words(spark, [(0, 0, "H1", 10.0, 10.0), (0, 1, "H2", 30.0, 10.0), (1, 0, "A", 10.0, 30.0), (1, 1, "B", 30.0, 30.0)])
    lc = layout.line_cells(w)
    got = layout.grid_assign(lc, layout.column_edges(lc)).orderBy("line_no", "col_no").collect()
    assert [(g.line_no, g.col_no, g.text) for g in got] == [(0, 1, "H1"), (0, 2, "H2"), (1, 1, "A"), (1, 2, "B")]


def test_rows_anchor_at_first_word(spark):
    w = words(spark, [(0, k, "w", 10.0 * k, y) for k, y in enumerate((0.0, 2.0, 3.0, 5.0, 6.5))])
    got = {x.top: x.row_no for x in layout.words_to_rows(w).collect()}
    assert got == {0.0: 1, 2.0: 1, 3.0: 1, 5.0: 2, 6.5: 2}


def test_spanning_tables_merge(spark):
    rows = []
    for page in (1, 2):
        for r, vals in enumerate([("Name", "Qty"), (f"a{page}", "1"), (f"b{page}", "2")], 1):
            rows += [(1, page, 1, r, c, v, 10.0 * c, 10.0 * r, 10.0 * c + 8, 10.0 * r + 8) for c, v in enumerate(vals, 1)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, page_no INT, table_no BIGINT, r BIGINT, c BIGINT, text STRING, x0 DOUBLE, top DOUBLE, x1 DOUBLE, bottom DOUBLE")
    merged, lines = layout.merge_spanning(layout.table_summary(df), df)
    assert [(m.table_id, m.parts) for m in merged.collect()] == [("table_spanning_pages_1-2", 2)]
    assert [x.row_index for x in lines.orderBy("row_index").collect()] == [0, 1, 2, 3, 4]


def test_region_iou_blocks_count_once(spark):
    reg = lambda rows: spark.createDataFrame(rows, "workbook_id BIGINT, sheet_id BIGINT, table_no BIGINT, r1 INT, c1 INT, r2 INT, c2 INT")
    a, b = reg([(1, 1, 1, 1, 1, 1000, 4)]), reg([(1, 1, 1, 501, 1, 1500, 4), (1, 1, 2, 2000, 1, 2001, 4)])
    got = compare.region_iou(a, b, block=64).collect()
    assert len(got) == 1 and got[0].iou == pytest.approx(500 / 1500)


def test_block_scans_equal_plain_windows(spark):
    """One key owns most rows; tiny blocks force every border case."""
    from pyspark.sql import Window as W

    df = spark.range(2000).select((F.col("id") % 7 == 0).cast("int").alias("k"), (F.col("id") * 3 + F.col("id") % 5).alias("p"), (F.col("id") % 13 == 0).alias("f"))
    w = W.partitionBy("k").orderBy("p")
    up = w.rowsBetween(W.unboundedPreceding, 0)
    want = df.select("k", "p", F.lag("p").over(w).alias("a"), F.lead("p").over(w).alias("z"), F.max(F.when(F.col("f"), F.col("p"))).over(up).alias("s"), F.row_number().over(w).cast("long").alias("n"))
    got = scan.with_neighbours(df, ["k"], "p", ["p"], "prev", "nxt", block=16)
    got = scan.with_segment_start(got, ["k"], "p", F.col("f"), "s", block=16)
    got = scan.with_row_number(got, ["k"], "p", "n", block=16).select("k", "p", F.col("prev.p").alias("a"), F.col("nxt.p").alias("z"), "s", "n")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_limits_of_the_first_rows_are_arguments(spark):
    rows = {r: ["x1", 2.0, 3.0] for r in range(1, 40)}
    rows[20] = ["2025-05-31", "2025-06-30", "Month 7"]
    seq = tables.row_sequence(profiles.row_profile(cells(spark, rows), sheets(spark, 39, 3)))
    assert [(x.r1, x.r2) for x in tables.regions_temporal(seq).collect()] == [(20, 39)]
    assert tables.regions_temporal(seq, head=5).count() == 0
    rows = {r: ["x1", 2.0, 3.0] for r in range(1, 40)}
    rows[30] = rows[31] = ["region name", "unit price", "total amount"]
    seq = tables.row_sequence(profiles.row_profile(cells(spark, rows), sheets(spark, 39, 3)))
    assert [(x.r1, x.header_rows, x.data_start_row, x.r2) for x in tables.regions_multirow(seq).collect()] == [(30, 2, 32, 39)]
    assert tables.regions_multirow(seq, head=11).count() == 0
    first = profiles.header_levels(cells(spark, rows), sheets(spark, 39, 3), head=5).first().header_levels
    assert (first, profiles.header_levels(cells(spark, rows), sheets(spark, 39, 3)).first().header_levels) == (1, 31)
    assert profiles.header_levels_meta(cells(spark, rows), sheets(spark, 39, 3), head=10).first().header_levels == 10
    assert profiles.header_levels_meta(cells(spark, rows), sheets(spark, 39, 3)).first().header_levels == 39


def test_sheet_text_with_and_without_limit(spark):
    df = cells(spark, {r: [f"v{r}"] for r in range(1, 150)})
    assert routing.sheet_text(df).count() == 149
    cut = [x.line for x in routing.sheet_text(df, 100).orderBy("r", F.length("line")).collect()]
    assert len(cut) == 101 and cut[0] == "Row 1: Col1:v1" and cut[-1] == "... (49 more rows truncated)"


def test_tables_of_a_page_are_all_kept(spark):
    found = spark.createDataFrame([(1, 0, n, 1) for n in range(25)], "doc_id long, page_no int, table_no int, strategy int")
    assert layout.tables_per_page_cap(found).count() == 25 and layout.tables_per_page_cap(found, 10).count() == 10



def parse(spark, *texts):
    rows = [(1, i, t) for i, t in enumerate(texts)]
    return compare.extract_json_block(spark.createDataFrame(rows, "workbook_id long, sheet_id long, response_text string"))


def test_any_readable_json_is_a_success(spark):
    got = {x.sheet_id: x for x in parse(spark, "{}", '{"notes": "none"}', "no json", "```json {broken ```", 'say {"analysis_confidence": 0.9} so').collect()}
    assert [got[i].status for i in range(5)] == ["success", "success", "parse_error", "parse_error", "success"]
    assert got[0].analysis_confidence == 0.5 and got[4].analysis_confidence == 0.9 and got[2].analysis_confidence == 0.0


def test_indicators_count_in_table_order(spark):
    table = lambda levels, marks, rows=5: (
        '{"boundaries": {"start_row": 1, "end_row": %d, "start_col": 1, "end_col": 10}, "headers": {"row_headers": [{"row": 1, "level": %d}]}, "complexity_indicators": [%s]}'
        % (rows, levels, ", ".join(f'"{m}"' for m in marks))
    )
    score = lambda *ts: '{"tables_detected": [%s]}' % ", ".join(ts)
    texts = [
        score(table(1, ["multi_level_headers"]), table(2, [])),  # named before it was seen: both count
        score(table(2, ["multi_level_headers"])),  # seen first
        score(table(1, ["large_table"], 200)),  # named before its size is known
        score(table(1, [], 200), table(1, ["large_table"])),
        score(table(1, ["odd", "odd"]), table(1, ["odd"])),
    ]
    parsed = parse(spark, *texts)
    got = {x.sheet_id: x.score for x in compare.response_complexity(parsed, compare.parsed_table_fields(compare.validate_tables(parsed))).collect()}
    assert [got[i] for i in range(5)] == [0.15, 0.1, 0.1, 0.05, 0.05]


def test_native_and_model_tables_are_united(spark):
    native = spark.createDataFrame([(1, 0, "p1_t1"), (2, 0, "p1_t1")], "doc_id long, page_no int, table_id string")
    model = spark.createDataFrame([(1, 0, "m1")], "doc_id long, page_no int, table_id string")
    assert routing.merge_tables(native, model).count() == 3


def test_insights_name_the_cost(spark):
    from sheetloom.operators import stats

    rows = [(1, "ai_primary", "complex", 0.05), (1, "traditional_only", "simple", 0.03), (2, "traditional_only", "simple", 0.03)]
    got = {x.workbook_id: x.insights for x in stats.file_insights(spark.createDataFrame(rows, "workbook_id long, decision string, complexity_level string, estimated_cost double")).collect()}
    assert got == {1: ["1 sheets required AI-primary processing", "Average cost per sheet: $0.0250"], 2: ["All sheets were simple enough for traditional processing"]}


def test_corpus_insights_and_advice(spark):
    from sheetloom.operators import compare

    compared = spark.createDataFrame([("ai", 0.1), ("ai", 0.2), ("unclear", 0.25), ("traditional", 0.29), ("tie_similar", 0.9)], "winner string, agreement_score double")
    decisions = spark.createDataFrame([("dual", 0.5), ("dual", 0.5), ("traditional_only", 9.0)], "decision string, estimated_cost double")
    row = compare.corpus_insights(compared, decisions).first()
    assert (row.sheets, row.analyses, row.cost, row.agreements, row.disagreements, row.ai_better, row.traditional_better) == (3, 2, 1.0, 1, 4, 2, 1)
    assert [x.split()[0] for x in row.insights] == ["High", "High", "High", "AI"] and [x.split()[0] for x in row.advice] == ["Analyze", "Process"]
    row = compare.corpus_insights(compared.limit(0), decisions.limit(0), ai_enabled=False).first()
    assert row.insights == [] and [x.split()[0] for x in row.advice] == ["Enable", "Process"]


def test_escapes_survive_write_and_read(spark, tmp_path):
    import json

    from sheetloom.sources import artifacts

    odd = ['back\\slash', 'line\nbreak', 'quo"te', "tab\tand é"]
    df = cells(spark, {1: odd, 2: [1.5, True, "plain", "end"]}).withColumns({"run_length": F.lit(1), "style": F.when(F.col("c") == 2, F.lit('{"number_format":"0.0 \\"x\\""}'))})
    lines = encoding.write_compact_sheets(df)
    rows = {x.r: json.loads(x.json) for x in lines.collect()}
    assert [c[1] for c in rows[1]["cells"]] == odd and json.loads(rows[1]["style"]) == {"number_format": '0.0 "x"'}
    out = lines.select(F.concat(F.lit('{"workbook_id":1,"sheet_id":1,'), F.expr("substring(json, 2)")).alias("value")).unionByName(spark.createDataFrame([("{broken",)], "value string"))
    out.write.text(str(tmp_path / "rows"))
    back = {(x.r, x.c): x.vtext for x in artifacts.read_compact_cells(spark, str(tmp_path / "rows")).filter("r = 1").collect()}
    assert [back[1, c] for c in range(1, 5)] == odd
    assert [x.line for x in artifacts.rejected_lines(spark, str(tmp_path / "rows")).collect()] == ["{broken"]


def test_workbook_and_compact_files(spark, tmp_path):
    import json

    from sheetloom.sources import artifacts

    cell = {"coordinate": "B2", "row": 2, "column": 2, "value": 1.5, "data_type": "n", "formula": "=A1", "comment": {"text": "hi"}, "style": {"font": {"bold": True}}, "is_error": False, "is_date": False}
    book = {"workbook": {"sheets": [{"name": "S", "state": "visible", "dimensions": {"min_row": 1, "min_col": 1, "max_row": 2, "max_col": 2}, "frozen_panes": {"frozen_rows": 1, "frozen_cols": 0},
            "cells": {"A1": {"value": "a\\b", "is_error": False, "is_date": False}, "B2": cell, "C3": {"value": True}, "D4": {"value": None}}}, {"name": "empty", "cells": {}}]}}
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "one.json").write_text(json.dumps(book, indent=1))
    (tmp_path / "v" / "bad.json").write_text("{no json")
    found, parts = artifacts.read_workbooks(spark, str(tmp_path / "v"))
    assert {(x.sheet_no, x.name, x.max_row, x.frozen_rows) for x in found.collect()} == {(0, "S", 2, 1), (1, "empty", None, None)}
    got = {(x.r, x.c): x for x in parts.collect()}
    assert {k: x.vtype for k, x in got.items()} == {(1, 1): "string", (2, 2): "number", (3, 3): "boolean", (4, 4): "null"}
    assert got[1, 1].vtext == "a\\b" and got[2, 2].vnum == 1.5 and got[2, 2].formula == "=A1" and json.loads(got[2, 2].style) == {"font": {"bold": True}} and got[1, 1].comment is None
    sheet = {"name": "S1", "frozen": [1, 1], "dimensions": [1, 1, 9, 3], "merged": [[2, 3, 2, 5]], "rows": [{"r": 1, "style": "h", "cells": [[1, "Product"], [2, "Price", "cur"], [3, None, None, "=B1", 4]]}]}
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "one.json").write_text(json.dumps(sheet, indent=1))
    (tmp_path / "c" / "two.json").write_text(json.dumps({"workbook": {"sheets": [sheet]}}))
    found, merges, parts = artifacts.read_compact_sheets(spark, str(tmp_path / "c"))
    assert [tuple(x)[2:] for x in found.collect()] == [("S1", 1, 1, 9, 3, 1, 1)] * 2
    assert {tuple(x)[2:] for x in merges.collect()} == {(2, 3, 2, 5)}
    assert {tuple(x)[2:] for x in parts.collect()} == {(1, 1, "string", "Product", None, None, "h", None, 1), (1, 2, "string", "Price", None, None, "cur", None, 1), (1, 3, "null", None, None, None, "h", "=B1", 4)}


def test_long_texts_and_pages_take_linear_folds(spark):
    import time

    text = "\n".join(f"sum {i}.5 of" for i in range(60_000))
    sections = spark.createDataFrame([(1, 1, 1, text)], "doc_id long, page_no int, section_no int, content string")
    words = spark.range(100_000).selectExpr("1L AS doc_id", "1 AS page_no", "CAST(id / 100 AS INT) AS line_no", "CAST(id % 100 AS INT) AS word_no", "'w' AS text", "CAST(id % 100 * 9 AS DOUBLE) AS x0",
                                            "CAST(floor(id / 100) * 40 AS DOUBLE) AS top", "CAST(id % 100 * 9 + 6 AS DOUBLE) AS x1", "CAST(floor(id / 100) * 40 + 10 AS DOUBLE) AS bottom")
    began = time.time()
    assert numbers.number_candidates(sections, {"decimal": r"\d+\.\d+"}).count() == 60_000
    assert layout.words_to_blocks(words).count() == 100_000
    assert time.time() - began < 60


def test_folds_equal_plain_aggregates(spark):
    from sheetloom.functions.folds import fold_append

    df = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 511, 512, 513, 1300)], "xs array<int>")
    step = lambda a, x: (F.struct((a["t"] + x).alias("t")), x % 3 == 0, a["t"])
    out = df.select("xs", fold_append(F.col("xs"), F.struct(F.lit(0).alias("t")), "struct<t:int>", "int", step).alias("o")).collect()
    for row in out:
        total, expected = 0, []
        for x in row.xs:
            expected += [total] if x % 3 == 0 else []
            total += x
        assert row.o == expected
