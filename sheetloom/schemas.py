"""Column contracts of the input tables (DDL strings Spark accepts)."""

CELLS = (
    "workbook_id BIGINT, sheet_id BIGINT, r INT, c INT, vtype STRING, vtext STRING, vnum DOUBLE, "
    "vbool BOOLEAN, formula STRING, style STRING, bold BOOLEAN, indent INT, has_comment BOOLEAN"
)
SHEETS = (
    "workbook_id BIGINT, sheet_id BIGINT, name STRING, min_row INT, min_col INT, max_row INT, max_col INT, "
    "frozen_rows INT, frozen_cols INT"
)
MERGES = "workbook_id BIGINT, sheet_id BIGINT, r1 INT, c1 INT, r2 INT, c2 INT"
REGIONS = "workbook_id BIGINT, sheet_id BIGINT, method STRING, r1 INT, c1 INT, r2 INT, c2 INT"
WORDS = (
    "doc_id BIGINT, page_no INT, line_no INT, word_no INT, text STRING, x0 DOUBLE, top DOUBLE, x1 DOUBLE, "
    "bottom DOUBLE, size DOUBLE, fontname STRING"
)
SECTIONS = "doc_id BIGINT, page_no INT, section_no INT, content STRING, x0 DOUBLE, top DOUBLE"
RESPONSES = "workbook_id BIGINT, sheet_id BIGINT, response_text STRING"
PAGES = "doc_id BIGINT, page_no INT, content STRING"

SHEET = ["workbook_id", "sheet_id"]
PAGE = ["doc_id", "page_no"]
