"""Words on pages: rows, table regions, exclusion zones, blocks and sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheetloom.functions import fixed
from sheetloom.functions.folds import fold_append, fold_runs
from sheetloom.functions.scan import with_neighbours, with_row_number, with_segment_start
from sheetloom.schemas import PAGE

WORD = ["doc_id", "page_no", "line_no", "word_no"]
LINE = [*PAGE, "row_no"]
BOX = ["x0", "top", "x1", "bottom"]


def page_range(df: DataFrame, raw: str = "page_raw") -> DataFrame:
    """One row per page of ``3`` or ``3-4``; unreadable text means page 1."""
    t = F.trim(raw)
    a = F.when(t.rlike(r"^\d+$"), t.try_cast("int")).when(t.rlike(r"^\d+-\d+$"), F.split_part(t, F.lit("-"), F.lit(1)).try_cast("int"))
    b = F.when(t.rlike(r"^\d+$"), t.try_cast("int")).when(t.rlike(r"^\d+-\d+$"), F.split_part(t, F.lit("-"), F.lit(2)).try_cast("int"))
    pages = F.when(a.isNull() | (a > b), F.array(F.lit(1))).otherwise(F.sequence(a, b))
    return df.withColumn("page_no", F.explode(pages))


def exclusion_zones(tables: DataFrame, pad: float = 10.0) -> DataFrame:
    """Padded table boxes, never left of or above the page."""
    return tables.withColumns(
        {"x0": F.greatest(F.col("x0") - pad, F.lit(0.0)), "top": F.greatest(F.col("top") - pad, F.lit(0.0)),
         "x1": F.col("x1") + pad, "bottom": F.col("bottom") + pad}
    )


def exclude_words(words: DataFrame, zones: DataFrame, band: float = 64.0) -> DataFrame:
    """Words that touch no zone of their page (closed intervals).

    Zones and words are spread over horizontal bands; the band joins the page in
    the equi key, so one crowded page is shared by many tasks.
    """
    bands = lambda a, b: F.sequence(F.floor(F.col(a) / band), F.floor(F.col(b) / band))
    z = zones.select(*[F.col(c).alias(f"z_{c}") for c in (*PAGE, *BOX)]).withColumn("z_band", F.explode(bands("z_top", "z_bottom")))
    w = words.select(*WORD, *BOX).withColumn("_band", F.explode(bands("top", "bottom")))
    touch = (
        (F.col("doc_id") == F.col("z_doc_id")) & (F.col("page_no") == F.col("z_page_no")) & (F.col("_band") == F.col("z_band"))
        & (F.col("x1") >= F.col("z_x0")) & (F.col("z_x1") >= F.col("x0"))
        & (F.col("bottom") >= F.col("z_top")) & (F.col("z_bottom") >= F.col("top"))
    )
    hit = w.join(z, touch, "left_semi").select(*WORD)
    return words.join(hit, WORD, "left_anti")


def words_to_rows(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Visual rows: a row takes all words within ``tolerance`` of its first word's top.

    Only the distinct tops of a page take part in the ordered rule.
    """
    tops = words.groupBy(*PAGE).agg(F.sort_array(F.collect_set("top")).alias("tops"))

    def step(a: Column, t: Column) -> tuple[Column, Column, Column]:
        opens = a["anchor"].isNull() | (t - a["anchor"] > tolerance)
        row = F.when(opens, a["row_no"] + 1).otherwise(a["row_no"])
        return F.struct(F.when(opens, t).otherwise(a["anchor"]).alias("anchor"), row.alias("row_no")), F.lit(True), F.struct(t.alias("top"), row.alias("row_no"))

    state = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(0).cast("long").alias("row_no"))
    keyed = tops.select(*PAGE, F.inline(fold_append(F.col("tops"), state, "struct<anchor:double,row_no:bigint>", "struct<top:double,row_no:bigint>", step)))
    return words.join(keyed, [*PAGE, "top"])


def tabular_row(rows: DataFrame) -> DataFrame:
    """Per visual row: word count, first x and whether its word starts are evenly spaced."""
    d = with_neighbours(rows.select(*LINE, "line_no", "word_no", "x0"), LINE, "x0", ["x0"], tie=("line_no", "word_no"), block=None)
    line = W.partitionBy(*LINE)
    d = d.withColumns({"n": F.count(F.lit(1)).over(line), "first_x": F.min("x0").over(line), "last_x": F.max("x0").over(line)})
    mean = F.try_divide(F.col("last_x") - F.col("first_x"), F.col("n") - 1)
    gaps = d.withColumn("near", F.abs(F.col("x0") - F.col("prev.x0") - mean) < mean * 0.5)
    per = gaps.groupBy(*LINE, "n", "first_x").agg(F.count_if("near").alias("near"))
    return per.withColumn(
        "tabular", F.when(F.col("n") < 2, False).when(F.col("n") > 2, F.col("near") >= (F.col("n") - 1) * 0.6).otherwise(F.col("n") >= 3)
    ).select(*LINE, "n", "first_x", "tabular")


def tabular_regions(lines: DataFrame, min_rows: int = 2, width_slack: int = 2, x_slack: float = 20.0) -> DataFrame:
    """Runs of tabular rows whose width stays near the run's first row and whose left edge stays near the previous row.

    Breaks that depend on neighbours are found by a block scan.  The rule against
    the first row's width then folds only over the rows where the width changes.
    """
    d = with_neighbours(lines, PAGE, "row_no", ["tabular", "n", "first_x"], block=None).filter("tabular")
    p = F.col("prev")
    hard = p.isNull() | ~p["tabular"] | (F.abs(F.col("first_x") - p["first_x"]) > x_slack)
    d = with_segment_start(d.withColumn("hard", hard), PAGE, "row_no", F.col("hard"), "run", block=None)
    change = d.filter(F.col("hard") | (F.col("n") != p["n"])).groupBy(*PAGE, "run").agg(
        F.sort_array(F.collect_list(F.struct("row_no", "n"))).alias("cs")
    )
    def step(a: Column, c: Column) -> tuple[Column, Column, Column]:
        opens = a["width"].isNull() | (F.abs(c["n"] - a["width"]) > width_slack)
        return F.struct(F.when(opens, c["n"]).otherwise(a["width"]).alias("width")), opens, c["row_no"]

    none = F.struct(F.lit(None).cast("bigint").alias("width"))
    opens = change.select(*PAGE, F.explode(fold_append(F.col("cs"), none, "struct<width:bigint>", "bigint", step)).alias("row_no"), F.lit(True).alias("open"))
    d = d.drop("prev", "run", "hard").join(opens, [*PAGE, "row_no"], "left")
    d = with_segment_start(d, PAGE, "row_no", F.col("open").isNotNull(), "start_row", block=None)
    reg = d.groupBy(*PAGE, "start_row").agg(F.max("row_no").alias("end_row"), F.count(F.lit(1)).alias("rows"))
    return with_row_number(reg.filter(F.col("rows") >= min_rows), PAGE, "start_row", "table_no", block=None)


def region_words(regions: DataFrame, rows: DataFrame) -> DataFrame:
    """Words of each table region with 1-based table row and column."""
    span = regions.select(*PAGE, "table_no", "start_row", F.explode(F.sequence("start_row", "end_row")).alias("row_no"))
    hit = rows.join(span, LINE).withColumn("r", F.col("row_no") - F.col("start_row") + 1)
    return with_row_number(hit, [*PAGE, "table_no", "r"], "x0", "c", tie=("line_no", "word_no"), block=None)


def region_box(cells: DataFrame, min_table_size: int = 2) -> DataFrame:
    box = cells.groupBy(*PAGE, "table_no").agg(
        F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"), F.max("r").alias("rows")
    )
    return box.filter(F.col("rows") >= min_table_size)


def token_box(cells: DataFrame, words: DataFrame, page_width: float = 612.0, page_height: float = 792.0, pad: float = 2.0) -> DataFrame:
    """Box of the page words that equal a distinctive token of the table, else the middle of the page."""
    key = [*PAGE, "table_no"]
    t = F.trim("text")
    tokens = cells.select(*key, t.alias("token")).filter((F.length("token") >= 3) | F.col("token").rlike(r"[$%/,]")).distinct()
    tables = cells.select(*key).distinct()
    box = lambda p: [F.min("x0").alias(f"{p}x0"), F.min("top").alias(f"{p}top"), F.max("x1").alias(f"{p}x1"), F.max("bottom").alias(f"{p}bottom"), F.count(F.lit(1)).alias(f"{p}n")]
    hits = words.join(tokens, (words.doc_id == tokens.doc_id) & (words.page_no == tokens.page_no) & (words.text == tokens.token))
    a = hits.select(tokens.doc_id, tokens.page_no, "table_no", *BOX).groupBy(*key).agg(*box("a_"))
    like = words.filter(F.col("text").rlike(r"^(\d{1,2}/\d{1,2}/\d{2,4}|\$\s*\d)"))
    b = like.groupBy(*PAGE).agg(*box("b_"))
    named = tokens.filter(F.lower("token").isin("category", "metric"))
    c = words.join(named, (words.doc_id == named.doc_id) & (words.page_no == named.page_no) & (words.text == named.token))
    c = c.select(named.doc_id, named.page_no, "table_no", *BOX).groupBy(*key).agg(*box("c_"))
    d = tables.join(a, key, "left").join(b, PAGE, "left").join(c, key, "left")
    few = F.coalesce("a_n", F.lit(0)) < 5
    extra = lambda x: F.when(few, F.col(x))
    found = F.coalesce("a_n", extra("b_n"), extra("c_n")).isNotNull()
    lo = lambda x: F.greatest(F.least(F.col(f"a_{x}"), extra(f"b_{x}"), extra(f"c_{x}")) - pad, F.lit(0.0))
    hi = lambda x: F.greatest(F.col(f"a_{x}"), extra(f"b_{x}"), extra(f"c_{x}")) + pad
    return d.select(
        *key,
        F.when(found, lo("x0")).otherwise(page_width * 0.25).alias("x0"), F.when(found, lo("top")).otherwise(page_height * 0.25).alias("top"),
        F.when(found, hi("x1")).otherwise(page_width * 0.75).alias("x1"), F.when(found, hi("bottom")).otherwise(page_height * 0.75).alias("bottom"),
    )


def is_meaningful_cell(text: Column) -> Column:
    """Length and code rules: one character never counts, two or three need a digit or a known mark."""
    t = F.trim(text)
    return F.coalesce(
        F.when(F.length(t) <= 1, False).when(F.length(t) <= 3, t.rlike(r"\d") | t.isin("$", "%", "N/A", "TBD")).otherwise(True), F.lit(False)
    )


def cell_text_meaningful(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("meaningful", is_meaningful_cell(F.col(text)))


def looks_like_prose(cells: DataFrame) -> DataFrame:
    """Tables with uneven row widths or mostly stop-word, short or cut-off cells."""
    key = [*PAGE, "table_no"]
    low = F.lower(F.trim("text"))
    score = (
        low.rlike("|".join(fixed.SENTENCE_WORDS)).cast("int")
        + ((F.length(low) <= 3) & low.rlike(r"^\p{L}+$")).cast("int")
        + (low.endswith("...") | (F.length(low) == 1)).cast("int")
    )
    filled = F.length(F.trim("text")) > 0
    rows = cells.groupBy(*key, "r").agg(F.count(F.lit(1)).alias("width"), F.count_if(filled).alias("filled"), F.sum(F.when(filled, score).otherwise(0)).alias("hits"))
    per = rows.groupBy(*key).agg(
        F.count_distinct("width").alias("widths"), F.count(F.lit(1)).alias("rows"), F.sum("filled").alias("filled"), F.sum("hits").alias("hits")
    )
    return per.withColumn("prose", (F.col("widths") > F.col("rows") * 0.5) | F.coalesce(F.try_divide("hits", "filled") > 0.4, F.lit(True)))


def table_valid(cells: DataFrame, confidence: DataFrame | None = None, threshold: float = 0.7, default_confidence: float = 0.75) -> DataFrame:
    """Row, column, content and confidence tests together with the prose test."""
    key = [*PAGE, "table_no"]
    filled = F.length(F.trim("text")) > 0
    per = cells.groupBy(*key).agg(
        F.max("r").alias("rows"), F.max("c").alias("cols"), F.count(F.lit(1)).alias("total"), F.count_if(filled).alias("filled"),
        F.count_if(filled & is_meaningful_cell(F.col("text"))).alias("meaningful"),
    )
    per = per.join(looks_like_prose(cells).select(*key, "prose"), key)
    per = per.join(confidence, key, "left") if confidence is not None else per.withColumn("confidence", F.lit(default_confidence))
    ok = (
        (F.col("rows") >= 2) & F.col("cols").between(2, 15) & (F.col("filled") / F.col("total") >= 0.4)
        & (F.col("meaningful") / F.col("total") >= 0.25) & (F.coalesce("confidence", F.lit(default_confidence)) >= threshold) & ~F.col("prose")
    )
    return per.withColumn("valid", ok).select(*key, "rows", "cols", "valid")


def tables_per_page_cap(found: DataFrame, cap: int | None = None) -> DataFrame:
    """Per page the first strategy that found anything and its tables with their rank; only the first ``cap`` if given."""
    best = found.groupBy(*PAGE).agg(F.min("strategy").alias("strategy"))
    w = W.partitionBy(*PAGE).orderBy("table_no")
    won = found.join(best, [*PAGE, "strategy"]).withColumn("rank", F.row_number().over(w))
    return won if cap is None else won.filter(F.col("rank") <= cap)


def letter(c: Column) -> Column:
    """The character 64 + c; ``char`` itself knows 256 characters only."""
    code = (c + 64).cast("int")
    return F.when(code < 256, F.char(code)).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def pdf_table_cells(cells: DataFrame) -> DataFrame:
    """Grid cells with column and row labels from the first row and column, and the rectangular cell count."""
    key = [*PAGE, "table_no"]
    t = F.trim("text")
    heads = cells.filter("r = 1").select(*key, "c", F.when(F.length(t) > 0, t).alias("head"))
    lefts = cells.filter("c = 1").select(*key, "r", F.when(F.length(t) > 0, t).alias("left"))
    size = cells.groupBy(*key).agg((F.max("r") * F.max("c")).alias("cell_count"))
    d = cells.filter(F.length(t) > 0).join(size, key).join(heads, [*key, "c"], "left").join(lefts, [*key, "r"], "left")
    return d.select(
        *key, "r", "c", t.alias("value"), F.coalesce("head", F.concat(F.lit("Column "), letter(F.col("c")))).alias("column_label"),
        F.coalesce("left", F.concat(F.lit("Row "), F.col("r").cast("string"))).alias("row_label"), (F.col("r") == 1).alias("is_header_row"), "cell_count",
    )


def table_summary(cells: DataFrame) -> DataFrame:
    """One row per table: size, box, signature of the first cells and the column labels (at most 16,384)."""
    key = [*PAGE, "table_no"]
    head = F.when((F.col("r") <= 2) & (F.col("c") <= 3), F.struct("r", "c", F.trim("text").alias("t")))
    label = F.when(F.col("r") == 1, F.struct("c", F.trim("text").alias("t")))
    per = cells.groupBy(*key).agg(
        F.max("r").alias("rows"), F.max("c").alias("cols"), *[f(b).alias(b) for f, b in ((F.min, "x0"), (F.min, "top"), (F.max, "x1"), (F.max, "bottom"))],
        F.sort_array(F.collect_list(head)).alias("h"), F.sort_array(F.collect_list(label)).alias("l"), F.count(F.lit(1)).alias("filled"),
    )
    names = F.transform(
        F.sequence(F.lit(1), F.col("cols").cast("int")),
        lambda i: F.coalesce(F.nullif(F.get(F.transform("l", lambda x: x["t"]), i - 1), F.lit("")), F.concat(F.lit("Column "), letter(i))),
    )
    sig = F.concat_ws("_", F.lit("page"), F.col("page_no"), F.concat_ws("x", "rows", "cols"), F.array_join(F.transform("h", lambda x: x["t"]), "|"))
    return per.withColumn("signature", sig).withColumn("labels", names).drop("h", "l")


def dedupe_tables(summary: DataFrame) -> DataFrame:
    """First table of each signature inside its document."""
    first = summary.groupBy("doc_id", "signature").agg(F.min(F.struct("page_no", "table_no")).alias("m"))
    keep = first.select("doc_id", F.col("m.page_no").alias("page_no"), F.col("m.table_no").alias("table_no"))
    return summary.join(keep, [*PAGE, "table_no"], "left_semi")


def spanning_link(summary: DataFrame, x_slack: float = 20.0, label_share: float = 0.7) -> DataFrame:
    """Whether a table continues the document's previous one on the page before."""
    d = with_neighbours(summary, ["doc_id"], "page_no", ["page_no", "table_no", "cols", "labels", "x0", "x1"], tie=("table_no",))
    p = F.col("prev")
    equal = F.size(F.filter(F.zip_with("labels", p["labels"], lambda a, b: F.lower(a) == F.lower(b)), lambda x: F.coalesce(x, F.lit(False))))
    linked = (
        (F.col("page_no") == p["page_no"] + 1) & (F.col("cols") == p["cols"]) & (equal / F.size("labels") >= label_share)
        & (F.abs(F.col("x0") - p["x0"]) <= x_slack) & (F.abs(F.col("x1") - p["x1"]) <= x_slack)
    )
    return d.withColumn("linked", F.coalesce(linked, F.lit(False))).drop("prev")


def merge_spanning(summary: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains of linked tables as one: (tables, rows).  Later header rows are dropped and rows renumbered.

    ``chain`` is the place of the chain's first table among its document's tables.
    """
    d = with_row_number(spanning_link(summary), ["doc_id"], "page_no", "ord", tie=("table_no",))
    d = with_segment_start(d, ["doc_id"], "ord", ~F.col("linked"), "chain")
    merged = d.groupBy("doc_id", "chain").agg(
        F.min("page_no").alias("page_from"), F.max("page_no").alias("page_to"), F.count(F.lit(1)).alias("parts"),
        F.min("x0").alias("x0"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom"),
    )
    merged = merged.withColumn("table_id", F.when(F.col("parts") > 1, F.format_string("table_spanning_pages_%d-%d", "page_from", "page_to")))
    link = d.select(*PAGE, "table_no", "chain", "ord")
    rows = cells.select(*PAGE, "table_no", "r").distinct().join(link, [*PAGE, "table_no"]).filter((F.col("r") > 1) | (F.col("chain") == F.col("ord")))
    rows = with_row_number(rows, ["doc_id", "chain"], "ord", "n", tie=("r",))
    return merged, rows.withColumn("row_index", F.col("n") - 1).select("doc_id", "chain", *PAGE[1:], "table_no", "r", "row_index")


# ---- text blocks and sections --------------------------------------------------


def words_to_blocks(words: DataFrame) -> DataFrame:
    """Greedy text blocks of a page in (top, x0) order, each word tested against the running box.

    The rule depends on everything placed before it on the page, so it folds over
    one page's word boxes; a page is one sheet of paper, not a growing group.
    """
    item = lambda no: lambda w: F.struct(w["line_no"].alias("line_no"), w["word_no"].alias("word_no"), no.alias("block_no"))
    return _blocks(words, lambda ws, b, i: F.transform(_members(ws, b), item(i + 1)), flat=True)


def block_texts(words: DataFrame) -> DataFrame:
    """Blocks with text, box and the look of their first word."""

    def block(ws: Column, b: Column, i: Column) -> Column:
        first = F.get(ws, b["at"])
        return F.struct(
            (i + 1).alias("block_no"), *[b[c].alias(c) for c in BOX],
            F.trim(F.array_join(F.transform(_members(ws, b), lambda w: w["text"]), " ")).alias("content"),
            first["size"].alias("font_size"), first["fontname"].alias("font_family"),
        )

    return _blocks(words, block, "text", "size", "fontname")


def _members(ws: Column, b: Column) -> Column:
    return F.slice(ws, b["at"] + 1, b["n"])


def _blocks(words: DataFrame, row: Callable[[Column, Column, Column], Column], *more: str, flat: bool = False) -> DataFrame:
    """A page's words in order with ``more`` of their columns, cut into blocks; ``row`` makes a block's row of the words, the block and its place.

    A block is a stretch of the ordered words, so the fold keeps its box, first word and length only.
    """
    item = F.struct("top", "x0", "line_no", "word_no", "x1", "bottom", *more)
    pages = words.groupBy(*PAGE).agg(F.sort_array(F.collect_list(item)).alias("ws"))
    kind = "struct<x0:double,top:double,x1:double,bottom:double,at:int,n:int>"

    def joins(b: Column, w: Column) -> Column:
        gap = w["x0"] - b["x1"]
        line = (F.abs(w["top"] - b["top"]) <= 5) & (gap <= 50)
        nxt = b["bottom"] + 2
        below = (w["top"] >= nxt - 5) & (w["top"] <= nxt + b["bottom"] - b["top"]) & (F.abs(w["x0"] - b["x0"]) <= 20)
        near = (F.abs(w["top"] - b["bottom"]) <= 30) & (gap <= 100)
        return line | below | near

    def first(b: Column, w: Column) -> Column:
        return F.struct(*[w[c].alias(c) for c in BOX], F.coalesce(b["at"] + b["n"], F.lit(0)).alias("at"), F.lit(1).alias("n"))

    def grown(b: Column, w: Column) -> Column:
        wider = [f(b[c], w[c]).alias(c) for c, f in zip(BOX, (F.least, F.least, F.greatest, F.greatest))]
        return F.struct(*wider, b["at"].alias("at"), (b["n"] + 1).alias("n"))

    rows = F.transform(fold_runs(F.col("ws"), kind, joins, first, grown), lambda b, i: row(F.col("ws"), b, i))
    return pages.select(*PAGE, F.inline(F.flatten(rows) if flat else rows))


def paragraphs(text: Column) -> Column:
    """Pieces between blank lines or sentence ends before a capital letter, with single spaces."""
    parts = F.split(F.trim(text), r"\n\s*\n|\.\s+(?=[A-Z])", -1)
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"(?U)\s+", " "))), lambda p: F.length(p) > 0)


def split_paragraphs(df: DataFrame, text: str = "content") -> DataFrame:
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(paragraphs(F.col(text))).alias("par_no", text))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def spaced_words(text: Column) -> Column:
    """Words of a paragraph, which has single spaces."""
    return F.when(F.length(text) > 0, F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1).otherwise(0)


def list_type(text: Column) -> Column:
    lines = F.split(text, "\n")
    line_hit = lambda pattern: F.size(F.filter(lines, lambda x: F.trim(x).rlike(pattern)))
    ordered, bullets = r"^(\d+\.|\d+\)|[a-z]\.|[A-Z]\.)", r"^[-•*○▪▫]"
    n_ord, n_all = line_hit(ordered), F.size(lines)
    n_un = F.size(F.filter(lines, lambda x: ~F.trim(x).rlike(ordered) & F.trim(x).rlike(bullets)))
    single = F.when(text.rlike(r"(?U)^\s*\w+[\.\)]\s+") | text.rlike(r"^\s*[-•*]\s+"), F.when(text.rlike(r"^\s*\d+[\.\)]"), "ordered").otherwise("unordered"))
    many = F.when(n_ord > n_all * 0.5, "ordered").when(n_un > n_all * 0.5, "unordered")
    return F.when(~text.contains("\n"), single).otherwise(many)


def section_kind(text: Column, bottom: Column, words: Column | None = None) -> Column:
    low, n = F.lower(text), word_count(text) if words is None else words
    upper = (F.upper(text) == text) & text.rlike(r"\p{L}")
    head = (n <= 10) & (upper | low.rlike("table|figure|section|chapter") | text.rlike(r"^\d+\.?\s+[A-Z]"))
    foot = low.contains("page ") | low.contains("copyright") | low.contains("©") | low.contains("all rights")
    return (
        F.when(head, "header")
        .when(list_type(text).isNotNull(), "list")
        .when(low.contains("table") & (text.contains(":") | (n < 15)), "table_caption")
        .when((n < 15) & low.rlike(r"figure|fig\.|chart|graph"), "figure_caption")
        .when((bottom > 700) | foot, "footer")
        .otherwise("paragraph")
    )


def section_title(text: Column, kind: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(F.trim(text), r"^\d+\.?\s*", ""), r"(?U)^\W+", "")
    return F.when((kind == "header") & (t != ""), t)


def heading_level(text: Column, size: Column) -> Column:
    dots = F.length(text) - F.length(F.translate(text, ".", ""))
    size = F.coalesce(size, F.lit(12.0))
    out = F.when(size >= 20, 1)
    for limit, level in ((16, 2), (14, 3), (12, 4), (10, 5), (8, 6)):
        out = out.when(size >= limit, level)
    return out.when(text.rlike(r"^\d+\.?\s+[A-Z]"), F.least(F.lit(4), dots + 1))


def llm_ready(text: Column, low: int = 3, high: int = 500, words: Column | None = None) -> Column:
    special = F.length(F.regexp_replace(text, r"(?U)[\p{L}\p{N}\s]+", "")) / F.length(text)
    return (word_count(text) if words is None else words).between(low, high) & text.contains(".") & (special <= 0.3)


def sections(blocks: DataFrame, min_words: int = 3) -> DataFrame:
    """Paragraphs of enough words, numbered inside their page, with type, title, structure and look."""
    text, n = F.col("content"), F.col("word_count")
    d = split_paragraphs(blocks).withColumn("word_count", spaced_words(text)).filter(n >= min_words)
    d = with_row_number(d, PAGE, "block_no", "section_no", tie=("par_no",), block=None)
    d = d.withColumn("section_type", section_kind(text, F.col("bottom"), n))
    return d.withColumns(
        {
            "section_id": F.format_string("page_%d_section_%d", "page_no", "section_no"),
            "character_count": F.length(text),
            "title": section_title(text, F.col("section_type")),
            "list_type": list_type(text),
            "heading_level": heading_level(text, F.col("font_size")),
            "llm_ready": llm_ready(text, words=n),
            "is_bold": F.col("font_family").contains("Bold"),
            "is_italic": F.col("font_family").contains("Italic"),
        }
    )


def toc(secs: DataFrame) -> DataFrame:
    """Titled headers with their level; a document reads it in (page_no, section_no) order."""
    return secs.filter((F.col("section_type") == "header") & F.col("title").isNotNull()).select(
        *PAGE, "section_no", "section_id", "title", F.coalesce("heading_level", F.lit(1)).alias("level")
    )


SECTION_TYPES = ["header", "list", "table_caption", "figure_caption", "footer", "paragraph"]


def document_summary(secs: DataFrame, numbers: DataFrame | None = None, words_per_minute: int = 200) -> DataFrame:
    d = secs.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("sections"), F.sum("word_count").alias("words"), F.count_if("llm_ready").alias("llm_ready_sections"),
        *[F.count_if(F.col("section_type") == k).alias(f"n_{k}") for k in SECTION_TYPES],
    )
    d = d.withColumn("average_length", F.round(F.col("words") / F.col("sections"), 6)).withColumn("reading_minutes", F.round(F.col("words") / words_per_minute, 6))
    if numbers is None:
        return d
    return d.join(numbers.groupBy("doc_id").agg(F.count(F.lit(1)).alias("numbers")), "doc_id", "left").fillna(0, ["numbers"])


def quality_bands(df: DataFrame, confidence: str = "confidence") -> DataFrame:
    c = F.col(confidence)
    band = F.when(c >= 0.9, "high").when(c >= 0.7, "medium").otherwise("low")
    return df.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def quality_scores(tables: DataFrame, summary: DataFrame) -> DataFrame:
    """Table, text and overall quality per document, and the simple content score."""
    t = tables.groupBy("doc_id").agg(
        F.coalesce(F.try_divide(F.sum(F.col("confidence") * F.col("cell_count")), F.sum("cell_count")), F.avg("confidence")).alias("table_quality"),
        F.count(F.lit(1)).alias("tables"), F.avg("confidence").alias("mean_confidence"),
    )
    x = F.least(F.lit(1.0), F.col("llm_ready_sections") / F.col("sections") * 0.7 + F.least(F.lit(1.0), F.col("sections") / 10) * 0.3)
    s = summary.select("doc_id", "sections", x.alias("text_quality"))
    j = t.join(s, "doc_id", "full")
    both = F.coalesce((F.col("table_quality") + F.col("text_quality")) / 2, "table_quality", "text_quality")
    simple = F.lit(0.7) + F.when(F.coalesce("tables", F.lit(0)) > 0, 0.15).otherwise(0.0) + F.when(F.coalesce("sections", F.lit(0)) > 0, 0.15).otherwise(0.0)
    return j.select(
        "doc_id", *[F.round(c, 6).alias(n) for n, c in (("table_quality", F.col("table_quality")), ("text_quality", F.col("text_quality")), ("overall", both),
                                                       ("simple_score", F.least(F.lit(1.0), simple)), ("mean_confidence", F.col("mean_confidence")))],
    )


def sections_with_content(secs: DataFrame, numbers: DataFrame) -> DataFrame:
    """Sections with text or numbers, with default page and id."""
    n = numbers.groupBy("doc_id", "page_no", "section_no").agg(F.count(F.lit(1)).alias("numbers"))
    j = secs.join(n, ["doc_id", "page_no", "section_no"], "left").fillna(0, ["numbers"])
    return j.filter((F.length(F.trim("content")) > 0) | (F.col("numbers") > 0)).select(
        "doc_id", F.coalesce("page_no", F.lit(1)).alias("page"), "content", "numbers",
        F.coalesce("section_id", F.format_string("page_%d_section_%d", F.coalesce("page_no", F.lit(1)), "section_no")).alias("section_id"),
    )


# ---- grid tables from lines ------------------------------------------------------


def _with_cell(words: DataFrame, x_tolerance: float) -> DataFrame:
    """Words of a line with the start of the cell that they belong to."""
    line = [*PAGE, "line_no"]
    d = with_neighbours(words, line, "x0", ["x1"], tie=("word_no",), block=None)
    opens = F.col("prev").isNull() | (F.col("x0") - F.col("prev.x1") > x_tolerance)
    return with_segment_start(d.withColumn("opens", opens), line, "x0", F.col("opens"), "cell_x0", block=None).drop("prev", "opens")


def _text(*order: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "text"))), lambda w: w["text"]), " ").alias("text")


def line_cells(words: DataFrame, x_tolerance: float = 6.0) -> DataFrame:
    """Words of a line merged into cells where the gap to the previous word is small."""
    return _with_cell(words, x_tolerance).groupBy(*PAGE, "line_no", "cell_x0").agg(
        _text("x0", "word_no"), F.min("top").alias("top"), F.max("x1").alias("x1"), F.max("bottom").alias("bottom")
    )


def column_starts(cells: DataFrame, x_tolerance: float = 6.0) -> DataFrame:
    """Distinct cell starts of a page; those that are the position of a column have its number.

    Columns are clusters of cell starts with steps up to twice the tolerance, their position is the upper median.
    """
    starts = cells.groupBy(*PAGE, "cell_x0").agg(F.count(F.lit(1)).alias("n"))
    d = with_neighbours(starts, PAGE, "cell_x0", ["cell_x0"], block=None)
    opens = F.col("prev").isNull() | (F.col("cell_x0") - F.col("prev.cell_x0") > 2 * x_tolerance)
    d = with_segment_start(d.withColumn("opens", opens), PAGE, "cell_x0", F.col("opens"), "cluster", block=None).drop("prev", "opens")
    cluster = W.partitionBy(*PAGE, "cluster")
    d = d.withColumns({"upto": F.sum("n").over(cluster.orderBy("cell_x0")), "half": F.floor(F.sum("n").over(cluster) / 2)})
    middle = (F.col("upto") > F.col("half")) & (F.col("upto") - F.col("n") <= F.col("half"))
    d = d.withColumn("middle", middle).withColumn("upto", F.count_if("middle").over(W.partitionBy(*PAGE).orderBy("cell_x0")))
    return d.select(*PAGE, "cell_x0", F.when(F.col("middle"), F.col("upto")).alias("col_no"))


def column_edges(cells: DataFrame, x_tolerance: float = 6.0) -> DataFrame:
    """Column positions of a page: clusters of cell starts with steps up to twice the tolerance, upper median each."""
    return column_starts(cells, x_tolerance).filter(F.col("col_no").isNotNull()).select(*PAGE, "col_no", F.col("cell_x0").alias("edge"))


def grid_assign(cells: DataFrame, edges: DataFrame, min_rows: int = 2, min_cols: int = 2) -> DataFrame:
    """Each cell in the column of the nearest edge (ties to the lower), of pages that hold a grid."""
    marks = edges.select(*PAGE, F.col("edge").alias("cell_x0"), "col_no")
    starts = cells.select(*PAGE, "cell_x0").distinct().join(marks, [*PAGE, "cell_x0"], "left")
    return _grid(cells, ["cell_x0"], starts, min_rows, min_cols)


def grid_of_words(words: DataFrame, cell_tolerance: float = 6.0, x_tolerance: float = 6.0, min_rows: int = 2, min_cols: int = 2) -> DataFrame:
    """``grid_assign`` of the words' line cells with their own edges; words go to their column without becoming cells first."""
    d = _with_cell(words, cell_tolerance)
    cells = d.select(*PAGE, "line_no", "cell_x0").distinct()
    return _grid(d.select(*PAGE, "line_no", "cell_x0", "x0", "word_no", "text"), ["cell_x0", "x0", "word_no"], column_starts(cells, x_tolerance), min_rows, min_cols)


def _grid(pieces: DataFrame, order: list[str], starts: DataFrame, min_rows: int, min_cols: int) -> DataFrame:
    """Edges are cell starts themselves, so the nearest edge on either side of every start comes from one forward and one backward scan."""
    x = with_segment_start(starts.withColumn("_neg", -F.col("cell_x0")), PAGE, "cell_x0", F.col("col_no").isNotNull(), "lo", block=None)
    # columns are numbered in the order of their edges, so the nearest ones have the largest number up to here and the smallest from here
    w = W.partitionBy(*PAGE)
    x = x.withColumns({"before": F.max("col_no").over(w.orderBy("cell_x0").rowsBetween(W.unboundedPreceding, 0)), "cols": F.count("col_no").over(w)})
    x = with_segment_start(x, PAGE, "_neg", F.col("col_no").isNotNull(), "hi", block=None).withColumn("hi", -F.col("hi"))
    x = x.withColumn("after", F.min("col_no").over(w.orderBy("_neg").rowsBetween(W.unboundedPreceding, 0)))
    lower = F.col("hi").isNull() | (F.col("cell_x0") - F.col("lo") <= F.col("hi") - F.col("cell_x0"))
    x = x.select(*PAGE, "cell_x0", F.when(F.col("lo").isNull() | ~lower, F.col("after")).otherwise(F.col("before")).alias("col_no"), "cols")
    d = pieces.join(x.filter(F.col("col_no").isNotNull() & (F.col("cols") >= min_cols)), [*PAGE, "cell_x0"])
    grid = d.groupBy(*PAGE, "line_no", "col_no").agg(_text(*order))
    # a line counts once, with its first column; the cells are not made again to count them
    line = W.partitionBy(*PAGE, "line_no")
    grid = grid.withColumns({"first": F.row_number().over(line.orderBy("col_no")) == 1, "filled": F.count(F.lit(1)).over(line)})
    grid = grid.withColumns({"rows": F.count_if("first").over(w), "multi": F.count_if(F.col("first") & (F.col("filled") >= min_cols)).over(w)})
    ok = (F.col("rows") >= min_rows) & (F.col("multi") >= max(2, min_rows - 1))
    return grid.filter(ok).select(*PAGE, "line_no", "col_no", "text")
