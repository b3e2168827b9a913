"""Page metrics, page groups and the merge of model and plain results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sheetloom.functions import fixed
from sheetloom.functions.scan import with_neighbours, with_segment_start
from sheetloom.operators.layout import word_count
from sheetloom.schemas import PAGE


def page_metrics(pages: DataFrame) -> DataFrame:
    """Matches of five overlapping number patterns per page, per 1000 characters and characters per number."""
    n = sum((F.regexp_count("content", F.lit(f"(?U){p}")) for p in fixed.NUMBERS_ROUTING), F.lit(0))
    chars = F.greatest(F.length("content"), F.lit(1))
    d = pages.withColumn("number_count", n).withColumn("char_count", chars)
    return d.withColumn("density", F.col("number_count") / F.col("char_count") * 1000.0).withColumn(
        "text_ratio", F.col("char_count") / F.greatest("number_count", F.lit(1))
    )


def page_category(metrics: DataFrame, min_numbers: int = 3, min_density: float = 0.5, min_likeness: float = 0.6) -> DataFrame:
    likeness = F.col("table_likeness") if "table_likeness" in metrics.columns else F.lit(0.0)
    low = (F.col("number_count") < min_numbers) & (F.col("density") < min_density)
    return metrics.withColumn(
        "category", F.when(low, "none_or_low_numbers").when(likeness >= min_likeness, "probable_table").otherwise("numeric_text")
    )


def page_groups(categories: DataFrame, max_pages: int = 5) -> DataFrame:
    """Runs of consecutive numeric pages, cut into groups of at most ``max_pages``."""
    d = categories.filter(F.col("category") != "none_or_low_numbers").select("doc_id", "page_no")
    d = with_neighbours(d, ["doc_id"], "page_no", ["page_no"])
    starts = F.col("prev").isNull() | (F.col("page_no") - F.col("prev.page_no") != 1)
    d = with_segment_start(d, ["doc_id"], "page_no", starts, "run").drop("prev")
    chunk = F.floor((F.col("page_no") - F.col("run")) / max_pages)
    return d.groupBy("doc_id", "run", chunk.alias("chunk")).agg(F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page")).drop("run", "chunk")


def grouped_pages(groups: DataFrame) -> DataFrame:
    return groups.select("doc_id", "first_page", F.explode(F.sequence("first_page", "last_page")).alias("page_no"))


def ungrouped_pages(pages: DataFrame, groups: DataFrame, model_pages: DataFrame) -> DataFrame:
    """Pages outside all groups; every page of a document the model returned nothing for."""
    answered = model_pages.select("doc_id").distinct()
    taken = grouped_pages(groups).join(answered, "doc_id", "left_semi").select("doc_id", "page_no")
    return pages.join(taken, PAGE, "left_anti")


def merge_pages(model_pages: DataFrame, plain_pages: DataFrame) -> DataFrame:
    """One row per page: the last model page, else the plain one.  ``seq`` orders model pages of one number."""
    body = [c for c in plain_pages.columns if c not in PAGE]
    every = model_pages.select(*PAGE, F.lit(1).alias("_src"), "seq", *body).unionByName(
        plain_pages.select(*PAGE, F.lit(0).alias("_src"), F.lit(0).cast("long").alias("seq"), *body)
    )
    best = every.groupBy(*PAGE).agg(F.max(F.struct("_src", "seq", *body)).alias("b"))
    return best.select(*PAGE, F.when(F.col("b._src") == 1, "model").otherwise("plain").alias("origin"), *[F.col(f"b.{c}").alias(c) for c in body])


def native_targets(metrics: DataFrame, groups: DataFrame) -> DataFrame:
    """Pages to search for tables natively: the grouped ones, or those with any number in documents without groups."""
    g = grouped_pages(groups).select("doc_id", "page_no")
    rest = metrics.filter("number_count > 0").join(groups.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "page_no")
    return g.unionByName(rest)


def merge_tables(native: DataFrame, model: DataFrame) -> DataFrame:
    """Native and model tables together; ``native_targets`` has decided where native tables are looked for."""
    return native.withColumn("origin", F.lit("native")).unionByName(model.withColumn("origin", F.lit("model")), allowMissingColumns=True)


def group_payload(pages: DataFrame, groups: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Ordered (page, text) array of each group (at most five pages) with words and the length of the section texts.

    ``max_chars`` cuts every section text for its length, if given.
    """
    d = pages.join(grouped_pages(groups), PAGE)
    item = F.struct((F.col("page_no") + 1).alias("page_number"), F.col("content").alias("text"))
    return d.groupBy("doc_id", "first_page").agg(
        F.sort_array(F.collect_list(item)).alias("payload"),
        F.sum(word_count(F.col("content"))).alias("word_count"),
        F.sum(F.length("content") if max_chars is None else F.length(F.substring("content", 1, max_chars))).alias("section_chars"),
    )


def group_summary(groups: DataFrame, sections: DataFrame, numbers: DataFrame, tables: DataFrame) -> DataFrame:
    """Sections, numbers and tables per group."""
    g = grouped_pages(groups)
    count = lambda df, name: df.join(g, PAGE).groupBy("doc_id", "first_page").agg(F.count(F.lit(1)).alias(name))
    out = groups.select("doc_id", "first_page")
    for df, name in ((sections, "text_sections"), (numbers, "numbers_found"), (tables, "tables_extracted")):
        out = out.join(count(df, name), ["doc_id", "first_page"], "left")
    return out.fillna(0)


# ---- complexity and routing decisions ---------------------------------------------


def capped(x: Column, top: float) -> Column:
    return F.least(x, F.lit(top))


def _score(d: DataFrame) -> DataFrame:
    parts = ["merged_cell_complexity", "header_complexity", "sparsity_complexity", "column_inconsistency", "formula_complexity"]
    d = d.withColumns({p: F.round(capped(F.col(p), 1.0), 9) for p in parts})
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    return d.withColumn("complexity_score", F.round(capped(total, 1.0), 9))


def _header_part() -> Column:
    lv = F.col("header_levels")
    return F.when(lv > 2, capped((lv - 2) * 0.1, 0.15)).otherwise(0.0) + capped(F.col("header_inconsistency") * 0.1, 0.1)


def _sparse_part() -> Column:
    return F.when(F.col("sparsity") > 0.5, capped((F.col("sparsity") - 0.5) * 0.4, 0.2)).otherwise(0.0)


def sheet_facts(sheets: DataFrame, merges: DataFrame, sparsity: DataFrame, formulas: DataFrame, columns: DataFrame, levels: DataFrame) -> DataFrame:
    """All profiles of a sheet on one row; every input is already one row per sheet."""
    key = ["workbook_id", "sheet_id"]
    lv = levels.select(*key, "header_levels", F.col("inconsistency").alias("header_inconsistency"))
    d = sheets.select(*key, "name")
    for part in (merges, sparsity.drop("stored_cells"), formulas, columns, lv):
        d = d.join(part, key, "left")
    return d.fillna(0).fillna(False)


def complexity_metrics(facts: DataFrame) -> DataFrame:
    """Five capped metrics from typed profiles, their sum and the score."""
    has = (F.col("merges") > 0) & (F.col("data_cells") > 0)
    merged = F.when(has, capped(F.col("merges") / F.col("data_cells") * 3, 0.3) + F.col("complex_weight") / F.col("merges") * 0.2).otherwise(0.0)
    return _score(
        facts.withColumns(
            {
                "merged_cell_complexity": merged, "header_complexity": _header_part(), "sparsity_complexity": _sparse_part(),
                "column_inconsistency": F.col("mean_inconsistency"),
                "formula_complexity": capped(F.col("formula_ratio") * 0.5, 0.05) + capped(F.col("complex_ratio") * 0.05, 0.05),
            }
        )
    )


def complexity_metrics_meta(facts: DataFrame) -> DataFrame:
    """The variant on stored metadata: clustered sheets and inconsistent columns add a little."""
    has = (F.col("merges") > 0) & (F.col("stored_cells") > 0)
    merged = F.when(has, capped(F.col("merges") / F.col("stored_cells") * 3, 0.3) + F.col("complex_merges") / F.col("merges") * 0.2).otherwise(0.0)
    return _score(
        facts.withColumns(
            {
                "merged_cell_complexity": merged, "header_complexity": _header_part(),
                "sparsity_complexity": _sparse_part() + F.when(F.col("clustered"), 0.05).otherwise(0.0),
                "column_inconsistency": F.col("mean_early") + capped(F.col("high_early") * 0.02, 0.05),
                "formula_complexity": capped(F.col("formula_ratio") * 0.5, 0.05) + capped(F.col("complex_ratio") * 0.05, 0.05),
            }
        )
    )


def complexity_level(df: DataFrame, simple: float = 0.3, complex_: float = 0.7) -> DataFrame:
    s = F.col("complexity_score")
    return df.withColumn("complexity_level", F.when(s < simple, "simple").when(s < complex_, "moderate").otherwise("complex")).withColumn(
        "recommendation", F.when(s < simple, "traditional").when(s < complex_, "dual").otherwise("ai_first")
    )


def failure_indicators(df: DataFrame) -> DataFrame:
    tests = [
        (F.col("merged_cell_complexity") > 0.15, "complex_merged_cells"),
        (F.col("header_complexity") > 0.15, "multi_level_headers"),
        (F.col("sparsity_complexity") > 0.1, "high_data_sparsity"),
        (F.col("column_inconsistency") > 0.1, "inconsistent_column_structure"),
        (F.col("formula_complexity") > 0.05, "complex_formulas"),
        (F.col("merges") > 10, "extensive_merging"),
    ]
    return df.withColumn("failure_indicators", flags(tests))


def one_row(*parts: DataFrame) -> DataFrame:
    """Single-row aggregates side by side, put together by a union and one more aggregate."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    return every.agg(*[F.max(c).alias(c) for c in every.columns])


def flags(tests: list[tuple[Column, str | Column]]) -> Column:
    """Array of the texts whose condition holds, in the given order."""
    items = [F.when(c, F.lit(t) if isinstance(t, str) else t) for c, t in tests]
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def workbook_recommendation(df: DataFrame) -> DataFrame:
    r = F.col("recommendation")
    return df.groupBy("workbook_id").agg(
        F.when(F.bool_or(r == "ai_first"), "ai_first").when(F.bool_or(r == "dual"), "dual").otherwise("traditional").alias("recommendation")
    )


def routing_decision(df: DataFrame, available: bool = True, traditional_max: float = 0.3, primary_min: float = 0.7, budget: float = 0.10) -> DataFrame:
    s = F.col("complexity_score")
    cost = F.lit(0.03) + s * 0.05
    choice = (
        F.when(F.lit(not available) | (cost > budget) | (s < traditional_max), "traditional_only").when(s >= primary_min, "ai_primary").otherwise("dual_analysis")
    )
    return df.withColumn("estimated_cost", F.round(cost, 9)).withColumn("decision", choice)


def sheet_text(cells: DataFrame, max_rows: int | None = None) -> DataFrame:
    """Prompt lines of each sheet, one row per line in order of ``r``; a sheet is never gathered.

    With ``max_rows`` only that many rows of a sheet are kept (limited per task before
    the shuffle), and a last line tells how many follow.
    """
    from sheetloom.functions.cells import value_text

    key = ["workbook_id", "sheet_id"]
    item = F.struct("c", F.concat(F.lit("Col"), F.col("c").cast("string"), F.lit(":"), F.coalesce(value_text(), F.lit("None"))).alias("t"))
    if max_rows is not None:
        rows = cells.select(*key, "r").distinct()
        counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("total"), F.max("r").alias("r"))
        first = rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy("r"))).filter(F.col("_n") <= max_rows).drop("_n")
        cells = cells.join(first, [*key, "r"], "left_semi")
    lines = cells.groupBy(*key, "r").agg(
        F.concat(F.lit("Row "), F.col("r").cast("string"), F.lit(": "), F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["t"]), ", ")).alias("line")
    )
    if max_rows is None:
        return lines
    more = F.concat(F.lit("... ("), (F.col("total") - max_rows).cast("string"), F.lit(" more rows truncated)"))
    return lines.unionByName(counts.filter(F.col("total") > max_rows).select(*key, "r", more.alias("line")))


def token_cost(lines: DataFrame) -> DataFrame:
    """Tokens and cost of each sheet's prompt: its lines joined by line breaks."""
    size = lines.groupBy("workbook_id", "sheet_id").agg((F.sum(F.length("line") + 1) - 1).alias("size"))
    prompt = (F.floor(F.col("size") / 4) + 1000).cast("long")
    return size.withColumn("prompt_tokens", prompt).withColumn("completion_tokens", F.lit(2000)).withColumn(
        "cost_usd", F.round(prompt / 1000 * 0.003 + F.lit(2000) / 1000 * 0.015, 9)
    ).drop("size")


def threshold_advice(decisions: DataFrame, disagreements: DataFrame, traditional_max: float = 0.3, dual_min: float = 0.3, budget: float = 0.10) -> DataFrame:
    """Advice rows from corpus rates; everything is one aggregate row plus an explode."""
    n = decisions.agg(
        F.count(F.lit(1)).alias("sheets"), F.count_if(F.col("decision") != "traditional_only").alias("used"),
        F.coalesce(F.sum(F.when(F.col("decision") != "traditional_only", F.col("estimated_cost"))), F.lit(0.0)).alias("cost"),
    )
    d = one_row(n, disagreements.agg(F.count(F.lit(1)).alias("cases")))
    total = F.greatest("sheets", F.lit(1))
    usage, cost = F.col("used") / total, F.col("cost") / total

    def advice(name: str, now: float, then: Column) -> Column:
        return F.struct(F.lit(name).alias("type"), F.lit(now).alias("current_value"), F.round(then.cast("double"), 9).alias("suggested_value"))

    items = F.array(
        F.when(usage < 0.2, advice("increase_ai_usage", traditional_max, F.lit(max(0.1, traditional_max - 0.1)))),
        F.when(usage > 0.8, advice("decrease_ai_usage", dual_min, F.lit(dual_min + 0.1))),
        F.when(F.col("cases") < 2, advice("increase_dual_analysis", dual_min, F.lit(max(0.1, dual_min - 0.1)))),
        F.when(cost > 0.05, advice("cost_control", budget, F.least(cost * 0.8, F.lit(budget)))),
    )
    rates = d.select(
        F.round(usage, 9).alias("usage_rate"), F.round(cost, 9).alias("cost_per_sheet"), F.round(F.col("cases") / total, 9).alias("disagreement_rate"),
        F.explode(F.filter(items, lambda x: x.isNotNull())).alias("a"),
    )
    return rates.select("usage_rate", "cost_per_sheet", "disagreement_rate", "a.*")


def complexity_preservation(full: DataFrame, reduced: DataFrame) -> DataFrame:
    key = ["workbook_id", "sheet_id"]
    j = full.select(*key, F.col("complexity_score").alias("full_score")).join(reduced.select(*key, F.col("complexity_score").alias("reduced_score")), key)
    p = F.when(F.col("full_score") > 0, F.col("reduced_score") / F.col("full_score") * 100).otherwise(100.0)
    return j.withColumn("preserved_percent", F.round(p, 6)).withColumn("band", F.when(p < 50, "warning").when(p < 80, "caution").otherwise("good"))
