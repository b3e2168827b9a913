"""Queries of page routing and complexity scoring."""

import re

from pyspark.sql import functions as F

from sheetloom.functions import fixed
from sheetloom.operators import numbers, profiles
from sheetloom.operators import routing as op
from sheetloom.plans.ctes import SHARED, VALUE
from sheetloom.plans.registry import query
from sheetloom.schemas import PAGE, SHEET

P, S = "doc_id, page_no", "workbook_id, sheet_id"

WC = r"CAST(len(list_filter(regexp_split_to_array({0}, '\s+'), lambda q: q <> '')) AS INT)"
COUNTS = " + ".join(f"len(regexp_extract_all(content, '{p}'))" for p in fixed.NUMBERS_ROUTING)
SHARED["pg"] = ("SELECT doc_id, page_idx AS page_no, content FROM pagetext", ["pagetext"])
SHARED["pm"] = (
    f"""SELECT *, number_count / char_count * 1000.0::DOUBLE AS density, char_count / greatest(number_count, 1) AS text_ratio, CASE WHEN number_count < 3 AND number_count / char_count * 1000 < 0.5::DOUBLE THEN 'none_or_low_numbers' ELSE 'numeric_text' END AS category
 FROM (SELECT {P}, content, CAST({COUNTS} AS INT) AS number_count, CAST(greatest(length(content), 1) AS INT) AS char_count FROM pg) x""", ["pg"])
SHARED["grp"] = (
    f"""SELECT doc_id, min(page_no) AS first_page, max(page_no) AS last_page FROM (SELECT doc_id, page_no, g, (row_number() OVER (PARTITION BY doc_id, g ORDER BY page_no) - 1) // 5 AS ch FROM (
 SELECT doc_id, page_no, page_no - row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS g FROM pm WHERE category <> 'none_or_low_numbers') x) y GROUP BY doc_id, g, ch""", ["pm"])
SHARED["gp"] = ("SELECT doc_id, first_page, unnest(range(first_page, last_page + 1)) AS page_no FROM grp", ["grp"])
MODEL = "SELECT doc_id, page_idx AS page_no, page_idx * 10 AS seq, 'model ' || content AS content FROM pagetext WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, page_idx, page_idx * 10 + 1, 'again ' || content FROM pagetext WHERE doc_id % 6 = 0"
SHARED["mp"] = (MODEL, ["pagetext"])
SHARED["plain"] = (f"SELECT * FROM pg WHERE NOT EXISTS (SELECT 1 FROM gp WHERE gp.doc_id=pg.doc_id AND gp.page_no=pg.page_no AND EXISTS (SELECT 1 FROM mp WHERE mp.doc_id=pg.doc_id))", ["pg", "gp", "mp"])


def pages(t):
    return t.pagetext.withColumnRenamed("page_idx", "page_no")


def metrics(t):
    return op.page_category(op.page_metrics(pages(t)))


def groups(t):
    return op.page_groups(metrics(t))


def model_pages(t):
    return t.spark.sql(MODEL.replace("FROM pagetext", "FROM {p}"), p=t.pagetext)


def plain(t):
    return op.ungrouped_pages(pages(t), groups(t), model_pages(t))


query("page_metrics", lambda t: op.page_metrics(pages(t)).drop("content").withColumns({"density": F.round("density", 9), "text_ratio": F.round("text_ratio", 9)}), "pm",
      f"SELECT {P}, number_count, char_count, round(density, 9) AS density, round(text_ratio, 9) AS text_ratio FROM pm")
query("page_category", lambda t: metrics(t).select(*PAGE, "category"), "pm", f"SELECT {P}, category FROM pm")
query("page_groups", groups, "grp", "SELECT * FROM grp")
query("ungrouped_pages", lambda t: plain(t).select(*PAGE), "plain", f"SELECT {P} FROM plain")
query("merge_pages", lambda t: op.merge_pages(model_pages(t), plain(t)), "mp plain",
      f"""SELECT {P}, CASE WHEN src = 1 THEN 'model' ELSE 'plain' END AS origin, content FROM (SELECT {P}, 1 AS src, seq, content FROM mp UNION ALL SELECT {P}, 0, 0, content FROM plain) x
 QUALIFY row_number() OVER (PARTITION BY {P} ORDER BY src DESC, seq DESC) = 1""")
query("merge_tables",
      lambda t: op.merge_tables(op.native_targets(metrics(t), groups(t)).withColumn("table_id", F.format_string("p%d_t1", F.col("page_no") + 1)),
                                model_pages(t).select(*PAGE, F.format_string("m%d", "seq").alias("table_id"))),
      "gp pm mp grp",
      f"""SELECT {P}, 'p' || (page_no + 1) || '_t1' AS table_id, 'native' AS origin FROM (SELECT {P} FROM gp UNION ALL SELECT {P} FROM pm WHERE number_count > 0 AND doc_id NOT IN (SELECT doc_id FROM grp)) n
 UNION ALL SELECT {P}, 'm' || seq AS table_id, 'model' FROM mp""")
query("group_payload",
      lambda t: op.group_payload(pages(t), groups(t)).select("doc_id", "first_page", "word_count", "section_chars", F.size("payload").alias("pages"),
                                                            F.array_join(F.transform("payload", lambda x: x["text"]), "\n").alias("text")),
      "pg gp",
      f"""SELECT doc_id, first_page, CAST(sum({WC.format('content')}) AS BIGINT) AS word_count, CAST(sum(length(content)) AS BIGINT) AS section_chars, CAST(count(*) AS INT) AS pages, string_agg(content, chr(10) ORDER BY page_no) AS text
 FROM pg JOIN gp USING ({P}) GROUP BY ALL""")


def page_numbers(t):
    s = pages(t).withColumn("section_no", F.lit(1))
    return numbers.numbers_fallback(s)


query("group_summary",
      lambda t: op.group_summary(groups(t), pages(t), page_numbers(t), model_pages(t).select(*PAGE)), "gp grp pg mp pm",
      f"""SELECT doc_id, first_page, coalesce(a, 0) AS text_sections, coalesce(b, 0) AS numbers_found, coalesce(c, 0) AS tables_extracted FROM (SELECT doc_id, first_page FROM grp) g
 LEFT JOIN (SELECT doc_id, first_page, count(*) AS a FROM pg JOIN gp USING ({P}) GROUP BY ALL) x USING (doc_id, first_page)
 LEFT JOIN (SELECT doc_id, first_page, CAST(nullif(sum({" + ".join(f"len(regexp_extract_all(content, '{p}'))" for p in fixed.NUMBERS_FALLBACK.values())}), 0) AS BIGINT) AS b FROM pg JOIN gp USING ({P}) GROUP BY ALL) y USING (doc_id, first_page)
 LEFT JOIN (SELECT doc_id, first_page, count(*) AS c FROM mp JOIN gp USING ({P}) GROUP BY ALL) z USING (doc_id, first_page)""")

# ---- complexity -------------------------------------------------------------------
CAP = "least({0}, {1}::DOUBLE)"


def _facts_sql(levels: str) -> str:
    return f"""SELECT {S}, coalesce(merges, 0) AS merges, coalesce(complex_merges, 0) AS complex_merges, coalesce(complex_weight, 0) AS complex_weight, data_cells, addressable, sparsity, clustered, f.stored_cells, formulas,
 coalesce(formula_ratio, 0) AS formula_ratio, coalesce(complex_ratio, 0) AS complex_ratio, coalesce(mean_inconsistency, 0) AS mean_inconsistency, coalesce(mean_early, 0) AS mean_early, coalesce(high_early, 0) AS high_early,
 coalesce(header_levels, 0) AS header_levels, coalesce(lv.inconsistency, 0) AS header_inconsistency FROM sheets LEFT JOIN mergeprof USING ({S}) LEFT JOIN sparse USING ({S}) LEFT JOIN formulas f USING ({S}) LEFT JOIN colmean USING ({S}) LEFT JOIN {levels} lv USING ({S})"""


HEAD = f"CASE WHEN header_levels > 2 THEN {CAP.format('(header_levels - 2) * 0.1::DOUBLE', 0.15)} ELSE 0 END + {CAP.format('header_inconsistency * 0.1::DOUBLE', 0.1)}"
SPARSE = f"CASE WHEN sparsity > 0.5::DOUBLE THEN {CAP.format('(sparsity - 0.5::DOUBLE) * 0.4::DOUBLE', 0.2)} ELSE 0 END"
FORM = f"{CAP.format('formula_ratio * 0.5::DOUBLE', 0.05)} + {CAP.format('complex_ratio * 0.05::DOUBLE', 0.05)}"


def _metrics_sql(facts: str, cells: str, weight: str, extra: str, cols: str) -> str:
    return f"""SELECT *, round(least(merged_cell_complexity + header_complexity + sparsity_complexity + column_inconsistency + formula_complexity, 1::DOUBLE), 9) AS complexity_score FROM (
 SELECT {S}, merges, sparsity, round(least(CASE WHEN merges > 0 AND {cells} > 0 THEN least(merges / {cells} * 3, 0.3::DOUBLE) + {weight} / merges * 0.2::DOUBLE ELSE 0 END, 1::DOUBLE), 9) AS merged_cell_complexity,
 round(least({HEAD}, 1::DOUBLE), 9) AS header_complexity, round(least({SPARSE}{extra}, 1::DOUBLE), 9) AS sparsity_complexity, round(least({cols}, 1::DOUBLE), 9) AS column_inconsistency, round(least({FORM}, 1::DOUBLE), 9) AS formula_complexity FROM {facts}) x"""


DEPS = ["sheets", "mergeprof", "sparse", "formulas", "colmean"]
SHARED["facts"] = (_facts_sql("levels"), [*DEPS, "levels"])
SHARED["facts_meta"] = (_facts_sql("levels_meta"), [*DEPS, "levels_meta"])
SHARED["cm"] = (_metrics_sql("facts", "data_cells", "complex_weight", "", "mean_inconsistency"), ["facts"])
SHARED["cmm"] = (_metrics_sql("facts_meta", "stored_cells", "complex_merges", " + CASE WHEN clustered THEN 0.05::DOUBLE ELSE 0 END", "mean_early + least(high_early * 0.02::DOUBLE, 0.05::DOUBLE)"), ["facts_meta"])
SHARED["cl"] = (
    """SELECT *, CASE WHEN complexity_score < 0.3::DOUBLE THEN 'simple' WHEN complexity_score < 0.7::DOUBLE THEN 'moderate' ELSE 'complex' END AS complexity_level,
 CASE WHEN complexity_score < 0.3::DOUBLE THEN 'traditional' WHEN complexity_score < 0.7::DOUBLE THEN 'dual' ELSE 'ai_first' END AS recommendation,
 list_filter([CASE WHEN merged_cell_complexity > 0.15::DOUBLE THEN 'complex_merged_cells' END, CASE WHEN header_complexity > 0.15::DOUBLE THEN 'multi_level_headers' END, CASE WHEN sparsity_complexity > 0.1::DOUBLE THEN 'high_data_sparsity' END,
  CASE WHEN column_inconsistency > 0.1::DOUBLE THEN 'inconsistent_column_structure' END, CASE WHEN formula_complexity > 0.05::DOUBLE THEN 'complex_formulas' END, CASE WHEN merges > 10 THEN 'extensive_merging' END], lambda q: q IS NOT NULL) AS failure_indicators FROM cm""", ["cm"])
SHARED["dec"] = (
    f"""SELECT {S}, complexity_score, round(0.03::DOUBLE + complexity_score * 0.05::DOUBLE, 9) AS estimated_cost,
 CASE WHEN 0.03::DOUBLE + complexity_score * 0.05::DOUBLE > 0.05::DOUBLE OR complexity_score < 0.3::DOUBLE THEN 'traditional_only' WHEN complexity_score >= 0.7::DOUBLE THEN 'ai_primary' ELSE 'dual_analysis' END AS decision FROM cl""", ["cl"])


def facts(t, meta=False):
    lv = (profiles.header_levels_meta if meta else profiles.header_levels)(t.cells, t.sheets)
    return op.sheet_facts(
        t.sheets, profiles.merge_profile(t.merges), profiles.sheet_sparsity(t.cells, t.sheets), profiles.formula_profile(t.cells),
        profiles.column_inconsistency(t.cells, t.sheets), lv,
    )


def scored(t):
    return op.failure_indicators(op.complexity_level(op.complexity_metrics(facts(t))))


def stored_scores(t):
    return t.stored("scores", lambda: scored(t))


def decisions(t):
    return op.routing_decision(stored_scores(t), budget=0.05)


M = ["merged_cell_complexity", "header_complexity", "sparsity_complexity", "column_inconsistency", "formula_complexity", "complexity_score"]
query("complexity_metrics", lambda t: op.complexity_metrics(facts(t)).select(*SHEET, *M), "cm", f"SELECT {S}, {', '.join(M)} FROM cm")
query("complexity_metrics_meta", lambda t: op.complexity_metrics_meta(facts(t, True)).select(*SHEET, *M), "cmm", f"SELECT {S}, {', '.join(M)} FROM cmm")
query("complexity_level", lambda t: stored_scores(t).select(*SHEET, "complexity_level", "recommendation"), "cl", f"SELECT {S}, complexity_level, recommendation FROM cl")
query("failure_indicators", lambda t: stored_scores(t).select(*SHEET, F.array_join("failure_indicators", ",").alias("failure_indicators")), "cl",
      f"SELECT {S}, array_to_string(failure_indicators, ',') AS failure_indicators FROM cl")
query("workbook_recommendation", lambda t: op.workbook_recommendation(stored_scores(t)), "cl",
      "SELECT workbook_id, CASE WHEN bool_or(recommendation='ai_first') THEN 'ai_first' WHEN bool_or(recommendation='dual') THEN 'dual' ELSE 'traditional' END AS recommendation FROM cl GROUP BY ALL")
query("routing_decision", lambda t: decisions(t).select(*SHEET, "complexity_score", "estimated_cost", "decision"), "dec", "SELECT * FROM dec")
SHARED["stext"] = (
    f"""SELECT {S}, r, 'Row ' || r || ': ' || string_agg('Col' || c || ':' || coalesce({VALUE}, 'None'), ', ' ORDER BY c) AS line FROM cells GROUP BY {S}, r""", ["cells"])
query("sheet_text", lambda t: op.sheet_text(t.cells), "stext", "SELECT * FROM stext")
query("token_cost", lambda t: op.token_cost(op.sheet_text(t.cells)), "stext",
      f"""SELECT {S}, p AS prompt_tokens, 2000 AS completion_tokens, round(p / 1000 * 0.003::DOUBLE + 2 * 0.015::DOUBLE, 9) AS cost_usd FROM (
 SELECT {S}, CAST(length(string_agg(line, chr(10))) // 4 + 1000 AS BIGINT) AS p FROM stext GROUP BY ALL) x""")


def trimmed_scores(t):
    """Scores of the trimmed data under the trimmed bounds."""
    runs = t.cells.withColumn("run_length", F.lit(1))
    kept, bounds = profiles.trim_trailing(runs), profiles.trimmed_dimensions(runs, t.sheets)
    f = op.sheet_facts(bounds, profiles.merge_profile(t.merges), profiles.sheet_sparsity(kept, bounds), profiles.formula_profile(kept),
                       profiles.column_inconsistency(kept, bounds), profiles.header_levels(kept, bounds))
    return op.complexity_metrics(f)


# The scores once more, on the cells within the extent and the bounds that follow from it.
SHARED["cells_cut"] = (f"SELECT cells.* FROM cells JOIN extent USING ({S}) WHERE r <= max_r AND c <= max_c", ["cells", "extent"])
SHARED["sheets_cut"] = (
    f"SELECT sheets.* REPLACE (coalesce(max_r, max_row) AS max_row, coalesce(max_c, max_col) AS max_col) FROM sheets LEFT JOIN extent USING ({S})", ["sheets", "extent"])
CUT = ["cm", "facts", "sparse", "axgaps", "formulas", "colmean", "coltypes", "levels", "lv", "cells", "sheets"]
for name in CUT[:-2]:
    body, needs = SHARED[name]
    SHARED[f"{name}_cut"] = (re.sub(rf"\b({'|'.join(CUT)})\b(?! AS)", r"\1_cut", body), [f"{n}_cut" if n in CUT else n for n in needs])
# Scores carry nine digits that may end in ties; the two engines break those differently, so the report shows six and four.
query("complexity_preservation",
      lambda t: op.complexity_preservation(stored_scores(t), trimmed_scores(t)).withColumns({k: F.round(k, n) for k, n in (("full_score", 6), ("reduced_score", 6), ("preserved_percent", 4))}), "cm cm_cut",
      f"""SELECT {S}, round(full_score, 6) AS full_score, round(reduced_score, 6) AS reduced_score, round(p, 4) AS preserved_percent, CASE WHEN p < 50 THEN 'warning' WHEN p < 80 THEN 'caution' ELSE 'good' END AS band FROM (
 SELECT {S}, a.complexity_score AS full_score, b.complexity_score AS reduced_score, round(CASE WHEN a.complexity_score > 0 THEN b.complexity_score / a.complexity_score * 100 ELSE 100.0::DOUBLE END, 6) AS p
 FROM cm a JOIN cm_cut b USING ({S})) x""")
