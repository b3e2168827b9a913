"""Queries of model-output ingestion and detector comparison."""

from pyspark.sql import functions as F

from sheetloom.functions import fixed
from sheetloom.operators import compare as op
from sheetloom.operators import routing
from sheetloom.plans import headers
from sheetloom.plans.ctes import SHARED
from sheetloom.plans.registry import query
from sheetloom.plans.routing import decisions, stored_scores
from sheetloom.schemas import SHEET

S = "workbook_id, sheet_id"

SHARED["parsed"] = (
    f"""SELECT {S}, CASE WHEN j IS NULL THEN 'parse_error' ELSE 'success' END AS status, CASE WHEN j IS NULL THEN 0 ELSE coalesce(CAST(json_extract_string(j, '$.analysis_confidence') AS DOUBLE), 0.5::DOUBLE) END AS analysis_confidence,
 coalesce(json_extract_string(j, '$.sheet_analysis.structure_complexity'), 'unknown') AS structure_complexity, coalesce(json_extract_string(j, '$.sheet_analysis.recommended_processing'), 'traditional') AS recommended_processing, j
 FROM (SELECT {S}, CAST(nullif(regexp_extract(response_text, '(?s)```json\\s*(.*?)\\s*```', 1), '') AS JSON) AS j FROM responses) x""", ["responses"])
SHARED["vt"] = (
    f"""SELECT *, CASE WHEN start_row IS NULL THEN 'Missing boundary field start_row' WHEN end_row IS NULL THEN 'Missing boundary field end_row' WHEN start_row > end_row OR start_col > end_col THEN 'Invalid boundaries' END AS error FROM (
 SELECT {S}, idx, json_extract_string(t, '$.table_id') AS table_id, CAST(json_extract_string(t, '$.boundaries.start_row') AS INT) AS start_row, CAST(json_extract_string(t, '$.boundaries.end_row') AS INT) AS end_row,
  CAST(json_extract_string(t, '$.boundaries.start_col') AS INT) AS start_col, CAST(json_extract_string(t, '$.boundaries.end_col') AS INT) AS end_col, t FROM (
  SELECT {S}, unnest(ts) AS t, CAST(unnest(range(0, len(ts))) AS INT) AS idx FROM (SELECT {S}, CAST(json_extract(j, '$.tables_detected[*]') AS JSON[]) AS ts FROM parsed WHERE j IS NOT NULL) a) b) c""", ["parsed"])
SHARED["fields"] = (
    f"""SELECT {S}, idx, table_id, coalesce(json_extract_string(t, '$.name'), 'AI Table ' || (idx + 1)) AS name, start_row, end_row, start_col, end_col, start_row AS data_start_row, end_row AS data_end_row, 'unknown' AS table_type,
 round(least(greatest(coalesce(CAST(json_extract_string(t, '$.confidence') AS DOUBLE), 0.5::DOUBLE), 0::DOUBLE), 1::DOUBLE), 9) AS confidence, 0.8::DOUBLE AS completeness, 0.8::DOUBLE AS consistency,
 end_row - start_row + 1 AS rows, end_col - start_col + 1 AS cols, CAST((end_row - start_row + 1) * (end_col - start_col + 1) AS BIGINT) AS total_cells,
 CASE WHEN idx = 0 THEN CAST(1 + sheet_id % 2 AS INT) ELSE 0 END AS header_levels, CASE WHEN idx = 0 THEN start_row || ',' || (start_row + 1) ELSE '' END AS header_rows,
 CASE WHEN idx = 0 THEN CASE WHEN sheet_id % 2 = 0 THEN 2 ELSE 1 END ELSE 0 END AS kinds FROM vt WHERE error IS NULL""", ["vt"])
SHARED["rsum"] = (
    f"""SELECT {S}, status, analysis_confidence, recommended_processing, coalesce(a, 0) AS table_count, coalesce(h, 0) AS high_confidence_tables, CASE WHEN status='success' THEN coalesce(e, 0) ELSE 1 END AS errors, CASE WHEN status<>'success' THEN status END AS failure_reason
 FROM parsed LEFT JOIN (SELECT {S}, count(*) AS a, count(*) FILTER (confidence > 0.7::DOUBLE) AS h FROM fields GROUP BY ALL) x USING ({S}) LEFT JOIN (SELECT {S}, count(*) AS e FROM vt WHERE error IS NOT NULL GROUP BY ALL) y USING ({S})""", ["parsed", "fields", "vt"])
SHARED["iou"] = (
    f"""SELECT * FROM (SELECT {S}, CAST(m.idx + 1 AS BIGINT) AS model_table, d.table_no AS other_table,
 CASE WHEN greatest(start_row, r1) <= least(end_row, r2) AND greatest(start_col, c1) <= least(end_col, c2) THEN (least(end_row, r2) - greatest(start_row, r1) + 1) * (least(end_col, c2) - greatest(start_col, c1) + 1) ELSE 0 END AS sh,
 (end_row - start_row + 1) * (end_col - start_col + 1) + (r2 - r1 + 1) * (c2 - c1 + 1) AS both_area, sh / (both_area - sh) AS iou FROM fields m JOIN detected d USING ({S})) x""", ["fields", "detected"])
SHARED["cc"] = (
    f"""SELECT {S}, t AS traditional_count, a AS ai_count, a - t AS count_difference, round(a / greatest(t, 1), 9) AS detection_ratio, t > 0 AND a > 0 AS both_found, t > 0 AND a = 0 AS only_traditional, t = 0 AND a > 0 AS only_ai, t = 0 AND a = 0 AS neither_found FROM (
 SELECT {S}, coalesce(t, 0) AS t, coalesce(a, 0) AS a FROM sheets LEFT JOIN (SELECT {S}, count(*) AS t FROM detected GROUP BY ALL) x USING ({S}) LEFT JOIN (SELECT {S}, count(*) AS a FROM fields GROUP BY ALL) y USING ({S})) z""", ["sheets", "detected", "fields"])
SHARED["bs"] = (
    f"""SELECT {S}, coalesce(round(avg(iou), 9), 0) AS average_overlap, coalesce(round(max(iou), 9), 0) AS max_overlap, count(*) FILTER (iou > 0.95::DOUBLE) AS exact_matches, count(*) FILTER (iou > 0.5::DOUBLE AND iou <= 0.95::DOUBLE) AS significant_overlaps FROM sheets LEFT JOIN iou USING ({S}) GROUP BY ALL""", ["sheets", "iou"])
SHARED["bm"] = (
    f"""SELECT {S}, CASE WHEN both_found THEN round(mb, 9) ELSE 0 END AS mean_best, CASE WHEN both_found THEN mt ELSE 0 END AS matched, CASE WHEN neither_found THEN 1 WHEN both_found THEN round(mt / ai_count, 9) ELSE 0::DOUBLE END AS agreement FROM cc
 LEFT JOIN (SELECT {S}, avg(b) AS mb, count(*) FILTER (b > 0.5::DOUBLE) AS mt FROM (SELECT {S}, model_table, max(iou) AS b FROM iou GROUP BY ALL) q GROUP BY ALL) w USING ({S})""", ["cc", "iou"])
SHARED["cmp"] = (
    f"""SELECT cc.*, average_overlap, max_overlap, mean_best, matched, agreement, coalesce(analysis_confidence, 0) AS ai_confidence, coalesce(errors, 0) AS ai_errors, coalesce(recommended_processing, 'traditional') AS ai_recommendation,
 complexity_score, complexity_level, failure_indicators, sparsity, merges, CASE WHEN neither_found THEN 1 WHEN both_found THEN average_overlap ELSE 0::DOUBLE END AS agreement_score
 FROM cc JOIN bs USING ({S}) JOIN bm USING ({S}) LEFT JOIN rsum USING ({S}) LEFT JOIN cl USING ({S})""", ["cc", "bs", "bm", "rsum", "cl"])
WIN = """CASE WHEN neither_found THEN 'tie_no_detection' WHEN ai_count = 0 THEN 'traditional' WHEN traditional_count = 0 THEN 'ai' WHEN agreement_score > 0.7::DOUBLE AND ai_confidence > 0.7::DOUBLE THEN 'tie_both_good'
 WHEN ai_confidence > 0.7::DOUBLE THEN 'ai' WHEN agreement_score > 0.5::DOUBLE THEN 'tie_similar' ELSE 'unclear' END"""
SHARED["win"] = (f"SELECT *, {WIN} AS winner FROM cmp", ["cmp"])


def parsed(t):
    return op.extract_json_block(t.responses)


def valid(t):
    return op.validate_tables(parsed(t))


def fields(t):
    return op.parsed_table_fields(valid(t))


def model(t):
    return t.stored("model_regions", lambda: op.model_regions(fields(t)))


def counts(t):
    return op.count_compare(headers.regions(t), model(t), t.sheets)


def iou(t):
    return op.region_iou(model(t), headers.regions(t))


def frame(t):
    def build():
        c = counts(t)
        return op.comparison_frame(c, op.boundary_summary(c, iou(t)), op.best_match(c, model(t), iou(t)), op.response_summary(parsed(t), fields(t), valid(t)), stored_scores(t))

    return t.stored("comparison", build)


query("extract_json_block", lambda t: parsed(t).withColumn("tables", F.size("tables")), "parsed",
      f"SELECT {S}, status, analysis_confidence, structure_complexity, recommended_processing, CAST(coalesce(json_array_length(j, '$.tables_detected'), 0) AS INT) AS tables FROM parsed")
query("validate_tables", lambda t: valid(t).drop("t"), "vt", f"SELECT {S}, idx, table_id, start_row, end_row, start_col, end_col, error FROM vt")
query("parsed_table_fields", lambda t: fields(t).drop("indicators").withColumn("header_rows", F.array_join(F.transform("header_rows", lambda x: x.cast("string")), ",")), "fields", "SELECT * EXCLUDE (kinds) FROM fields")
query("response_complexity", lambda t: op.response_complexity(parsed(t), fields(t)), "parsed fields",
      f"""SELECT {S}, score, CASE WHEN n = 0 THEN 'simple' WHEN score >= 0.3::DOUBLE THEN 'complex' WHEN score >= 0.15::DOUBLE THEN 'moderate' ELSE 'simple' END AS level FROM (
 SELECT {S}, coalesce(n, 0) AS n, CASE WHEN coalesce(n, 0) = 0 THEN 0::DOUBLE ELSE round(m * 0.1::DOUBLE + k * 0.05::DOUBLE + l * 0.05::DOUBLE + CASE structure_complexity WHEN 'complex' THEN 0.15::DOUBLE WHEN 'moderate' THEN 0.08::DOUBLE ELSE 0 END, 9) END AS score
 FROM parsed LEFT JOIN (SELECT {S}, count(*) AS n, count(*) FILTER (header_levels > 1) AS m, max(kinds) AS k, count(*) FILTER (total_cells > 1000) AS l FROM fields GROUP BY ALL) f USING ({S})) x""")
query("model_regions", lambda t: op.model_regions(fields(t)).withColumn("header_rows", F.array_join(F.transform("header_rows", lambda x: x.cast("string")), ",")), "fields",
      f"SELECT {S}, 'ai_analysis' AS method, start_row AS r1, start_col AS c1, end_row AS r2, end_col AS c2, CAST(idx + 1 AS BIGINT) AS table_no, confidence, header_rows, data_start_row, data_end_row FROM fields")
query("response_summary", lambda t: op.response_summary(parsed(t), fields(t), valid(t)), "rsum", "SELECT * FROM rsum")
query("count_compare", counts, "cc", "SELECT * FROM cc")
query("region_iou", lambda t: iou(t).withColumn("iou", F.round("iou", 9)), "iou", f"SELECT {S}, model_table, other_table, round(iou, 9) AS iou FROM iou WHERE sh > 0")
query("boundary_summary", lambda t: op.boundary_summary(counts(t), iou(t)), "bs", "SELECT * FROM bs")
query("best_match", lambda t: op.best_match(counts(t), model(t), iou(t)), "bm", "SELECT * FROM bm")
ALIGN = "ai_recommendation = CASE WHEN traditional_count > 0 THEN 'traditional' ELSE 'ai_assisted' END"
query("recommendation_alignment", lambda t: op.recommendation_alignment(frame(t)).select(*SHEET, "expected_recommendation", "aligned", "recommendation_accurate", "complexity_recommendation"), "cmp",
      f"""SELECT {S}, CASE WHEN traditional_count > 0 THEN 'traditional' ELSE 'ai_assisted' END AS expected_recommendation, {ALIGN} AS aligned,
 (ai_recommendation = 'traditional' AND traditional_count > 0) OR (ai_recommendation IN ('ai_assisted','ai_primary') AND traditional_count = 0) OR ai_recommendation = 'dual' AS recommendation_accurate,
 CASE WHEN complexity_score >= 0.7::DOUBLE THEN 'ai_primary' WHEN complexity_score >= 0.3::DOUBLE THEN 'dual' ELSE 'traditional' END AS complexity_recommendation FROM cmp""")
query("overall_agreement", lambda t: op.overall_agreement(frame(t)).select(*SHEET, "overall_agreement"), "cmp",
      f"SELECT {S}, round(agreement * 0.4::DOUBLE + mean_best * 0.3::DOUBLE + CASE WHEN {ALIGN} THEN 0.3::DOUBLE ELSE 0 END, 9) AS overall_agreement FROM cmp")
query("confidence_distribution", lambda t: op.confidence_distribution(model(t)), "fields",
      f"SELECT {S}, round(avg(confidence), 9) AS average, count(*) FILTER (confidence > 0.7::DOUBLE) AS high, count(*) FILTER (confidence < 0.3::DOUBLE) AS low FROM fields GROUP BY ALL")
query("complexity_expectation", lambda t: op.complexity_expectation(frame(t)).select(*SHEET, "traditional_performance", "ai_performance", "actual_ai_advantage", "complexity_alignment"), "cmp",
      f"""SELECT *, CASE WHEN traditional_performance = 'as_expected' AND ai_performance = 'as_expected' THEN 1::DOUBLE ELSE 0.5::DOUBLE END AS complexity_alignment FROM (SELECT {S},
 CASE WHEN (traditional_count > 0) = (complexity_score < 0.7::DOUBLE) THEN 'as_expected' ELSE 'unexpected' END AS traditional_performance,
 CASE WHEN complexity_score < 0.3::DOUBLE OR ai_count > 0 THEN 'as_expected' ELSE 'unexpected' END AS ai_performance, ai_count > 0 AND ai_count >= traditional_count AS actual_ai_advantage FROM cmp) x""")
query("winner", lambda t: op.winner(frame(t)).select(*SHEET, "winner"), "win", f"SELECT {S}, winner FROM win")
query("failure_causes", lambda t: op.failure_causes(frame(t)).select(*SHEET, "traditional_failed", "ai_failed", "both_failed", "only_traditional_failed", "only_ai_failed", F.array_join("potential_causes", ",").alias("potential_causes")), "cmp",
      f"""SELECT {S}, traditional_count = 0 AS traditional_failed, ai_count = 0 AS ai_failed, neither_found AS both_failed, only_ai AS only_traditional_failed, only_traditional AS only_ai_failed,
 array_to_string(list_concat(list_transform(failure_indicators, lambda q: 'complexity_' || q), list_filter([CASE WHEN sparsity > 0.7::DOUBLE THEN 'high_sparsity' END, CASE WHEN merges > 10 THEN 'many_merged_cells' END], lambda q: q IS NOT NULL)), ',') AS potential_causes FROM cmp""")
query("test_case_value", lambda t: op.test_case_value(frame(t)).select(*SHEET, "potential_score", "test_case_type", F.array_join("reasons", ",").alias("reasons"), "recommended"), "cmp",
      f"""SELECT {S}, potential_score, CASE WHEN potential_score > 0.7::DOUBLE THEN 'high_value' WHEN potential_score > 0.4::DOUBLE THEN 'moderate_value' WHEN potential_score > 0.1::DOUBLE THEN 'low_value' ELSE 'none' END AS test_case_type, reasons, potential_score > 0.4::DOUBLE AS recommended FROM (
 SELECT {S}, round(CASE WHEN a THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN b THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN c THEN 0.4::DOUBLE ELSE 0 END, 9) AS potential_score,
 array_to_string(list_filter([CASE WHEN a THEN 'table_count_disagreement' END, CASE WHEN b THEN 'low_agreement' END, CASE WHEN c THEN 'confident_disagreement' END], lambda q: q IS NOT NULL), ',') AS reasons FROM (
 SELECT {S}, count_difference <> 0 AS a, agreement_score < 0.5::DOUBLE AS b, ai_confidence > 0.7::DOUBLE AND agreement_score < 0.5::DOUBLE AS c FROM cmp) x) y""")
query("insights", lambda t: op.insights(frame(t)).select(*SHEET, F.array_join("insights", "; ").alias("insights"), F.array_join("tuning", "; ").alias("tuning")), "cmp",
      f"""SELECT {S}, array_to_string(list_filter([CASE WHEN ai_count > traditional_count THEN 'AI detected ' || (ai_count - traditional_count) || ' more tables than traditional methods' END,
 CASE WHEN traditional_count > ai_count THEN 'Traditional methods detected ' || (traditional_count - ai_count) || ' more tables than AI' END,
 CASE WHEN agreement_score > 0.8::DOUBLE THEN 'High agreement between methods suggests reliable detection' END, CASE WHEN agreement_score < 0.3::DOUBLE THEN 'Low agreement suggests one method may be failing or detecting different structures' END,
 CASE WHEN ai_confidence > 0.8::DOUBLE THEN 'AI analysis has high confidence in its results' END, CASE WHEN ai_confidence < 0.3::DOUBLE THEN 'AI analysis has low confidence - results may be unreliable' END,
 CASE WHEN complexity_level = 'complex' AND traditional_count = 0 THEN 'Complex structure likely caused traditional method failure' END, CASE WHEN complexity_level = 'simple' AND ai_count = 0 THEN 'AI may have over-complicated a simple structure' END], lambda q: q IS NOT NULL), '; ') AS insights,
 array_to_string(list_filter([CASE WHEN ai_confidence < 0.5::DOUBLE THEN 'Consider adjusting AI confidence thresholds' END, CASE WHEN complexity_score > 0.5::DOUBLE AND agreement_score < 0.3::DOUBLE THEN 'Consider lowering complexity threshold for AI activation' END,
 CASE WHEN complexity_score < 0.3::DOUBLE AND ai_confidence < 0.7::DOUBLE THEN 'Consider raising complexity threshold to avoid unnecessary AI calls' END, CASE WHEN average_overlap < 0.5::DOUBLE THEN 'Consider improving boundary detection algorithms' END], lambda q: q IS NOT NULL), '; ') AS tuning FROM cmp""")
CI, CA = fixed.CORPUS_INSIGHTS, fixed.CORPUS_ADVICE
query("corpus_insights", lambda t: op.corpus_insights(op.winner(frame(t)), decisions(t)).withColumns({"insights": F.array_join("insights", "; "), "advice": F.array_join("advice", "; ")}), "dec win",
      f"""SELECT *, array_to_string(list_filter([CASE WHEN analyses / greatest(sheets, 1) > 0.5::DOUBLE THEN '{CI["many_analyses"]}' END, CASE WHEN analyses / greatest(sheets, 1) < 0.2::DOUBLE THEN '{CI["few_analyses"]}' END,
 CASE WHEN disagreements > agreements THEN '{CI["disagreement"]}' END, CASE WHEN cost / greatest(analyses, 1) > 0.1::DOUBLE THEN '{CI["cost"]}' END,
 CASE WHEN ai_better > traditional_better THEN '{CI["ai_better"]}' END, CASE WHEN traditional_better > ai_better THEN '{CI["traditional_better"]}' END], lambda q: q IS NOT NULL), '; ') AS insights,
 array_to_string(list_filter([CASE WHEN disagreements > 3 THEN '{CA["disagreements"]}' END, CASE WHEN sheets < 10 THEN '{CA["few_sheets"]}' END], lambda q: q IS NOT NULL), '; ') AS advice FROM
 (SELECT count(*) AS sheets, count(*) FILTER (decision <> 'traditional_only') AS analyses, round(coalesce(sum(estimated_cost) FILTER (decision <> 'traditional_only'), 0), 6) AS cost FROM dec) a,
 (SELECT count(*) FILTER (agreement_score > 0.7::DOUBLE) AS agreements, count(*) FILTER (agreement_score < 0.3::DOUBLE) AS disagreements, count(*) FILTER (contains(winner, 'ai')) AS ai_better,
  count(*) FILTER (contains(winner, 'traditional') AND NOT contains(winner, 'ai')) AS traditional_better FROM win) b""")
query("comparison_rollup", lambda t: op.comparison_rollup(frame(t), SHEET), "win",
      f"""SELECT count(*) AS total, round(avg(CAST(contains(winner, 'ai') AS INT)), 9) AS ai_rate, round(avg(CAST(contains(winner, 'traditional') AND NOT contains(winner, 'ai') AS INT)), 9) AS traditional_rate,
 round(avg(CAST(contains(winner, 'tie') AND NOT contains(winner, 'ai') AS INT)), 9) AS agreement_rate, (SELECT round(avg(agreement_score), 9) FROM (SELECT agreement_score FROM win ORDER BY workbook_id DESC, sheet_id DESC LIMIT 10) q) AS recent_agreement FROM win""")
query("disagreement_cases", lambda t: op.disagreement_cases(frame(t)), "win",
      f"SELECT {S}, complexity_score, agreement_score, traditional_count, ai_count, ai_confidence, winner FROM win WHERE agreement_score < 0.3::DOUBLE")
query("quality_compare", lambda t: op.quality_compare(frame(t)), "cmp",
      f"""SELECT {S}, c AS traditional_confidence, ai_confidence, round(ai_confidence - c, 9) AS confidence_difference, false AS traditional_has_errors, ai_errors > 0 AS ai_has_errors, CASE WHEN c > 0 THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END AS traditional_completeness, ai_confidence AS ai_completeness
 FROM (SELECT *, CASE WHEN traditional_count > 0 THEN 0.8::DOUBLE ELSE 0 END AS c FROM cmp) x""")
query("threshold_advice", lambda t: routing.threshold_advice(decisions(t), op.disagreement_cases(frame(t))), "dec win",
      """WITH r AS (SELECT count(*) AS n, count(*) FILTER (decision <> 'traditional_only') AS u, coalesce(sum(estimated_cost) FILTER (decision <> 'traditional_only'), 0) AS k, (SELECT count(*) FROM win WHERE agreement_score < 0.3::DOUBLE) AS d FROM dec),
 q AS (SELECT u / n AS usage, k / n AS cost, d / n AS dis, d FROM r)
 SELECT round(usage, 9) AS usage_rate, round(cost, 9) AS cost_per_sheet, round(dis, 9) AS disagreement_rate, type, current_value, round(suggested_value, 9) AS suggested_value FROM q JOIN LATERAL (
 SELECT 'increase_ai_usage' AS type, 0.3::DOUBLE AS current_value, 0.2::DOUBLE AS suggested_value, usage < 0.2::DOUBLE AS ok UNION ALL SELECT 'decrease_ai_usage', 0.3::DOUBLE, 0.4::DOUBLE, usage > 0.8::DOUBLE
 UNION ALL SELECT 'increase_dual_analysis', 0.3::DOUBLE, 0.2::DOUBLE, d < 2 UNION ALL SELECT 'cost_control', 0.1::DOUBLE, least(cost * 0.8::DOUBLE, 0.1::DOUBLE), cost > 0.05::DOUBLE) a ON ok""")
