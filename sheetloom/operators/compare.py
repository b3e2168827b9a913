"""Model output ingestion and the comparison of two table detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetloom.functions import fixed
from sheetloom.operators.routing import flags, one_row
from sheetloom.schemas import SHEET

BOUND = ["start_row", "end_row", "start_col", "end_col"]
_B = "STRUCT<start_row:STRING,end_row:STRING,start_col:STRING,end_col:STRING>"
RESPONSE_SCHEMA = (
    "analysis_confidence DOUBLE, sheet_analysis STRUCT<total_tables:INT,data_density:DOUBLE,structure_complexity:STRING,recommended_processing:STRING>, "
    f"tables_detected ARRAY<STRUCT<table_id:STRING,name:STRING,boundaries:{_B},data_area:{_B},"
    "headers:STRUCT<row_headers:ARRAY<STRUCT<row:STRING,level:STRING>>,column_headers:ARRAY<STRUCT<col:STRING,level:STRING,rows:ARRAY<STRUCT<row:INT>>>>>,"
    "table_type:STRING,confidence:DOUBLE,complexity_indicators:ARRAY<STRING>,data_quality:STRUCT<completeness:DOUBLE,consistency:DOUBLE>>>"
)


def extract_json_block(responses: DataFrame) -> DataFrame:
    """Fenced JSON, else first brace to last; unreadable text becomes a ``parse_error`` row with defaults."""
    fenced = F.regexp_extract("response_text", r"(?s)```json\s*(.*?)\s*```", 1)
    braces = F.regexp_extract("response_text", r"(?s)(\{.*\})", 1)
    block = F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(braces, F.lit("")))
    d = responses.withColumn("p", F.from_json(block, RESPONSE_SCHEMA))
    ok = F.try_parse_json(block).isNotNull()  # any readable JSON is a success, whatever keys it has
    d = d.withColumn("p", F.when(ok, F.col("p")))
    sheet = F.col("p.sheet_analysis")
    return d.select(
        *SHEET,
        F.when(ok, "success").otherwise("parse_error").alias("status"),
        F.when(ok, F.coalesce("p.analysis_confidence", F.lit(0.5))).otherwise(0.0).alias("analysis_confidence"),
        F.coalesce(sheet["structure_complexity"], F.lit("unknown")).alias("structure_complexity"),
        F.coalesce(sheet["recommended_processing"], F.lit("traditional")).alias("recommended_processing"),
        F.coalesce("p.tables_detected", F.array().cast("array<" + _table_type() + ">")).alias("tables"),
    )


def _table_type() -> str:
    return RESPONSE_SCHEMA[RESPONSE_SCHEMA.index("ARRAY<STRUCT<table_id") + 6 : -1]


def validate_tables(parsed: DataFrame) -> DataFrame:
    """One row per reported table with its error, null when the boundaries are usable."""
    d = parsed.select(*SHEET, F.posexplode("tables").alias("idx", "t"))
    b = F.col("t.boundaries")
    missing = F.coalesce(*[F.when(b[k].isNull(), F.lit(f"Missing boundary field {k}")) for k in BOUND])
    n = {k: b[k].try_cast("int") for k in BOUND}
    bad = F.when(F.greatest(*[x.isNull().cast("int") for x in n.values()]) == 1, "Invalid boundary values").when(
        (n["start_row"] > n["end_row"]) | (n["start_col"] > n["end_col"]), "Invalid boundaries"
    )
    error = F.when(b.isNull(), "Missing boundaries").otherwise(F.coalesce(missing, bad))
    tid = F.coalesce("t.table_id", F.concat(F.lit("ai_table_"), F.col("idx").cast("string")))
    return d.select(*SHEET, "idx", tid.alias("table_id"), error.alias("error"), *[v.alias(k) for k, v in n.items()], "t")


def parsed_table_fields(valid: DataFrame) -> DataFrame:
    """Fields of the usable tables: defaults, clamped scores, size and header levels."""
    unit = lambda c, d: F.least(F.greatest(F.coalesce(c, F.lit(d)), F.lit(0.0)), F.lit(1.0))
    t = F.col("t")
    level = lambda hs: F.transform(hs, lambda h: F.coalesce(h["level"].try_cast("int"), F.lit(1)))
    levels = F.greatest(F.coalesce(F.array_max(level(t["headers"]["row_headers"])), F.lit(0)), F.coalesce(F.array_max(level(t["headers"]["column_headers"])), F.lit(0)))
    rows = F.transform(t["headers"]["row_headers"], lambda h: h["row"].try_cast("int"))
    more = F.flatten(F.transform(t["headers"]["column_headers"], lambda h: F.transform(h["rows"], lambda r: r["row"])))
    none = F.array().cast("array<int>")
    area = lambda k: F.coalesce(t["data_area"][k].try_cast("int"), F.col(k))
    return valid.filter(F.col("error").isNull()).select(
        *SHEET, "idx", "table_id", F.coalesce(t["name"], F.concat(F.lit("AI Table "), (F.col("idx") + 1).cast("string"))).alias("name"), *BOUND,
        area("start_row").alias("data_start_row"), area("end_row").alias("data_end_row"),
        F.coalesce(t["table_type"], F.lit("unknown")).alias("table_type"), F.round(unit(t["confidence"], 0.5), 9).alias("confidence"),
        unit(t["data_quality"]["completeness"], 0.8).alias("completeness"), unit(t["data_quality"]["consistency"], 0.8).alias("consistency"),
        (F.col("end_row") - F.col("start_row") + 1).alias("rows"), (F.col("end_col") - F.col("start_col") + 1).alias("cols"),
        ((F.col("end_row") - F.col("start_row") + 1).cast("long") * (F.col("end_col") - F.col("start_col") + 1)).alias("total_cells"),
        levels.alias("header_levels"), F.sort_array(F.array_distinct(F.concat(F.coalesce(rows, none), F.coalesce(more, none)))).alias("header_rows"),
        F.coalesce(t["complexity_indicators"], F.array().cast("array<string>")).alias("indicators"),
    )


def response_complexity(parsed: DataFrame, fields: DataFrame) -> DataFrame:
    per = fields.groupBy(*SHEET).agg(
        F.count(F.lit(1)).alias("tables"), F.count_if(F.col("header_levels") > 1).alias("multi"), F.count_if(F.col("total_cells") > 1000).alias("large"),
        F.min(F.when(F.col("header_levels") > 1, F.col("idx"))).alias("first_multi"), F.min(F.when(F.col("total_cells") > 1000, F.col("idx"))).alias("first_large"),
    )
    seen = fields.select(*SHEET, "idx", F.explode("indicators").alias("i")).groupBy(*SHEET, "i").agg(F.min("idx").alias("at"))
    # An indicator that the tables so far have already shown counts no more: headers of a table come before its indicators, its size after.
    known = F.when(F.col("i") == "multi_level_headers", F.col("at") >= F.col("first_multi")).when(F.col("i") == "large_table", F.col("at") > F.col("first_large"))
    fresh = seen.join(per.select(*SHEET, "first_multi", "first_large"), SHEET).groupBy(*SHEET).agg(F.count_if(~F.coalesce(known, F.lit(False))).alias("new"))
    d = parsed.select(*SHEET, "structure_complexity").join(per, SHEET).join(fresh, SHEET, "left").fillna(0, ["new"])
    new = F.col("new")
    structure = F.when(F.col("structure_complexity") == "complex", 0.15).when(F.col("structure_complexity") == "moderate", 0.08).otherwise(0.0)
    s = F.round(F.col("multi") * 0.1 + new * 0.05 + F.col("large") * 0.05 + structure + F.when(F.col("tables") > 3, 0.1).otherwise(0.0), 9)
    rest = parsed.select(*SHEET).join(per.select(*SHEET), SHEET, "left_anti").select(*SHEET, F.lit(0.0).alias("score"), F.lit("simple").alias("level"))
    scored = d.select(*SHEET, F.least(s, F.lit(1.0)).alias("score"), F.when(s >= 0.3, "complex").when(s >= 0.15, "moderate").otherwise("simple").alias("level"))
    return scored.unionByName(rest)


def model_regions(fields: DataFrame) -> DataFrame:
    return fields.select(
        *SHEET, F.lit("ai_analysis").alias("method"), F.col("start_row").alias("r1"), F.col("start_col").alias("c1"), F.col("end_row").alias("r2"), F.col("end_col").alias("c2"),
        (F.col("idx") + 1).cast("long").alias("table_no"), "confidence", "header_rows", "data_start_row", "data_end_row",
    )


def response_summary(parsed: DataFrame, fields: DataFrame, valid: DataFrame) -> DataFrame:
    """Per response: tables, confident tables, errors and recommendation; failed ones as zero rows with a reason."""
    per = fields.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("table_count"), F.count_if(F.col("confidence") > 0.7).alias("high_confidence_tables"))
    err = valid.filter(F.col("error").isNotNull()).groupBy(*SHEET).agg(F.count(F.lit(1)).alias("errors"))
    ok = F.col("status") == "success"
    return (
        parsed.select(*SHEET, "status", "analysis_confidence", "recommended_processing").join(per, SHEET, "left").join(err, SHEET, "left")
        .fillna(0, ["table_count", "high_confidence_tables", "errors"])
        .withColumn("errors", F.when(ok, F.col("errors")).otherwise(1)).withColumn("failure_reason", F.when(~ok, F.col("status")))
    )


# ---- comparison ----------------------------------------------------------------------


def region_iou(model: DataFrame, other: DataFrame, block: int = 256) -> DataFrame:
    """Intersection over union of the region pairs that overlap.

    Pairs meet in row blocks and count once, in the block of their first shared
    row; pairs without overlap (value 0) are never formed.
    """
    cols = ["table_no", "r1", "c1", "r2", "c2"]
    spread = F.explode(F.sequence(F.floor(F.col("r1") / block), F.floor(F.col("r2") / block))).alias("_b")
    a = model.select(*SHEET, *[F.col(c).alias(f"a_{c}") for c in cols], spread)
    b = other.select(*SHEET, *[F.col(c).alias(f"b_{c}") for c in cols], spread)
    lo = lambda k: F.greatest(f"a_{k}", f"b_{k}")
    hi = lambda k: F.least(f"a_{k}", f"b_{k}")
    j = a.join(b, [*SHEET, "_b"]).filter((F.col("_b") == F.floor(lo("r1") / block)) & (lo("r1") <= hi("r2")) & (lo("c1") <= hi("c2")))
    area = lambda r1, r2, c1, c2: (r2 - r1 + 1).cast("long") * (c2 - c1 + 1)
    own = lambda p: area(*[F.col(f"{p}_{k}") for k in ("r1", "r2", "c1", "c2")])
    shared = area(lo("r1"), hi("r2"), lo("c1"), hi("c2"))
    return j.select(*SHEET, F.col("a_table_no").alias("model_table"), F.col("b_table_no").alias("other_table"), (shared / (own("a") + own("b") - shared)).alias("iou"))


def count_compare(other: DataFrame, model: DataFrame, sheets: DataFrame) -> DataFrame:
    n = lambda df, name: df.groupBy(*SHEET).agg(F.count(F.lit(1)).alias(name))
    d = sheets.select(*SHEET).join(n(other, "traditional_count"), SHEET, "left").join(n(model, "ai_count"), SHEET, "left").fillna(0)
    t, a = F.col("traditional_count"), F.col("ai_count")
    return d.withColumns(
        {
            "count_difference": a - t, "detection_ratio": F.round(a / F.greatest(t, F.lit(1)), 9), "both_found": (t > 0) & (a > 0),
            "only_traditional": (t > 0) & (a == 0), "only_ai": (t == 0) & (a > 0), "neither_found": (t == 0) & (a == 0),
        }
    )


def boundary_summary(counts: DataFrame, iou: DataFrame) -> DataFrame:
    """Mean and maximum over all pairs (the pairs without overlap enter through the pair count) and the two bands."""
    x = F.col("iou")
    per = iou.groupBy(*SHEET).agg(F.sum(x).alias("total"), F.round(F.max(x), 9).alias("max_overlap"), F.count_if(x > 0.95).alias("exact_matches"), F.count_if((x > 0.5) & (x <= 0.95)).alias("significant_overlaps"))
    pairs = F.col("traditional_count") * F.col("ai_count")
    return (
        counts.select(*SHEET, "traditional_count", "ai_count").join(per, SHEET, "left").fillna(0)
        .withColumn("average_overlap", F.when(pairs > 0, F.round(F.col("total") / pairs, 9)).otherwise(0.0))
        .select(*SHEET, "average_overlap", "max_overlap", "exact_matches", "significant_overlaps")
    )


def best_match(counts: DataFrame, model: DataFrame, iou: DataFrame) -> DataFrame:
    """Best overlap of each model region, averaged, and the share above one half."""
    best = iou.groupBy(*SHEET, F.col("model_table").alias("table_no")).agg(F.max("iou").alias("best"))
    per = model.select(*SHEET, "table_no").join(best, [*SHEET, "table_no"], "left").fillna(0.0, ["best"]).groupBy(*SHEET).agg(
        F.avg("best").alias("mean_best"), F.count_if(F.col("best") > 0.5).alias("matched")
    )
    t, a = F.col("traditional_count"), F.col("ai_count")
    return counts.select(*SHEET, "traditional_count", "ai_count").join(per, SHEET, "left").select(
        *SHEET, F.when((t > 0) & (a > 0), F.round("mean_best", 9)).otherwise(0.0).alias("mean_best"),
        F.when((t > 0) & (a > 0), F.col("matched")).otherwise(0).alias("matched"),
        F.when((t == 0) & (a == 0), 1.0).when((t == 0) | (a == 0), 0.0).otherwise(F.round(F.col("matched") / a, 9)).alias("agreement"),
    )


def comparison_frame(counts: DataFrame, bounds: DataFrame, best: DataFrame, responses: DataFrame, complexity: DataFrame) -> DataFrame:
    """One wide row per sheet that the rules below read."""
    r = responses.select(*SHEET, F.col("analysis_confidence").alias("ai_confidence"), F.col("errors").alias("ai_errors"), F.col("recommended_processing").alias("ai_recommendation"))
    k = complexity.select(*SHEET, "complexity_score", "complexity_level", "failure_indicators", "sparsity", "merges")
    d = counts.join(bounds, SHEET).join(best, SHEET).join(r, SHEET, "left").join(k, SHEET, "left")
    d = d.fillna(0.0, ["ai_confidence"]).fillna(0, ["ai_errors"]).fillna("traditional", ["ai_recommendation"])
    score = F.when(F.col("neither_found"), 1.0).when(F.col("both_found"), F.col("average_overlap")).otherwise(0.0)
    return d.withColumn("agreement_score", score)


def recommendation_alignment(d: DataFrame) -> DataFrame:
    found, rec = F.col("traditional_count") > 0, F.col("ai_recommendation")
    s = F.col("complexity_score")
    accurate = ((rec == "traditional") & found) | (rec.isin("ai_assisted", "ai_primary") & ~found) | (rec == "dual")
    return d.withColumn("expected_recommendation", F.when(found, "traditional").otherwise("ai_assisted")).withColumns(
        {
            "aligned": rec == F.col("expected_recommendation"), "recommendation_accurate": accurate,
            "complexity_recommendation": F.when(s >= 0.7, "ai_primary").when(s >= 0.3, "dual").otherwise("traditional"),
        }
    )


def overall_agreement(d: DataFrame) -> DataFrame:
    x = F.col("agreement") * 0.4 + F.col("mean_best") * 0.3 + F.col("aligned").cast("double") * 0.3
    return recommendation_alignment(d).withColumn("overall_agreement", F.round(x, 9))


def confidence_distribution(model: DataFrame) -> DataFrame:
    c = F.col("confidence")
    return model.groupBy(*SHEET).agg(F.round(F.avg(c), 9).alias("average"), F.count_if(c > 0.7).alias("high"), F.count_if(c < 0.3).alias("low"))


def complexity_expectation(d: DataFrame) -> DataFrame:
    s, t, a = F.col("complexity_score"), F.col("traditional_count"), F.col("ai_count")
    want_t, want_a = s < 0.7, s >= 0.3
    tp = F.when((t > 0) == want_t, "as_expected").otherwise("unexpected")
    ap = F.when(((a > 0) & want_a) | ~want_a, "as_expected").otherwise("unexpected")
    return d.withColumns(
        {
            "traditional_performance": tp, "ai_performance": ap, "actual_ai_advantage": (a > 0) & (a >= t),
            "complexity_alignment": F.when((tp == "as_expected") & (ap == "as_expected"), 1.0).otherwise(0.5),
        }
    )


def winner(d: DataFrame) -> DataFrame:
    t, a, g, c = (F.col(x) for x in ("traditional_count", "ai_count", "agreement_score", "ai_confidence"))
    return d.withColumn(
        "winner",
        F.when((t == 0) & (a == 0), "tie_no_detection").when(a == 0, "traditional").when(t == 0, "ai")
        .when((g > 0.7) & (c > 0.7), "tie_both_good").when(c > 0.7, "ai").when(g > 0.5, "tie_similar").otherwise("unclear"),
    )


def failure_causes(d: DataFrame) -> DataFrame:
    t, a = F.col("traditional_count") == 0, F.col("ai_count") == 0
    causes = F.concat(
        F.transform("failure_indicators", lambda x: F.concat(F.lit("complexity_"), x)),
        flags([(F.col("sparsity") > 0.7, "high_sparsity"), (F.col("merges") > 10, "many_merged_cells")]),
    )
    return d.withColumns({"traditional_failed": t, "ai_failed": a, "both_failed": t & a, "only_traditional_failed": t & ~a, "only_ai_failed": ~t & a, "potential_causes": causes})


def test_case_value(d: DataFrame) -> DataFrame:
    g, c = F.col("agreement_score"), F.col("ai_confidence")
    tests = [(F.col("count_difference") != 0, "table_count_disagreement"), (g < 0.5, "low_agreement"), ((c > 0.7) & (g < 0.5), "confident_disagreement")]
    p = F.round(sum((F.when(t[0], w).otherwise(0.0) for t, w in zip(tests, (0.3, 0.3, 0.4))), F.lit(0.0)), 9)
    kind = F.when(p > 0.7, "high_value").when(p > 0.4, "moderate_value").when(p > 0.1, "low_value").otherwise("none")
    return d.withColumns({"potential_score": p, "test_case_type": kind, "reasons": flags(tests), "recommended": p > 0.4})


def insights(d: DataFrame) -> DataFrame:
    t, a, g, c, s = (F.col(x) for x in ("traditional_count", "ai_count", "agreement_score", "ai_confidence", "complexity_score"))
    lv = F.col("complexity_level")
    says = flags(
        [
            (a > t, F.concat(F.lit("AI detected "), (a - t).cast("string"), F.lit(" more tables than traditional methods"))),
            (t > a, F.concat(F.lit("Traditional methods detected "), (t - a).cast("string"), F.lit(" more tables than AI"))),
            (g > 0.8, "High agreement between methods suggests reliable detection"),
            (g < 0.3, "Low agreement suggests one method may be failing or detecting different structures"),
            (c > 0.8, "AI analysis has high confidence in its results"),
            (c < 0.3, "AI analysis has low confidence - results may be unreliable"),
            ((lv == "complex") & (t == 0), "Complex structure likely caused traditional method failure"),
            ((lv == "simple") & (a == 0), "AI may have over-complicated a simple structure"),
        ]
    )
    advice = flags(
        [
            (c < 0.5, "Consider adjusting AI confidence thresholds"),
            ((s > 0.5) & (g < 0.3), "Consider lowering complexity threshold for AI activation"),
            ((s < 0.3) & (c < 0.7), "Consider raising complexity threshold to avoid unnecessary AI calls"),
            (F.col("average_overlap") < 0.5, "Consider improving boundary detection algorithms"),
        ]
    )
    return d.withColumns({"insights": says, "tuning": advice})


def corpus_insights(compared: DataFrame, decisions: DataFrame, ai_enabled: bool = True) -> DataFrame:
    """One row of corpus counts with insights and advice, from two aggregates; ``compared`` has winner and agreement_score, sheets that are not routed to traditional methods alone count as analysed."""
    used = F.col("decision") != "traditional_only"
    n = decisions.agg(
        F.count(F.lit(1)).alias("sheets"), F.count_if(used).alias("analyses"),
        F.round(F.coalesce(F.sum(F.when(used, F.col("estimated_cost"))), F.lit(0.0)), 6).alias("cost"),
    )
    ai, traditional = F.col("winner").contains("ai"), F.col("winner").contains("traditional")
    c = compared.agg(
        F.count_if(F.col("agreement_score") > 0.7).alias("agreements"), F.count_if(F.col("agreement_score") < 0.3).alias("disagreements"),
        F.count_if(ai).alias("ai_better"), F.count_if(traditional & ~ai).alias("traditional_better"),
    )
    share, each = F.col("analyses") / F.greatest("sheets", F.lit(1)), F.col("cost") / F.greatest("analyses", F.lit(1))
    on = F.lit(ai_enabled)
    found = {
        "many_analyses": on & (share > 0.5), "few_analyses": on & (share < 0.2), "disagreement": F.col("disagreements") > F.col("agreements"),
        "cost": on & (each > 0.1), "ai_better": F.col("ai_better") > F.col("traditional_better"), "traditional_better": F.col("traditional_better") > F.col("ai_better"),
    }
    todo = {"no_ai": ~on, "disagreements": on & (F.col("disagreements") > 3), "few_sheets": F.col("sheets") < 10}
    return one_row(n, c).withColumns(
        {
            "insights": flags([(found[k], text) for k, text in fixed.CORPUS_INSIGHTS.items()]),
            "advice": flags([(todo[k], text) for k, text in fixed.CORPUS_ADVICE.items()]),
        }
    )


def comparison_rollup(d: DataFrame, order: list[str], last: int = 10) -> DataFrame:
    """Win rates over all comparisons and the mean agreement of the latest ones (a top-k, not a sort of everything)."""
    w = winner(d)
    rates = w.agg(
        F.count(F.lit(1)).alias("total"), F.round(F.avg(F.col("winner").contains("ai").cast("double")), 9).alias("ai_rate"),
        F.round(F.avg((~F.col("winner").contains("ai") & F.col("winner").contains("traditional")).cast("double")), 9).alias("traditional_rate"),
        F.round(F.avg((~F.col("winner").contains("ai") & F.col("winner").contains("tie")).cast("double")), 9).alias("agreement_rate"),
    )
    recent = d.orderBy(*[F.desc(c) for c in order]).limit(last).agg(F.round(F.avg("agreement_score"), 9).alias("recent_agreement"))
    return one_row(rates, recent)


def disagreement_cases(d: DataFrame, limit: float = 0.3) -> DataFrame:
    return winner(d.filter(F.col("agreement_score") < limit)).select(
        *SHEET, "complexity_score", "agreement_score", "traditional_count", "ai_count", "ai_confidence", "winner"
    )


def quality_compare(d: DataFrame) -> DataFrame:
    t = F.col("traditional_count") > 0
    trust = F.when(t, 0.8).otherwise(0.0)
    return d.select(
        *SHEET, trust.alias("traditional_confidence"), "ai_confidence", F.round(F.col("ai_confidence") - trust, 9).alias("confidence_difference"),
        F.lit(False).alias("traditional_has_errors"), (F.col("ai_errors") > 0).alias("ai_has_errors"),
        F.when(t, 0.8).otherwise(0.2).alias("traditional_completeness"), F.col("ai_confidence").alias("ai_completeness"),
    )
