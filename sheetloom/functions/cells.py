"""Scalar column functions on typed cells and on A1 references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheetloom.functions import fixed


def is_number(vtype: str = "vtype") -> Column:
    """Numeric in the sense of the row tests: booleans count as numbers there."""
    return F.col(vtype).isin("number", "boolean")


def is_text(vtype: str = "vtype") -> Column:
    return F.col(vtype).isin("string", "date", "error")


def number_text(x: Column) -> Column:
    """Whole numbers without a fraction part, others as Spark prints doubles."""
    whole = (x == F.floor(x)) & (F.abs(x) < F.lit(1e15))
    return F.when(whole, x.cast("long").cast("string")).otherwise(x.cast("string"))


def value_text(prefix: str = "") -> Column:
    """Display text of a cell value, null for an empty cell."""
    t = F.col(f"{prefix}vtype")
    return (
        F.when(t == "number", number_text(F.col(f"{prefix}vnum")))
        .when(t == "boolean", F.when(F.col(f"{prefix}vbool"), "True").otherwise("False"))
        .when(t != "null", F.col(f"{prefix}vtext"))
    )


def has_content() -> Column:
    """Not null and not blank after trimming."""
    return F.when(is_text(), F.length(F.trim("vtext")) > 0).otherwise(
        (F.col("vtype") == "boolean") & F.col("vbool").isNotNull()
        | (F.col("vtype") == "number") & F.col("vnum").isNotNull()
    )


def numeric_loose(text: Column) -> Column:
    """Digits only once dots and dashes are taken out (ISO dates pass, grouped numbers do not)."""
    return F.translate(text, ".-", "").rlike(r"^\d+$")


def numeric_strict(text: Column) -> Column:
    """Parses as a float once comma, dollar, percent and space are taken out."""
    return F.translate(text, ",$% ", "").rlike(fixed.FLOAT_TEXT)


def looks_like_date(text: Column) -> Column:
    return F.coalesce(text.rlike("(?i)" + "|".join(fixed.DATE_PATTERNS)), F.lit(False))


def temporal_hits(text: Column) -> Column:
    """0, 1 or 2: one for an ISO date of the 2020s, one for a numbered month."""
    return F.coalesce(
        text.rlike(fixed.ISO_2020S).cast("int") + text.rlike("(?i)" + fixed.MONTH_N).cast("int"), F.lit(0)
    )


def column_letters(c: Column) -> Column:
    """1 -> A, 28 -> AB, 16384 -> XFD (three letters cover every sheet column)."""
    a = F.when(c > 702, F.char((F.floor((c - 703) / 676) % 26 + 65).cast("int"))).otherwise("")
    b = F.when(c > 26, F.char((F.floor((c - 27) / 26) % 26 + 65).cast("int"))).otherwise("")
    return F.concat(a, b, F.char(((c - 1) % 26 + 65).cast("int")))


def a1(r: Column, c: Column) -> Column:
    return F.concat(column_letters(c), r.cast("string"))


def a1_row(ref: Column) -> Column:
    return F.coalesce(F.regexp_extract(ref, fixed.A1_REF, 2).try_cast("int"), F.lit(0))


def a1_col(ref: Column) -> Column:
    letters = F.regexp_extract(ref, fixed.A1_REF, 1)
    codes = F.filter(F.split(letters, ""), lambda x: x != "")
    return F.aggregate(codes, F.lit(0), lambda acc, x: acc * 26 + F.ascii(x) - 64)


def count_terms(low: Column, words: list[str]) -> Column:
    """How many of the words occur in a text that is already lower-cased."""
    total = F.lit(0)
    for w in words:
        total = total + F.contains(low, F.lit(w)).cast("int")
    return total
