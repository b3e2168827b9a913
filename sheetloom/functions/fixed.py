"""Word lists, patterns and constants that results depend on."""

# A number as text accepts them (float syntax without exotic forms).
FLOAT_TEXT = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"

# Cell reference.
A1_REF = r"^([A-Z]+)(\d+)$"

# Date shapes searched without regard to case.
DATE_PATTERNS = [
    r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}",
    r"\d{4}[/-]\d{1,2}[/-]\d{1,2}",
    r"\w{3}\s+\d{1,2}[,]?\s+\d{4}",
    r"\d{1,2}\s+\w{3}\s+\d{4}",
    r"Q[1-4]\s+\d{4}",
    r"\d{4}Q[1-4]",
]
ISO_2020S = r"202[0-9]-\d{2}-\d{2}"
MONTH_N = r"Month \d+"

# Finance words of section labels.
FINANCE_TERMS = [
    "assets", "liabilities", "equity", "revenue", "expenses", "income",
    "cash", "receivable", "payable", "inventory", "property", "debt",
    "retained", "earnings", "capital", "current", "non-current", "total",
]

# Words and endings that mark error text.
ERROR_TERMS = [
    "values must be of type", "invalid", "error", "exception", "failed", "not found",
    "undefined", "null reference", "type error", "validation error", "parse error",
    "syntax error", "runtime error", "missing", "required", "cannot", "unable to",
    "failed to", "unexpected", "unrecognized", "unknown", "unsupported", "deprecated",
    "obsolete", "placeholder", "todo", "fixme", "bug", "issue", "problem",
]
ERROR_ENDINGS = [" of type", " must be"]
ERROR_WHOLE = ["of type", "must be"]
ERROR_MARKS = ["...", "---", "***", "!!!", "???"]

# Title words that are taken for dates.
TITLE_DATE_WORDS = ["2024", "2025", "2026", "jan", "feb", "mar"]

# Formula shapes counted as complex.
COMPLEX_FORMULA = [r"IF.*IF", r"VLOOKUP", r"INDEX.*MATCH", r"SUMPRODUCT", r"\$[A-Z]+\$\d+:\$[A-Z]+\$\d+"]

# Content type by file extension, and the extensions accepted for upload.
CONTENT_TYPES = {
    "pdf": "application/pdf",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "xls": "application/vnd.ms-excel",
    "json": "application/json",
    "html": "text/html",
}
DEFAULT_CONTENT_TYPE = "application/octet-stream"
UPLOAD_EXTENSIONS = ["xlsx", "xlsm", "xltx", "xltm", "pdf"]

# Number formats in priority order (main set), and the sets of the other extractors.
NUMBERS_MAIN = {
    "percentage": r"(?<!\w)\d+(?:\.\d+)?%(?!\w)",
    "currency": r"\$\s*\d+(?:,\d{3})*(?:\.\d{2})?\b",
    "ratio": r"\b\d+(?:\.\d+)?x\b",
    "date_number": r"(?:FY|CY|Q[1-4]\s*)?(?:19|20)\d{2}\b",
    "scientific_notation": r"\b\d+(?:\.\d+)?[eE][+-]?\d+\b",
    "fraction": r"\b\d+/\d+\b",
    "decimal": r"\b\d+\.\d+\b",
    "integer": r"\b\d{1,3}(?:,\d{3})*\b",
    "ordinal": r"\b\d{1,2}(?:st|nd|rd|th)\b",
}
NUMBER_PRIORITY = list(NUMBERS_MAIN)
NUMBERS_LEGACY = {
    "integer": r"\b\d{1,3}(?:,\d{3})*\b",
    "decimal": r"\b\d+\.\d+\b",
    "percentage": r"\b\d+(?:\.\d+)?%\b",
    "currency": r"\$\s*\d+(?:,\d{3})*(?:\.\d{2})?\b",
    "scientific_notation": r"\b\d+(?:\.\d+)?[eE][+-]?\d+\b",
    "fraction": r"\b\d+/\d+\b",
    "date_number": r"\b(?:19|20)\d{2}\b|\b\d{1,2}(?:st|nd|rd|th)\b",
}
NUMBERS_SIMPLE = {
    "currency": r"\$\s*\d+(?:,\d{3})*(?:\.\d{2})?",
    "percentage": r"\d+(?:\.\d+)?%",
    "decimal": r"\d+\.\d+",
    "integer": r"\b\d{1,3}(?:,\d{3})*\b",
}
NUMBERS_FALLBACK = {
    "currency": r"\$\s*\d{1,3}(?:,\d{3})*(?:\.\d{2})?",
    "percentage": r"\b\d+(?:\.\d+)?%\b",
    "decimal": r"\b\d+\.\d+\b",
    "scientific_notation": r"\b\d+(?:\.\d+)?[eE][+-]?\d+\b",
    "integer": r"\b\d{1,3}(?:,\d{3})*\b",
}
NUMBERS_ROUTING = [
    r"\b\d{1,3}(?:,\d{3})*\b",
    r"\b\d+\.\d+\b",
    r"\b\d+(?:\.\d+)?%\b",
    r"\$\s*\d+(?:,\d{3})*(?:\.\d{2})?",
    r"\b\d+(?:\.\d+)?[eE][+-]?\d+\b",
]

# Words that raise and lower the confidence of a number.
BUSINESS_TERMS = [
    "revenue", "income", "profit", "loss", "cost", "expense", "price",
    "amount", "total", "sum", "million", "billion", "thousand",
    "rate", "percentage", "margin", "growth", "increase", "decrease",
]
LAYOUT_TERMS = ["page", "section", "figure", "table", "chapter"]
SKIP_CONTEXTS = ["page", "section", "figure", "table", "chapter", "version", "year", "date", "phone", "zip"]

# Units in the order they are tried.
UNITS = {
    r"\b(million|mil|m)\b": "million",
    r"\b(billion|bil|b)\b": "billion",
    r"\b(thousand|k)\b": "thousand",
    r"\b(dollars?|usd)\b": "dollars",
    r"\b(cents?)\b": "cents",
    r"\b(years?|yrs?)\b": "years",
    r"\b(months?|mos?)\b": "months",
    r"\b(days?)\b": "days",
    r"\b(hours?|hrs?)\b": "hours",
    r"\b(minutes?|mins?)\b": "minutes",
    r"\b(seconds?|secs?)\b": "seconds",
    r"\b(percent|percentage|%)\b": "percent",
}
CURRENCIES = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}

# Substrings that mark running text in a table cell.
SENTENCE_WORDS = ["the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by"]

# Insights and advice over a whole corpus of comparisons, in the order they are given.
CORPUS_INSIGHTS = {
    "many_analyses": "High AI utilization suggests many complex sheets in dataset",
    "few_analyses": "Low AI utilization suggests mostly simple sheets",
    "disagreement": "High disagreement rate suggests need for threshold tuning",
    "cost": "High per-analysis cost suggests large/complex sheets",
    "ai_better": "AI frequently outperforms traditional methods",
    "traditional_better": "Traditional methods often sufficient - consider raising AI thresholds",
}
CORPUS_ADVICE = {
    "no_ai": "Enable AI analysis to collect comparison data",
    "disagreements": "Analyze disagreement cases for test case generation",
    "few_sheets": "Process more files to get statistically significant results",
}
