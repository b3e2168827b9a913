"""Personal data: base patterns, and contextual extraction bootstrapped from them.

Base matches are the seeds.  Every token with a digit or an at-sign is an
instance; the shape of a token, alone and with the word on its left or right,
is a lexical pattern, and so is that word with the coarse class of the token, so
that identifiers of another shape are found in a known context.  Spark scores the graph of patterns and instances in rounds: a
pattern is worth the mean score of its distinct instances, an instance the best of its
accepted patterns.  Tokens outside base matches that reach the threshold are
added as identifiers of the kind their patterns lead to.

All of it is DataFrame operations; matches, not texts, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetloom.llm.store import Stored
from sheetloom.llm.text import filled

# The base patterns.  They equal the published forms; possessive quantifiers and look-behinds only
# keep a long run of word characters from being searched again at each of its characters.
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?+[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = list(BASE)
TOKEN_CHARS = r"\s\"'(),;<>\[\]{}"
TOKEN = rf"(?<![^{TOKEN_CHARS}])[^{TOKEN_CHARS}0-9@]*+[0-9@][^{TOKEN_CHARS}]*+"

DOC = ["__id", "__key"]


def _named(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"__id": F.col("doc_id").cast("long"), "__key": F.xxhash64(filled(F.col("text")))})


def _found(kind: str, pattern: str) -> Column:
    """Matches of one kind in order, each with the length of the gap before it and the words around it."""
    text = F.col("text")
    gaps = F.split(text, pattern, -1)
    plain = lambda c: F.translate(c, "\n\r\t", "   ")
    zipped = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("after"))
    rows = F.filter(zipped, lambda z: z["match"].isNotNull())
    return F.transform(
        rows,
        lambda z, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("no"),
            F.char_length(z["gap"]).cast("long").alias("gap"),
            z["match"].alias("match"),
            F.lower(F.substring_index(F.rtrim(plain(z["gap"])), " ", -1)).alias("left"),
            F.lower(F.substring_index(F.ltrim(plain(z["after"])), " ", 1)).alias("right"),
        ),
    )


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""
    size = F.char_length(digits)
    total = F.aggregate(
        F.sequence(F.lit(0), size - 1),
        F.lit(0),
        lambda total, i: total + F.when(i % 2 == 0, _digit(digits, size - i)).otherwise((_digit(digits, size - i) * 2) % 10 + F.floor(_digit(digits, size - i) / 5).cast("int")),
    )
    return total % 10 == 0


def _digit(digits: Column, at: Column) -> Column:
    return F.substring(digits, at, F.lit(1)).cast("int")


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    size = F.char_length(digits)
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return (
        F.when(kind == "ip", F.forall(parts, lambda p: (F.char_length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255)))
        .when(kind == "card", F.when(size.between(13, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", size.between(9, 15))
        .otherwise(True)
    )


def matches(docs: DataFrame) -> Stored:
    """Base matches that hold and tokens, with code-point spans and context: __id, __key, kind, start, end, match, left, right."""
    named = _named(docs.select("doc_id", "text")).where(F.col("text").rlike("[0-9@]"))
    every = F.concat(*(_found(k, p) for k, p in {**BASE, "token": TOKEN}.items()))
    rows = named.select(*DOC, F.inline(every)).distinct()
    so_far = Window.partitionBy(*DOC, "kind").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    size = F.char_length("match").cast("long")
    placed = rows.withColumn("end", F.sum(F.col("gap") + size).over(so_far)).withColumn("start", F.col("end") - size)
    return Stored(placed.where(_valid(F.col("kind"), F.col("match"))).select(*DOC, "kind", "start", "end", "match", "left", "right"), "matches")


def _context(value: str) -> list[Column]:
    """The word on the left or right with the coarse class of a value: an at-sign, letters and digits, or digits; no word, no pattern."""
    kind = F.when(F.contains(F.col(value), F.lit("@")), "@").when(F.col(value).rlike(r"\p{L}"), "a").otherwise("9")
    return [F.concat_ws(" ", F.lit(side), kind, F.nullif(F.col(word), F.lit(""))) for side, word in (("l", "left"), ("r", "right"))]


def instances(found: DataFrame, least: int = 6) -> DataFrame:
    """Tokens with their value, patterns and, where a base match covers them, its kind as ``seed``.

    A token needs ``least`` letters or digits and five digits or an at-sign to be an
    identifier; closing punctuation is cut off.  Base matches that are not one token
    are instances by their context, too.
    """
    base = F.col("kind") != "token"
    by_place = Window.partitionBy(*DOC).orderBy("start")
    before = F.max(F.when(base, F.struct("end", "kind"))).over(by_place.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(base, F.struct("start", "kind"))).over(by_place.rangeBetween(0, Window.unboundedFollowing))
    rows = found.withColumns({"before": before, "after": after}).where(~base)
    value = F.regexp_replace("match", r"[.:!?]+$", "")
    rows = rows.withColumn("value", value).withColumn("end", F.col("start") + F.char_length("value"))
    seed = F.when(F.col("before.end") > F.col("start"), F.col("before.kind")).when(F.col("after.start") < F.col("end"), F.col("after.kind"))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[0-9]", "9"), r"\p{Lu}+", "A"), r"[\p{L}&&[^A]]+", "a")
    strong = (F.char_length(F.regexp_replace("value", r"[^\p{L}0-9]", "")) >= least) & (
        (F.char_length(F.regexp_replace("value", "[^0-9]", "")) >= 5) | F.col("value").contains("@")
    )
    patterns = F.array(
        F.concat_ws(" ", F.lit("S"), "shape"), F.concat_ws(" ", F.lit("L"), F.col("left"), "shape"), F.concat_ws(" ", F.lit("R"), "shape", F.col("right")), *_context("value")
    )
    whole = found.where(base).select(*DOC, "start", "end", F.lower("match").alias("value"), F.col("kind").alias("seed"), F.array(*_context("match")).alias("patterns"))
    tokens = rows.withColumn("seed", seed).withColumn("shape", shape).where(strong).select(*DOC, "start", "end", F.lower("value").alias("value"), "seed", patterns.alias("patterns"))
    return tokens.unionByName(whole.where(F.col("value").rlike(rf"[{TOKEN_CHARS}]")))


def bootstrap(found: DataFrame, rounds: int = 3, threshold: float = 0.8, support: int = 3) -> DataFrame:
    """(value, kind) of unseen identifiers: the values that accepted patterns lead to after ``rounds``.

    A pattern is accepted with a confidence of ``threshold`` and at least ``support``
    distinct values that are seeds or reached the threshold in an earlier round.  Confidence is the sum of its instances' scores over their number plus one.
    """
    edges = Stored(found.select("value", F.explode("patterns").alias("pattern")).distinct(), "edges")
    scores = Stored(found.where("seed IS NOT NULL").groupBy("value", F.col("seed").alias("kind")).agg(F.lit(1.0).alias("score"), F.lit(True).alias("is_seed")), "scores")
    sizes = Stored(edges.df.groupBy("pattern").agg(F.count("*").alias("n")), "sizes")
    for _ in range(rounds):
        by_kind = edges.df.join(scores.df, "value").groupBy("pattern", "kind").agg(F.sum("score").alias("total"), F.sum((F.col("is_seed") | (F.col("score") >= threshold)).cast("int")).alias("seeds"))
        trusted = by_kind.join(sizes.df, "pattern").withColumn("confidence", F.col("total") / (F.col("n") + 1)).where((F.col("confidence") >= threshold) & (F.col("seeds") >= support))
        accepted = Stored(trusted.select("pattern", "kind", "confidence"), "accepted")
        reached = edges.df.join(accepted.df, "pattern").groupBy("value", "kind").agg(F.max("confidence").alias("score"), F.lit(False).alias("is_seed"))
        merged = scores.df.where("is_seed").unionByName(reached).groupBy("value", "kind").agg(F.max("score").alias("score"), F.max("is_seed").alias("is_seed"))
        after = Stored(merged, "scores")
        scores.drop()
        accepted.drop()
        scores = after
    sizes.drop()
    edges.drop()
    best = scores.df.where(F.col("score") >= threshold).groupBy("value").agg(F.max(F.struct("score", "kind"))["kind"].alias("kind"))
    return best


def personal_data(docs: DataFrame, rounds: int = 3, threshold: float = 0.8, support: int = 3) -> DataFrame:
    """One row per document of (doc_id, text): doc_id and spans, an array of (kind, start, end, base).

    Spans are code points, end exclusive, ordered by kind as listed in KINDS and start.
    ``base`` marks matches of the base patterns; the others were found by context and
    overlap no base match.  A null or empty text has no spans.  Rows that repeat
    doc_id and text are one document and get the same spans; other columns are ignored.
    """
    found = matches(docs)
    tokens = Stored(instances(found.df), "instances")
    values = Stored(bootstrap(tokens.df, rounds, threshold, support), "values")
    unseen = tokens.df.where("seed IS NULL").join(values.df, "value").select(*DOC, "kind", "start", "end", F.lit(False).alias("base"))
    every = found.df.where("kind <> 'token'").select(*DOC, "kind", "start", "end", F.lit(True).alias("base")).unionByName(unseen)
    order = F.array_position(F.lit(KINDS), F.col("kind")).alias("order")
    spans = Stored(every.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct(order, "start", "end", "kind", "base"))).alias("spans")), "spans")
    tokens.drop()
    values.drop()
    found.drop()
    wanted = _named(docs.select("doc_id", "text")).select("doc_id", *DOC)
    same = wanted["__id"].eqNullSafe(spans.df["__id"]) & (wanted["__key"] == spans.df["__key"])
    none = F.expr("CAST(array() AS array<struct<kind:string,start:bigint,end:bigint,base:boolean>>)")
    tidy = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base")))
    return wanted.join(spans.df, same, "left").select("doc_id", F.coalesce(tidy, none).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
