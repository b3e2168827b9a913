"""Toxicity by weak supervision.

Spark counts the terms (words and word beginnings) of a bounded sample of labelled
rows; the terms that lean to toxic texts are dealt to many lexicon voters, and
patterns of the writing give more voters.  A generative model of the votes
estimates how often each voter fires on either class and how far voters repeat
each other; its posteriors, not the labels, train a linear classifier over terms.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetloom.llm.store import Stored
from sheetloom.llm.text import filled, held_out, pieces

WORD = re.compile(r"[^\W\d_]+")
CACHE_WORDS = 120_000

#: Patterns of writing that may accompany abuse; the label model finds what they are worth.
PATTERNS = {
    "shouting": re.compile(r"\b[^\W\d_a-zß-öø-ÿ]{4,}\b"),
    "exclamations": re.compile(r"!{2,}"),
    "masked": re.compile(r"\w[*#@$]{2,}\w?"),
    "address": re.compile(r"\b(?:you|du|tu|toi|vous|usted) (?:are|bist|es|êtes|eres)\b", re.I),
    "stretched": re.compile(r"(\w)\1{3,}"),
}
#: Hashes under which two texts must have the same smallest word to count as copies in training.
COPY_HASHES = 4


def terms_of(word: str) -> list[str]:
    """The word and its first 4, 5 and 6 letters."""
    return [word, *(f"{word[:n]}~" for n in (4, 5, 6) if len(word) >= n)]


def words_of(text: str | None) -> Counter:
    return Counter(WORD.findall((text or "").lower()))


def features_of(text: str | None) -> set[str]:
    """Terms of the whole text; a term of a repeated word, or of two words, stands a second time with a mark."""
    seen: Counter = Counter()
    for word, n in words_of(text).items():
        for term in terms_of(word):
            seen[term] += n
    return {*seen, *(f"{t}+" for t, n in seen.items() if n > 1)}


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    cache: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def score(self, text: str | None) -> float:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        found: Counter = Counter()
        for word, n in words_of(text).items():
            hit = self.cache.get(word)
            if hit is None:
                hit = self.cache[word] = tuple(t for t in terms_of(word) if t in self.weights or f"{t}+" in self.weights)
            for term in hit:
                found[term] += n
        get = self.weights.get
        z = self.bias + sum(get(t, 0.0) + (get(f"{t}+", 0.0) if found[t] > 1 else 0.0) for t in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def label_model(votes: np.ndarray, prior: float, start: np.ndarray, rounds: int = 15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior, accuracies, correlations) of 0/1 votes under a two-class generative model.

    ``start`` are first guesses of the posterior.  A voter that repeats others
    (correlation left over within the classes) counts less, in proportion.
    """
    posterior = start.astype(float)
    n, m = votes.shape
    for _ in range(rounds):
        toxic, clean = posterior.sum() + 1e-9, (1 - posterior).sum() + 1e-9
        fires1 = np.clip((votes.T @ posterior + 0.5) / (toxic + 1), 1e-4, 1 - 1e-4)
        fires0 = np.clip((votes.T @ (1 - posterior) + 0.05) / (clean + 1), 1e-4, 1 - 1e-4)
        left = votes - (posterior[:, None] * fires1 + (1 - posterior)[:, None] * fires0)
        cov = left.T @ left / n
        deviation = np.sqrt(np.diag(cov)) + 1e-9
        correlation = cov / np.outer(deviation, deviation)
        np.fill_diagonal(correlation, 0)
        weight = 1 / (1 + np.clip(correlation, 0, 1).sum(1))
        on, off = np.log(fires1 / fires0), np.log((1 - fires1) / (1 - fires0))
        z = np.log(prior / (1 - prior)) + (votes * (weight * on) + (1 - votes) * (weight * off)).sum(1)
        posterior = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    return posterior, np.stack([fires1, fires0]), correlation


def logistic(rows: list[np.ndarray], target: np.ndarray, weight: np.ndarray, width: int, rounds: int = 600, ridge: float = 1e-6) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse 0/1 rows with soft targets (Adam, full batches)."""
    lengths = np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if lengths.sum() else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    theta, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    theta[-1] = -2
    weight = weight / weight.sum()
    for k in range(1, rounds + 1):
        z = np.bincount(owner, theta[flat], len(rows)) + theta[-1]
        error = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target)
        g = np.append(np.bincount(flat, error[owner], width) + ridge * theta[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return theta[:-1], float(theta[-1])


def _chosen(labels: DataFrame, rows: int) -> tuple[DataFrame, float]:
    """Ids of at most rows/2 toxic and rows/2 clean labelled documents that are not held out, and the share of toxic ones."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    half = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2) for y in (0, 1)]
    return half[0].unionByName(half[1]), share


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, least: int = 4, significant: float = 3.5, odds_least: float = 6, top_terms: int = 4000, voters: int = 32) -> Model:
    """Fit on at most ``sample_rows`` labelled rows; held-out rows are never read for labels.

    Copies and near copies (the same smallest word under COPY_HASHES hashes) count once, or the plain words
    of a much copied toxic text would look toxic.  Counts cover every term of the sample.  A term needs ``least`` documents and a
    lean of ``significant`` standard deviations to the toxic class with odds of at
    least ``odds_least``, so that a language's common words stay out; the strongest
    ``top_terms`` are the lexicon of the voters and the features of the classifier.  Without
    rows of both classes the model answers 0 for everything.
    """
    ids, share = _chosen(labels.select("doc_id", "toxic"), sample_rows)
    if not share or share == 1:
        return Model({}, -40.0)
    texts = docs.select("doc_id", filled(F.col("text")).alias("text")).join(F.broadcast(ids), "doc_id")  # ids: sample_rows at most
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    smallest = F.array(*(F.array_min(F.transform(words, lambda w, k=k: F.xxhash64(F.lit(k), w))) for k in range(COPY_HASHES)))
    sample = Stored(texts.groupBy("toxic", smallest.alias("copies")).agg(F.min(F.struct("doc_id", "text"))["text"].alias("text")), "toxicity")

    def terms(batches):
        for batch in batches:
            out = {"term": [], "toxic": []}
            for r in batch.to_pylist():
                found = features_of(r["text"])
                out["term"] += found
                out["toxic"] += [r["toxic"]] * len(found)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("term", pa.string()), ("toxic", pa.int32())]))

    totals = {r["toxic"]: r["count"] for r in sample.df.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return Model({}, -40.0)
    share_here = totals[1] / (totals[0] + totals[1])
    both = F.col("t") + F.col("c")
    lean = (F.col("t") - both * share_here) / F.sqrt(both * share_here * (1 - share_here))
    odds = (F.col("t") + 0.5) / (totals[1] + 1.0) / ((F.col("c") + 0.5) / (totals[0] + 1.0))
    counted = (
        sample.df.mapInArrow(terms, "term string, toxic int").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        .where((both >= least) & (lean >= significant) & (odds >= odds_least)).withColumn("lean", lean).orderBy(F.desc("lean"), "term").limit(top_terms).collect()
    )  # bounded by top_terms
    vocabulary = {r.term: i for i, r in enumerate(counted)}
    voter_of = {vocabulary[t]: k % voters for k, t in enumerate(vocabulary)}
    names = list(PATTERNS)

    def features(batches):
        for batch in batches:
            out = {"toxic": [], "terms": [], "patterns": []}
            for r in batch.to_pylist():
                out["toxic"].append(r["toxic"])
                out["terms"].append(np.array(sorted(vocabulary[t] for t in features_of(r["text"]) if t in vocabulary), np.int32).tobytes())
                out["patterns"].append(bytes(bool(PATTERNS[n].search(r["text"])) for n in names))
            yield pa.RecordBatch.from_pydict(out, pa.schema([("toxic", pa.int32()), ("terms", pa.binary()), ("patterns", pa.binary())]))

    found = sample.df.mapInArrow(features, "toxic int, terms binary, patterns binary").collect()  # bounded by sample_rows
    sample.drop()
    found.sort(key=lambda r: (r.toxic, bytes(r.terms), bytes(r.patterns)))
    rows = [np.frombuffer(r.terms, np.int32) for r in found]
    truth = np.array([r.toxic for r in found], float)
    votes = np.zeros((len(rows), voters + len(names)))
    for i, r in enumerate(rows):
        for t in r:
            if t in voter_of:
                votes[i, voter_of[t]] = 1
        votes[i, voters:] = list(found[i].patterns)
    posterior, _, _ = label_model(votes, float(truth.mean()), truth)
    weight = np.where(truth == 1, share / max(truth.mean(), 1e-9), (1 - share) / max(1 - truth.mean(), 1e-9))
    theta, bias = logistic(rows, posterior, weight, len(counted))
    return Model({t: float(theta[i]) for t, i in vocabulary.items()}, bias)


def toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Append score (0 to 1, higher: more likely toxic) from the whole text.

    Null and empty texts get the score of a text without any known term.  Other
    columns pass through; a column ``score`` is replaced.  No shuffle.
    """
    schema = T.StructType([f for f in docs.schema.fields if f.name != "score"] + [T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most top_terms weights

    def run(batches):
        for batch in pieces(batches):
            made = pa.array(map(sent.value.score, batch.column(batch.schema.get_field_index(text)).to_pylist()), pa.float64())
            keep = [i for i, n in enumerate(batch.schema.names) if n != "score"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), made], names=[*(batch.schema.names[i] for i in keep), "score"])

    return docs.mapInArrow(run, schema)
