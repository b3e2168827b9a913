"""Language identification with averaged hashed subword embeddings and a linear softmax.

A bounded sample of labelled rows is turned into bags of hashed subwords by Spark;
stochastic gradient descent in numpy fits embeddings and softmax on the driver.
Another part of the sample fits the temperature of the scores and the score below
which a prediction is rejected.  The fitted model is a fixed-size table of
(bucket, language) weights, so prediction is one pass over the documents without
a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheetloom.llm.text import held_out, pieces, unit_hash

UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")
CACHE_WORDS = 120_000


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def subwords(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of the word, bucket) of every word and of its 2- to 4-byte pieces, with marked ends."""
    marked = [f"<{w}>".encode() for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    data = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    word = np.repeat(np.arange(len(marked)), sizes)
    owners, ids = [np.arange(len(marked))], [np.fromiter(map(zlib.crc32, marked), np.uint32, len(marked))]
    piece = data + np.uint32(1)
    for n in (2, 3, 4):
        piece = piece[:-1] * np.uint32(0x01000193) ^ (data[n - 1 :] + np.uint32(n << 8))
        within = word[: len(piece)] == word[n - 1 :]
        owners.append(word[: len(piece)][within])
        ids.append(piece[within])
    mixed = np.concatenate(ids)
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return np.concatenate(owners), ((mixed >> np.uint32(8)) % np.uint32(buckets)).astype(np.int64)


def bag(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    seen = Counter(words)
    owner, ids = subwords(list(seen), buckets)
    total = np.bincount(ids, np.fromiter(seen.values(), np.float64, len(seen))[owner], buckets)
    found = np.flatnonzero(total)
    return found.astype(np.int32), total[found].astype(np.float32)


@dataclass
class Model:
    """weights[bucket] are the summed-up logits of one subword; a text's logits are their mean plus ``bias``."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def __post_init__(self):
        self.index: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.languages) + 1), np.float32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("index", "rows")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.__post_init__()

    def _learn(self, words: list[str]) -> None:
        """Sums of the weights and numbers of the subwords of new words."""
        if len(self.index) + len(words) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(1024, len(self.rows), len(words)), self.rows.shape[1]), np.float32)])
        owner, ids = subwords(words, len(self.weights))
        at = len(self.index)
        for c in range(len(self.languages)):
            self.rows[at : at + len(words), c] = np.bincount(owner, self.weights[ids, c], len(words))
        self.rows[at : at + len(words), -1] = np.bincount(owner, minlength=len(words))
        self.index.update(zip(words, range(at, at + len(words))))

    def logits(self, text: str) -> np.ndarray:
        counts = Counter(WORD.findall(text.lower()))
        if not counts:
            return self.bias.astype(np.float64)
        if len(self.index) > CACHE_WORDS:
            self.__post_init__()
        new = [w for w in counts if w not in self.index]
        if new:
            self._learn(new)
        at = np.fromiter(map(self.index.__getitem__, counts), np.int64, len(counts))
        total = np.fromiter(counts.values(), np.float32, len(counts)) @ self.rows[at]
        return total[:-1].astype(np.float64) / total[-1] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(bags: list[tuple[int, np.ndarray, np.ndarray]], classes: int, buckets: int, dim: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Stochastic gradient descent over (class, buckets, counts) bags; returns collapsed weights and bias."""
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((dim, classes), np.float32), np.zeros(classes, np.float32)
    steps, step = epochs * len(bags), 0
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            label, ids, counts = bags[k]
            share = counts / counts.sum()
            hidden = share @ embed[ids]
            error = softmax(hidden @ out + bias)
            error[label] -= 1
            lr = rate * (1 - step / steps)
            back = out @ error
            out -= lr * np.outer(hidden, error)
            bias -= lr * 0.1 * error
            embed[ids] -= lr * np.outer(share, back) * min(len(ids), 50)
            step += 1
    return embed @ out, bias


def _sample(labelled: DataFrame, rows_per_language: int) -> DataFrame:
    """At most about ``rows_per_language`` rows of each language, chosen by the hash of doc_id."""
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row per language
    share = F.create_map(*(x for lang, n in counts.items() for x in (F.lit(lang), F.lit(rows_per_language / n))))
    return labelled.where(unit_hash(F.lit("sample"), F.col("doc_id")) < share[F.col("lang")]) if counts else labelled


def train(docs: DataFrame, rows_per_language: int = 600, buckets: int = 1 << 16, dim: int = 12, epochs: int = 6, rate: float = 0.4, reject: float = 0.001, seed: int = 7) -> Model | None:
    """Fit on rows with a known language that are not held out; None if there are none.

    The sample is bounded by ``rows_per_language``; of it a quarter calibrates.  A
    sampled row gives a bag of its whole text and bags of short runs of its words,
    so that short texts are covered.  ``reject``: share of correctly identified
    calibration rows that the threshold may reject.
    """
    labelled = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = _sample(labelled, rows_per_language).withColumn("calibrates", unit_hash(F.lit("calibrates"), F.col("doc_id")) < 0.25).select("doc_id", "lang", "text", "calibrates")

    def bags(batches):
        for batch in batches:
            out = {"lang": [], "calibrates": [], "ids": [], "counts": []}
            for r in batch.to_pylist():
                words = WORD.findall(r["text"].lower())
                if not has_letter(r["text"]) or not words:
                    continue
                rng = np.random.default_rng(zlib.crc32(str(r["doc_id"]).encode()))
                runs = [words]
                for size in (3, 8, 20):
                    start = int(rng.integers(0, max(1, len(words) - size)))
                    runs.append(words[start : start + size])
                for run in runs:
                    ids, counts = bag(run, buckets)
                    out["lang"].append(r["lang"])
                    out["calibrates"].append(r["calibrates"])
                    out["ids"].append(ids.tobytes())
                    out["counts"].append(counts.tobytes())
            yield pa.RecordBatch.from_pydict(out, pa.schema([("lang", pa.string()), ("calibrates", pa.bool_()), ("ids", pa.binary()), ("counts", pa.binary())]))

    found = rows.mapInArrow(bags, "lang string, calibrates boolean, ids binary, counts binary").collect()  # bounded by the sample
    languages = sorted({r.lang for r in found})
    if not languages:
        return None
    found.sort(key=lambda r: (r.lang, bytes(r.ids)))
    data = [(r.calibrates, (languages.index(r.lang), np.frombuffer(r.ids, np.int32), np.frombuffer(r.counts, np.float32))) for r in found]
    learn = [x for held, x in data if not held] or [x for _, x in data]
    weights, bias = fit(learn, len(languages), buckets, dim, epochs, rate, seed)
    model = Model(languages, weights, bias)
    check = [x for held, x in data if held] or learn
    logits = np.stack([(c / c.sum()) @ weights[i] + bias for _, i, c in check]).astype(np.float64)
    truth = np.array([y for y, _, _ in check])
    likelihood = {t: np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in np.geomspace(0.05, 5, 40)}
    model.temperature = float(max(likelihood, key=likelihood.get))
    p = softmax(logits / model.temperature)
    right = p.argmax(1) == truth
    scores = p.max(1)[right] if right.any() else p.max(1)
    model.threshold = float(np.quantile(scores, reject, method="lower"))
    return model


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Append lang_pred, score (0 to 1) and accepted to every row.

    A text that is null or has no letter is ``und`` with score 0 and is rejected,
    and so is every text if the model is None.  Other texts get the likeliest
    learned language; ``accepted`` tells whether the score reaches the calibrated
    threshold.  The whole text counts.  Other columns pass through; columns of
    those three names are replaced.
    """
    added = T.StructType.fromDDL("lang_pred string, score double, accepted boolean")
    schema = T.StructType([f for f in docs.schema.fields if f.name not in added.fieldNames()] + added.fields)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages: fixed by parameters

    def run(batches):
        model = sent.value
        for batch in pieces(batches):
            found = [model.predict(t) if model else (UNKNOWN, 0.0) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            keep = [i for i, n in enumerate(batch.schema.names) if n not in added.fieldNames()]
            made = [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()), pa.array([x != UNKNOWN and s >= model.threshold for x, s in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *made], names=[*(batch.schema.names[i] for i in keep), *added.fieldNames()])

    return docs.mapInArrow(run, schema)
