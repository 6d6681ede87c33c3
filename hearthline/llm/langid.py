"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character 1- to 3-grams of the whole lower-cased text, 1 + log(count) times the inverse document frequency,
normalised to length one. Document frequencies are counted over all training documents (partial counts per task, then a
sum). The classifier learns by follow-the-regularised-leader with elastic-net penalties, which leaves most weights at zero, on a bounded
sample: at most `PER_LANGUAGE` labelled rows of each language and `SAMPLE` in all, chosen by hash. A fifth of the sample is held back
to calibrate a softmax temperature.

Defined results: null texts and texts without a letter are `und` with score 0; with nothing to learn from, all are `und`; repeated
rows get a row each; rows with a null doc_id are predicted, never learned from, and not held out; an empty table gives no rows; lang, source, doc_id and other columns never enter a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import arrays

BITS = 15
DIM = 1 << BITS
#: Bounds of the classifier's sample of labelled rows.
PER_LANGUAGE, SAMPLE = 600, 4000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 2e-3, 1e-3, 4
#: Below this calibrated probability filter_language() rejects a document.
MIN_SCORE = 0.3
_LETTER = re.compile(r"[^\W\d_]")


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram numbers, and the count of each."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    spaced = np.where((codes <= 32) | (codes == 160), np.uint32(32), codes)
    m1, m2, m3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
    one = spaced * m1
    parts = [one ^ (one >> np.uint32(15))]
    if len(codes) > 1:
        two = (one[:-1] ^ (one[:-1] >> np.uint32(13))) * m2 + one[1:]
        parts.append((two ^ (two >> np.uint32(14))) * m3)
        if len(codes) > 2:
            three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * m3 + one[2:]
            parts.append((three ^ (three >> np.uint32(14))) * m2)
    counts = np.bincount(np.concatenate(parts) >> np.uint32(32 - BITS), minlength=DIM)
    at = np.flatnonzero(counts)
    return at, counts[at]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, counts = features(text)
    value = (1 + np.log(counts)) * idf[at]
    norm = np.sqrt(value @ value)
    return at, value / norm if norm else value


class Ftrl:
    """Multinomial logistic regression by FTRL-proximal with L1 and L2 penalties."""

    def __init__(self, classes: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((DIM, classes)), np.zeros((DIM, classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(value @ w)
        p[label] -= 1
        g = value[:, None] * p[None, :]
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The t that makes softmax(logits / t) likeliest, by golden-section search on log t."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))[np.arange(len(labels)), labels]
        return -np.log(np.maximum(p, 1e-12)).mean() + 1e-3 * log_t**2

    a, b, g = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: crc32(doc_id as text) mod 3 is not 1."""
    return docs.where("text is not null and lang is not null and coalesce(pmod(crc32(cast(cast(doc_id as string) as binary)), 3) <> 1, false)").select("doc_id", "text", "lang")


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each feature, and all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DIM + 1, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                total[features(text)[0]] += 1
                total[DIM] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["feature", "n"])

    rows = texts.select("text").mapInArrow(run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()  # DIM + 1 rows at most
    out = np.zeros(DIM + 1, np.int64)
    out[rows.feature.to_numpy(np.int64)] = rows.n.to_numpy(np.int64)
    return out[:DIM], int(out[DIM])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> dict | None:
    """Model from docs(doc_id, text, lang) as given by training_rows(): languages, weights, idf, temperature."""
    df, n = document_frequencies(docs)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + df)) + 1
    # the rows of a language with the least hashes; a common language is thinned by hash first, so that no task sorts all of it
    order = F.xxhash64("doc_id", F.lit(7))
    named = docs.select("doc_id", "lang", order.alias("h"))
    # one row a language: labels are a short list
    share = named.groupBy("lang").agg((F.lit(2.0 * per_language) / F.count("*")).alias("share"))
    thin = named.join(F.broadcast(share), "lang").where(F.col("h").cast("double") < (F.col("share") - 0.5) * 2.0**64)
    ids = thin.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("k") <= per_language)
    ids = ids.orderBy("k", "h", "doc_id", "lang").limit(sample).select("doc_id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [vector(t, idf) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), pa.array([a.astype(np.int32) for a, _ in rows], pa.list_(pa.int32())), pa.array([v.astype(np.float32) for _, v in rows], pa.list_(pa.float32()))],
                names=["doc_id", "lang", "at", "value"],
            )

    rows = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "lang", "text").mapInArrow(run, "doc_id bigint, lang string, at array<int>, value array<float>").toPandas()
    rows = rows.sort_values(["doc_id", "lang"]).sample(frac=1, random_state=1)[: 2 * sample]
    languages = sorted(rows.lang.unique())
    number = {k: i for i, k in enumerate(languages)}
    model, held = Ftrl(len(languages)), np.arange(len(rows)) % 5 == 4
    data = [(np.asarray(a, np.int64), np.asarray(v, float), number[k]) for a, v, k in zip(rows["at"], rows.value, rows.lang, strict=True)]
    for _ in range(EPOCHS):
        for row, out in zip(data, held, strict=True):
            if not out:
                model.learn(*row)
    weights = model.weights()
    kept = [row for row, out in zip(data, held, strict=True) if out]
    logits = np.array([v @ weights[a] for a, v, _ in kept]).reshape(len(kept), len(languages))
    return {"languages": languages, "weights": weights.astype(np.float32), "idf": idf, "temperature": temperature(logits, np.array([k for *_, k in kept], int))}


def _judge(model: dict | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, scores = [], []
    for text in texts:
        if model is None or not text or not _LETTER.search(text):
            langs.append("und")
            scores.append(0.0)
            continue
        at, value = vector(text, model["idf"])
        p = softmax(value @ model["weights"][at] / model["temperature"])
        k = int(p.argmax())
        langs.append(model["languages"][k])
        scores.append(float(p[k]))
    return langs, scores


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """The op10 rows: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = _judge(shared.value, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.expr("coalesce(pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1, false)")
    return docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, train(training_rows(docs)))


def filter_language(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """docs whose language is found with at least min_score. Rows, columns and types stay otherwise."""
    shared = docs.sparkSession.sparkContext.broadcast(train(training_rows(docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in arrays.chunks(batches):
            langs, scores = _judge(shared.value, chunk.column("text").to_pylist())
            yield chunk.filter(pa.array([k != "und" and s >= min_score for k, s in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
