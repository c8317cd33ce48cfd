"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

The languages are all non-null values of lang; the driver holds DIM weights for each. Three passes. The first counts the document frequency of each hashed n-gram over all learning
documents. The second takes a bounded sample for each language, by a threshold on a hash of doc_id,
and fits weights by follow-the-regularised-leader with an elastic net, which keeps most of them at
zero; a fifth of the sample is set aside to fit the temperature. The third scores every text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, table

DIM = 1 << 16
#: The classifier is fitted on at most about this many documents of each language.
SAMPLE_PER_LANGUAGE = 600
UNDETERMINED = "und"


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1-, 2- and 3-grams of the lower-cased characters, and 1 + log of how often each occurs."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    two = c[:-1] * np.uint32(0x01000193) ^ c[1:]
    three = two[:-1] * np.uint32(0x01000193) ^ c[2:]
    found = np.concatenate([c + np.uint32(7), two * np.uint32(3) + np.uint32(11), three * np.uint32(5) + np.uint32(13)]) * np.uint32(0x9E3779B1)
    counts = np.bincount(found >> np.uint32(16), minlength=DIM)
    at = np.nonzero(counts)[0]
    return at.astype(np.int32), (1 + np.log(counts[at])).astype(np.float32)


@dataclass
class Ftrl:
    """Follow-the-regularised-leader, proximal, for a softmax over the given number of classes."""

    classes: int
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.5
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self):
        self.z, self.n = np.zeros((2, DIM, self.classes), np.float32)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return -np.sign(z) * np.maximum(np.abs(z) - self.l1, 0) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of logits with the least log loss, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()) + 1e-4 * t * t

    lo, hi, g = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    heat: float

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, tf = ngrams(text)
        x = tf * self.idf[at]
        return at, x / max(float(np.sqrt((x * x).sum())), 1e-9)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        at, x = self.vector(text)
        p = softmax(x @ self.weights[at] / self.heat)
        best = int(p.argmax())
        return self.languages[best], float(p[best])

    def udf(self):
        model = self

        @F.arrow_udf("struct<lang: string, score: double>")
        def predicted(text: pa.Array) -> pa.Array:
            langs, scores = zip(*(model.predict(t) for t in text.to_pylist())) if len(text) else ((), ())
            return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

        return predicted


def document_frequency(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many texts hold each hashed n-gram, and how many texts there are; the result has DIM rows at most."""

    def count(batches):
        df, n = np.zeros(DIM, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                df[ngrams(text)[0]] += 1
                n += 1
        at = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["gram", "n"])

    rows = texts.mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    df, at, n = np.zeros(DIM, np.int64), rows["gram"].to_numpy(), rows["n"].to_numpy()
    df[at[at >= 0]] = n[at >= 0]
    return df, int(n[at < 0].sum())


def fit(docs: DataFrame, learn_from) -> LanguageModel:
    """A model from the text and non-null lang of the rows of docs for which the column learn_from holds."""
    rows = docs.where(learn_from & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros(DIM, np.float32), np.zeros((DIM, 0), np.float32), 1.0)
    df, n = document_frequency(rows.select("text"))
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(1 << 30)) / float(1 << 30)
    part = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, SAMPLE_PER_LANGUAGE / counts[k]))))
    sample = rows.where(draw < part[F.col("lang")]).dropDuplicates(["doc_id", "lang", "text"])  # repeated rows are drawn once

    def vectors(batches):
        for batch in batches:
            found = [ngrams(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([x.tobytes() for _, x in found], pa.binary()), batch.column(2)], ["lang", "at", "x", "draw"])

    got = sample.select("lang", "text", draw.alias("draw")).mapInArrow(vectors, "lang string, at binary, x binary, draw double").toArrow().sort_by([("draw", "ascending"), ("lang", "ascending")])
    names = {k: i for i, k in enumerate(languages)}
    data = []
    for lang, at, x in zip(*(got[c].to_pylist() for c in ("lang", "at", "x"))):
        at = np.frombuffer(at, np.int32)
        x = np.frombuffer(x, np.float32) * idf[at]
        data.append((at, x / max(float(np.sqrt((x * x).sum())), 1e-9), names[lang]))
    order = np.random.default_rng(7).permutation(len(data))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    ftrl = Ftrl(len(languages))
    for _ in range(4):
        for i in used:
            ftrl.learn(*data[i])
    weights = ftrl.weights().astype(np.float32)
    logits = np.array([data[i][1] @ weights[data[i][0]] for i in held]).reshape(len(held), len(languages))
    return LanguageModel(languages, idf, weights, temperature(logits, np.array([data[i][2] for i in held], int)))


def identify(docs: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    Learns from rows whose crc32 of doc_id, as text, modulo `folds` is not `held`; rows with a null
    doc_id have no fold, are not learned from and count as not held out. lang_pred is `und`
    with score 0 where text is null, empty or has no letter, or where nothing could be learned.
    Repeated rows get equal results. An empty table gives an empty result.
    """
    fold = F.coalesce(bucket_of("doc_id", folds), F.lit(-1))
    model = fit(docs, (fold != held) & (fold >= 0))
    return docs.select("doc_id", (fold == held).alias("held_out"), model.udf()("text").alias("p")).select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_identified(docs: DataFrame, least_score: float = 0.3) -> DataFrame:
    """docs without the rows whose language can't be told: no letters, or a calibrated score below least_score.

    All columns pass through, whatever their names. Rows with null or empty text go; repeated rows
    stay or go together; null ids and null languages are not learned from but judged like others. An
    empty table gives an empty result.
    """
    fold = F.coalesce(bucket_of("doc_id", 5), F.lit(-1))
    model = fit(docs, (fold != 0) & (fold >= 0))
    seen = docs.select(F.struct("*").alias("row"), model.udf()("text").alias("p"))
    return seen.where((F.col("p.lang") != UNDETERMINED) & (F.col("p.score") >= least_score)).select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op3_language_id": op3_language_id}
ORACLE_SQL: dict[str, str] = {}
