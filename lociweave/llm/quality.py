"""Quality classifier: a factorisation machine over hashed words, structure statistics and size.

Every pair of features interacts through the product of their low-rank factors; the sum over all
pairs is half of (square of the sum - sum of the squares) in each rank, so a text is scored in time
linear in its features. Fitted on the driver by AdaGrad on a bounded sample of labelled rows, then
sent to the executors, which score every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, table, text_bytes

WORD_DIM, RANK = 1 << 15, 8
STATISTICS = ("bias", "log_words", "log_bytes", "word_length", "distinct_words", "signs", "upper", "digits", "wide", "line_words", "repeated_lines", "signed_words", "lone_signs", "short_words")
DIM = WORD_DIM + len(STATISTICS)
#: The model is fitted on at most about this many labelled rows of each label.
SAMPLE_PER_LABEL = 3000
MOST_WORDS_KEPT = 400_000
#: Classes of bytes: 1 upper case, 2 digit, 4 sign, 8 part of a character beyond ASCII.
BYTE_CLASS = np.array([1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 8 if b > 127 else 4 if b > 32 and not chr(b).isalnum() else 0 for b in range(256)], np.uint8)


class WordIds(dict):
    """Hash of a lower-cased word, kept from its first use."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS_KEPT:
            self.clear()
        self[word] = i = crc32(word) % WORD_DIM
        return i


def features(text: bytes, ids: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of a text's features: words with unit length in all, then the statistics."""
    words = text.lower().split()
    n = len(words)
    at, counts = np.unique(np.fromiter(map(ids.__getitem__, words), np.int32, n), return_counts=True)
    x = 1 + np.log(counts)
    x /= max(float(np.sqrt((x * x).sum())), 1.0)
    kinds = np.bincount(BYTE_CLASS[np.frombuffer(text, np.uint8)], minlength=9)
    size, some = max(len(text), 1), max(n, 1)
    lines = [s for s in text.split(b"\n") if s]
    last = np.fromiter((w[-1] for w in words), np.uint8, n)
    lengths = np.fromiter(map(len, words), np.int64, n)
    stats = np.array([
        1.0, np.log1p(n) / 10, np.log1p(len(text)) / 12, min(lengths.sum() / some / 10, 3), len(at) / some, kinds[4] / size * 4, kinds[1] / size * 2, kinds[2] / size * 4,
        kinds[8] / size, min(some / max(len(lines), 1) / 50, 3), 1 - len(set(lines)) / max(len(lines), 1), (BYTE_CLASS[last] == 4).sum() / some, ((lengths == 1) & (BYTE_CLASS[last] == 4)).sum() / some * 2, (lengths <= 2).sum() / some,
    ])
    return np.concatenate([at, np.arange(WORD_DIM, DIM, dtype=np.int32)]), np.concatenate([x, stats])


@dataclass
class FactorisationMachine:
    linear: np.ndarray
    factors: np.ndarray
    shift: float = 0.0

    @classmethod
    def fit(cls, data: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 8, rate: float = 0.08, decay: float = 1e-5) -> FactorisationMachine:
        """AdaGrad on the log loss, one example at a time in a fixed random order."""
        rng = np.random.default_rng(11)
        w, v = np.zeros(DIM), rng.normal(0, 0.03, (DIM, RANK))
        gw, gv = np.full(DIM, 1e-6), np.full((DIM, RANK), 1e-6)
        for _ in range(epochs):
            for i in rng.permutation(len(data)):
                at, x, label = data[i]
                own = v[at]
                sums = x @ own
                z = x @ w[at] + 0.5 * float((sums * sums - (x * x) @ (own * own)).sum())
                miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label
                dw = miss * x + decay * w[at]
                dv = miss * (x[:, None] * sums - (x * x)[:, None] * own) + decay * own
                gw[at] += dw * dw
                gv[at] += dv * dv
                w[at] -= rate * dw / np.sqrt(gw[at])
                v[at] -= rate * dv / np.sqrt(gv[at])
        return cls(w, v)

    def logit(self, at: np.ndarray, x: np.ndarray) -> float:
        own = self.factors[at]
        sums = x @ own
        return float(x @ self.linear[at] + 0.5 * (sums * sums - (x * x) @ (own * own)).sum()) + self.shift

    def udf(self):
        model = FactorisationMachine(self.linear.astype(np.float32), self.factors.astype(np.float32), self.shift)

        @F.arrow_udf("double")
        def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            ids = WordIds()
            for text in batches:
                z = np.array([model.logit(*features(t, ids)) for t in text_bytes(text)])
                yield pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return scored


def fit(docs: DataFrame, labels: DataFrame, learn_from) -> FactorisationMachine:
    """A model from the labels (doc_id, quality) that the column learn_from admits; one that says 0.5 if there are none."""
    known = labels.where(learn_from).select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)").distinct()
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if not counts:
        return FactorisationMachine(np.zeros(DIM), np.zeros((DIM, RANK)))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, SAMPLE_PER_LABEL / n))))
    few = known.where(draw < share[F.col("quality")])  # distinct, so at most about 2 * SAMPLE_PER_LABEL rows

    def vectors(batches):
        ids = WordIds()
        for batch in batches:
            found = [features(t, ids) for t in text_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.tobytes() for a, _ in found], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in found], pa.binary())], ["quality", "draw", "at", "x"])

    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").dropDuplicates().select("quality", draw.alias("draw"), "text")  # repeated documents teach once
    got = rows.mapInArrow(vectors, "quality int, draw double, at binary, x binary").toArrow().sort_by([("draw", "ascending"), ("quality", "ascending"), ("at", "ascending")])
    data = [(np.frombuffer(a, np.int32), np.frombuffer(x, np.float32).astype(float), q) for q, a, x in zip(*(got[c].to_pylist() for c in ("quality", "at", "x")))]
    if not data:
        return FactorisationMachine(np.zeros(DIM), np.zeros((DIM, RANK)))
    model = FactorisationMachine.fit(data)
    drawn = {k: min(n, SAMPLE_PER_LABEL) for k, n in counts.items()}
    if len(counts) == 2:  # from the sample's share of labels to that of all labels
        model.shift = float(np.log(counts[1] / counts[0]) - np.log(drawn[1] / drawn[0]))
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Learns from labels whose crc32 of doc_id, as text, modulo `folds` is not `held`; null ids and
    null labels teach nothing, null ids are not held out. Repeated labels and documents teach once. Null text counts as empty and is scored
    like any other. Without labels of documents every score is 0.5. Repeated rows get equal results. An empty
    table gives an empty result.
    """
    fold = F.coalesce(bucket_of("doc_id", folds), F.lit(-1))
    model = fit(docs, labels, (fold != held) & (fold >= 0))
    return docs.select("doc_id", (fold == held).alias("held_out"), model.udf()("text").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op7_quality_classifier": op7_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
