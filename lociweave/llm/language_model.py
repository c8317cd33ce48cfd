"""LM scoring: a hashed maximum-entropy model with class-factored softmax.

A token's probability is that of its class in context, times that of its subclass in the class and
context, times that of the token in its subclass. Classes are the most frequent tokens, one each,
and hashes of the last two bytes for all others; subclasses are hashes of whole tokens. Both
softmaxes (Layer) have hashed features of the words themselves, frequent or rare, with their classes as the first bits: the word before
(n-gram), the word before that (skip) and the two together (n-gram), beside a bias; those of the
second are told apart by class. Within a subclass a token's probability is its count plus a half over the subclass's, with
one place for unseen words.

Feature counts cover all learning documents. The expected counts come from the contexts (hashes of
the two words before) that occur: each gradient step is one Spark job, whose tasks hold a share of
the contexts and the weight rows that only these contexts use, so the parts hardly overlap.
The hashes have more bits the more tokens there are, up to GROW bits more: the weights and
normalisers that tasks get are bounded (Layer.size) at 77 MB.

Token counts cover all learning documents. The most frequent HEAD tokens travel to the executors;
the counts of all others meet the documents in a shuffle join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, materialise, mix64, small_batches, table, text_bytes

HEAD, SINGLE, HASHED, SUBCLASSES = 1 << 18, 64, 64, 64
LEAVES = SINGLE + HASHED * SUBCLASSES
STEPS, RATE, PRIOR = 8, 0.4, 2.0
#: Hashes of words have one bit more for each eightfold of so many tokens, up to GROW bits more.
GROW_FROM, GROW = 1 << 17, 6
#: Contexts are dealt by so many low bits of the word before.
SHARE_BITS, SHARES = 4, 8
#: The low half of a token's number is its code, the high half its class and, in higher bits, a hash of the word.
CODE = (1 << 32) - 1
#: No word holds a line break, so it can stand for the end.
END = b"\n"
MOST_WORDS_HELD = 400_000
MOST_CODES_HELD = 150_000
BLOCK_BYTES = 500_000
BATCH_ROWS = 1024


def blocks(column: pa.Array) -> Iterator[list[list[bytes]]]:
    """Words of each text, in runs of texts of bounded size, one text at least."""
    held, size = [], 0
    for text in text_bytes(column):
        held.append(text.lower().split())
        size += len(text)
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def token_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts; counted in each task before the shuffle."""

    def count(batches):
        counts: Counter = Counter()
        for batch in batches:
            for docs in blocks(batch.column(0)):
                for words in docs:
                    counts.update(words)
                counts[END] += len(docs)
                if len(counts) > MOST_WORDS_HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])
                    counts.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

    return texts.mapInArrow(count, "word binary, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def leaf_of(word: bytes) -> int:
    """The leaf of a word that has no class of its own."""
    return SINGLE + crc32(word[-2:]) % HASHED * SUBCLASSES + crc32(word) % SUBCLASSES


def class_of(leaf: int) -> int:
    return leaf if leaf < SINGLE else SINGLE + (leaf - SINGLE) // SUBCLASSES


def numbered_as(word: bytes, code: int, leaf: int) -> int:
    return (xxhash.xxh64_intdigest(word) >> 40 << 7 | class_of(leaf)) << 32 | code


class Codes(dict):
    """A token's number: its hash, and as code its place in the head, or the head's size plus its leaf less SINGLE."""

    def __init__(self, head: list[bytes]):
        super().__init__((w, numbered_as(w, i, i if i < SINGLE else leaf_of(w))) for i, w in enumerate(head))
        self.head, self.most = len(head), len(head) + MOST_CODES_HELD

    def __missing__(self, word: bytes) -> int:
        leaf = leaf_of(word)
        number = numbered_as(word, self.head + leaf - SINGLE, leaf)
        if len(self) < self.most:
            self[word] = number
        return number


@dataclass
class Vocabulary:
    """The head, most frequent first; its counts; the totals of all learning tokens and of each leaf."""

    head: list[bytes]
    counts: np.ndarray
    tokens: int
    distinct: int
    leaf_tokens: np.ndarray
    leaf_distinct: np.ndarray

    def leaves(self) -> np.ndarray:
        """The leaf of each code: a class of one token, or a subclass; the end has leaf 0."""
        found = [leaf_of(w) for w in self.head]
        found[:SINGLE] = range(len(found[:SINGLE]))
        return np.array(found + list(range(SINGLE, LEAVES)), np.int64)


@dataclass(frozen=True)
class Layer:
    """A softmax over `outputs`; its context is a class of its own, the word before and the one before that, by `own`, `one` and `two` bits.

    Weight rows: a bias for each class, class with word before, class with word two back, and all three hashed to `pair` bits.
    """

    own: int
    one: int
    two: int
    pair: int
    outputs: int

    @property
    def contexts(self) -> int:
        return 1 << (self.own + self.one + self.two)

    @property
    def rows(self) -> int:
        return (1 << self.own) + (1 << (self.own + self.one)) + (1 << (self.own + self.two)) + (1 << self.pair)

    @property
    def size(self) -> int:
        """Numbers in the weights and the normalisers."""
        return self.rows * self.outputs + self.contexts

    def context(self, own, before: np.ndarray, skipped: np.ndarray) -> np.ndarray:
        return (own << (self.one + self.two)) | ((before & ((1 << self.one) - 1)) << self.two) | (skipped & ((1 << self.two) - 1))

    def active(self, context: np.ndarray) -> list[np.ndarray]:
        """The four rows of each context; those of the word before and of both words are used in one share only."""
        own, share = context >> (self.one + self.two), (context >> self.two) & ((1 << SHARE_BITS) - 1)
        second, third = 1 << self.own, (1 << self.own) + (1 << (self.own + self.one))
        low = self.pair - SHARE_BITS
        both = (mix64(context.astype(np.uint64) + np.uint64(1)) & np.uint64((1 << low) - 1)).astype(np.int64)
        return [own, second + (context >> self.two), third + (own << self.two | context & ((1 << self.two) - 1)), third + (1 << (self.own + self.two)) + (share << low | both)]

    def scores(self, weights: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of active weights, for each context and output, and their log normalisers."""
        z = sum(weights[r] for r in self.active(context))
        most = z.max(1, keepdims=True)
        return z, most[:, 0] + np.log(np.exp(z - most).sum(1))

    def normalisers(self, weights: np.ndarray) -> np.ndarray:
        """The log normaliser of every context."""
        out = np.zeros(self.contexts, np.float32)
        for lo in range(0, self.contexts, 4096):
            context = np.arange(lo, min(lo + 4096, self.contexts))
            out[context] = self.scores(weights, context)[1]
        return out

    def log_probability(self, weights: np.ndarray, norm: np.ndarray, context: np.ndarray, output: np.ndarray) -> np.ndarray:
        """Of each output in its context: four weights and one normaliser."""
        flat = weights.reshape(-1)
        return sum(flat[r * self.outputs + output] for r in self.active(context)) - norm[context]


def layers_of(tokens: int) -> tuple[Layer, Layer]:
    """The layers of classes and of subclasses, for so many learning tokens."""
    more = min(GROW, (tokens // GROW_FROM).bit_length() // 3)
    return Layer(0, 8 + more, 7, 10 + more, SINGLE + HASHED), Layer(6, 4 + more, 4, 8 + more, SUBCLASSES)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From (word, c): the head's threshold comes from a histogram of counts with a bounded number of rows."""
    level = F.when(F.col("c") < 4096, F.col("c")).otherwise(F.floor(F.log2("c") * 64) + 4096 - 768).cast("int")
    levels = sorted(((r["level"], r["n"], r["least"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()), reverse=True)
    size, least = 0, 1 << 62
    for _, n, c in levels:
        if size + n > HEAD:
            break
        size, least = size + n, c
    top = counts.where((F.col("c") >= least) | (F.col("word") == F.lit(END))).toArrow()
    pairs = sorted(zip(top["word"].to_pylist(), top["c"].to_pylist()), key=lambda p: (p[0] != END, -p[1], p[0]))
    head = [w for w, _ in pairs] or [END]
    single = F.col("word").isin(head[:SINGLE])
    leaf = F.crc32(F.substring("word", -2, 2)) % HASHED * SUBCLASSES + F.crc32("word") % SUBCLASSES
    rows = counts.where(~single).groupBy(leaf.cast("int").alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    n, v = np.zeros(LEAVES), np.zeros(LEAVES)
    for i, (_, c) in enumerate(pairs[:SINGLE]):
        n[i], v[i] = c, 1
    for r in rows:
        n[SINGLE + r["k"]], v[SINGLE + r["k"]] = r["n"], r["v"]
    return Vocabulary(head, np.array([c for _, c in pairs] or [0]), int(n.sum()), int(v.sum()), n, v)


def flat_codes(docs: list[list[bytes]], codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all texts' tokens in a row, each text as end, words, end; and where each begins."""
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    starts = np.concatenate([[0], np.cumsum(lengths + 2)])
    out = np.full(starts[-1], codes[END], np.int64)
    for at, words in zip(starts.tolist(), docs):
        out[at + 1 : at + 1 + len(words)] = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
    return out, starts


def events(flat: np.ndarray, starts: np.ndarray, leaves: np.ndarray, layers: tuple[Layer, Layer]):
    """The places of all tokens but the ends that begin texts; their leaves; and for each layer, which of them have an output there, contexts and outputs."""
    inside = np.ones(len(flat), bool)
    inside[starts[:-1]] = False
    at = np.flatnonzero(inside)
    word, leaf = flat >> 32, leaves[flat[at] & CODE]
    before, skipped = word[at - 1], word[at - 2]  # two before the first token of a text stands an end
    low = np.flatnonzero(leaf >= SINGLE)
    kind, sub = np.divmod(leaf[low] - SINGLE, SUBCLASSES)
    first = leaf.copy()
    first[low] = SINGLE + kind
    top, bottom = layers
    return at, leaf, [(slice(None), top.context(0, before, skipped), first), (low, bottom.context(kind, before[low], skipped[low]), sub)]


def statistics(texts: DataFrame, words: Vocabulary) -> DataFrame:
    """(part, cell, n): how often row and output (parts 0 and 1, a layer each) and context (parts 2 and 3) occur over all tokens of texts."""
    head, leaves, layers = words.head, words.leaves(), layers_of(words.tokens)

    def count(batches):
        codes, one = Codes(head), np.int32(1)
        pairs, contexts = [np.zeros(x.rows * x.outputs, np.int32) for x in layers], [np.zeros(x.contexts, np.int32) for x in layers]
        for batch in batches:
            for docs in blocks(batch.column(0)):
                _, _, found = events(*flat_codes(docs, codes), leaves, layers)
                for layer, seen, total, (_, context, output) in zip(layers, pairs, contexts, found):
                    np.add.at(total, context, one)
                    for r in layer.active(context):
                        np.add.at(seen, r * layer.outputs + output, one)
        for part, total in enumerate([*pairs, *contexts]):
            at = np.flatnonzero(total)
            for lo in range(0, len(at), 100_000):
                cell = at[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), part, np.int32)), pa.array(cell.astype(np.int32)), pa.array(total[cell].astype(np.int64))], ["part", "cell", "n"])

    return texts.mapInArrow(count, "part int, cell int, n bigint").groupBy("part", "cell").agg(F.sum("n").alias("n"))


def add_rows(out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """out[rows] += values, with repeats in rows."""
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    out[rows[first]] += np.add.reduceat(values[order], first, axis=0)


def expected(layer: Layer, weights: np.ndarray, context: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Expected counts of each row and output, over contexts that occur n times."""
    out = np.zeros(weights.shape, np.float32)
    for lo in range(0, len(context), 4096):
        part = context[lo : lo + 4096]
        z, norm = layer.scores(weights, part)
        p = np.exp(z - norm[:, None]) * n[lo : lo + 4096, None].astype(np.float32)
        for r in layer.active(part):
            add_rows(out, r, p)
    return out


def train(counts: DataFrame, words: Vocabulary) -> list[np.ndarray]:
    """The weights of each layer, by STEPS distributed gradient steps from the bias of output frequencies.

    A step is divided by the greater of seen and expected counts, a bound of the curvature.
    """
    layers = layers_of(words.tokens)
    counts = materialise(counts, "statistics")
    share = F.when(F.col("part") == 2, F.shiftright("cell", layers[0].two)).otherwise(F.shiftright("cell", layers[1].two)).bitwiseAND((1 << SHARE_BITS) - 1)
    dealt = materialise(counts.where("part >= 2").repartition(SHARES, share), "contexts")
    seen, weights = [], []
    for part, layer in enumerate(layers):
        found = counts.where(F.col("part") == part).select("cell", F.col("n").cast("float").alias("n")).toArrow()
        up = np.zeros(layer.rows * layer.outputs, np.float32)
        up[found["cell"].to_numpy()] = found["n"].to_numpy()
        seen.append(up.reshape(layer.rows, layer.outputs))
        weights.append(np.zeros((layer.rows, layer.outputs), np.float32))
        weights[-1][: 1 << layer.own] = np.log(seen[-1][: 1 << layer.own] + 0.5)

    for _ in range(STEPS):
        now = [w.copy() for w in weights]

        def gradient(batches):
            held = [b for b in batches if b.num_rows]  # a share of a bounded number of contexts
            if held:
                part, cell, n = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
                for i, layer in enumerate(layers):
                    own = part == i + 2
                    order = np.argsort(cell[own])
                    out = expected(layer, now[i], cell[own][order].astype(np.int64), n[own][order])
                    rows = np.flatnonzero(out.any(1))
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([rows.tobytes()], pa.binary()), pa.array([out[rows].tobytes()], pa.binary())], ["layer", "rows", "counts"])

        model = [np.zeros_like(w) for w in weights]
        for r in dealt.mapInArrow(gradient, "layer int, rows binary, counts binary").toArrow().to_pylist():
            rows = np.frombuffer(r["rows"], np.int64)
            model[r["layer"]][rows] += np.frombuffer(r["counts"], np.float32).reshape(len(rows), layers[r["layer"]].outputs)
        for layer, w, up, down in zip(layers, weights, seen, model):
            pull = PRIOR * w
            pull[: 1 << layer.own] = 0
            w += RATE * np.clip((up - down - pull) / (np.maximum(up, down) + PRIOR), -3, 3)
    return weights


def score(docs: DataFrame, folds: int = 5, held: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32 of doc_id, as text, modulo `folds` is not `held`; rows with a null
    doc_id have no fold: they are scored, not learned from. Null text counts as empty, which is one
    token, the end. With nothing to learn from, base_score is 0 and all classes are alike. Repeated
    rows are learned from each time, and get equal results; sums over rare words, which a shuffle
    adds up in any order, are rounded to six places for that. An empty table gives an empty result.
    """
    fold = F.coalesce(bucket_of("doc_id", folds), F.lit(-1))
    texts = docs.where((fold != held) & (fold >= 0)).select("text")
    with small_batches(docs.sparkSession, BATCH_ROWS):
        counts = materialise(token_counts(texts), "token-counts")
        words = vocabulary(counts)
        return _scored(docs, fold == held, words, train(statistics(texts, words), words), counts)


def _scored(docs: DataFrame, held_out, words: Vocabulary, weights: list[np.ndarray], counts: DataFrame) -> DataFrame:
    head, leaves, layers = words.head, words.leaves(), layers_of(words.tokens)
    norms = [layer.normalisers(w) for layer, w in zip(layers, weights)]
    rest = LEAVES - SINGLE
    gain = np.concatenate([np.log10(words.counts + 0.5), np.zeros(rest)])
    within = np.log10(words.leaf_tokens + 0.5 * (words.leaf_distinct + 1))
    whole = float(np.log10(words.tokens + 0.5 * (words.distinct + 1)))
    known = np.concatenate([words.counts > 0, np.zeros(rest, bool)]).astype(np.int64)

    def work(batches):
        codes = Codes(head)
        for batch in batches:
            first = 0
            for docs in blocks(batch.column(2)):
                flat, starts = flat_codes(docs, codes)
                at, leaf, found = events(flat, starts, leaves, layers)
                steps = -within[leaf]
                for layer, w, norm, (which, context, output) in zip(layers, weights, norms, found):
                    steps[which] += layer.log_probability(w, norm, context, output) / np.log(10)
                code = flat[at] & CODE
                begins = starts[:-1] - np.arange(len(docs))
                sums = [np.add.reduceat(x, begins) for x in (np.ones(len(at), np.int64), known[code], gain[code], steps)]
                rare = code >= len(head)
                tails = [dict(Counter(w for w, r in zip(words_, rare[lo : lo + len(words_)].tolist()) if r)) for lo, words_ in zip(begins.tolist(), docs)]
                rows = slice(first, first + len(docs))
                first = rows.stop
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i)[rows.start : rows.stop] for i in (0, 1, 3)), *map(pa.array, sums),
                     pa.array([list(t) for t in tails], pa.list_(pa.binary())), pa.array([list(t.values()) for t in tails], pa.list_(pa.int64()))],
                    ["rid", "doc_id", "held_out", "n_tokens", "n_known", "gain", "steps", "tail", "times"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    part = materialise(rows.mapInArrow(work, f"rid bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, gain double, steps double, tail array<binary>, times array<bigint>"), "scored")
    tail = part.select("rid", F.explode(F.arrays_zip("tail", "times")).alias("t")).select("rid", F.col("t.tail").alias("word"), "t.times")
    found = tail.join(counts, "word", "left").groupBy("rid").agg(
        F.round(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)), 6).alias("rare_gain"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known")
    )
    gain_all = F.col("gain") + F.coalesce("rare_gain", F.lit(0.0))
    return part.drop("tail", "times").join(found, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(words.tokens).cast("long").alias("train_tokens"),
        (gain_all - F.col("n_tokens") * F.lit(whole)).alias("base_score"), (gain_all + F.col("steps")).alias("score"),
    )


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op5_lm_score": op5_lm_score}
ORACLE_SQL: dict[str, str] = {}
