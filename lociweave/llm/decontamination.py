"""Benchmark decontamination by template windows with consistent slots.

A text becomes a template: numbers, names (capitalised words inside a sentence) and units after numbers give
way to typed placeholders, of which a run of one type is one slot; other words give way to their
lower-cased core. Windows of the benchmark's
templates form a hash table that meets every window of every document. Matching windows of an item, on
one diagonal (position in the document less position in the item) or on several in the order of both
texts, form a hit if they are a share of the item's, or if LEAST_RUN words around one of them match in a row; the slots must map the
item's values to the document's one to one, so a question with other numbers or names is caught,
while an accidental run of placeholders is not.

The benchmark is read in blocks of a bounded number of words; each block is one pass over the
documents, and nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, table, text_bytes

WINDOW = 8
#: A window needs so many words that are no slots, and a hit so large a share of its item's windows.
LEAST_LITERALS, LEAST_COVERAGE = 4, 0.3
#: Or so many words in a row, over places where up to MOST_SLIP words are added, left out or changed.
LEAST_RUN, MOST_SLIP = 13, 2
#: Words of benchmark items that one pass over the documents looks for.
BLOCK_WORDS = 2_000_000
MOST_WORDS_KEPT = 400_000
UNITS = frozenset(b"km m cm mm kg g mg lb lbs oz l ml s sec min h hours minutes seconds days weeks months years miles feet inches percent dollars euros degrees".split())
CAPITAL, DIGITS, ENDS, UNIT, BREAK = (np.uint64(1 << i) for i in range(5))
NUMBER_SLOT, NAME_SLOT, UNIT_SLOT = (np.uint64(32 * i) for i in (1, 2, 3))
EDGES = b" \t.,;:!?\"'()[]{}<>*#&%$|-_/\\`~"
NUMBER = re.compile(rb"\W*\d[\d.,:/]*[%a-zA-Z]{0,3}\W*")


class Codes(dict):
    """A word's code from its first use: a hash of its core, and in the lowest five bits what it looks like."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS_KEPT:
            self.clear()
        core = word.strip(EDGES)
        code = (xxhash.xxh64_intdigest(core.lower()) >> 7 << 7) | 1 << 6
        name = core.decode("utf-8", "replace")
        code |= int(CAPITAL) * (name[:1].isupper() and not name.isupper()) | int(DIGITS) * bool(NUMBER.fullmatch(word))
        code |= int(ENDS) * word.rstrip(b"\"')]}*#&%$").endswith((b".", b"!", b"?")) | int(UNIT) * (core.lower() in UNITS)
        self[word] = code = int(BREAK) if word == b"\0" else code
        return code


def template(words: list[bytes], codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Template codes of words, with line breaks as b"\\0" words; and which of the words are no breaks."""
    c = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    real = (c & BREAK) == 0
    before = np.concatenate([[BREAK], c[:-1]])
    opens = (before & (BREAK | ENDS)) != 0
    is_number = (c & DIGITS) != 0
    after_number = np.concatenate([[False], is_number[:-1]])
    out = np.where(is_number, NUMBER_SLOT, np.where((c & UNIT != 0) & after_number, UNIT_SLOT, np.where((c & CAPITAL != 0) & ~opens, NAME_SLOT, c >> np.uint64(6) << np.uint64(6))))
    return out[real], real


def slots(t: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the template's slots begin: every literal, and the first of a run of equal placeholders; no run goes over a position in `first`."""
    run = np.zeros(len(t), bool)
    run[1:] = (t[1:] == t[:-1]) & (t[1:] <= UNIT_SLOT)
    run[first[first < len(t)]] = False
    return np.nonzero(~run)[0]


class Slots:
    """A text's template with one code a slot; the words of a slot are those from its place to the next one's."""

    def __init__(self, codes: np.ndarray, places: np.ndarray, words: list[bytes]):
        self.codes, self.places, self.words = codes.tolist(), [*places.tolist(), len(words)], words

    def value(self, i: int) -> tuple[bytes, ...]:
        return tuple(w.strip(EDGES) for w in self.words[self.places[i] : self.places[i + 1]])


def split(text: bytes) -> list[bytes]:
    return text.replace(b"\n", b" \0 ").split()


def windows(t: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` codes."""
    if len(t) < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        m = mix64(t)
        h = np.zeros(len(t) - size + 1, np.uint64)
        for i in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + m[i : i + len(h)]
        return h ^ (h >> np.uint64(29))


class Same:
    """A one-to-one map between the slot values of an item and a document."""

    def __init__(self, item: Slots, doc: Slots):
        self.item, self.doc, self.to, self.back = item, doc, {}, {}

    def pair(self, i: int, j: int) -> tuple | None:
        """The values of slot i of the item and j of the document, () for a literal; None if their codes differ."""
        if not (0 <= i < len(self.item.codes) and 0 <= j < len(self.doc.codes)) or self.item.codes[i] != self.doc.codes[j]:
            return None
        kind = self.item.codes[i]
        if kind > UNIT_SLOT:
            return ()
        a, b = self.item.value(i), self.doc.value(j)
        if i == 0 and b[-len(a) :] == a or i == len(self.item.codes) - 1 and b[: len(a)] == a:
            b = a  # the document goes on with more of the kind before or after the item
        return (kind, a), (kind, b)

    def take(self, values: list[tuple]) -> bool:
        """Take the pairs into the map, if they agree with it and with one another."""
        to, back = {}, {}
        for v in values:
            if v:
                a, b = v
                if self.to.get(a, to.get(a, b)) != b or self.back.get(b, back.get(b, a)) != a:
                    return False
                to[a], back[b] = b, a
        self.to |= to
        self.back |= back
        return True

    def step(self, i: int, j: int) -> bool:
        v = self.pair(i, j)
        return v is not None and self.take([v])


def in_order(at: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """A longest chain of windows (place in the item, in the document, size) that rises in both places."""
    at, tails, links, last = sorted(at, key=lambda w: (w[0], -w[1])), [], [], []
    for i, (_, p, _) in enumerate(at):
        k = bisect_left(tails, p)
        tails[k : k + 1], last[k : k + 1] = [p], [i]
        links.append(last[k - 1] if k else -1)
    i, out = last[-1] if last else -1, []
    while i >= 0:
        out.append(at[i])
        i = links[i]
    return out[::-1]


class Block:
    """Items of a benchmark, with the table of their windows."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW, coverage: float = LEAST_COVERAGE):
        codes, found = Codes(), defaultdict(list)
        self.ids, self.items, self.totals, self.coverage = [], [], [], coverage
        self.sizes = set()
        for item_id, text in items:
            words = split(text)
            t, real = template(words, codes)
            if not len(t):
                continue
            places = slots(t, np.zeros(1, int))
            t = t[places]
            size = min(window, len(t))
            literal = np.concatenate([[0], np.cumsum(t > UNIT_SLOT)])
            rich = np.nonzero(literal[size:] - literal[:-size] >= min(LEAST_LITERALS, size))[0]
            at = rich if len(rich) else np.arange(len(t) - size + 1)  # items of little but slots keep all their windows
            hashes = windows(t, size)
            for q in at.tolist():
                found[(size, int(hashes[q]))].append((len(self.ids), q))
            self.sizes.add(size)
            self.ids.append(item_id)
            self.items.append(Slots(t, places, [w for w, r in zip(words, real) if r]))
            self.totals.append(len(at))
        self.tables = {}
        for size in self.sizes:
            hashes = np.array(sorted(h for s, h in found if s == size), np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[hashes >> np.uint64(44)] = True
            self.tables[size] = (hashes, seen, [found[(size, h)] for h in hashes.tolist()])

    def hits(self, texts: list[bytes], codes: Codes) -> list[list[tuple]]:
        """For each text, a tuple (item_id, windows, of_windows, changed_slots, at_word) for each item found in it."""
        words = [split(t) for t in texts]
        flat = [w for ws in words for w in (b"\0", *ws)]
        t, real = template(flat, codes)
        own = [[w for w in ws if w != b"\0"] for ws in words]
        ends = np.cumsum([0, *map(len, own)])
        places = slots(t, ends)
        t, bounds = t[places], np.searchsorted(places, ends)
        met = defaultdict(lambda: defaultdict(list))
        for size, (hashes, seen, at_hash) in self.tables.items():
            h = windows(t, size)
            at = np.nonzero(seen[h >> np.uint64(44)])[0]
            to = np.minimum(np.searchsorted(hashes, h[at]), len(hashes) - 1)
            for p, k in zip(*(x[hashes[to] == h[at]].tolist() for x in (at, to))):
                d = int(np.searchsorted(bounds, p, "right")) - 1
                if p + size <= bounds[d + 1]:
                    for item, q in at_hash[k]:
                        p_own = p - int(bounds[d])
                        met[(d, item)][p_own - q].append((q, p_own, size))
        out: list[list] = [[] for _ in texts]
        held, doc = -1, None
        for (d, item), diagonals in sorted(met.items(), key=lambda x: x[0]):
            if d != held:
                lo, hi = int(bounds[d]), int(bounds[d + 1])
                held, doc = d, Slots(t[lo:hi], places[lo:hi] - int(ends[d]), own[d])
            found = [self._consistent(item, at, doc) for _, at in sorted(diagonals.items())]
            found = [x for x in found if x[0]]
            if not found:
                continue
            good, changed = max(found, key=lambda x: len(x[0]))
            if len(found) > 1:
                chained = self._consistent(item, in_order([w for at, _ in found for w in at]), doc)
                if len(chained[0]) > len(good):
                    good, changed = chained
            if len(good) >= self.coverage * self.totals[item] or any(self._run(item, at, doc) >= LEAST_RUN for at, _ in found):
                q, p, _ = good[0]
                out[d].append((self.ids[item], len(good), self.totals[item], changed, doc.places[p] - self.items[item].places[q]))
        return out

    def _consistent(self, item: int, at: list[tuple[int, int, int]], doc: Slots) -> tuple[list[tuple[int, int, int]], int]:
        """Of windows (place in the item, in doc, size) those whose words match one by one and whose slots agree with those before; and the number of slots with another value."""
        same, changed, good = Same(self.items[item], doc), set(), []
        for q, p, size in sorted(set(at)):
            values = [same.pair(q + i, p + i) for i in range(size)]
            if all(v is not None for v in values) and same.take(values):
                good.append((q, p, size))
                changed.update(q + i for i, v in enumerate(values) if v and v[0] != v[1])
        return good, len(changed)

    def _run(self, item: int, at: list[tuple[int, int, int]], doc: Slots) -> int:
        """The most words of the item that match around one of the windows, with consistent slots, past slips of up to MOST_SLIP words."""
        mine, best, done = self.items[item], 0, -1
        slips = sorted(((i, j) for i in range(MOST_SLIP + 1) for j in range(MOST_SLIP + 1) if i or j), key=sum)
        for q, p, size in at:
            if q + size <= done:
                continue
            same, n = Same(mine, doc), 0
            for i in range(size):
                n += same.step(q + i, p + i)
            for way, i, j in ((1, q + size, p + size), (-1, q - 1, p - 1)):
                while True:
                    if same.step(i, j):
                        n, i, j = n + 1, i + way, j + way
                        done = max(done, i)
                        continue
                    for x, y in slips:  # three literals or slots have to match again
                        if all(same.pair(i + way * (x + k), j + way * (y + k)) is not None for k in range(3)) and any(mine.codes[i + way * (x + k)] > UNIT_SLOT for k in range(3)):
                            i, j = i + way * x, j + way * y
                            break
                    else:
                        break
                    if not same.step(i, j):
                        break
                    n, i, j = n + 1, i + way, j + way
            best = max(best, n)
            if best >= LEAST_RUN:
                break
        return best

    def udf(self, id_type: str):
        block = self
        inner = pa.struct([("item_id", {"bigint": pa.int64(), "int": pa.int32()}.get(id_type, pa.string())), ("windows", pa.int32()), ("of_windows", pa.int32()), ("changed_slots", pa.int32()), ("at_word", pa.int32())])

        @F.arrow_udf(f"array<struct<item_id: {id_type}, windows: int, of_windows: int, changed_slots: int, at_word: int>>")
        def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            codes = Codes()
            for batch in batches:
                texts, out, held, size = text_bytes(batch), [], [], 0
                for text in texts:
                    held.append(text)
                    size += len(text)
                    if size > 2_000_000:
                        out += block.hits(held, codes)
                        held, size = [], 0
                out += block.hits(held, codes)
                yield pa.array([[dict(zip(("item_id", "windows", "of_windows", "changed_slots", "at_word"), h)) for h in hs] for hs in out], pa.list_(inner))

        return found


def blocks(benchmark: DataFrame) -> Iterator[Block]:
    """The benchmark in blocks of about BLOCK_WORDS words; one block is on the driver at a time."""
    items = benchmark.where("text is not null and item_id is not null").select("item_id", "text")
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = max(1, -(-words // BLOCK_WORDS))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).orderBy("item_id", "text").toArrow() if n > 1 else items.orderBy("item_id", "text").toArrow()
        yield Block(list(zip(rows["item_id"].to_pylist(), text_bytes(rows["text"].combine_chunks()))))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item found in it: doc_id, item_id, windows, of_windows, coverage, changed_slots, at_word.

    windows: matching windows with consistent slots, of the item's of_windows; at_word: where the
    item's first word would stand in the document. Items shorter than a window are one window.
    Null or empty texts, on either side, match nothing; items without an id are skipped; repeated
    documents and items give repeated rows. Empty tables give an empty result. Other columns are
    not read.
    """
    kind = dict(benchmark.dtypes)["item_id"]
    parts = [docs.select("doc_id", F.explode(b.udf(kind)("text")).alias("h")).select("doc_id", "h.*") for b in blocks(benchmark)]
    out = reduce(DataFrame.unionAll, parts)
    return out.select("doc_id", "item_id", "windows", "of_windows", (F.col("windows") / F.col("of_windows")).alias("coverage"), "changed_slots", "at_word")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows in which an item of the benchmark is found."""
    kind = dict(benchmark.dtypes)["item_id"]
    for b in blocks(benchmark):
        docs = docs.where(F.size(b.udf(kind)(F.coalesce("text", F.lit("")))) == 0)
    return docs


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_benchmark_decontamination": op4_benchmark_decontamination}
ORACLE_SQL: dict[str, str] = {}
