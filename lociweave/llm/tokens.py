"""Token counts by a compiled finite-state tokenizer.

The tokenizer file is compiled once, on the driver, into two deterministic transducers. The first
cuts a text into words: five states, seven kinds of character, and a mark on each transition that
starts a word. A text is dealt into chunks of equal length; all chunks step together, from every
state at once, which gives each chunk a map from entry state to exit state; a parallel prefix scan
composes the maps, so each chunk's true entry state is known, and a second pass emits the marks.
The second reads a word symbol by symbol. Its automaton is a trie of the vocabulary with failure
links, so after each symbol it knows the tokens that end there, longest first. The tokens of a prefix
end with the one of these that is compatible with the last token of what lies before it; compatible
means that no merge across the cut comes before the merges that made the two. Each transition
thus gives the number of tokens emitted so far, in time linear in the word. Words are cached.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CHUNK = 128
#: Characters that are cut together, at least one text; and words and pairs of tokens that a worker keeps before it starts anew.
BLOCK_CHARS, MOST_KEPT = 1_000_000, 400_000
#: Symbols of a word: its bytes, the last of which is another symbol than the same byte inside.
SYMBOLS, LAST_BYTE = 512, 256
#: Unicode's white space.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
SPACE, LETTER, NUMBER, OTHER, QUOTE, QUOTE_1, QUOTE_2 = range(7)
IDLE, WORD_, SIGNS, LAST, LAST_TWO = range(5)


def cutter() -> tuple[np.ndarray, np.ndarray]:
    """NEXT and STARTS of state * 8 + kind, for the pattern that splits contractions, letters, single digits and runs of other signs."""
    to, starts = np.zeros(40, np.uint8), np.zeros(40, bool)
    for state in (IDLE, WORD_, SIGNS):
        for kind, goal in ((SPACE, IDLE), (LETTER, WORD_), (NUMBER, IDLE), (OTHER, SIGNS), (QUOTE, SIGNS), (QUOTE_1, LAST), (QUOTE_2, LAST_TWO)):
            inside = state == SIGNS and kind >= OTHER  # a quote inside a run of signs belongs to the run
            to[state * 8 + kind] = SIGNS if inside else goal
            starts[state * 8 + kind] = not (kind == SPACE or inside or state == WORD_ and kind == LETTER)
    for kind in range(7):
        to[LAST * 8 + kind], to[LAST_TWO * 8 + kind] = IDLE, LAST
    return to, starts


def kinds_of_characters() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        major = unicodedata.category(chr(i))[0]
        if major in "LN":
            kinds[i] = LETTER if major == "L" else NUMBER
    kinds[SPACES] = SPACE
    kinds[ord("'")] = QUOTE
    return kinds


class TokenTransducer:
    """The compiled tokenizer: count(texts) gives the number of tokens of each."""

    def __init__(self, spec: dict):
        model = spec["model"]
        wanted = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
        if model["type"] != "BPE" or spec["normalizer"]["normalizers"] != wanted or model["continuing_subword_prefix"]:
            raise ValueError("only lower-casing byte-level BPE with word ends can be compiled")
        # printable bytes stand for themselves, the others for the characters from 256 on
        plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        spare = iter(range(256, 512))
        suffix, names = model["end_of_word_suffix"], {}
        for b in range(256):
            letter = chr(b) if b in plain else chr(next(spare))
            names[letter], names[letter + suffix] = b, LAST_BYTE + b
        # tokens are numbered in order of their merges, after the symbols
        self.parts, self.lengths, spelled = [], [1] * SYMBOLS, [(i,) for i in range(SYMBOLS)]
        for i, m in enumerate(model["merges"], SYMBOLS):
            u, t = m if isinstance(m, list) else m.split(" ")
            self.parts.append((names[u], names[t]))
            if u + t in names:
                raise ValueError("two merges make one token")
            names[u + t] = i
            spelled.append(spelled[names[u]] + spelled[names[t]])
            self.lengths.append(len(spelled[i]))
        self.merges = {pair: i for i, pair in enumerate(self.parts, SYMBOLS)}
        self._compile(spelled)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"])) if spec["added_tokens"] else None
        self.kinds = kinds_of_characters()
        self.next, self.starts = cutter()
        self.words_kept: dict[str, int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def _compile(self, spelled: list[tuple[int, ...]]) -> None:
        """The trie's transitions, by node * SYMBOLS + symbol; of each node its failure link and the longest token that ends there; of each token the next shorter one."""
        self.to, ends, depth_first = {}, [-1], [0]
        for token, symbols in enumerate(spelled):
            node = 0
            for x in symbols:
                at = node * SYMBOLS + x
                if at not in self.to:
                    self.to[at] = len(ends)
                    ends.append(-1)
                node = self.to[at]
            ends[node] = token
        below: list[list[tuple[int, int]]] = [[] for _ in ends]
        for at, node in self.to.items():
            below[at // SYMBOLS].append((at % SYMBOLS, node))
        self.fail, self.longest, self.shorter = [0] * len(ends), ends[:], [-1] * len(spelled)
        for node in depth_first:  # the list grows: breadth first
            for x, child in below[node]:
                depth_first.append(child)
                if node:
                    self.fail[child] = self._goto(self.fail[node], x)
                if ends[child] >= 0:
                    self.shorter[ends[child]] = self.longest[self.fail[child]] if node else -1
                else:
                    self.longest[child] = self.longest[self.fail[child]]

    def _goto(self, node: int, symbol: int) -> int:
        to = self.to
        while True:
            at = node * SYMBOLS + symbol
            if at in to:
                return to[at]
            node = self.fail[node]

    def compatible(self, u: int, t: int) -> bool:
        """Whether u and t stay apart side by side. The merges that made them are undone, the latest first (of equal ones
        that of t, as the left of two equal merges comes first); none that came later may be one across the cut."""
        known = self.pairs.get((u, t))
        if known is None:
            if len(self.pairs) > MOST_KEPT:
                self.pairs.clear()
            key, limit, known = (u, t), len(self.lengths), None
            while known is None:
                if self.merges.get((u, t), limit) < limit:
                    known = False
                elif max(u, t) < SYMBOLS:
                    known = True
                elif u > t:
                    limit, u = u, self.parts[u - SYMBOLS][1]
                else:
                    limit, t = t + 1, self.parts[t - SYMBOLS][0]
            self.pairs[key] = known
        return known

    def emitted(self, word: str) -> int:
        """Tokens of one word, in time linear in its length."""
        symbols = word.encode()
        last, count, node = [-1], [0], 0
        to, fail, longest, shorter, lengths, end = self.to, self.fail, self.longest, self.shorter, self.lengths, len(symbols)
        for i, x in enumerate(symbols, 1):
            if i == end:
                x += LAST_BYTE
            at = node * SYMBOLS + x
            while at not in to:
                node = fail[node]
                at = node * SYMBOLS + x
            node = to[at]
            t = longest[node]
            j = i - lengths[t]
            while j and not self.compatible(last[j], t):
                t = shorter[t]
                j = i - lengths[t]
            last.append(t)
            count.append(count[j] + 1)
        return count[-1]

    def marks(self, kinds: np.ndarray) -> np.ndarray:
        """Which characters start a word."""
        n = len(kinds)
        grid = np.zeros(-(-n // CHUNK) * CHUNK, np.uint8)
        grid[:n] = kinds
        grid = np.ascontiguousarray(grid.reshape(-1, CHUNK).T)
        maps = np.repeat(np.arange(5, dtype=np.uint8)[:, None], grid.shape[1], 1)
        for row in grid:
            maps = self.next[(maps << 3) | row]
        step = 1
        while step < maps.shape[1]:
            maps = np.concatenate([maps[:, :step], np.take_along_axis(maps[:, step:], maps[:, :-step].astype(np.int64), 0)], 1)
            step *= 2
        state = np.concatenate([[IDLE], maps[IDLE, :-1]]).astype(np.uint8)
        out = np.empty(grid.shape, bool)
        for i, row in enumerate(grid):
            at = (state << 3) | row
            out[i], state = self.starts[at], self.next[at]
        return out.T.reshape(-1)[:n]

    def words(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words of a normalised text."""
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.kinds[c]
        quotes = np.nonzero(kinds == QUOTE)[0]
        if len(quotes):
            after = np.concatenate([c, np.zeros(2, np.uint32)])
            a, b = after[quotes + 1], after[quotes + 2]
            kinds[quotes[np.isin(a, [ord(x) for x in "stmd"])]] = QUOTE_1
            two = (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            kinds[quotes[two]] = QUOTE_2
        marks = self.marks(kinds)
        cuts = np.append(np.nonzero(marks | (kinds == SPACE))[0], len(c))
        starts = np.nonzero(marks[cuts[:-1]])[0]
        return cuts[starts], cuts[starts + 1]

    def count(self, texts: list[str | None]) -> np.ndarray:
        out, held, size, first = np.zeros(len(texts), np.int64), [], 0, 0
        for i, text in enumerate(texts):
            text = text or ""
            if self.special is not None and "<" in text:
                text, out[i] = self.special.subn("\n", text)
            if not text.isascii():
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            held.append(text.lower())
            size += len(held[-1]) + 1
            if size >= BLOCK_CHARS or i + 1 == len(texts):
                out[first : i + 1] += self._block(held)
                held, size, first = [], 0, i + 1
        return out

    def _block(self, texts: list[str]) -> np.ndarray:
        whole = "\n".join(texts)
        starts, ends = self.words(whole)
        if len(self.words_kept) > MOST_KEPT:
            self.words_kept.clear()
        words = [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        for w in set(words).difference(self.words_kept):
            self.words_kept[w] = self.emitted(w)
        upto = np.concatenate([[0], np.cumsum(np.fromiter(map(self.words_kept.__getitem__, words), np.int64, len(words)))])
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
        return np.diff(upto[np.searchsorted(starts, bounds)])

    def udf(self):
        compiled = self

        @F.arrow_udf("bigint")
        def counted(text: pa.Array) -> pa.Array:
            return pa.array(compiled.count(text.to_pylist()))

        return counted


def compiled(path: str) -> TokenTransducer:
    with open(path, encoding="utf-8") as f:
        return TokenTransducer(json.load(f))


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    tokenizer: the path of a tokenizer file on the driver; executors get the compiled transducer.
    Null text counts as empty, with 0 bytes and tokens. Each special token inside a text is one
    token. Repeated rows get equal results; an empty table gives an empty result; ids pass through.
    """
    n = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    counted = docs.select("doc_id", n.alias("n_bytes"), compiled(tokenizer).udf()("text").alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLE_SQL: dict[str, str] = {}
