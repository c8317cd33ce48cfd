"""Substring dedup: windows of words that also start in an earlier document, by an FM-index per shard.

Only stretches that can match travel. Each window of 13 words has an anchor, the least hash among
its runs of 5 words; equal windows have equal anchors. One shuffle of anchors shows which occur in
two documents or more. The stretches around those, as long as their windows share the anchor, go to
the shard of the anchor, where equal stretches are one. Each shard builds a compressed FM-index over
its distinct stretches and streams them through backward search, which carries the match of a
stretch from word to word: where the matching statistic reaches 13, the least document of the rows in
range decides. What comes back to a document is the runs of words to remove.

An anchor that a task meets in two documents is known to be shared there and then; its rows are dealt
by document and it sends one row by hash, so a passage that is everywhere makes no large group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, discard, materialise, mix64, release, table, text_bytes, whole_ids
from .fm_index import FMIndex

WINDOW, RUN = 13, 5
CHUNK_ANCHORS, CHUNK_BYTES, SLICE = 500_000, 1_000_000, 512
SHARD_ANCHORS = 40_000
#: A shard of more stretches is dealt anew by the hashes of its windows.
HOT_SHARD = 8 * SHARD_ANCHORS
MOST_WORDS_KEPT = 400_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def anchors(docs: list[list[bytes]], hashes: WordHashes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of each text: text, start, place of its anchor (both within the text) and the anchor's hash."""
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    begins = np.concatenate([[0], np.cumsum(lengths)])
    h = np.fromiter((x for words in docs for x in map(hashes.__getitem__, words)), np.uint64, int(begins[-1]))
    run = min(RUN, window)
    choices = window - run + 1
    n = len(h) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    with np.errstate(over="ignore"):
        g = np.zeros(len(h) - run + 1, np.uint64)
        for i in range(run):
            g = g * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(g)]
    g = mix64(g)
    best, place = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, choices):
        less = g[j : j + n] < best
        np.copyto(best, g[j : j + n], where=less)
        place[less] = j
    text = np.repeat(np.arange(len(docs)), lengths)[:n]
    start = np.arange(n) - begins[text]
    inside = start + window <= lengths[text]
    return text[inside], start[inside], (start + place)[inside], best[inside]


def shared_anchors(docs: DataFrame, window: int) -> DataFrame:
    """(doc, version, span, hash): the runs of windows whose anchor occurs in two documents or more.

    docs: (doc_id, version, text); a span is the first window's start, times window + 1, plus the number of windows.
    """

    def send(h: np.ndarray, doc: np.ndarray, version: np.ndarray, span: np.ndarray):
        order = np.lexsort((doc, h))
        h, doc, version, span = (x[order] for x in (h, doc, version, span))
        first = np.concatenate([[True], h[1:] != h[:-1]])
        group = np.cumsum(first) - 1
        begin = np.nonzero(first)[0]
        end = np.append(begin[1:], len(h)) - 1
        known = (doc[begin] != doc[end])[group]
        sign = begin[doc[begin] != doc[end]]  # one row a known hash tells the other tasks
        flag = np.concatenate([known.astype(np.int32), np.full(len(sign), 2, np.int32)])
        cols = [np.concatenate([x, x[sign]]) for x in (h.view(np.int64), doc, version, span)]
        salt = np.where(flag == 1, 1 + (mix64(cols[1].view(np.uint64)) & np.uint64(0xFFFF)).astype(np.int32), 0).astype(np.int32)
        for lo in range(0, len(flag), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 100_000]) for x in (*cols, salt, flag)], ["hash", "doc", "version", "span", "salt", "flag"])

    def find(batches):
        hashes, held, size = WordHashes(), [], 0
        for batch in batches:
            ids, versions = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            for first, words in chunks(batch.column(2)):
                text, start, at, h = anchors(words, hashes, window)
                if not len(at):
                    continue
                new = np.nonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))[0]
                own = first + text[new]
                held.append((h[new], ids[own], versions[own], start[new] * (window + 1) + np.diff(new, append=len(at))))
                size += len(new)
                if size >= CHUNK_ANCHORS:
                    yield from send(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if held:
            yield from send(*map(np.concatenate, zip(*held)))

    rows = docs.mapInArrow(find, "hash bigint, doc bigint, version bigint, span bigint, salt int, flag int")
    of = Window.partitionBy("hash", "salt")
    seen = rows.withColumns({"lo": F.min("doc").over(of), "hi": F.max("doc").over(of), "sign": F.max("flag").over(of)})
    return seen.where("flag = 1 or flag = 0 and (lo < hi or sign = 2)").select("doc", "version", "span", "hash")


def chunks(column: pa.Array):
    """(index of the first, words of each) for runs of texts of bounded size, one text at least."""
    held, size, first = [], 0, 0
    for lo in range(0, len(column), SLICE):
        for i, text in enumerate(text_bytes(column.slice(lo, SLICE)), lo):
            held.append(text.split())
            size += len(text)
            if size >= CHUNK_BYTES:
                yield first, held
                held, size, first = [], 0, i + 1
    if held:
        yield first, held


SEGMENTS = "shard int, seg binary, doc bigint, version bigint, start int"
#: Two hashes name a stretch; Spark starts the second from the hash of a constant.
SEED, SECOND = 42, 7
SECOND_SEED = xxhash.xxh64_intdigest(SECOND.to_bytes(4, "little"), SEED)


def segments(shard: list[int], seg: list[bytes], doc: list[int], version: list[int], start: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(shard, pa.int32()), pa.array(seg, pa.binary()), pa.array(doc, pa.int64()), pa.array(version, pa.int64()), pa.array(start, pa.int32())],
        ["shard", "seg", "doc", "version", "start"],
    )


def stretches(docs: DataFrame, shared: DataFrame, window: int, shards: int) -> DataFrame:
    """SEGMENTS: runs of words whose windows have one shared anchor, by the anchor's shard."""

    def cut(batches):
        for batch in batches:
            docs, versions = (batch.column(i).to_pylist() for i in (0, 1))
            spans, homes = batch.column(3), batch.column(4)
            for first, texts in chunks(batch.column(2)):
                shard, seg, doc, version, start = [], [], [], [], []
                for i, words in enumerate(texts, first):
                    for span, home in zip(spans[i].as_py(), homes[i].as_py()):
                        a, n = divmod(span, window + 1)
                        seg.append(b" ".join(words[a : a + n - 1 + window]))
                        shard.append(home)
                        start.append(a)
                    doc += [docs[i]] * len(spans[i])
                    version += [versions[i]] * len(spans[i])
                yield segments(shard, seg, doc, version, start)

    one = F.struct("span", F.pmod("hash", F.lit(shards)).cast("int").alias("shard"))
    places = shared.groupBy(F.col("doc").alias("doc_id"), "version").agg(F.collect_set(one).alias("places"))
    joined = docs.join(places, ["doc_id", "version"]).select("doc_id", "version", "text", "places.span", "places.shard")
    return joined.mapInArrow(cut, SEGMENTS)


def split_hot(cut: DataFrame, window: int, shards: int) -> DataFrame:
    """cut, with the stretches of shards of over HOT_SHARD rows dealt anew, window by window, by a hash of the window.

    Around a passage that is in a great part of all documents, stretches across its ends differ in
    every document but share an anchor. Equal windows still meet, under their own hash.
    """
    hot = {r["shard"]: r["count"] for r in cut.groupBy("shard").count().where(F.col("count") > HOT_SHARD).collect()}  # fewer than rows / HOT_SHARD
    if not hot:
        return cut
    more = max(1, sum(hot.values()) * 5 // SHARD_ANCHORS)

    def windows(batches):
        for batch in batches:
            shard, seg, doc, version, start = [], [], [], [], []
            for text, d, v, at in zip(*(batch.column(c).to_pylist() for c in ("seg", "doc", "version", "start"))):
                words = text.split(b" ")
                for i in range(len(words) - window + 1):
                    seg.append(b" ".join(words[i : i + window]))
                    shard.append(shards + xxhash.xxh64_intdigest(seg[-1]) % more)
                    doc.append(d)
                    version.append(v)
                    start.append(at + i)
            yield segments(shard, seg, doc, version, start)

    is_hot = F.col("shard").isin(list(hot))
    return cut.where(~is_hot).union(cut.where(is_hot).mapInArrow(windows, SEGMENTS))


class SymbolIds(dict):
    """Symbols from 1 on, in order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self) + 1
        return i


def search_shard(rows: pa.Table, window: int) -> pa.Table:
    """(id_1, id_2, least) of each distinct stretch of (shard, seg, doc): the least document of each of its windows; stretches may repeat."""
    rows = rows.select(["seg", "doc"]).group_by("seg").aggregate([("doc", "min")])
    segs, ids = rows["seg"].to_pylist(), SymbolIds()
    split = [s.split(b" ") for s in segs]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    ends = np.cumsum(lengths + 1) - 1
    symbols = np.zeros(int(ends[-1]) + 1, np.int64)
    inside = np.ones(len(symbols), bool)
    inside[ends] = False
    symbols[inside] = np.fromiter((i for words in split for i in map(ids.__getitem__, words)), np.int64, int(lengths.sum()))
    index = FMIndex(symbols, np.repeat(rows["doc_min"].to_numpy().astype(np.int64), lengths + 1), window)
    least = index.least_of_windows(symbols, ends, lengths)
    offsets = np.concatenate([[0], np.cumsum(lengths - window + 1)]).astype(np.int32)
    names = [np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in segs), np.uint64, len(segs)).view(np.int64) for seed in (SEED, SECOND_SEED)]
    return pa.table({"id_1": names[0], "id_2": names[1], "least": pa.ListArray.from_arrays(pa.array(offsets), pa.array(least))})


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, version, text): version tells texts of a repeated doc_id apart."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("version"), "text")


def repeated_runs(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, version, starts): for each text with repeats, where its repeated windows start, in words."""
    plain = identified(docs.where("doc_id is not null and text is not null"))
    shared = materialise(shared_anchors(plain, window), "anchors")
    release(docs.sparkSession)
    shards = max(1, -(-shared.count() // SHARD_ANCHORS))
    whole = materialise(stretches(plain, shared, window, shards), "stretches")
    discard(shared)
    cut = split_hot(whole, window, shards)

    def once(batches):
        """Stretches that a task has in several documents leave it once, with the least of them."""
        least: dict = {}
        for batch in batches:
            for key, doc in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), batch.column(2).to_pylist()):
                if doc < least.get(key, doc + 1):
                    least[key] = doc
            if len(least) > MOST_WORDS_KEPT:
                yield _distinct(least)
                least = {}
        yield _distinct(least)

    distinct = cut.select("shard", "seg", "doc").mapInArrow(once, "shard int, seg binary, doc bigint")
    found = distinct.groupBy("shard").applyInArrow(lambda rows: search_shard(rows, window), "id_1 bigint, id_2 bigint, least array<bigint>")
    named = cut.select(F.xxhash64("seg").alias("id_1"), F.xxhash64(F.lit(SECOND), "seg").alias("id_2"), "doc", "version", "start")
    rows = named.join(found, ["id_1", "id_2"])
    late = F.filter(F.transform("least", lambda x, i: F.when(x < F.col("doc"), i)), lambda i: i.isNotNull())
    late = rows.select("doc", "version", "start", late.alias("late")).where("size(late) > 0")
    runs = materialise(late.select("doc", "version", F.transform("late", lambda i: F.col("start") + i).alias("starts")), "late")
    discard(whole)
    return runs.groupBy("doc", "version").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def _distinct(least: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in least], pa.int32()), pa.array([k[1] for k in least], pa.binary()), pa.array(list(least.values()), pa.int64())], ["shard", "seg", "doc"])


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept (the words left, joined by one space).

    A word goes if a window of `window` consecutive words covers it whose word sequence also starts in
    a document with a smaller doc_id, judged on the input. Null text has no words; texts shorter than
    a window, and rows with a null doc_id, keep all words and take none from others. Rows that share a
    doc_id are one document to each other: they remove nothing from one another. An empty table gives
    an empty result. doc_id is of an integer type; others raise a TypeError. Other columns are not read.
    """
    whole_ids(docs)
    runs = repeated_runs(docs, window)
    kind = docs.schema["doc_id"].dataType.simpleString()
    same = (F.col("doc_id").cast("bigint") == F.col("doc")) & (F.xxhash64("text") == F.col("version"))
    rows = docs.select("doc_id", "text").join(runs, same, "left").select("doc_id", "text", "starts")

    def keep(batches):
        for batch in (b.slice(lo, SLICE) for b in batches for lo in range(0, b.num_rows, SLICE)):
            n, gone, kept = [], [], []
            for text, starts in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist()):
                words = text.split()
                n.append(len(words))
                if starts:
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = np.unique(starts)
                    edge[at] += 1
                    edge[at + window] -= 1
                    stay = np.cumsum(edge)[:-1] == 0
                    words = [w for w, s in zip(words, stay.tolist()) if s]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(keep, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = without_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_substring_dedup": op1_substring_dedup}

ORACLE_SQL = {
    "op1_substring_dedup": f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') w from documents),
x as (select doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) s from d where len(w) >= {WINDOW}),
g as (select doc_id, s, array_to_string(w[s : s + {WINDOW - 1}], ' ') t from x),
m as (select t, min(doc_id) least from g group by 1),
r as (select distinct g.doc_id, unnest(range(g.s, g.s + {WINDOW})) p from g join m using (t) where m.least < g.doc_id),
p as (select doc_id, list(p) gone from r group by 1),
k as (select d.doc_id, len(d.w) n_words, coalesce(len(p.gone), 0) n_removed,
        array_to_string(case when p.gone is null then d.w else list_transform(list_filter(range(1, len(d.w) + 1), lambda i: not list_contains(p.gone, i)), lambda i: d.w[i]) end, ' ') kept
      from d left join p using (doc_id))
select doc_id, n_words::bigint n_words, n_removed::bigint n_removed, sha256(kept) kept_sha256 from k"""
}
