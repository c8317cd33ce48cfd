"""SimHash near-dedup: fingerprints, pigeonhole blocks, verified Hamming distance, components.

A fingerprint of 64 bits is cut into b blocks. Two fingerprints that differ in at most r bits agree
in at least b - r blocks, so they meet under the key of some choice of b - r blocks. More blocks
make longer keys, so fewer chance partners in a bucket, for more choices: radius 3 with 6 blocks is
20 choices of 32 bits. Copies collapse to one row per distinct fingerprint before any
key is made; buckets are sorted runs that stream through numpy, where distances are verified and
only a spanning forest of each bucket is passed on, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, mix64, numbered, small_batches, table, text_bytes
from .components import components

SEED = 42
#: Buckets up to this size compare all their members at once; larger ones probe the bucket for every word within reach.
DENSE = 6_000
#: Shingle hashes in a sketch, members of a bucket that are compared in all pairs at once.
SKETCH, SMALL_BUCKET = 512, 32
#: Keys of a set of shingles, minima in a key.
BANDS, BAND_ROWS = 28, 4
#: By how many standard deviations the share of equal minima may lie below the similarity in a pair whose sketches are compared.
DEVIATIONS = 4


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of `size` words, joined by spaces; of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(size)))) if len(words) >= size else (b" ".join(words),)
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if over half the hashes have it; zero for no hashes. Long texts are counted in parts."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(((2 * counts > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def fingerprint_udf(size: int):
    @F.arrow_udf("bigint")
    def prints(text: pa.Array) -> pa.Array:
        found = [fingerprint(shingle_hashes(t.lower().split(), size)) for t in text_bytes(text)]
        return pa.array(np.array(found, np.uint64).view(np.int64))

    return prints


def block_masks(blocks: int, radius: int) -> list[int]:
    """The mask of each choice of blocks - radius blocks."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def spanning_links(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph that links distinct fingerprints within radius: two arrays of ends."""
    n = len(prints)
    root = np.arange(n)

    def join(a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist()):
            while root[i] != i:
                root[i] = i = root[root[i]]
            while root[j] != j:
                root[j] = j = root[root[j]]
            if i != j:
                root[max(i, j)] = min(i, j)
                ends.append((i, j))

    ends: list[tuple[int, int]] = []
    if n == 2:
        near = np.bitwise_count(prints[:1] ^ prints[1:]) <= radius
        return prints[:1][near], prints[1:][near]
    if n <= DENSE:
        step = max(1, 4_000_000 // n)
        for lo in range(0, n, step):
            near = np.bitwise_count(prints[lo : lo + step, None] ^ prints[None, lo:]) <= radius
            a, b = np.nonzero(near)
            a, b = a + lo, b + lo
            keep = a < b
            a, b = a[keep], b[keep]
            fresh = _apart(root, a, b)
            join(a[fresh], b[fresh])
    else:
        order = np.argsort(prints)
        sorted_ = prints[order]
        flips = [sum(1 << i for i in c) for k in range(1, radius + 1) for c in combinations(range(64), k)]
        varying = np.bitwise_or.reduce(prints ^ prints[0])
        for flip in flips:
            if flip & ~int(varying):
                continue
            wanted = sorted_ ^ np.uint64(flip)
            at = np.minimum(np.searchsorted(sorted_, wanted), n - 1)
            hit = np.nonzero(sorted_[at] == wanted)[0]
            a, b = order[hit], order[at[hit]]
            fresh = _apart(root, a, b)
            join(a[fresh], b[fresh])
    if not ends:
        return np.zeros(0, prints.dtype), np.zeros(0, prints.dtype)
    i, j = np.array(ends).T
    return prints[i], prints[j]


def _apart(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs are not joined yet."""
    while True:
        up = root[root]
        if (up == root).all():
            break
        root[:] = up
    return np.nonzero(root[a] != root[b])[0]


def keyed(rows: DataFrame, blocks: int, radius: int, *also: str) -> DataFrame:
    """The columns `also` and fp of rows, with key, for each choice of blocks; sorted by key within partitions.

    A key hashes what it stands for; two that collide only make candidates that fail verification.
    """
    masks = [m - (1 << 64) if m >> 63 else m for m in block_masks(blocks, radius)]
    keys = F.array(*(F.xxhash64(*also[1:], F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)))
    dealt = rows.select(*also[:1], "fp", F.explode(keys).alias("key"))
    return dealt.repartition("key").sortWithinPartitions("key", *also[:1], "fp")


def sorted_buckets(batches):
    """(rows but the key) of each run of two or more equal keys; batches are sorted by their last column, the key."""
    rest: list[np.ndarray] = []  # the rows of the last key so far
    for batch in chain(batches, [None]):
        if batch is not None:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)
            if not len(rows):
                continue
            if rows[0, -1] == rows[-1, -1] and (not rest or rest[-1][-1, -1] == rows[0, -1]):
                rest.append(rows)
                continue
            rows = np.concatenate([*rest, rows])
            cut = np.nonzero(rows[1:, -1] != rows[:-1, -1])[0] + 1
            rest, rows = [rows[cut[-1] :]], rows[: cut[-1]]
        elif rest:
            rows = np.concatenate(rest)
            cut = np.array([len(rows)])
        else:
            return
        starts = np.concatenate([[0], cut[:-1]]).astype(np.int64)
        many = cut - starts > 1
        for lo, hi in zip(starts[many].tolist(), cut[many].tolist()):
            yield rows[lo:hi, :-1]


def near_links(prints: DataFrame, blocks: int, radius: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) within radius bits, enough to connect all that are."""

    def link(batches):
        a, b = [], []
        for rows in sorted_buckets(batches):
            x, y = spanning_links(rows[:, 0].copy().view(np.uint64), radius)
            if len(x):
                a.append(x)
                b.append(y)
            if len(a) > 4096:
                yield _pairs(a, b)
                a, b = [], []
        if a:
            yield _pairs(a, b)

    dealt = keyed(prints, blocks, radius)
    return dealt.mapInArrow(link, "a bigint, b bigint").where("a <> b").distinct()


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])


def near_components(docs: DataFrame, shingle: int = 3, blocks: int = 6, radius: int = 3) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id, n_near.

    component_id: the smallest doc_id reachable over fingerprints within `radius` bits, itself
    included; n_near: rows of the component. Null text counts as empty; texts without words have
    fingerprint zero and link like any other. Null ids take part but name a component only where it
    has no other id (then component_id is null). Repeated rows are separate members. An empty table
    gives an empty result. Other columns are not read.
    """
    rows = materialise(docs.select("doc_id", fingerprint_udf(shingle)("text").alias("fp")), "prints")
    prints = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-prints")
    roots = components(near_links(prints.select("fp"), blocks, radius)).withColumnRenamed("node", "fp")
    named = materialise(prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    whole = materialise(named.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("n_near")), "components")  # apart from its join, which can split a hot root
    by_print = named.join(whole, "root").select("fp", "component_id", "n_near")
    return rows.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_near")


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The smallest SKETCH of the distinct hashes of a text's shingles: all of them for short texts."""
    return np.unique((hashes >> np.uint64(32)).astype(np.uint32))[:SKETCH]


def verdict(a: np.ndarray, b: np.ndarray, similarity: float) -> int:
    """1 or -1 where two sketches show that the sets have the similarity or not; 0 where they are too close to it.

    At 0.8 an estimate from 512 hashes has a standard deviation of 0.018; short texts' sketches are
    whole but for equal halves of hashes.
    """
    margin = 0.1 if max(len(a), len(b)) >= SKETCH else 0.01
    found = resemblance(a, b) - similarity
    return 0 if abs(found) <= margin else 1 if found > 0 else -1


def minima(hashes: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """The least of all hashes in each of BAND_ROWS * bands random orders; two sets of similarity s have one in common with probability s."""
    draw = np.random.default_rng(SEED).integers(0, 1 << 64, (2, bands * BAND_ROWS, 1), np.uint64)
    least = np.full(bands * BAND_ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024] * (draw[0] | np.uint64(1)) + draw[1]).min(1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """A hash of each band of BAND_ROWS minima; sets of similarity s have no band in common with probability (1 - s**BAND_ROWS)**bands."""
    bands = len(least) // BAND_ROWS
    key = np.arange(bands, dtype=np.uint64)
    for minimum in least.reshape(bands, BAND_ROWS).T:
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) ^ minimum)
    return key


def resemblance(a: np.ndarray, b: np.ndarray) -> float:
    """The share of shingles that two texts have in common, from their sketches; exact where both are short."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = b[a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b]
    if max(len(a), len(b)) < SKETCH:
        return len(common) / (len(a) + len(b) - len(common))
    least = np.union1d(a, b)[:SKETCH]
    return float(np.searchsorted(common, least[-1], "right") / len(least))


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(rid, n, fp, keys, marks, sketch) of (rid, text): of the set of shingles its size, SimHash, band keys, a byte of each minimum, and sketch."""

    @F.arrow_udf("struct<n: int, fp: bigint, keys: array<bigint>, marks: binary, sketch: binary>")
    def signed(text: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in text:
            n, fps, keys, marks, sketches = [], [], [], [], []
            for t in text_bytes(batch):
                h = np.unique(shingle_hashes(t.lower().split(), shingle))
                n.append(len(h))
                fps.append(fingerprint(h))
                least = minima(h)
                keys.append(band_keys(least).view(np.int64))
                marks.append((mix64(least) >> np.uint64(56)).astype(np.uint8).tobytes())
                sketches.append(sketch(h).tobytes())
            prints = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.StructArray.from_arrays([pa.array(n, pa.int32()), prints, pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary()), pa.array(sketches, pa.binary())], ["n", "fp", "keys", "marks", "sketch"])

    return docs.select("rid", signed("text").alias("s")).select("rid", "s.*")


def bucket_links(rows: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of a bucket whose sizes allow the similarity; rows are (rid, n)."""
    a, b = np.triu_indices(len(rows), 1)
    n = rows[:, 1]
    fits = np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b])
    return a[fits], b[fits]


def family_links(rows: np.ndarray, marks: np.ndarray, sketches: list[np.ndarray], band: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs of a large bucket whose groups differ: enough of those that sketches show to be alike to
    connect them, and all that are too close to the threshold to tell. rows are (rid, fp, n, group).

    Members are taken from the bitwise majority of the fingerprints outwards, as copies have their
    original there; groups that meet are one from then on. Sketches are compared of pairs that agree
    in enough of their marks, a byte of each minimum, and in no whole band before this one, whose
    bucket compares them.
    """
    n, prints, sizes, group = len(rows), rows[:, 1].copy().view(np.uint64), rows[:, 2], rows[:, 3].copy()
    bits = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    majority = ((2 * bits > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum()
    order, a, b = np.argsort(np.bitwise_count(prints ^ majority), kind="stable"), [], []
    least = similarity - DEVIATIONS * np.sqrt(similarity * (1 - similarity) / marks.shape[1])
    for rank, one in enumerate(order[:-1].tolist()):
        rest = order[rank + 1 :]
        rest = rest[(group[rest] != group[one]) & (np.minimum(sizes[rest], sizes[one]) >= similarity * np.maximum(sizes[rest], sizes[one]))]
        same = marks[rest] == marks[one]
        met = same[:, : band * BAND_ROWS].reshape(len(rest), band, BAND_ROWS).all(2).any(1)
        for other in rest[(same.mean(1) >= least) & ~met].tolist():
            if group[other] == group[one]:
                continue
            found = verdict(sketches[one], sketches[other], similarity)
            if found >= 0:
                a.append(one)
                b.append(other)
            if found > 0:
                group[group == group[other]] = group[one]
    return np.array(a, np.int64), np.array(b, np.int64)


def buckets_of(batches) -> Iterator[pa.Table]:
    """The rows of each bucket; batches are sorted by the column bucket."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            held.append(batch)
            if held[0]["bucket"][0] == batch["bucket"][-1]:
                continue
        elif not held:
            return
        rows = pa.Table.from_batches(held)
        key = rows["bucket"].to_numpy()
        cuts = [0, *(np.nonzero(key[1:] != key[:-1])[0] + 1).tolist(), len(key)]
        last = cuts.pop(-2) if batch is not None else None
        if last is not None:
            held = rows.slice(last).combine_chunks().to_batches()
            cuts[-1] = last
        yield from (rows.slice(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:]))


def near_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, blocks: int = 6, radius: int = 3) -> DataFrame:
    """(rid, root) of the rows of docs (rid, text) that have near-duplicates: root is the smallest rid of the group.

    SimHash comes first: rows whose fingerprints differ in at most `radius` bits, found by choices of
    blocks, are checked by their sets of shingles and grouped. Fingerprints of an edited copy often lie
    further apart, so pairs of different groups that share a band key are checked the same way. These
    share a band key of their sets of `shingle`-word shingles: at a similarity of 0.8 a
    pair is missed with probability 4e-7, wherever the texts differ, and less above. They are linked if the
    sets have at least the given similarity, by their sketches or, near the threshold, in whole.

    A bucket of over SMALL_BUCKET rows compares its members with one pivot, by a join that splits a hot
    bucket; if it is not in one group then, a task compares all pairs of different groups, by their
    112 minima first: at a similarity of 0.8 a pair is left out there with probability 6e-5, at 0.85 with 1e-9.
    So a family of n copies that are not alike costs n * n comparisons of 112 bytes in a task and the
    memory of n sketches, but rows only for links. Texts without words are alike.
    """
    rows = materialise(signatures(docs, shingle), "signatures")
    settled = _alike(_candidates(print_links(rows, blocks, radius)), rows, docs, shingle, similarity)
    groups = components(settled)
    dealt = rows.select("rid", "fp", "n", F.posexplode("keys").alias("band", "key"))
    keys = materialise(dealt.groupBy("key").agg(F.count("*").alias("members"), F.min("rid").alias("pivot")).where("members > 1"), "keys")
    met = materialise(dealt.join(keys, "key"), "buckets")
    large = met.where(F.col("members") > SMALL_BUCKET).withColumnRenamed("key", "bucket")
    small = met.where(F.col("members") <= SMALL_BUCKET).select("rid", "n", "key")

    def compare_all(batches):
        for bucket in sorted_buckets(batches):
            x, y = bucket_links(bucket, similarity)
            yield bucket[x, 0], bucket[y, 0]

    pairs = small.repartition("key").sortWithinPartitions("key", "rid", "n").mapInArrow(_dealt(compare_all), "a bigint, b bigint")
    pairs = pairs.union(large.select(F.col("pivot").alias("a"), F.col("rid").alias("b")))
    links = settled.union(_alike(_across(_candidates(pairs), groups), rows, docs, shingle, similarity))
    roots = components(links)
    held = large.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    held = materialise(held.select("rid", "fp", "n", "root", "band", "bucket"), "grouped")
    apart = held.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    apart = materialise(apart.select("bucket"), "apart")
    if not apart.isEmpty():

        def compare(batches):
            for bucket in buckets_of(batches):
                ints = np.stack([bucket[c].to_numpy().astype(np.int64) for c in ("rid", "fp", "n", "root")], 1)
                marks = np.frombuffer(b"".join(bucket["marks"].to_pylist()), np.uint8).reshape(len(ints), -1)
                sketches = [np.frombuffer(x, np.uint32) for x in bucket["sketch"].to_pylist()]
                x, y = family_links(ints, marks, sketches, bucket["band"][0].as_py(), similarity)
                yield ints[x, 0], ints[y, 0]

        unsettled = materialise(held.join(apart, "bucket", "left_semi"), "unsettled")
        marked = unsettled.join(rows.select("rid", "marks", "sketch"), "rid")
        marked = marked.select("rid", "fp", "n", "root", "band", "marks", "sketch", "bucket").repartition("bucket").sortWithinPartitions("bucket", "rid")
        with small_batches(docs.sparkSession, 2048):
            near = _candidates(marked.mapInArrow(_dealt(compare), "a bigint, b bigint"))
        roots = components(links.union(_alike(near, rows, docs, shingle, similarity)))
        discard(unsettled)
    discard(rows, keys, met, held, apart)
    return roots.withColumnRenamed("node", "rid")


def print_links(rows: DataFrame, blocks: int, radius: int) -> DataFrame:
    """Pairs (a, b) of rids of (rid, fp) whose fingerprints lie within radius bits, enough to connect all that do."""
    first = materialise(rows.groupBy("fp").agg(F.min("rid").alias("first"), F.count("*").alias("n")), "first-prints")
    a, b = (first.select(F.col("fp").alias(end), F.col("first").alias(name)) for end, name in (("a", "x"), ("b", "y")))
    near = near_links(first.select("fp"), blocks, radius).join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return near.union(rows.select("rid", "fp").join(first.where("n > 1"), "fp").select(F.col("first").alias("a"), F.col("rid").alias("b")))


def _across(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (a, b) that (node, root) does not hold in one group."""
    x, y = (groups.select(F.col("node").alias(end), F.col("root").alias(name)) for end, name in (("a", "x"), ("b", "y")))
    met = materialise(pairs.join(x, "a", "left").join(y, "b", "left").where("not (x <=> y) or x is null").select("a", "b"), "across")
    discard(pairs)
    return met


def _dealt(parts):
    """For mapInArrow: the (a, b) that parts yields, in record batches."""

    def run(batches):
        a, b, size = [], [], 0
        for x, y in parts(batches):
            a.append(x)
            b.append(y)
            size += len(x)
            if size > 100_000 or len(a) > 4096:
                yield _pairs(a, b)
                a, b, size = [], [], 0
        if a:
            yield _pairs(a, b)

    return run


def _candidates(met: DataFrame) -> DataFrame:
    return materialise(met.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")


def _alike(pairs: DataFrame, rows: DataFrame, docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The candidate pairs whose sets of shingles have the similarity: sketches settle clear cases, whole sets the others."""
    # ends in tables of known size: what they are joined with is shuffled only where they are too large to broadcast
    ends = materialise(_ids_of(pairs), "ends")
    sketches = materialise(rows.join(ends, "rid").select("rid", "sketch"), "sketches")

    @F.arrow_udf("int")
    def clear(x: pa.Array, y: pa.Array) -> pa.Array:
        pairs = zip(*(map(lambda v: np.frombuffer(v, np.uint32), c.to_pylist()) for c in (x, y)))
        return pa.array([verdict(a, b, similarity) for a, b in pairs], pa.int32())

    settled = materialise(_ends_of(pairs, sketches.withColumnRenamed("sketch", "of")).select("a", "b", clear("x", "y").alias("verdict")), "settled")
    close = settled.where("verdict = 0").select("a", "b")
    close_ends = materialise(_ids_of(close), "ends")

    @F.arrow_udf("binary")
    def whole(text: pa.Array) -> pa.Array:
        return pa.array([np.unique(shingle_hashes(t.lower().split(), shingle)).tobytes() for t in text_bytes(text)], pa.binary())

    @F.arrow_udf("boolean")
    def alike(x: pa.Array, y: pa.Array) -> pa.Array:
        found = []
        for a, b in zip(x, y):
            a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
            common = len(np.intersect1d(a, b, assume_unique=True))
            found.append(common >= similarity * (len(a) + len(b) - common))
        return pa.array(found, pa.bool_())

    with small_batches(docs.sparkSession):
        sets = materialise(docs.join(close_ends, "rid", "left_semi").select("rid", whole("text").alias("of")), "whole-sets")
        checked = materialise(_ends_of(close, sets).where(alike("x", "y")).select("a", "b"), "checked")
    found = materialise(settled.where("verdict > 0").select("a", "b").union(checked), "links")
    discard(pairs, ends, sketches, settled, close_ends, sets, checked)
    return found


def _ids_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct()


def _ends_of(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """pairs (a, b) with x and y, what values (rid, of) has of the two."""
    x, y = (values.withColumnsRenamed({"rid": end, "of": name}) for end, name in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, root), one row for each row of docs with near-duplicates: root is the smallest doc_id of its group.

    Null and empty texts are alike. A doc_id with several texts is in several groups; null ids take
    part, and name a group only where it has no other id (root is null). An empty table gives an empty
    result. Other columns are not read.
    """
    rows = numbered(docs.select("doc_id", "text"))
    groups = near_groups(rows.select("rid", "row.text"), shingle, similarity).join(rows.select("rid", "row.doc_id"), "rid")
    least = materialise(groups.groupBy(F.col("root").alias("group")).agg(F.min("doc_id").alias("least")), "least")
    return groups.join(least, F.col("root") == F.col("group")).select("doc_id", F.col("least").alias("root"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near-duplicates, that of the smallest doc_id.

    Rows are told apart by a number of their own: a doc_id with several texts stands in several
    groups; of rows with equal ids in a group one stays, and null ids come after all others. Null and
    empty texts are alike. An empty table gives an empty result; all columns pass through.
    """
    rows = numbered(docs)
    groups = materialise(near_groups(rows.select("rid", "row.text"), shingle, similarity), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid"))
    winners = groups.join(rows.select("rid", "row.doc_id"), "rid").groupBy("root").agg(first.alias("first")).select(F.col("first.rid").alias("rid"))
    losers = materialise(groups.select("rid").join(winners, "rid", "left_anti"), "losers")
    return rows.join(losers, "rid", "left_anti").select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), shingle=3, radius=3)


QUERIES = {"op8_simhash_near_dedup": op8_simhash_near_dedup}
ORACLE_SQL: dict[str, str] = {}
