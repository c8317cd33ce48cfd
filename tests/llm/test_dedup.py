"""Exact, near, substring and line dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connect, same
from pyspark.sql import functions as F

from lociweave.llm import components, exact_dedup, line_dedup, registry, simhash, substring_dedup
from lociweave.llm.common import materialise
from lociweave.llm.fm_index import FMIndex

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SQL = registry.oracle_sql()


def words(text):
    return WORDS.findall((text or "").encode())


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf_dir, name):
    same(registry.queries()[name](spark, sf_dir), connect(sf_dir), SQL[name])


# exact


def brute_exact(rows):
    groups = defaultdict(list)
    sha = {}
    for d, t in rows:
        k = (t or "").encode().translate(LOWER)
        sha[k] = hashlib.sha256(k).hexdigest()
        groups[k].append(d)
    out = []
    for k, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(d, keep, len(ids), d == keep, sha[k]) for d in ids]
    return sorted(out, key=repr)


def test_exact_edges(frame, edge_rows):
    rows = [r[:2] for r in edge_rows]
    assert rows_of(exact_dedup.exact_dedup(frame(edge_rows))) == brute_exact(rows)


def test_exact_history_and_empty(frame):
    got = exact_dedup.exact_dedup(frame([(1, "A"), (2, "new")]), frame([(9, "a"), (8, "old")]))
    assert [(r[0], r[1], r[2], r[3]) for r in rows_of(got)] == [(1, 9, 2, False), (2, 2, 1, True)]
    assert exact_dedup.exact_dedup(frame([])).count() == 0


def test_exact_drop_loses_no_text(frame):
    rows = [(1, "A"), (2, "a"), (1, "unique text"), (None, "a"), (3, "b"), (3, "B"), (3, "b"), (None, "n"), (None, "N"), (4, None), (5, "")]
    kept = exact_dedup.drop_exact_copies(frame(rows))
    got = sorted(((r["doc_id"], (r["text"] or "").lower()) for r in kept.collect()), key=repr)
    assert got == [(1, "unique text"), (2, "a"), (3, "b"), (5, ""), (None, "n")] and kept.columns == frame([]).columns
    assert exact_dedup.drop_exact_copies(frame([])).count() == 0


def test_exact_ids_of_other_types_and_the_least_id(spark):
    texts = spark.createDataFrame([("x", "A"), ("y", "a"), (None, "b")], "doc_id string, text string")
    assert [(r[0], r[1]) for r in rows_of(exact_dedup.exact_dedup(texts))] == [("x", "y"), ("y", "y"), (None, None)]
    least = spark.createDataFrame([(-(1 << 63), "A"), (None, "a")], "doc_id long, text string")
    assert {r["keep_id"] for r in exact_dedup.exact_dedup(least).collect()} == {-(1 << 63)}


def test_members_take_the_winner_from_their_slot(frame):
    """Results come through the index: with other winners and counts in the slots, members say otherwise."""
    rows = materialise(frame([(i, f"t{i % 5}") for i in range(20)]).select(F.col("doc_id").alias("rid"), "doc_id", exact_dedup.digest_of("text").alias("digest"), F.lit(True).alias("late")), "test")
    groups = rows.select("digest").distinct().select("digest", F.lit(99).cast("long").alias("keep_id"), F.lit(3).cast("long").alias("n"))
    looked = exact_dedup.look_up(rows, exact_dedup.build_index(groups, 2), 2).collect()
    assert {(r["winner"], r["before"]) for r in looked} == {(99, 3)} and len({(r["shard"], r["slot"]) for r in looked}) == 5


def test_exact_salted_shards(frame, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SALT_ROWS", 7)
    monkeypatch.setattr(exact_dedup, "SHARD_DIGESTS", 5)
    rows = [(i, f"t{i % 23}" if i % 3 else "hot") for i in range(200)]
    assert rows_of(exact_dedup.exact_dedup(frame(rows))) == brute_exact(rows)


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 3000), st.integers(0, 99))
def test_perfect_hash_is_minimal(n, seed):
    keys = np.random.default_rng(seed).integers(0, 2**63, (n, 2)).astype(np.uint64)
    mph = exact_dedup.MinimalPerfectHash.build(keys)
    again = exact_dedup.MinimalPerfectHash(mph.sizes, np.packbits(mph.bits))
    assert sorted(again.slots(keys).tolist()) == list(range(n))


# near


def brute_print(text, size=3):
    w = WORDS.findall((text or "").encode().translate(LOWER))
    if not w:
        return 0
    runs = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_near(rows, radius=3):
    fps = [brute_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def test_near_edges(frame, edge_rows):
    got = simhash.near_components(frame(edge_rows)).select("doc_id", "fingerprint", "component_id")
    assert rows_of(got) == brute_near([r[:2] for r in edge_rows])
    assert simhash.near_components(frame([])).count() == 0


def test_near_families(frame):
    rng = random.Random(1)
    rows = []
    for family in range(8):
        base = [f"f{family}w{rng.randrange(400)}" for _ in range(200)]
        for copy in range(6):
            t = list(base)
            for _ in range(copy // 2):
                t[rng.randrange(200)] = f"new{rng.random()}"
            rows.append((family * 10 + copy, " ".join(t)))
    assert rows_of(simhash.near_components(frame(rows)).select("doc_id", "fingerprint", "component_id")) == brute_near(rows)


@settings(max_examples=15, deadline=None)
@given(st.integers(2, 60), st.integers(0, 99), st.booleans())
def test_spanning_links_connect_what_is_near(n, seed, probe):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 4).astype(np.uint64)
    prints = np.unique(base[rng.integers(0, 4, n)] ^ (np.uint64(1) << rng.integers(0, 20, n).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 20, n).astype(np.uint64)))
    old, simhash.DENSE = simhash.DENSE, 1 if probe else 6000
    try:
        a, b = simhash.spanning_links(prints, 3)
    finally:
        simhash.DENSE = old
    assert len(a) < len(prints)

    def groups(pairs):
        parent = {int(p): int(p) for p in prints}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in pairs:
            x, y = find(int(x)), find(int(y))
            parent[max(x, y)] = min(x, y)
        return [find(int(p)) for p in prints]

    assert groups(zip(a, b)) == groups((x, y) for x in prints for y in prints if int(x ^ y).bit_count() <= 3)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (None, 3), (200, 300)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 300: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_short_edge_lists_take_no_rounds(spark, monkeypatch):
    """Each round's plans cost the driver memory; a short list takes the same few jobs however long its paths are, with the roots that rounds find."""
    rng = np.random.default_rng(3)
    edges = [(i + 1, i) for i in range(0, 60)] + [(int(a), int(b)) for a, b in rng.integers(100, 400, (150, 2))] + [(-5, 2**62), (7, 7), (None, 3)]
    given = spark.createDataFrame(edges, "a long, b long")

    def jobs_of(name):
        spark.sparkContext.setJobGroup(name, name)
        got = sorted(components.components(given).collect())
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return got, jobs

    got, jobs = jobs_of("one-task")
    assert jobs <= 8
    monkeypatch.setattr(components, "ONE_TASK", 0)
    assert jobs_of("rounds")[0] == got


def test_verified_near_duplicates(frame):
    rng = random.Random(4)
    rows, close = [], []
    for family in range(6):
        base = [f"f{family}w{rng.randrange(500)}" for _ in range(300)]
        for copy in range(4):
            t = list(base)
            for k in range(copy * 2):
                t[(k * 37 + family) % 300] = f"n{family}c{copy}k{k}"
            rows.append((family * 10 + copy, " ".join(t)))
        half = base[:150] + [f"h{family}w{i}" for i in range(150)]
        rows.append((family * 10 + 9, " ".join(half)))  # a third in common: no near-duplicate
    got = {r["doc_id"]: r["root"] for r in simhash.near_duplicates(frame(rows + [(None, "x"), (500, None)])).collect()}

    def jaccard(x, y):
        a, b = ({" ".join(t.split()[i : i + 5]) for i in range(296)} for t in (x, y))
        return len(a & b) / len(a | b)

    for i, (d, t) in enumerate(rows):
        close += [(d, e) for e, u in rows[:i] if jaccard(t, u) >= 0.8]
    assert close and all(got.get(d) == got.get(e) for d, e in close)
    assert not any(d % 10 == 9 for d in got)


def test_near_drop_loses_no_text(frame):
    base = [f"w{i}" for i in range(200)]
    a, b, other = " ".join(base), " ".join([*base[:100], "x", *base[101:]]), " ".join(f"o{i}" for i in range(50))
    kept = simhash.drop_near_duplicates(frame([(None, a), (7, b), (7, other), (9, a), (None, "alone")]))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([(7, b), (7, other), (None, "alone")], key=repr)
    assert kept.columns == frame([]).columns and simhash.drop_near_duplicates(frame([])).count() == 0


def test_twins_in_a_family_all_meet(frame):
    """Pairs of twins in a family whose other members lie below the threshold."""
    rng, rows = random.Random(9), []
    core = [f"c{i}" for i in range(300)]
    for i in range(120):
        t = list(core)
        for k in rng.sample(range(300), 8):
            t[k] = f"d{i}k{k}"
        u = list(t)
        u[rng.randrange(300)] = f"u{i}"
        rows += [(2 * i, " ".join(t)), (2 * i + 1, " ".join(u))]
    got = {r["doc_id"]: r["root"] for r in simhash.near_duplicates(frame(rows)).collect()}
    assert all(got.get(2 * i) is not None and got.get(2 * i) == got.get(2 * i + 1) for i in range(120))


def test_near_duplicates_of_every_kind_of_edit(frame):
    rng = random.Random(8)
    rows, pairs = [], []
    for i in range(60):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(150, 400))]
        n, foreign = len(base), [f"x{rng.randrange(3000)}" for _ in range(400)]
        for k, t in enumerate((base, base[: int(0.85 * n)], base + foreign[: n // 7], base[: n // 2] + foreign[: n // 12] + base[n // 2 + n // 12 :])):
            rows.append((10 * i + k, " ".join(t)))
    grams = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows}
    pairs = [(10 * i, 10 * i + k) for i in range(60) for k in (1, 2, 3)]
    assert all(len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]) for a, b in pairs)
    got = {r["doc_id"]: r["root"] for r in simhash.near_duplicates(frame(rows)).collect()}
    assert got == {d: d // 10 * 10 for d, _ in rows}


def test_near_duplicates_in_large_buckets(frame):
    """Many documents of one bucket that are not alike, each with a near copy: no pair may depend on the first pivot."""
    rng = random.Random(5)
    core, rows = [f"c{i}" for i in range(300)], []
    for i in range(60):
        own = [f"d{i}w{rng.randrange(500)}" for _ in range(150)]
        rows += [(2 * i, " ".join(core + own)), (2 * i + 1, " ".join(core + own[:140] + [f"n{i}"] * 5))]
    keys = [simhash.band_keys(simhash.minima(np.unique(simhash.shingle_hashes(t.encode().split(), 5)))) for _, t in rows]
    assert max(Counter(k for ks in keys for k in set(ks.tolist())).values()) > 2 * simhash.SMALL_BUCKET
    got = {r["doc_id"]: r["root"] for r in simhash.near_duplicates(frame(rows)).collect()}
    assert got == {d: d // 2 * 2 for d, _ in rows}


def test_family_links_connect_all_that_are_alike():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, 200, np.uint64)) for _ in range(4)]
    rows, marks, sketches = [], [], []
    for i in range(60):
        h = sets[i % 4].copy()
        h[rng.integers(0, 200, 4 + i % 3 * 12)] = rng.integers(0, 1 << 63, 4 + i % 3 * 12, np.uint64)
        h = np.unique(h)
        rows.append((i, np.uint64(simhash.fingerprint(h)).astype(np.int64), len(h), i))
        marks.append((simhash.mix64(simhash.minima(h)) >> np.uint64(56)).astype(np.uint8))
        sketches.append(simhash.sketch(h))
    x, y = simhash.family_links(np.array(rows), np.array(marks), sketches, 0, 0.8)
    alike = {(i, j) for i in range(60) for j in range(i) if simhash.resemblance(sketches[i], sketches[j]) >= 0.8}

    def groups(pairs):
        root = list(range(60))
        for _ in range(60):
            for i, j in pairs:
                root[i] = root[j] = min(root[i], root[j])
        return root

    found = list(zip(x.tolist(), y.tolist()))
    root = groups(found)
    assert all(root[i] == root[j] for i, j in alike) and len(found) < 120 < len(alike)
    assert all(simhash.resemblance(sketches[i], sketches[j]) >= 0.79 for i, j in found)


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 99)), st.sets(st.integers(0, 99)))
def test_resemblance_of_short_texts_is_exact(a, b):
    want = len(a & b) / len(a | b) if a | b else 1.0
    assert simhash.resemblance(*(np.array(sorted(x), np.uint32) for x in (a, b))) == want


def test_long_texts_near_the_threshold_are_judged_by_all_their_shingles(frame):
    rng, rows, want = random.Random(6), [], {}
    for i in range(60):
        base = [f"b{i}w{rng.randrange(10**6)}" for _ in range(1504)]
        part = base[: (1203 if i % 2 else 1185) + 4]  # a similarity of 0.802 or 0.79
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(part))]
        if i % 2:
            want |= {2 * i: 2 * i, 2 * i + 1: 2 * i}
    got = {r["doc_id"]: r["root"] for r in simhash.near_duplicates(frame(rows)).collect()}
    assert got == want


# substrings


def brute_substring(rows, window=13):
    first = {}
    split = [(d, words(t)) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - window + 1):
            if d is not None:
                k = tuple(w[i : i + window])
                first[k] = min(d, first.get(k, d))
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone |= set(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), kept.decode()))
    return sorted(out, key=repr)


def test_substring_edges(frame, edge_rows):
    assert rows_of(substring_dedup.without_repeats(frame(edge_rows))) == brute_substring([r[:2] for r in edge_rows])
    assert substring_dedup.without_repeats(frame([])).count() == 0


@pytest.mark.parametrize("anchors, shard, hot", [(1_000_000, 40_000, 320_000), (20, 15, 30), (20, 40, 1)])
def test_substring_passages(frame, monkeypatch, anchors, shard, hot):
    for name, value in (("CHUNK_ANCHORS", anchors), ("SHARD_ANCHORS", shard), ("HOT_SHARD", hot)):
        monkeypatch.setattr(substring_dedup, name, value)
    rng = random.Random(2)
    passages = [[f"p{k}w{rng.randrange(30)}" for _ in range(rng.randrange(12, 60))] for k in range(6)]
    rows = []
    for d in range(60):
        t = []
        for _ in range(rng.randrange(1, 5)):
            t += [rng.choice("abcdefgh") for _ in range(rng.randrange(20))] + rng.choice(passages)[rng.randrange(3) :]
        rows.append((d if d % 7 else 3, " ".join(t)))  # some ids have several texts
    assert rows_of(substring_dedup.without_repeats(frame(rows))) == brute_substring(rows)


def test_substring_ids_must_be_whole(spark):
    with pytest.raises(TypeError):
        substring_dedup.without_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=6, max_size=40), min_size=1, max_size=6), st.integers(2, 6))
def test_fm_index_finds_the_least_of_each_window(seqs, size):
    symbols = np.array([x for s in seqs for x in (*s, 0)])
    lengths = np.array([len(s) for s in seqs])
    ends = np.cumsum(lengths + 1) - 1
    index = FMIndex(symbols, np.repeat(np.arange(len(seqs))[::-1], lengths + 1), size)
    windows = [(tuple(s[i : i + size]), len(seqs) - 1 - k) for k, s in enumerate(seqs) for i in range(len(s) - size + 1)]
    want = [min(k for v, k in windows if v == w) for w, _ in windows]
    assert index.least_of_windows(symbols, ends, lengths).tolist() == want


# lines


def brute_lines(rows, run=3):
    split = [(d, (t.split("\n") if t is not None else [])) for d, t in rows]
    first = {}
    for d, x in split:
        for i in range(len(x) - run + 1):
            if d is not None:
                k = tuple(x[i : i + run])
                first[k] = min((d, i), first.get(k, (d, i)))
    out = []
    for d, x in split:
        gone = {j for i in range(len(x) - run + 1) if d is not None and first[tuple(x[i : i + run])] < (d, i) for j in range(i, i + run)}
        out.append((d, len(x), len(gone), "\n".join(s for i, s in enumerate(x) if i not in gone)))
    return sorted(out, key=repr)


def test_line_edges(frame, edge_rows):
    rows = edge_rows + [(20, "a\nb\nc\nd"), (21, "x\na\nb\nc\nd\ny"), (22, "a\nb"), (23, "q\nq\nq\nq\nq"), (24, "\n\n\n\n")]
    assert rows_of(line_dedup.line_dedup(frame(rows))) == brute_lines([r[:2] for r in rows])
    assert line_dedup.line_dedup(frame([])).count() == 0


def test_line_runs(frame):
    rng = random.Random(3)
    rows = [(d, "\n".join(rng.choice("abcde") for _ in range(rng.randrange(12)))) for d in range(50)]
    assert rows_of(line_dedup.line_dedup(frame(rows))) == brute_lines(rows)
    assert Counter(r["n_removed"] > 0 for r in line_dedup.line_dedup(frame(rows)).collect())[True] > 5


def test_near_duplicates_meet_by_their_fingerprints(frame, monkeypatch):
    signatures = simhash.signatures
    monkeypatch.setattr(simhash, "signatures", lambda *a: signatures(*a).withColumn("keys", F.array("rid")))  # no two rows share a band
    rng = np.random.default_rng(11)
    texts = [[f"w{v}" for v in rng.integers(0, 400, 300)] for _ in range(3)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(10 + i, "  ".join(t)) for i, t in enumerate(texts)] + [(20 + i, " ".join(t + ["end"])) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["root"] for r in simhash.near_duplicates(frame(rows)).collect()}
    hashes = [simhash.shingle_hashes(t.encode().split(), 5) for _, t in rows]
    prints = [simhash.fingerprint(np.unique(h)) for h in hashes]
    near = {i for i in range(3) if (prints[i] ^ prints[6 + i]).bit_count() <= 3}
    assert near and got == {d: d % 10 for i in range(3) for d in ((i, 10 + i, 20 + i) if i in near else (i, 10 + i))}
