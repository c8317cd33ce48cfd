"""Language ID, quality, language model, tokens, decontamination and mixing."""

import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lociweave.llm import decontamination, language, language_model, mixing, quality, tokens


def crc(d):
    return zlib.crc32(str(d).encode())


def auc(y, s):
    rank = np.argsort(np.argsort(s))
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


# language


def test_language_held_out_accuracy(spark, sf_dir):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = language.op3_language_id(spark, sf_dir).collect()
    assert len(got) == len(truth) and all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.95


def test_language_edges(frame, edge_rows):
    got = language.identify(frame(edge_rows)).collect()
    assert len(got) == len(edge_rows)
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0 for i in (1, 2, 3, 5, 12)) and by_id[6]["lang_pred"] == "en"
    assert language.identify(frame([])).count() == 0
    assert {r["lang_pred"] for r in language.identify(frame([(1, "some text", "s", None)])).collect()} == {"und"}
    kept = language.keep_identified(frame(edge_rows))
    assert kept.columns == frame([]).columns and {6, 7, 8} <= {r["doc_id"] for r in kept.collect()} and kept.where("text is null").count() == 0


def test_language_ignores_lang_of_held_out_rows(frame):
    rows = [(i, ("the house and the tree " if i % 2 else "das haus und der baum ") * 3 + str(i), "s", "en" if i % 2 else "de") for i in range(80)]
    flip = [(*r[:3], "xx") if crc(r[0]) % 5 == 0 else r for r in rows]
    a, b = ({r["doc_id"]: tuple(r) for r in language.identify(frame(x)).collect()} for x in (rows, flip))
    assert a == b


def test_temperature_lowers_loss():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 400)
    z = 9 * (np.eye(3)[np.where(rng.random(400) < 0.8, y, rng.integers(0, 3, 400))])
    loss = lambda t: -np.log(language.softmax(z / t)[np.arange(400), y]).mean()
    t = language.temperature(z, y)
    assert loss(t) < loss(1.0) and t > 1


# quality


def test_quality_held_out(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = quality.op7_quality_classifier(spark, sf_dir).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (crc(r["doc_id"]) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert auc(np.array([labels[r["doc_id"]] for r in held]), np.array([r["score"] for r in held])) > 0.9


def test_quality_edges(spark, frame, edge_rows):
    labels = spark.createDataFrame([(6, 1, 0), (5, 0, 0), (9, None, 1), (None, 1, 0), (77, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(frame(edge_rows), labels).count() == len(edge_rows)
    assert {r["score"] for r in quality.quality_scores(frame(edge_rows), labels.where("false")).collect()} == {0.5}
    assert quality.quality_scores(frame([]), labels).count() == 0


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    fm = quality.FactorisationMachine(rng.normal(size=quality.DIM), rng.normal(size=(quality.DIM, quality.RANK)), 0.3)
    at, x = quality.features(b"Some words, some WORDS 12!\nMore words", quality.WordIds())
    pairs = sum(float(fm.factors[at[i]] @ fm.factors[at[j]]) * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert fm.logit(at, x) == pytest.approx(0.3 + float(x @ fm.linear[at]) + pairs)


# language model


def test_lm_counts_and_scores(frame, edge_rows, monkeypatch):
    monkeypatch.setattr(language_model, "HEAD", 40)
    rng = random.Random(6)
    prose = [(100 + i, " ".join(rng.choice(["the cat sat", "a dog ran", "the dog sat", "one Bird sang"]) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows = edge_rows[:8] + edge_rows[10:] + prose
    got = language_model.score(frame(rows)).collect()
    count = Counter()
    for d, t, *_ in rows:
        if d is not None and crc(d) % 5 != 1:
            count.update((t or "").encode().lower().split() + [b"\n"])
    n, den = sum(count.values()), math.log10(sum(count.values()) + 0.5 * (len(count) + 1))
    want = Counter()
    for d, t, *_ in rows:
        w = (t or "").encode().lower().split() + [b"\n"]
        want[(d, d is not None and crc(d) % 5 == 1, len(w), sum(count[x] > 0 for x in w), n, round(sum(math.log10(count[x] + 0.5) - den for x in w), 6))] += 1
    assert Counter((*r[:5], round(r["base_score"], 6)) for r in got) == want
    held = [r for r in got if r["held_out"] and r["doc_id"] >= 100]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert language_model.score(frame([])).count() == 0


def test_lm_layers_are_distributions():
    rng = np.random.default_rng(2)
    for layer in language_model.layers_of(1000):
        w = rng.normal(size=(layer.rows, layer.outputs)).astype(np.float32)
        norm = layer.normalisers(w)
        context = rng.integers(0, layer.contexts, 50)
        p = sum(np.exp(layer.log_probability(w, norm, context, np.full(50, k))) for k in range(layer.outputs))
        assert np.allclose(p, 1, atol=1e-4)
        n = rng.integers(1, 9, 50)
        want = np.zeros(w.shape)
        for c, m in zip(context, n):
            rows = [int(r[0]) for r in layer.active(np.array([c]))]
            e = np.exp(w[rows].sum(0).astype(float))
            for r in rows:
                want[r] += m * e / e.sum()
        assert np.allclose(language_model.expected(layer, w, context, n), want, atol=1e-3)


def test_lm_shares_use_rows_of_their_own():
    for layer in language_model.layers_of(1 << 30):
        context = np.random.default_rng(3).integers(0, layer.contexts, 20_000)
        share = context >> layer.two & (1 << language_model.SHARE_BITS) - 1
        _, before, _, both = layer.active(context)
        for rows in (before, both):
            assert len(set(zip(rows.tolist(), share.tolist()))) == len(set(rows.tolist()))
    assert sum(4 * x.size for x in language_model.layers_of(1 << 60)) < 77e6


def test_lm_score_against_plain_python(frame, edge_rows, monkeypatch):
    """The score column, recomputed word by word from the weights; and a word after a rare word is learned."""
    monkeypatch.setattr(language_model, "HEAD", 70)
    rng, held = random.Random(8), {}
    train = language_model.train
    monkeypatch.setattr(language_model, "train", lambda counts, words: held.setdefault("weights", train(held.setdefault("counts", counts), held.setdefault("words", words))))
    vocab = [f"{rng.choice('abcdefgh')}{rng.choice('klmnop')}{i}" for i in range(150)]
    follows = dict(zip(vocab, rng.sample(vocab, len(vocab))))
    rows = [(100 + i, " ".join(f"{w} {follows[w]}" for w in rng.choices(vocab, k=rng.randrange(1, 60)))) for i in range(150)] + edge_rows[:8]
    got = language_model.score(frame(rows)).collect()
    words, weights = held["words"], held["weights"]
    layers, count = language_model.layers_of(words.tokens), Counter()
    for d, t, *_ in rows:
        if crc(d) % 5 != 1:
            count.update((t or "").encode().lower().split() + [b"\n"])
    single = words.head[: language_model.SINGLE]

    def soft(layer, w, own, before, skipped, k):
        context = layer.context(own, np.array([before]), np.array([skipped]))
        z = sum(w[int(r[0])].astype(float) for r in layer.active(context))
        return z[k] - math.log(np.exp(z).sum())

    leaf_words = {}
    for w in count:
        leaf_words.setdefault(single.index(w) if w in single else language_model.leaf_of(w), []).append(w)

    def plain(text):
        total, past = 0.0, [b"\n", b"\n"]
        for w in text.encode().lower().split() + [b"\n"]:
            leaf, before, skipped = (single.index(x) if x in single else language_model.leaf_of(x) for x in (w, past[-1], past[-2]))
            before, skipped = (language_model.numbered_as(x, 0, k) >> 32 for x, k in ((past[-1], before), (past[-2], skipped)))
            kind, sub = divmod(leaf - language_model.SINGLE, language_model.SUBCLASSES)
            total += soft(layers[0], weights[0], 0, before, skipped, leaf if w in single else language_model.SINGLE + kind)
            if w not in single:
                total += soft(layers[1], weights[1], kind, before, skipped, sub)
            mates = leaf_words.get(leaf, [])
            total += math.log((count[w] + 0.5) / (sum(count[x] for x in mates) + 0.5 * (len(mates) + 1)))
            past.append(w)
        return total / math.log(10)

    texts = dict((d, t or "") for d, t, *_ in rows)
    for r in got[:60]:
        assert r["score"] == pytest.approx(plain(texts[r["doc_id"]]), abs=1e-3 * r["n_tokens"] ** 0.5)
    out = [r for r in got if r["held_out"] and r["doc_id"] >= 100]
    assert sum(r["score"] - r["base_score"] for r in out) / sum(r["n_tokens"] for r in out) > 0.2


# tokens


@pytest.fixture(scope="module")
def word_bpe():
    return public_tokenizers.path("word_bpe_49k.json")


def test_tokens_match_the_library(spark, sf_dir, frame, edge_rows, word_bpe):
    library = Tokenizer.from_file(word_bpe)
    library.no_truncation()
    rng = random.Random(8)
    pool = [*"abstremlvd'' \t\n\x1c\x85 ’0123½²Ⅳ̄ßÜÉéİΣσςǅ!!?.,<|>-_…漢かな가́​🙂", "<|endoftext|>", "<|startoftext|>", "'re", "'ll", "don't", " the "]
    texts = [(i, "".join(rng.choice(pool) for _ in range(rng.randrange(80)))) for i in range(3000)] + [r[:2] for r in edge_rows]
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    got = tokens.token_counts(frame(texts), word_bpe).collect()
    want = Counter((d, len((t or "").encode()), count(t), count(t) > 2048) for d, t in texts)
    assert Counter(map(tuple, got)) == want
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert all(r["n_tokens"] == count(docs[r["doc_id"]]) for r in tokens.op6_token_counts(spark, sf_dir).collect())
    assert tokens.token_counts(frame([]), word_bpe).count() == 0


def merged(one, symbols):
    """The leftmost pair of the earliest merge becomes one, until no pair has a merge."""
    while True:
        ranks = [one.merges.get(p, 1 << 30) for p in zip(symbols, symbols[1:])]
        if not ranks or min(ranks) == 1 << 30:
            return symbols
        i = ranks.index(min(ranks))
        symbols = [*symbols[:i], min(ranks), *symbols[i + 2 :]]


def test_word_automaton_emits_what_merging_gives(word_bpe):
    one, rng = tokens.compiled(word_bpe), random.Random(4)
    for _ in range(3000):
        word = "".join(rng.choice("aabtheionsé") for _ in range(rng.randrange(1, 40)))
        symbols = list(word.encode())
        symbols[-1] += tokens.LAST_BYTE
        assert one.emitted(word) == len(merged(one, symbols))


def test_one_long_word_takes_linear_time(word_bpe):
    one, rng = tokens.compiled(word_bpe), random.Random(5)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000))
    began = time.perf_counter()
    whole = one.count([word])[0]
    assert time.perf_counter() - began < 30
    library = Tokenizer.from_file(word_bpe)
    library.no_truncation()
    assert one.count([word[:20_000]])[0] == len(library.encode(word[:20_000], add_special_tokens=False).ids) and whole > 100_000


def test_chunk_maps_compose(word_bpe):
    one = tokens.compiled(word_bpe)
    kinds = np.random.default_rng(3).choice(5, 3000).astype(np.uint8)
    state, want = tokens.IDLE, []
    for k in kinds:
        want.append(bool(one.starts[state * 8 + k]))
        state = int(one.next[state * 8 + k])
    assert one.marks(kinds).tolist() == want


# decontamination

QUESTION = "If Alice has 12 apples and Bob gives her 5 km of rope then how many apples does Alice hold at the end of it all"


def brute_contains(text, item):
    a, b = (text or "").split(), item.split()
    return any(a[i : i + len(b)] == b for i in range(len(a) - len(b) + 1))


def test_decontamination_edges(spark, frame, edge_rows):
    bench = spark.createDataFrame([(1, QUESTION), (2, None), (3, ""), (4, "two words"), (None, "x y z"), (5, edge_rows[5][1])], "item_id long, text string")
    again = QUESTION.replace("Alice", "Carol").replace("12", "99").replace("5 km", "7 kg")
    mixed = again.replace("does Carol hold", "does Erin hold")
    rows = edge_rows + [(30, QUESTION), (31, "Well now. " + again), (32, mixed), (33, "here are two words."), (34, "two other words")]
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(frame(rows), bench).collect()}
    assert {(6, 5), (7, 5), (8, 5), (None, 5), (30, 1), (31, 1), (33, 4)} <= set(got) and got[(30, 1)]["changed_slots"] == 0 and got[(31, 1)]["changed_slots"] == 5
    assert got.get((32, 1)) is None or got[(32, 1)]["windows"] < got[(31, 1)]["windows"]
    assert not {d for d, _ in got} & {1, 2, 3, 4, 5, 9, 10, 11, 34}
    assert decontamination.contaminated(frame([]), bench).count() == 0 and decontamination.contaminated(frame(rows), bench.where("false")).count() == 0
    kept = decontamination.keep_uncontaminated(frame(rows), bench)
    assert {1, 2, 4, 9, 34} <= {r["doc_id"] for r in kept.collect()} and kept.where("doc_id in (6, 30, 31)").count() == 0


def test_decontamination_finds_all_verbatim_items(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    want = {(d["doc_id"], b["item_id"]) for d in docs for b in bench if brute_contains(d["text"], b["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.op4_benchmark_decontamination(spark, sf_dir).collect()}
    assert want <= got and len(got - want) <= 0.02 * len(docs)


def test_decontamination_finds_excerpts_insertions_and_longer_names(spark, frame):
    long, short = [f"alpha{i}" for i in range(59)], [f"beta{i}" for i in range(15)]
    asked = "yesterday {0} gave away seven coins, then {0} lost one coin while {0} ran, so later {0} found that {0} kept nothing"
    bench = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(short)), (3, asked.format("Tom"))], "item_id long, text string")
    other = " ".join(f"gamma{i}" for i in range(40))
    rows = [(1, f"{other} {' '.join(long[20:42])} {other}"), (2, f"{other} {' '.join(short[:8] + ['extra'] + short[8:])} {other}"), (3, f"{other} {asked.format('Mary Ann')} {other}")]
    rows += [(4, f"{other} {' '.join(long[20:32])} {other}"), (5, f"{other} {' '.join(short[:8])} {other}")]
    halves = long[:20] + other.split() + long[30:40] + other.split()[::-1] + long[45:]
    rows += [(6, " ".join(halves))]
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(frame(rows), bench).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 3), (6, 1)}
    assert got[(1, 1)]["windows"] == 15 and got[(1, 1)]["at_word"] == 20 and got[(3, 3)]["coverage"] == 1 and got[(6, 1)]["windows"] == 13 + 3 + 7


def test_decontamination_of_no_texts():
    block = decontamination.Block([(1, QUESTION.encode())])
    assert block.hits([], decontamination.Codes()) == [] and block.hits([b"", b" \n "], decontamination.Codes()) == [[], []]


def test_decontamination_in_blocks(spark, frame, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", 30)
    bench = spark.createDataFrame([(i, f"item {i} has words a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i}") for i in range(12)], "item_id long, text string")
    rows = [(i, f"before item {i} has words a{i} b{i} c{i} d{i} e{i} f{i} g{i} h{i} after") for i in range(12)]
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(frame(rows), bench).collect()}
    assert got == {(i, i) for i in range(12)} and decontamination.keep_uncontaminated(frame(rows), bench).count() == 0


# mixing


def test_mix_reaches_targets(frame):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 30)), None if i % 7 == 0 else f"s{min(i % 5, 3)}") for i in range(600)] + [(1000 + i, None, "s1") for i in range(5)] + [(2000, "", "empty")]
    got = mixing.mix(frame(rows)).collect()
    source = {r[0]: r[2] for r in rows}
    total = sum(r["size"] for r in got)
    sums = {}
    for r in got:
        t = sums.setdefault(source[r["doc_id"]], [0, r["target"], r["source_size"]])
        t[0] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert sum(t for _, t, _ in sums.values()) == pytest.approx(1.5 * total)
    assert all(abs(taken - target) <= 15 and target <= 2 * size for taken, target, size in sums.values())
    names = sorted((s for s in sums if s is not None)) + [None]
    level = [sums[s][1] / w for s, w in zip(names, [3, 1, 2] * 2) if sums[s][1] < 2 * sums[s][2]]
    assert max(level) == pytest.approx(min(level))
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(frame(rows).repartition(5)).collect()), key=repr)


def test_mix_edges(frame, edge_rows):
    assert mixing.mix(frame(edge_rows)).count() == len(edge_rows) and mixing.mix(frame([])).count() == 0
    got = mixing.mix_documents(frame(edge_rows))
    assert got.columns == [*frame([]).columns, "mix_copies"] and got.where("mix_copies not in (1, 2)").count() == 0
