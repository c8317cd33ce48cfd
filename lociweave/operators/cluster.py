"""Average-linkage trees, static and dynamic cuts, and modules from expression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialise
from .similarity import ROWS, STRIP, adjacent

#: Double strips of distances made at once.
WIDE = 4
#: Dynamic cut, medium sensitivity: how scattered a branch's core may be, and how short its gap, as shares of the usable height.
MOST_SCATTER, LEAST_GAP = 0.82, 0.135


def average_linkage(distance: np.ndarray, complete: bool = False, keep: bool = True) -> np.ndarray:
    """Merges (left, right, height, size) of a dense distance matrix in order of height, by nearest-neighbour chains;
    of complete linkage where asked.

    Leaves are 0 to n - 1, the merge in row m makes node n + m. Without keep no second matrix is made: the
    distances below the diagonal and on it are used up, those above it stay.
    """
    n = len(distance)
    d = distance.astype(float) if keep else distance
    np.fill_diagonal(d, np.inf)

    def of(i: int) -> np.ndarray:
        return d[i] if keep else np.concatenate([d[i, :i], d[i:, i]])

    size, alive, chain, found = np.ones(n), np.ones(n, bool), [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.argmax(alive))]
        while True:
            row = np.where(alive, of(chain[-1]), np.inf)
            row[chain[-1]] = np.inf
            near = int(np.argmin(row))
            if len(chain) > 1 and row[chain[-2]] <= row[near]:
                near = chain[-2]
            if len(chain) > 1 and near == chain[-2]:
                break
            chain.append(near)
        b, a = chain.pop(), chain.pop()
        a, b = min(a, b), max(a, b)
        found.append((a, b, d[b, a]))
        x, y = of(a), of(b)
        merged = np.maximum(x, y) if complete else (size[a] * x + size[b] * y) / (size[a] + size[b])
        if keep:
            d[a], d[:, a] = merged, merged
        else:
            d[a, :a], d[a:, a] = merged[:a], merged[a:]
        d[a, a] = np.inf
        size[a] += size[b]
        alive[b] = False
    order = sorted(range(len(found)), key=lambda i: found[i][2])
    node, count, out = list(range(n)), [1] * n, []
    parent: dict[int, int] = {}

    def top(i: int) -> int:
        while i in parent:
            i = parent[i]
        return i

    for m, i in enumerate(order):
        a, b, h = found[i]
        a, b = top(a), top(b)
        out.append((min(node[a], node[b]), max(node[a], node[b]), h, count[a] + count[b]))
        parent[b] = a
        node[a], count[a] = n + m, count[a] + count[b]
    return np.array(out, float).reshape(-1, 4)


def leaves(tree: np.ndarray, n: int) -> list[list[int]]:
    """The leaves below each node."""
    out = [[i] for i in range(n)]
    for a, b, *_ in tree:
        out.append(out[int(a)] + out[int(b)])
    return out


def by_size(groups: list[list[int]], n: int, least: int) -> np.ndarray:
    """Labels 1, 2, ... by falling size (ties: the smaller first leaf); 0 for groups below `least`."""
    labels = np.zeros(n, int)
    for k, g in enumerate(sorted((g for g in groups if len(g) >= least), key=lambda g: (-len(g), min(g))), 1):
        labels[g] = k
    return labels


def static_cut(tree: np.ndarray, n: int, height: float, least: int = 10) -> np.ndarray:
    """Branches of the tree below a height."""
    below, used = leaves(tree, n), np.zeros(n + len(tree), bool)
    for m, (a, b, h, _) in enumerate(tree):
        if h <= height:
            used[int(a)] = used[int(b)] = True
        else:
            used[n + m] = True
    return by_size([g for i, g in enumerate(below) if not used[i]], n, least)


def dynamic_cut(tree: np.ndarray, distance: np.ndarray, least: int = 30, pam: bool = True) -> np.ndarray:
    """Hybrid cut: branches that are large, tight and well separated when they merge; then the rest by distance to a module's medoid."""
    n = len(distance)
    if n < least or not len(tree):
        return np.zeros(n, int)
    heights = tree[:, 2]
    ref = float(np.quantile(heights, 0.05))
    cut = ref + 0.99 * (float(heights.max()) - ref)
    scatter_limit, gap_limit = ref + MOST_SCATTER * (cut - ref), LEAST_GAP * (cut - ref)
    closed: dict[int, list[list[int]]] = {i: [] for i in range(n)}  # modules already found below a node
    open_: dict[int, list[int] | None] = {i: [i] for i in range(n)}  # the branch that still grows

    def good(members: list[int], at: float) -> bool:
        if len(members) < least:
            return False
        core = members[: int(least / 2 + np.sqrt(max(len(members) - least / 2, 0)))]
        scatter = float(distance[np.ix_(core, core)].sum() / max(len(core) * (len(core) - 1), 1))
        return scatter < scatter_limit and at - scatter > gap_limit

    for m, (a, b, h, _) in enumerate(tree):
        a, b, node = int(a), int(b), n + m
        if h > cut:
            closed[node] = closed[a] + closed[b] + [x for x in (open_[a], open_[b]) if x and good(x, cut)]
            open_[node] = None
            continue
        x, y = open_.pop(a), open_.pop(b)
        closed[node] = closed.pop(a) + closed.pop(b)
        if x and y and good(x, h) and good(y, h):
            closed[node] += [x, y]
            open_[node] = None
        elif x and y:
            open_[node] = x + y if len(x) >= len(y) else y + x
        else:
            grown = x or y
            if grown and good(grown, h):
                closed[node] = closed[node] + [grown]
                grown = None
            open_[node] = None
    last = n + len(tree) - 1
    groups = closed[last] + ([open_[last]] if open_[last] and good(open_[last], cut) else [])
    labels = by_size([g for g in groups if g], n, least)
    if pam and labels.max() > 0:
        ks = range(1, labels.max() + 1)
        medoids, reach = [], []
        for k in ks:
            g = np.nonzero(labels == k)[0]
            c = int(np.concatenate([distance[np.ix_(g[lo : lo + STRIP], g)].mean(1) for lo in range(0, len(g), STRIP)]).argmin())
            medoids.append(g[c])
            reach.append(distance[g[c], g].max())
        rest = np.nonzero(labels == 0)[0]
        to = distance[np.ix_(rest, medoids)]
        near = to.argmin(1)
        inside = to[np.arange(len(rest)), near] <= np.array(reach)[near]
        labels[rest[inside]] = near[inside] + 1
    return by_size([np.nonzero(labels == k)[0].tolist() for k in range(1, labels.max() + 1)], n, 1) if labels.max() else labels


def eigenvector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """First right singular vector over samples of standardised genes, and its share of variance; it rises with mean expression."""
    sd = x.std(1, ddof=1, keepdims=True)
    z = np.divide(x - x.mean(1, keepdims=True), sd, out=np.zeros_like(x), where=sd > 0)
    w, v = np.linalg.eigh(z.T @ z)
    e, mean = v[:, -1], z.mean(0)
    if float(e @ mean) < 0:
        e = -e
    return e, float(w[-1] / max(w.sum(), 1e-300))


def merge_close(labels: np.ndarray, x: np.ndarray, height: float = 0.3) -> np.ndarray:
    """Modules whose eigengenes' tree joins them below `height` become one, until none are."""
    labels = labels.copy()
    while labels.max() > 1:
        ks = np.unique(labels[labels > 0])
        me = np.stack([eigenvector(x[labels == k])[0] for k in ks])
        d = 1 - np.corrcoef(me)
        groups = static_cut(average_linkage(d), len(ks), height, 1)
        if groups.max() == len(ks):
            break
        new = np.zeros_like(labels)
        for k, g in zip(ks, groups):
            new[labels == k] = g
        labels = by_size([np.nonzero(new == g)[0].tolist() for g in range(1, new.max() + 1)], len(labels), 1)
    return labels


def overlap(adjacent: np.ndarray) -> np.ndarray:
    """Topological overlap of a dense adjacency matrix without diagonal; 1 on the diagonal."""
    k = adjacent.sum(1)
    tom = (adjacent @ adjacent + adjacent) / (np.minimum(k[:, None], k[None, :]) + 1 - adjacent)
    np.fill_diagonal(tom, 1)
    return tom


def modules_of(x: np.ndarray, tom: np.ndarray, least: int = 30, merge: float = 0.3, kme: float = 0.3) -> np.ndarray:
    """Labels of genes (rows of x): tree of 1 - tom, hybrid cut, removal of genes far from their eigengene, merging."""
    d = 1 - tom
    return _pruned(x, dynamic_cut(average_linkage(d), d, least), least, merge, kme)


def distances(z: np.ndarray, power: float, out: np.ndarray) -> np.ndarray:
    """1 - overlap of unit vectors, written to out by strips; 0 on the diagonal. No other matrix of this size is made."""
    n, ids = len(z), np.arange(len(z))
    parts = [slice(lo, min(lo + 2 * STRIP, n)) for lo in range(0, n, 2 * STRIP)]
    k, room = np.concatenate([adjacent(z[p], z, power, ids[p], ids).sum(1) for p in parts]), np.empty(4 * STRIP * STRIP)
    for at in range(0, len(parts), WIDE):  # some strips at once, as each makes the adjacencies of all pairs of others anew
        p = slice(parts[at].start, parts[min(at + WIDE, len(parts)) - 1].stop)
        rows = adjacent(z[p], z, power, ids[p], ids)
        for q in parts[at:]:
            shared, w = np.zeros((p.stop - p.start, q.stop - q.start)), rows[:, q]
            for u in parts:
                shared += rows[:, u] @ adjacent(z[u], z[q], power, ids[u], ids[q], room[: (u.stop - u.start) * (q.stop - q.start)].reshape(u.stop - u.start, -1))
            out[p, q] = 1 - (shared + w) / (np.minimum(k[p][:, None], k[q][None, :]) + 1 - w)
    mirror(out)
    return out


def mirror(d: np.ndarray) -> None:
    """What stands above the diagonal is written below it, 0 on it; by strips."""
    for lo in range(0, len(d), STRIP):
        hi = min(lo + STRIP, len(d))
        d[hi:, lo:hi] = d[lo:hi, hi:].T
        own = np.triu(d[lo:hi, lo:hi], 1)
        d[lo:hi, lo:hi] = own + own.T


def _pruned(x: np.ndarray, labels: np.ndarray, least: int, merge: float, kme: float = 0.3) -> np.ndarray:
    """Labels without genes far from their eigengene, close modules merged."""
    for k in range(1, labels.max() + 1):
        g = np.nonzero(labels == k)[0]
        e = eigenvector(x[g])[0]
        r = np.array([np.corrcoef(v, e)[0, 1] if v.std() > 0 else 0.0 for v in x[g]])
        labels[g[np.abs(r) < kme]] = 0
        if (labels == k).sum() < least:
            labels[labels == k] = 0
    labels = by_size([np.nonzero(labels == k)[0].tolist() for k in np.unique(labels[labels > 0])], len(labels), 1)
    return merge_close(labels, x, merge)


def _square(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur in rows (s, t, distance), in order, and their distances as a square matrix."""
    ids = np.unique(np.concatenate([rows["s"], rows["t"]]))
    at, to = np.searchsorted(ids, rows["s"]), np.searchsorted(ids, rows["t"])
    d = np.zeros((len(ids), len(ids)))
    d[at, to] = d[to, at] = rows["distance"]
    return ids, d


def _with_alone(distances: DataFrame, samples: DataFrame | None) -> DataFrame:
    """distances, and each of the samples at distance 0 from itself, so that a sample without any other counts."""
    if samples is None:
        return distances
    return distances.select("s", "t", "distance").union(samples.select("sample_ord", "sample_ord", F.lit(0.0)))


def sample_tree(distances: DataFrame) -> DataFrame:
    """(step, left_, right_, height, size) of samples from (s, t, distance); samples are few, so one task builds the tree.

    Leaves are numbered from 0 in order of the sample ids that occur.
    """

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        tree = average_linkage(_square(rows)[1])
        return pd.DataFrame({"step": np.arange(len(tree)), "left_": tree[:, 0].astype(int), "right_": tree[:, 1].astype(int), "height": tree[:, 2], "size": tree[:, 3].astype(int)})

    return distances.groupBy(F.lit("all").alias("tree")).applyInPandas(build, "step bigint, left_ bigint, right_ bigint, height double, size bigint")


def sample_order(distances: DataFrame, traits: DataFrame) -> DataFrame:
    """(sample_ord, place, trait): the leaves of the samples' tree from left to right, with their trait."""

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        ids, d = _square(rows)
        return pd.DataFrame({"sample_ord": ids[leaves(average_linkage(d), len(ids))[-1]], "place": np.arange(len(ids))})

    return distances.groupBy(F.lit("all").alias("tree")).applyInPandas(order, "sample_ord bigint, place bigint").join(traits, "sample_ord", "left")


def keep_samples(distances: DataFrame, height: float | None = None, least: int = 10, samples: DataFrame | None = None) -> DataFrame:
    """(sample_ord, label, keep): keep the largest branch below the height; everything without a height.

    samples (sample_ord): all samples, so that one that has no distance to another is in the result.
    """

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        ids, d = _square(rows)
        labels = np.ones(len(ids), int) if height is None else static_cut(average_linkage(d), len(ids), height, least)
        return pd.DataFrame({"sample_ord": ids, "label": labels, "keep": labels == 1})

    return _with_alone(distances, samples).groupBy(F.lit("all").alias("tree")).applyInPandas(split, "sample_ord bigint, label bigint, keep boolean")


def label_sizes(labelled: DataFrame, label: str = "label") -> DataFrame:
    """(label, n): the size of each group, the ungrouped (0) too."""
    return labelled.groupBy(label).agg(F.count("*").alias("n"))


def modules_in_block(rows: pd.DataFrame, unit, power: float, least: int, merge: float) -> pd.DataFrame:
    """(iter, gene_id, b, module) of the genes (gene_id, v, b, out, iter) of one block and iteration."""
    rows = rows.sort_values("gene_id").reset_index(drop=True)
    it = int(rows["iter"].iloc[0])
    raw = np.stack(rows["v"].to_numpy()).astype(float)
    z = unit(raw)
    keep = np.ones(len(rows), bool) if it == 0 else (rows["out"].fillna(0) != it).to_numpy()
    labels = np.zeros(len(rows), int)
    d = np.empty((keep.sum(), keep.sum()))
    tree = average_linkage(distances(z[keep], power, d), keep=False)
    mirror(d)  # what the tree has used up
    labels[keep] = _pruned(raw[keep], dynamic_cut(tree, d, least), least, merge)
    return pd.DataFrame({"iter": it, "gene_id": rows["gene_id"], "b": rows["b"], "module": pd.array(np.where(keep, labels, -1), "Int64").astype("Int64")}).assign(module=lambda f: f["module"].where(f["module"] >= 0))


def detect_modules(expr: DataFrame, power: float, kind: str = "bicor", least: int = 30, merge: float = 0.3, block: int = 20_000, held_out: DataFrame | None = None, iterations: int = 0) -> DataFrame:
    """(iter, gene_id, module) of (gene_id, v): labels by falling size, 0 for none; iter 0 is the full network.

    Blocks of about `block` genes, dealt by a hash, are clustered apart; modules of different blocks whose
    eigengenes are closer than `merge` become one. A block is dense in one task: one matrix of block
    squared numbers, made once. With held_out (gene_id, iter) and iterations, each iteration is one task more, in
    which the genes held out have module null.
    """
    unit = ROWS[kind]
    n = max(1, -(-expr.count() // block))
    x = expr.select("gene_id", "v", F.pmod(F.xxhash64("gene_id"), F.lit(n)).cast("int").alias("b"))
    x = x.join(held_out.select("gene_id", F.col("iter").alias("out")), "gene_id", "left") if held_out is not None else x.withColumn("out", F.lit(0))
    x = x.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(iterations))))

    found = x.groupBy("b", "iter").applyInPandas(lambda rows: modules_in_block(rows, unit, power, least, merge), "iter int, gene_id bigint, b int, module bigint")
    if n == 1:
        return found.select("iter", "gene_id", F.col("module").cast("int").alias("module"))
    wide = F.when(F.col("module") > 0, F.col("module") * n + F.col("b")).otherwise(F.col("module"))
    return merge_blocks(expr, materialise(found.select("iter", "gene_id", wide.alias("module")), "block-modules"), merge)


def merge_blocks(expr: DataFrame, labels: DataFrame, height: float) -> DataFrame:
    """(iter, gene_id, module) of labels, with modules of an iteration joined whose eigengenes' tree joins them below `height`; by falling size."""
    me = eigengenes(expr, labels.where("module > 0").select("gene_id", F.struct("iter", "module").alias("module")))
    sizes = labels.where("module > 0").groupBy("iter", "module").agg(F.count("*").alias("n"), F.min("gene_id").alias("first"))
    values = me.groupBy(F.col("module.iter").alias("iter"), F.col("module.module").alias("module")).agg(F.array_sort(F.collect_list(F.struct("sample_ord", "me"))).alias("x"))

    def join(rows: pd.DataFrame) -> pd.DataFrame:  # a row for each module of an iteration
        rows = rows.sort_values("module").reset_index(drop=True)
        group = np.arange(1, len(rows) + 1)
        if len(rows) > 1:
            with np.errstate(invalid="ignore"):
                d = np.nan_to_num(1 - np.corrcoef(np.stack(rows["x"].to_numpy()).astype(float)), nan=1.0)
            group = static_cut(average_linkage(d), len(rows), height, 1)
        whole = rows.assign(group=group).groupby("group").agg(n=("n", "sum"), first=("first", "min")).sort_values(["n", "first"], ascending=[False, True])
        final = {g: i for i, g in enumerate(whole.index, 1)}
        return pd.DataFrame({"iter": rows["iter"], "module": rows["module"], "final": [final[g] for g in group]})

    final = values.select("iter", "module", F.col("x.me").alias("x")).join(sizes, ["iter", "module"]).groupBy("iter").applyInPandas(join, "iter int, module bigint, final int")
    return labels.join(final, ["iter", "module"], "left").select("iter", "gene_id", F.when(F.col("module") > 0, F.col("final")).otherwise(F.col("module")).cast("int").alias("module"))


def eigengenes(expr: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, sample_ord, me, explained): the eigengene of each module but 0, from (gene_id, v).

    A module's samples by samples product is summed over partial blocks, so no task holds a module.
    """
    labelled = modules.where("module <> 0") if "struct" not in dict(modules.dtypes)["module"] else modules
    x = expr.select("gene_id", "v").join(labelled, "gene_id").withColumn("part", F.pmod(F.xxhash64("gene_id"), F.lit(64)))

    def gram(rows: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(rows["v"].to_numpy()).astype(float)
        sd = m.std(1, ddof=1, keepdims=True)
        z = np.divide(m - m.mean(1, keepdims=True), sd, out=np.zeros_like(m), where=sd > 0)
        return pd.DataFrame({"g": [(z.T @ z).tobytes()], "m": [z.sum(0).tobytes()]})

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        mean = sum(np.frombuffer(v) for v in rows["m"])
        g = sum(np.frombuffer(v) for v in rows["g"]).reshape(len(mean), -1)
        w, v = np.linalg.eigh(g)
        e = v[:, -1] if float(v[:, -1] @ mean) >= 0 else -v[:, -1]
        return pd.DataFrame({"sample_ord": np.arange(len(e)), "me": e, "explained": float(w[-1] / max(w.sum(), 1e-300))})

    names = x.select("module").distinct().select(F.xxhash64("module").alias("name"), "module")
    parts = x.withColumn("name", F.xxhash64("module")).groupBy("name", "part").applyInPandas(lambda key, rows: gram(rows).assign(name=key[0]), "g binary, m binary, name bigint")
    solved = parts.groupBy("name").applyInPandas(lambda key, rows: solve(rows).assign(name=key[0]), "sample_ord bigint, me double, explained double, name bigint")
    return solved.join(names, "name").select("module", "sample_ord", "me", "explained")


def trait_correlation(me: DataFrame, traits: DataFrame) -> DataFrame:
    """(module, corr, n): correlation of a value per sample with the trait, over samples that have both."""
    x = me.join(traits, "sample_ord").where("me is not null and trait is not null")
    return x.groupBy("module").agg(F.corr("me", "trait").alias("corr"), F.count("*").alias("n"))
