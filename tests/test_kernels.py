"""Numeric kernels against direct numpy and published definitions."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lociweave.functions.expressions import incomplete_beta
from lociweave.operators import cluster, enrich, similarity


def planted(seed=3, modules=4, size=60, noise=60, samples=40):
    rng = np.random.default_rng(seed)
    factors = rng.normal(size=(modules, samples))
    rows, truth = [], []
    for m in range(modules):
        for load in rng.uniform(0.75, 0.95, size):
            rows.append(load * factors[m] + math.sqrt(1 - load**2) * rng.normal(size=samples))
            truth.append(m + 1)
    rows += list(rng.normal(size=(noise, samples)))
    return np.array(rows), np.array(truth + [0] * noise)


def adjusted_rand(a, b):
    table = pd.crosstab(a, b).to_numpy()
    pairs = lambda x: (x * (x - 1) / 2).sum()
    n = table.sum()
    expected = pairs(table.sum(0)) * pairs(table.sum(1)) / (n * (n - 1) / 2)
    return (pairs(table) - expected) / ((pairs(table.sum(0)) + pairs(table.sum(1))) / 2 - expected)


def brute_linkage(d):
    groups, heights = {i: [i] for i in range(len(d))}, []
    while len(groups) > 1:
        h, a, b = min((np.mean([d[i, j] for i in x for j in y]), p, q) for p, x in groups.items() for q, y in groups.items() if p < q)
        heights.append(h)
        groups[a] += groups.pop(b)
    return np.array(heights)


@settings(max_examples=25, deadline=None)
@given(st.integers(3, 14), st.integers(0, 1000))
def test_average_linkage_heights(n, seed):
    x = np.random.default_rng(seed).normal(size=(n, 4))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    tree = cluster.average_linkage(d)
    assert np.allclose(np.sort(tree[:, 2]), np.sort(brute_linkage(d)))
    assert tree[-1, 3] == n and sorted(cluster.leaves(tree, n)[-1]) == list(range(n))


def test_static_cut_keeps_the_largest_branch():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(24, 30))
    x[20:] += 10
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    labels = cluster.static_cut(cluster.average_linkage(d), 24, 20.0, 10)
    assert (labels[:20] == 1).all() and (labels[20:] == 0).all()


def test_planted_modules_are_found():
    x, truth = planted()
    z = similarity.bicor_rows(x)
    a = np.abs(np.clip(z @ z.T, -1, 1)) ** 6
    np.fill_diagonal(a, 0)
    labels = cluster.modules_of(x, cluster.overlap(a), 30)
    assert labels.max() == 4 and adjusted_rand(labels, truth) > 0.8


def test_overlap_properties():
    x, _ = planted(modules=2, size=20, noise=10)
    z = similarity.pearson_rows(x)
    a = np.abs(np.clip(z @ z.T, -1, 1)) ** 4
    np.fill_diagonal(a, 0)
    tom = cluster.overlap(a)
    assert np.allclose(tom, tom.T) and tom.min() >= 0 and tom.max() <= 1 + 1e-12


def test_pearson_and_bicor_rows():
    x = np.random.default_rng(1).normal(size=(5, 30))
    assert np.allclose(similarity.pearson_rows(x) @ similarity.pearson_rows(x).T, np.corrcoef(x))
    flat = np.vstack([np.ones(30), np.r_[np.zeros(25), np.arange(5)]])
    assert np.allclose(similarity.pearson_rows(flat)[0], 0)
    assert np.allclose(similarity.bicor_rows(flat)[1], similarity.pearson_rows(flat)[1])  # zero deviation falls back


def test_eigenvector_sign_follows_the_mean():
    x, _ = planted(modules=1, size=30, noise=0)
    for sign in (1, -1):
        e, share = cluster.eigenvector(sign * x)
        assert float(e @ (sign * x).mean(0)) > 0 and 0 < share <= 1


@pytest.mark.parametrize("r, n, p", [(0.5, 10, 0.14111328125), (0.0, 12, 1.0), (1.0, 9, 0.0), (0.9, 4, 0.1)])
def test_student_p(r, n, p):
    assert float(incomplete_beta(np.array([(n - 2) / 2]), 0.5, np.array([1 - r * r]))[0]) == pytest.approx(p, abs=1e-9)


def test_module_labels_fall_with_size():
    assert cluster.by_size([[0, 1], [2, 3, 4], [5]], 6, 2).tolist() == [2, 2, 1, 1, 1, 0]


def test_complete_linkage_against_brute_force():
    rng = np.random.default_rng(4)
    for n in (1, 2, 12, 30):
        d = rng.random((n, n))
        d = np.maximum(d, d.T)
        np.fill_diagonal(d, 0)
        groups = [[i] for i in range(n)]
        while len(groups) > 1:
            h, a, b = min((d[np.ix_(a, b)].max(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
            if h > 0.6:
                break
            groups[a] += groups.pop(b)
        want = np.zeros(n, int)
        for k, g in enumerate(sorted(groups, key=min), 1):
            want[g] = k
        assert enrich.complete_linkage_groups(d, 0.6).tolist() == want.tolist()


def test_hypergeometric_tail_against_sums():
    from math import comb, log10

    cases = [(k, n, m, 40) for k in (0, 1, 3, 12) for n in (0, 5, 40) for m in (0, 7, 40)]
    got = enrich.hypergeometric_tail.func(*(pd.Series(c) for c in zip(*cases)))
    for (k, n, m, t), g in zip(cases, got):
        p = sum(comb(m, j) * comb(t - m, n - j) for j in range(max(k, 0), min(m, n) + 1)) / comb(t, n)
        assert g == (-np.inf if p == 0 else pytest.approx(log10(p), abs=1e-9))
