"""Fits of cells by margins against dense ones, and the search for sets."""

import itertools
import math
import random

import numpy as np
import pytest

from paramlens.operators import interactions as I
from paramlens.plans.cells import Target


def cells(rng, sizes, missing=0.0):
    every = [c for c in itertools.product(*map(range, sizes)) if rng.random() >= missing]
    code = np.array(every).T
    code = np.stack([np.unique(row, return_inverse=True)[1] for row in code])
    n = rng.integers(1, 40, len(every)).astype(float)
    return code, [int(r.max()) + 1 for r in code], n


def dense(code, sizes, margins):
    columns = [np.ones(code.shape[1])]
    for m in margins:
        flat = np.ravel_multi_index([code[j] for j in m], [sizes[j] for j in m])
        columns += [(flat == v).astype(float) for v in np.unique(flat)]
    return np.stack(columns, axis=1)


@pytest.mark.parametrize("sizes,missing", [((3, 4), 0), ((5, 6), 0.3), ((6, 7), 0.75), ((2, 3, 4), 0), ((3, 3, 2), 0.2), ((2, 2, 2, 3), 0)])
def test_fits_and_ranks_are_those_of_least_squares(sizes, missing):
    rng = np.random.default_rng(4)
    for _ in range(5):
        code, own, n = cells(rng, sizes, missing)
        margins = list(itertools.combinations(range(len(own)), len(own) - 1))
        mean = rng.normal(size=len(n)) + 1e3
        x, w = dense(code, own, margins), np.sqrt(n)
        coef, _, rank, _ = np.linalg.lstsq(x * w[:, None], mean * w, rcond=None)
        fit, got = I.fitted_means(code, own, margins, n, mean)
        assert got == rank and np.abs(fit - x @ coef).max() < 1e-6
        hits = np.minimum(n, rng.binomial(n.astype(int), 0.4)).astype(float)
        h = I.proportional(code, own, margins, n, hits)
        for m in margins:  # the margins and totals are met, and what is left has the form of the model
            flat = np.ravel_multi_index([code[j] for j in m], [own[j] for j in m])
            assert np.abs(np.bincount(flat, h) - np.bincount(flat, hits)).max() < 1e-4 * n.sum()
        inside = (h > 1e-6) & (h < n - 1e-6)
        if inside.all():
            logit = np.log(h / (n - h))
            assert np.abs(logit - x @ np.linalg.lstsq(x, logit, rcond=None)[0]).max() < 1e-5
        assert I.deviance(code, own, margins, n, hits)[0] >= 0


def test_best_sets_come_in_order_and_are_made_when_asked_for():
    rng = random.Random(3)
    dims = [f"d{i}" for i in range(10)]
    strength = {d: rng.random() for d in dims}
    pairs = {frozenset(p): rng.random() ** 3 for p in itertools.combinations(dims, 2) if rng.random() < 0.6}

    def score(s):
        return sum(strength[d] for d in s) + sum(pairs.get(frozenset(p), 0.0) for p in itertools.combinations(s, 2))

    for size in (2, 3, 5):
        want = sorted((-score(s), s) for s in itertools.combinations(dims, size))
        got = list(I.best_sets(strength, pairs, size))
        assert len(got) == math.comb(10, size) and all(abs(a[0] + b[0]) < 1e-9 for a, b in zip(got, want, strict=True))
        assert len({s for _, s in got}) == len(got) and all(abs(score(s) - w) < 1e-9 for w, s in got)


def test_a_search_over_many_dimensions_lists_few():
    dims = [f"p{i:02d}" for i in range(26)]
    effects = [(d, 0.5 / (i + 1)) for i, d in enumerate(dims)]
    pairs = [(dims[i], dims[j], 0.3 / (1 + i * j)) for i in range(26) for j in range(i)]
    made = []
    push = I.heapq.heappush
    I.heapq.heappush = lambda q, x: (made.append(1), push(q, x))
    try:
        got = I.combo_plan(dims, pairs, 6, 50, effects)
    finally:
        I.heapq.heappush = push
    assert len(got) == 50 and got[0] == tuple(dims[:6]) and len(made) < 40_000  # there are 230,230
    assert I.budget(1000, 3) == 2000 and I.budget(10**6, 4) == 100 and I.budget(10**9, 6) == 50


def test_strengths():
    assert I.strengths([("a", 0.2), ("b", -0.1), ("c", None)], [("a", "b", 0.3, True), ("b", "c", 0.9, False)]) == {"a": 0.3, "b": 0.3, "c": 0.0}


def test_search_finds_a_planted_set(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, (4000, 6))
    y = 2.0 * (x[:, 1] & x[:, 2] & x[:, 4]) + rng.normal(0, 1, 4000)
    df = spark.createDataFrame([(*map(int, r), float(v)) for r, v in zip(x, y, strict=True)], ", ".join(f"d{i} int" for i in range(6)) + ", y double")
    dims, target = [f"d{i}" for i in range(6)], Target("y")
    pairs = I.interactions(df, target, dims)
    effects = spark.createDataFrame([(d, 0.01) for d in dims], "dim string, omega2 double")
    found = I.search(df, target, dims, 3, effects, pairs, batch=7)
    top = found.orderBy("p").first()
    assert top["dims"] == ["d1", "d2", "d4"] and top["detectable"] and found.count() == 20
    table = I.cell_table(df, target, ("d1", "d2", "d4")).collect()
    assert len(table) == 8 and abs(sum(r["n"] * (r["mean"] - r["fitted"]) for r in table)) < 1e-6
