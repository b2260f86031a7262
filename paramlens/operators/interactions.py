"""Interactions of two to six dimensions, and association between dimensions.

Facts are aggregated to cells by Spark; each set's small table of cells is then fitted by itself,
many sets at a time.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import intervals as I
from ..functions import kernel
from ..plans.cells import Target, keyed, set_cells

#: Cells with fewer rows make a set too sparse to test.
MIN_CELL = 5


def _codes(levels: list[list[str]]) -> tuple[np.ndarray, list[int]]:
    columns = [pd.factorize(np.array([x[j] for x in levels]), sort=True) for j in range(len(levels[0]))]
    return np.stack([c[0] for c in columns]), [len(c[1]) for c in columns]


def _groups(code: np.ndarray, sizes: list[int], margins: list[tuple[int, ...]]) -> list[tuple[np.ndarray, int]]:
    """For each margin the group that every cell is in, numbered among those that there are, and how many."""
    out = []
    for m in margins:
        flat = np.ravel_multi_index([code[j] for j in m], [sizes[j] for j in m]) if m else np.zeros(code.shape[1], dtype=int)
        _, at = np.unique(flat, return_inverse=True)
        out.append((at, int(at.max()) + 1))
    return out


def _parts(a: np.ndarray, b: np.ndarray, na: int) -> int:
    """Into how many unconnected parts the rows and columns of a table fall."""
    root = np.arange(na)
    while True:
        least = np.full(int(b.max()) + 1, na)
        np.minimum.at(least, b, root[a])
        new = root.copy()
        np.minimum.at(new, a, least[b])
        if (new == root).all():
            return len(np.unique(root))
        root = new


def rank_of(code: np.ndarray, sizes: list[int], margins: list[tuple[int, ...]]) -> int:
    """How many numbers the margins' terms are worth, without a matrix of them where the table is whole or has two sides."""
    cells = code.shape[1]
    whole = cells == int(np.prod(sizes))
    if whole and len(margins) == len(sizes) and all(len(m) == len(sizes) - 1 for m in margins):
        return cells - int(np.prod([s - 1 for s in sizes]))
    if all(len(m) == 1 for m in margins) and len(margins) == 2:
        (a, na), (b, nb) = _groups(code, sizes, margins)
        return na + nb - _parts(a, b, na)
    columns = [np.ones(cells)] + [(at == v).astype(float) for at, n in _groups(code, sizes, margins) for v in range(n)]
    return int(np.linalg.matrix_rank(np.stack(columns, axis=1)))


def fitted_means(code: np.ndarray, sizes: list[int], margins: list[tuple[int, ...]], n: np.ndarray, mean: np.ndarray, rounds: int = 2000) -> tuple[np.ndarray, int]:
    """Weighted least squares of cell means on the margins' terms, and the rank of the fit.

    Each margin in turn takes the weighted mean of what the others leave, until that moves nothing; memory follows the cells.
    """
    groups = _groups(code, sizes, margins)
    grand = float((n * mean).sum() / n.sum())
    parts = [np.zeros(len(n)) for _ in groups]
    weights = [np.bincount(at, weights=n, minlength=k) for at, k in groups]
    scale = max(1e-300, float(np.abs(mean - grand).max()))
    fit = np.full(len(n), grand)
    for _ in range(rounds):
        moved = 0.0
        for j, (at, k) in enumerate(groups):
            step = (np.bincount(at, weights=n * (mean - fit), minlength=k) / weights[j])[at]
            parts[j] += step
            fit = fit + step
            moved = max(moved, float(np.abs(step).max()))
        if moved <= 1e-13 * scale:
            break
    return fit, rank_of(code, sizes, margins)


def proportional(code: np.ndarray, sizes: list[int], margins: list[tuple[int, ...]], n: np.ndarray, hits: np.ndarray, rounds: int = 500) -> np.ndarray:
    """The hits that a logistic model on the margins gives each cell: hits and misses are scaled to their margins and the cells' totals in turn."""
    groups = _groups(code, sizes, margins)
    seen = np.stack([hits, n - hits])
    fit = np.stack([n * hits.sum() / n.sum(), n * (1 - hits.sum() / n.sum())])
    own = [np.stack([np.bincount(at, weights=x, minlength=k) for x in seen]) for at, k in groups]
    for _ in range(rounds):
        before = fit[0]
        for (at, k), due in zip(groups, own, strict=True):
            now = np.stack([np.bincount(at, weights=x, minlength=k) for x in fit])
            fit = fit * np.divide(due, now, out=np.zeros_like(now), where=now > 0)[:, at]
            both = fit.sum(axis=0)
            fit = fit * np.divide(n, both, out=np.zeros_like(both), where=both > 0)
        if np.abs(fit[0] - before).max() < 1e-9 * max(1.0, n.sum()) / 1000:
            break
    return fit[0]


def deviance(code: np.ndarray, sizes: list[int], margins: list[tuple[int, ...]], n: np.ndarray, hits: np.ndarray) -> tuple[float, int]:
    """Deviance of a logistic model on the margins from one rate a cell, and its rank."""
    fit = proportional(code, sizes, margins, n, hits)
    with np.errstate(divide="ignore", invalid="ignore"):
        one = np.where(hits > 0, hits * np.log(hits / fit), 0) + np.where(n - hits > 0, (n - hits) * np.log((n - hits) / (n - fit)), 0)
    return max(0.0, 2 * float(one.sum())), rank_of(code, sizes, margins)


def _interaction(binary: bool, least: int):
    columns = ["dims", "N", "cells", "F", "D", "df", "dfW", "p", "omega2", "SSI", "min_cell", "sparse"]

    def one(part: pd.DataFrame) -> pd.DataFrame:
        dims = list(part["dims"].iloc[0])
        code, sizes = _codes([list(x) for x in part["levels"]])
        n, s, ss = (part[c].to_numpy(dtype=float) for c in ("n", "s", "ss"))
        low = 0 if len(n) < int(np.prod(sizes)) else int(n.min())
        margins = [m for m in combinations(range(len(dims)), len(dims) - 1)]
        total, cells = n.sum(), len(n)
        out = dict.fromkeys(columns, math.nan) | {"dims": dims, "N": int(total), "cells": cells, "min_cell": low, "sparse": low < least}
        if not out["sparse"]:
            fit, rank = fitted_means(code, sizes, margins, n, s / n)
            df, df_w = cells - rank, total - cells
            inner, inter = float(np.maximum(0, ss - s * s / n).sum()), float((n * (s / n - fit) ** 2).sum())
            every = max(0.0, float(ss.sum() - s.sum() ** 2 / total))
            out |= {"df": df, "dfW": df_w, "SSI": inter}
            if df > 0 and df_w > 0 and inner > 0:
                ms = inner / df_w
                out |= {"F": inter / df / ms, "omega2": (inter - df * ms) / (every + ms) if every > 0 else 0.0}
                out["p"] = kernel.f_survival(out["F"], df, df_w)
            elif df > 0 and df_w > 0:
                out |= {"F": math.inf if inter > 0 else math.nan, "p": float(inter <= 0), "omega2": inter / every if every > 0 else 0.0}
            if binary and df > 0:
                d, rank = deviance(code, sizes, margins, n, part["total"].to_numpy(dtype=float))
                out |= {"D": d, "df": cells - rank, "p": kernel.chi2_survival(d, cells - rank)}
        return pd.DataFrame([out], columns=columns)

    return one


_SCHEMA = "dims array<string>, N long, cells long, F double, D double, df double, dfW double, p double, omega2 double, SSI double, min_cell long, sparse boolean"


def interactions(sweep: DataFrame, target: Target, dims: list[str], size: int = 2, sets: list[tuple[str, ...]] | None = None, least: int | None = None) -> DataFrame:
    """For every set of dimensions, the part of the target beyond all smaller sets, with p and q.

    A continuous target has an F test, a binary one a likelihood-ratio test. Sets of three or more
    with a cell under ``MIN_CELL`` rows are marked sparse and not tested.
    """
    least = (0 if size == 2 else MIN_CELL) if least is None else least
    cells = set_cells(sweep, target, dims, size, sets).where(F.col("n") > 0)
    found = cells.groupBy("dims").applyInPandas(_interaction(target.binary, least), _SCHEMA)
    clean = found.withColumns({c: F.nanvl(c, F.lit(None)) for c in ("F", "D", "df", "dfW", "p", "omega2", "SSI")})
    return I.with_q(clean)


def moderators(sweep: DataFrame, target: Target, dims: list[str], parents: list[str]) -> DataFrame:
    """Interactions of each dimension with each parent, one family of tests, strongest first."""
    sets = sorted({tuple(sorted((d, p))) for d, p in product(dims, parents) if d != p})
    order = sorted({d for s in sets for d in s})
    return interactions(sweep, target, order, 2, sets).where(F.col("p").isNotNull()).coalesce(1).sortWithinPartitions("p")


def acts(sweep: DataFrame, target: Target, dim: str, parents: list[str]) -> DataFrame:
    """Where a dimension acts, one row at most: its strongest detectable moderator, and the levels of that inside which it shows.

    ``kind`` is "only" where a pooled test over the other levels finds nothing, "modulated" where it acts in
    those too or in all, "unresolved" where no level has the rows to show it. ``pooled_p`` is the stratified
    test over the other levels: summed squares for F, or summed G.
    """
    from .effects import acts_where

    others = [p for p in parents if p != dim]
    found = interactions(sweep, target, [*others, dim], 2, [(p, dim) for p in others])
    top = found.where("detectable").select(F.element_at("dims", 1).alias("parent"), "p", "q").orderBy("p", "parent").limit(1)
    inside = acts_where(sweep, target, dim, others).join(F.broadcast(top.withColumnRenamed("p", "_p").withColumnRenamed("q", "_q")), "parent")  # one row
    on, off = F.col("detectable"), ~F.col("detectable")
    off_sum = (lambda c: F.sum(F.when(off & F.col("G" if target.binary else "SSB").isNotNull(), F.col(c))))
    pooled = [off_sum("G").alias("_g"), off_sum("dfG").alias("_d1")] if target.binary else [off_sum("SSB").alias("_b"), off_sum("SSW").alias("_w"), off_sum("df1").alias("_d1"), off_sum("df2").alias("_d2")]
    one = inside.groupBy("parent").agg(
        F.first("_p").alias("p"), F.first("_q").alias("q"), F.array_sort(F.collect_list(F.when(on, F.col("level")))).alias("on"),
        F.array_sort(F.collect_list(F.when(off, F.col("level")))).alias("off"), F.max_by("level", F.when(on, F.struct("omega2", "level"))).alias("strongest"), *pooled,
    )
    if target.binary:
        p = F.when(F.col("_d1") > 0, kernel.column(kernel.chi2_survival, F.col("_g"), F.col("_d1")))
    else:
        ratio = F.try_divide(F.col("_b") / F.col("_d1"), F.nullif(F.col("_w") / F.col("_d2"), F.lit(0.0)))
        p = F.when((F.col("_d1") > 0) & (F.col("_d2") > 0) & (F.col("_w") > 0), kernel.column(kernel.f_survival, ratio, F.col("_d1"), F.col("_d2")))
    one = one.withColumn("pooled_p", p)
    kind = F.when(F.size("on") == 0, "unresolved").when((F.size("off") > 0) & (F.col("pooled_p") > I.ALPHA), "only").otherwise("modulated")
    return one.select(F.lit(dim).alias("dim"), "parent", "p", "q", kind.alias("kind"), "on", "off", "pooled_p", "strongest")


def chosen_set(tests: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """(dims, why): the strongest detectable set; for pairs without one, the pair that was drawn together the most."""
    best = tests.where("detectable").orderBy(F.desc("omega2"), "dims").limit(1).select("dims", F.lit("strongest").alias("why"), F.lit(0).alias("_o"))
    if linked is not None:
        drawn = linked.where("linked").orderBy(F.desc("V"), "a", "b").limit(1)
        best = best.unionByName(drawn.select(F.array("a", "b").alias("dims"), F.lit("drawn together").alias("why"), F.lit(1).alias("_o")))
    return best.orderBy("_o").limit(1).drop("_o")


_FITTED = "levels array<string>, fitted double"


def _fitted(binary: bool):
    def one(part: pd.DataFrame) -> pd.DataFrame:
        code, sizes = _codes([list(x) for x in part["levels"]])
        margins = list(combinations(range(len(sizes)), len(sizes) - 1))
        n, s = part["n"].to_numpy(dtype=float), part["s"].to_numpy(dtype=float)
        if binary:
            fit = proportional(code, sizes, margins, n, part["total"].to_numpy(dtype=float)) / n
        else:
            fit = fitted_means(code, sizes, margins, n, s / n)[0] + part["base_mean"].to_numpy(dtype=float)
        return pd.DataFrame({"levels": part["levels"], "fitted": fit})

    return one


def cell_table(sweep: DataFrame, target: Target, dims: tuple[str, ...]) -> DataFrame:
    """The cells of a set of dimensions: ``l0``..., n, mean, interval, what all smaller sets give (``fitted``), and whether they are withheld.

    The fit of a binary target is a logistic one.
    """
    from .effects import mean_interval

    cells = set_cells(sweep, target, list(dims), len(dims)).where(F.col("n") > 0)
    fits = cells.groupBy("dims").applyInPandas(_fitted(target.binary), _FITTED)
    out = mean_interval(cells, target).join(fits, "levels")
    at = [F.element_at("levels", i + 1).alias(f"l{i}") for i in range(len(dims))]
    return out.select(*at, "n", "mean", "lo", "hi", "fitted", (F.col("n") < I.MIN_N).alias("withheld"))


def pair_table(sweep: DataFrame, target: Target, a: str, b: str) -> DataFrame:
    """The cells of a pair with mean, interval, the value that an additive fit gives, and whether they are withheld."""
    return cell_table(sweep, target, (a, b)).withColumnsRenamed({"l0": "a", "l1": "b"})


def association(sweep: DataFrame, dims: list[str]) -> DataFrame:
    """Cramer's V of each pair of dimensions over rows to which both apply, with chi-squared and p.

    Pairs that are linked beyond chance and by more than 0.03 are marked; they were not drawn independently.
    """
    keys = keyed(sweep, dims)
    rows = sweep.select(*[keys[d].alias(d) for d in dims]).withColumn("_one", F.lit(1.0))
    cells = set_cells(rows, Target("_one"), dims, 2).select(
        F.element_at("dims", 1).alias("a"), F.element_at("dims", 2).alias("b"), F.element_at("levels", 1).alias("la"), F.element_at("levels", 2).alias("lb"), F.col("n").cast("double").alias("o")
    )
    # Cells without rows add their expected count; over all cells these sum to N. The windows are over cells.
    pair = W.partitionBy("a", "b")
    seen = cells.withColumns({"ra": F.sum("o").over(W.partitionBy("a", "b", "la")), "cb": F.sum("o").over(W.partitionBy("a", "b", "lb")), "N": F.sum("o").over(pair)})
    e = F.col("ra") * F.col("cb") / F.col("N")
    out = seen.groupBy("a", "b").agg(F.sum(F.col("o") * F.col("o") / e).alias("t"), F.first("N").alias("N"), F.size(F.collect_set("la")).alias("ua"), F.size(F.collect_set("lb")).alias("ub"))
    out = out.where("ua >= 2 and ub >= 2").withColumn("chi2", F.greatest(F.lit(0.0), F.col("t") - F.col("N")))
    out = out.withColumns({"df": (F.col("ua") - 1) * (F.col("ub") - 1), "V": F.sqrt(F.col("chi2") / (F.col("N") * (F.least("ua", "ub") - 1)))})
    out = out.withColumn("p", kernel.column(kernel.chi2_survival, F.col("chi2"), F.col("df")))
    return out.withColumn("linked", (F.col("p") < 1e-6) & (F.col("V") > 0.03)).select("a", "b", "N", "chi2", "df", "V", "p", "linked")


def uniformity(sweep: DataFrame, dim: str, levels: DataFrame | None = None) -> DataFrame:
    """Chi-squared test that all levels are equally frequent: (N, k, chi2, p, uneven).

    ``levels`` may list levels (``level``) that the context lacks; they count with no rows.
    """
    key = keyed(sweep, [dim])[dim]
    counts = sweep.select(key.alias("level")).where(F.col("level").isNotNull()).groupBy("level").agg(F.count("*").alias("o"))
    if levels is not None:
        counts = levels.select("level").distinct().join(counts, "level", "left").fillna(0, ["o"])
    sums = counts.agg(F.sum("o").alias("N"), F.count("*").alias("k"), F.sum(F.col("o") * F.col("o")).alias("t"))
    out = sums.withColumn("chi2", F.when(F.col("k") >= 2, F.try_divide(F.col("t") * F.col("k"), F.col("N")) - F.col("N")))
    out = out.withColumn("p", kernel.column(kernel.chi2_survival, F.col("chi2"), F.col("k") - 1))
    return out.select("N", "k", "chi2", "p", (F.col("p") < 1e-6).alias("uneven"))


#: Sets that a search tests at most, and rows it reads for them.
SETS, READS = 2000, 400_000_000


def budget(rows: int, size: int) -> int:
    """How many sets of a size a search may test: each reads every row once for each of its dimensions; 50 in any case."""
    return max(50, min(SETS, READS // max(1, rows * size)))


def strengths(effects: list[tuple[str, float]], pairs: list[tuple[str, str, float, bool]]) -> dict[str, float]:
    """By dimension: what it does alone, or with another where that is detectable, whichever is more; never below 0."""
    found = {d: max(0.0, w or 0.0) for d, w in effects}
    for a, b, w, detectable in pairs:
        if detectable:
            found[a], found[b] = max(found.get(a, 0.0), w), max(found.get(b, 0.0), w)
    return found


def best_sets(strength: dict[str, float], pairs: dict[frozenset, float], size: int) -> Iterator[tuple[float, tuple[str, ...]]]:
    """Sets of a size, strongest first, made one by one: (strength, dimensions).

    A set is as strong as its dimensions and its pairs together. Parts of sets wait in a queue under the most that
    they can still reach, so sets that are never asked for are never made.
    """
    order = sorted(strength, key=lambda d: (-strength[d], d))
    joint = [[pairs.get(frozenset((a, b)), 0.0) for b in order] for a in order]
    most = [max(row, default=0.0) for row in joint]

    def more(k: int, at: int, chosen: tuple[int, ...]) -> float:
        """The most that k further dimensions, from a place in the order on, can add."""
        gains = [strength[order[i]] + sum(joint[i][j] for j in chosen) + (k - 1) / 2 * most[i] for i in range(at, len(order))]
        return sum(heapq.nlargest(k, gains))

    count = itertools.count()
    queue: list[tuple[float, int, int, float, tuple[int, ...]]] = []

    def put(score: float, chosen: tuple[int, ...]) -> None:
        at = chosen[-1] + 1 if chosen else 0
        left = size - len(chosen)
        if len(order) - at >= left:
            heapq.heappush(queue, (-(score + more(left, at, chosen)), -len(chosen), next(count), score, chosen))

    put(0.0, ())
    while queue:
        *_, score, chosen = heapq.heappop(queue)
        if len(chosen) == size:
            yield score, tuple(sorted(order[i] for i in chosen))
            continue
        for i in range(chosen[-1] + 1 if chosen else 0, len(order)):
            put(score + strength[order[i]] + sum(joint[i][j] for j in chosen), (*chosen, i))


def combo_plan(dims: list[str], pairs: list[tuple[str, str, float]], size: int, sets: int = SETS, effects: list[tuple[str, float]] = ()) -> list[tuple[str, ...]]:
    """Sets to test first: those whose dimensions and pairs do most, as many as the budget allows, without listing the others."""
    alone = dict.fromkeys(dims, 0.0) | {d: max(0.0, w or 0.0) for d, w in effects if d in dims}
    joint = {frozenset((a, b)): max(0.0, w or 0.0) for a, b, w in pairs}
    return [tuple(sorted(s, key=dims.index)) for _, s in itertools.islice(best_sets(alone, joint, size), sets)]


def search(sweep: DataFrame, target: Target, dims: list[str], size: int, effects: DataFrame, pairs: DataFrame, batch: int = 250) -> DataFrame:
    """Interactions of the strongest sets within the budget of sets and row reads, q over all that were tested.

    ``effects`` has (dim, omega2), ``pairs`` (dims, omega2, detectable). Sets go through the facts in batches, one scan each
    that groups by all sets of the batch; names and strengths of dimensions are what reaches the driver.
    """
    alone = [(r["dim"], r["omega2"]) for r in effects.select("dim", "omega2").collect()]
    joint = [(*r["dims"], r["omega2"]) for r in pairs.where("detectable").select("dims", "omega2").collect()]
    chosen = combo_plan(dims, joint, size, budget(sweep.count(), size), alone)
    tests = [interactions(sweep, target, dims, size, chosen[i : i + batch]).drop("q", "detectable") for i in range(0, len(chosen), batch)]
    if not tests:
        return I.with_q(sweep.sparkSession.createDataFrame([], _SCHEMA))
    return I.with_q(reduce(DataFrame.unionByName, tests))
