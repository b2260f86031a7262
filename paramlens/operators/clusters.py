"""Groups of trials with like outcomes.

Outcomes are scaled to their share of ranks. Centres are found on a sample of bounded size, chosen
by a hash, with a distance that leaves missing values out; then every row is assigned where it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import intervals as I
from ..plans.cells import Target, level_cells
from ..plans.ranges import order_statistics
from .halves import mann_whitney, rank_scale, shares

#: Rows that the number of groups, silhouettes and centres are found on, at most.
CHOOSE, JUDGE, FIT = 2000, 1000, 20_000
LEAST_GROUP, LEAST_SILHOUETTE = 30, 0.26
#: Distinct values of an outcome up to which their shares of ranks are broadcast, some 30 MB; rows are shuffled by value beyond.
BROADCAST = 1_000_000


def _distance(x: np.ndarray, c: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Squared distances over outcomes that both have, scaled up to all weight."""
    seen = ~np.isnan(x)[:, None, :] & ~np.isnan(c)[None, :, :]
    off = np.where(seen, np.nan_to_num(x)[:, None, :] - np.nan_to_num(c)[None, :, :], 0.0)
    weight = (seen * w).sum(axis=2)
    return np.where(weight > 0, (off * off * w).sum(axis=2) * w.sum() / np.maximum(weight, 1e-12), np.inf)


def _lloyd(x: np.ndarray, k: int, w: np.ndarray, rng: np.random.Generator, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Seeds far apart, then moves centres; an empty group takes the farthest row."""
    centres = x[[rng.integers(len(x))]]
    while len(centres) < k:
        near = np.minimum(_distance(x, centres, w).min(axis=1), 1e12)
        centres = np.concatenate([centres, x[[rng.choice(len(x), p=near / near.sum()) if near.sum() > 0 else rng.integers(len(x))]]])
    for _ in range(rounds):
        d = _distance(x, centres, w)
        own = d.argmin(axis=1)
        new = centres.copy()
        for j in range(k):
            part = x[own == j]
            if len(part):
                known = ~np.isnan(part)
                new[j] = np.where(known.any(axis=0), np.nansum(part, axis=0) / np.maximum(1, known.sum(axis=0)), np.nan)
            else:
                new[j] = x[d.min(axis=1).argmax()]
        if np.array_equal(new, centres, equal_nan=True):
            break
        centres = new
    return centres, float(_distance(x, centres, w).min(axis=1).sum())


def silhouette(x: np.ndarray, own: np.ndarray, w: np.ndarray) -> float:
    d = np.sqrt(_distance(x, x, w))
    groups = [np.flatnonzero(own == j) for j in np.unique(own)]
    if len(groups) < 2:
        return -1.0
    means = np.stack([d[:, g].mean(axis=1) for g in groups], axis=1)
    at = np.searchsorted(np.unique(own), own)
    size = np.array([len(g) for g in groups])[at]
    a = means[np.arange(len(x)), at] * size / np.maximum(1, size - 1)
    means[np.arange(len(x)), at] = np.inf
    b = means.min(axis=1)
    return float(np.where(size > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0.0).mean())


def grade(s: float) -> str:
    return "strong" if s >= 0.71 else "reasonable" if s >= 0.51 else "weak" if s >= LEAST_SILHOUETTE else "none"


def fit(x: np.ndarray, w: np.ndarray, seed: int = 0x5EED) -> tuple[np.ndarray, float]:
    """Centres of the best number of groups from 2 to 7, and their silhouette; none if groups aren't apart."""
    rng = np.random.default_rng(seed)
    best: tuple[float, int] = (-1.0, 0)
    for k in range(2, 8):
        some = x[:CHOOSE]
        if len(some) < k * LEAST_GROUP:
            break
        centres = min((_lloyd(some, k, w, rng) for _ in range(4)), key=lambda r: r[1])[0]
        own = _distance(some, centres, w).argmin(axis=1)
        s = silhouette(some[:JUDGE], own[:JUDGE], w)
        if np.bincount(own, minlength=k).min() >= LEAST_GROUP and s > best[0]:
            best = (s, k)
    if best[0] < LEAST_SILHOUETTE:
        return np.zeros((0, x.shape[1])), best[0]
    return min((_lloyd(x[:FIT], best[1], w, rng) for _ in range(4)), key=lambda r: r[1])[0], best[0]


@dataclass(frozen=True)
class Outcome:
    """A target with what it tells: score, activity, risk or skill, if known; ``usable`` is false for flags, diagnostics and costs."""

    column: str
    kind: str | None = None
    usable: bool = True


def drawn_from(outcomes: list[Outcome]) -> list[Outcome]:
    """The outcomes that groups are drawn from: those whose kind is known, scores first; all usable ones where only scores are."""
    told = [o for kind in ("score", "activity", "risk", "skill") for o in outcomes if o.usable and o.kind == kind]
    if any(o.kind != "score" for o in told):
        return told
    return [Outcome(o.column, "outcome") for o in outcomes if o.usable]


def weights_of(outcomes: list[Outcome]) -> list[float]:
    """Every kind weighs the same, shared among its outcomes."""
    kinds = [o.kind for o in outcomes]
    return [1 / kinds.count(k) for k in kinds]


def profile(rows: DataFrame, cluster: str, outcomes: list[str]) -> DataFrame:
    """(cluster, outcome, n, share_seen, median, rank, stands_out, high): what each group is like, one row an outcome.

    The median is a value that a row has. A group stands out on the two outcomes whose mean rank is furthest from
    the middle, of those that half of the group has. Groups are few; runs small jobs at once.
    """
    scaled = rows.select(cluster, *[F.col(c).cast("double").alias(c) for c in outcomes])
    for c in outcomes:
        scaled = rank_scale(scaled, c).withColumnRenamed("share", f"_r_{c}")
    groups = [r[0] for r in rows.where(F.col(cluster).isNotNull()).select(cluster).distinct().orderBy(cluster).collect()]
    columns = {(g, c): F.when(F.col(cluster) == g, F.col(c)) for g in groups for c in outcomes}
    medians = order_statistics(rows, columns, (0.5,)) if columns else {}
    table = rows.sparkSession.createDataFrame([(g, c, at[0][0] if n else None) for (g, c), (n, at) in medians.items()], f"`{cluster}` {dict(rows.dtypes)[cluster]}, outcome string, median double")
    long = scaled.where(F.col(cluster).isNotNull()).select(cluster, F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c).alias("outcome"), F.col(f"_r_{c}").alias("r")) for i, c in enumerate(outcomes)])))
    means = long.groupBy(cluster, "outcome", "i").agg(F.count("*").alias("n"), (F.count("r") / F.count("*")).alias("share_seen"), F.avg("r").alias("rank"))
    seen = F.col("share_seen") >= 0.5
    far = W.partitionBy(cluster).orderBy(F.desc_nulls_last(F.when(seen, F.abs(F.col("rank") - 0.5))), "i")
    means = means.withColumn("stands_out", seen & (F.row_number().over(far) <= 2))
    return means.join(table, [cluster, "outcome"]).select(cluster, "outcome", "n", "share_seen", "median", "rank", "stands_out", (F.col("rank") > 0.5).alias("high"))


def assign(sweep: DataFrame, outcomes: list[str], key: list[str], weights: list[float] | None = None) -> DataFrame:
    """The key columns and ``cluster``, 0 the largest; null for rows with under half the weight, or without groups."""
    w = np.array(weights or [1.0] * len(outcomes))
    rows = sweep.select(*key, *[F.col(c).cast("double").alias(c) for c in outcomes])
    tables, told = {}, {}
    for c in outcomes:
        # Ranks are worked out once for the sample and both passes over rows.
        tables[c] = shares(rows, c).localCheckpoint()
        told[c] = tables[c].agg(F.count("*").alias("values"), F.count("share").alias("shares")).first()

    def scaled(some: DataFrame) -> DataFrame:
        for c in outcomes:
            own = tables[c].select(F.col("_v"), F.col("share").alias("_share"))
            own = F.broadcast(own) if told[c]["values"] <= BROADCAST else own
            some = some.join(own, F.col(c) == F.col("_v"), "left").drop("_v", c).withColumnRenamed("_share", c)
        return some

    known = sum((F.when(F.col(c).isNotNull(), F.lit(float(v))).otherwise(0.0) for c, v in zip(outcomes, w) if told[c]["shares"]), F.lit(0.0))
    order = [F.xxhash64(*key), *key]
    picked = rows.where(known >= w.sum() / 2).orderBy(*order).limit(FIT)
    sample = scaled(picked).orderBy(*order).select(*outcomes).toPandas().to_numpy(dtype=float)
    centres, _ = fit(sample, w) if len(sample) else (np.zeros((0, len(outcomes))), -1.0)
    if len(centres):
        size = np.bincount(_distance(sample, centres, w).argmin(axis=1), minlength=len(centres))
        centres = centres[np.argsort(-size, kind="stable")]
    kinds = dict(rows.dtypes)

    def grouped(part: pd.DataFrame) -> np.ndarray:
        x = part[outcomes].to_numpy(dtype=float)
        ok = (~np.isnan(x) * w).sum(axis=1) >= w.sum() / 2
        own = _distance(x, centres, w).argmin(axis=1) if len(centres) else np.zeros(len(x))
        return np.where(ok & bool(len(centres)), own, np.nan)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part[key].assign(cluster=pd.Series(grouped(part), index=part.index).astype("Int64"))

    def tally(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            own = grouped(part)
            found, n = np.unique(own[~np.isnan(own)].astype("int64"), return_counts=True)
            yield pd.DataFrame({"cluster": found, "n": n})

    out = scaled(rows).mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in key) + ", cluster long")
    # The sample's sizes give an order to begin with; all rows decide which group is the largest.
    sizes = scaled(rows.select(*outcomes)).mapInPandas(tally, "cluster long, n long").groupBy("cluster").agg(F.sum("n").alias("_n"))
    named = sizes.select("cluster", (F.row_number().over(W.orderBy(F.desc("_n"), "cluster")) - 1).cast("long").alias("_c"))  # seven rows at most
    return out.join(F.broadcast(named), "cluster", "left").select(*key, F.col("_c").alias("cluster"))


def composition(sweep: DataFrame, dims: list[str], inside: Column) -> DataFrame:
    """(dim, level, n, n_in): how often each level occurs, and inside a group."""
    from ..plans.cells import keyed

    keys = keyed(sweep, dims)
    rows = sweep.select(*[keys[d].alias(d) for d in dims], F.coalesce(inside, F.lit(False)).cast("long").alias("_in"))
    return rows.unpivot(["_in"], dims, "dim", "level").where(F.col("level").isNotNull()).groupBy("dim", "level").agg(F.count("*").alias("n"), F.sum("_in").alias("n_in"))


def apart(sweep: DataFrame, dims: list[str], inside: Column) -> DataFrame:
    """(dim, n, n_in, G, df, V, p, q, detectable): how far each dimension's levels are shared out unlike inside a group, the furthest first.

    G tests independence of being inside and the level; V is the root of G a row, at most 1.
    """
    from .effects import effects

    own = Target("_in", binary=True)
    cells = level_cells(sweep.withColumn("_in", F.coalesce(inside, F.lit(False)).cast("double")), own, dims)
    sums = cells.groupBy("dim").agg(F.sum("total").cast("long").alias("n_in"))
    out = I.with_q(effects(cells, own, "dim").join(sums, "dim"))
    out = out.select("dim", F.col("N").alias("n"), "n_in", "G", F.col("dfG").alias("df"), F.least(F.lit(1.0), F.sqrt(F.col("G") / F.col("N"))).alias("V"), "p", "q", "detectable")
    return out.orderBy(F.desc_nulls_last("V"), "dim")


def outcome_tests(sweep: DataFrame, targets: list[Target], inside: Column, drawn: list[str] = ()) -> DataFrame:
    """(outcome, test, n_in, n_out, value_in, value_out, shift, p, q): each outcome inside a group against the rest.

    A binary outcome has a G test and rates, another one a Mann-Whitney test, medians left to ``profile``, and the
    share of pairs in which the group's value is the larger. Outcomes that the group was drawn from aren't tested.
    """
    from .effects import effects

    rows = sweep.withColumn("_in", F.coalesce(inside, F.lit(False)))
    parts = None
    for t in targets:
        null = F.lit(None).cast("double")
        if t.binary:
            flagged = rows.withColumn("_g", F.when(F.col("_in"), "in").otherwise("out"))
            cells = level_cells(flagged, t, ["_g"])
            side = lambda g, c: F.max(F.when(F.col("level") == g, c))
            rates = cells.groupBy("dim").agg(*[side(g, F.col("n")).alias(f"n_{g}") for g in ("in", "out")], *[side(g, F.col("total") / F.col("n")).alias(f"value_{g}") for g in ("in", "out")])
            one = effects(cells, t, "dim").join(rates, "dim").select(F.lit(t.column).alias("outcome"), F.lit("G").alias("test"), "n_in", "n_out", "value_in", "value_out", null.alias("shift"), "p")
        else:
            means = rows.agg(F.avg(F.when(F.col("_in"), F.col(t.column))).alias("value_in"), F.avg(F.when(~F.col("_in"), F.col(t.column))).alias("value_out"))
            one = mann_whitney(rows, t.column, "_in").crossJoin(F.broadcast(means)).select(  # one row
                F.lit(t.column).alias("outcome"), F.lit("Mann-Whitney").alias("test"), F.col("na").alias("n_in"), F.col("nb").alias("n_out"), "value_in", "value_out", "shift", "p"
            )
        if t.column in drawn:
            one = one.withColumn("p", null)
        parts = one if parts is None else parts.unionByName(one)
    return I.with_q(parts)
