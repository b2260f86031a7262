"""One-way effects: the board, its levels, and what they show in both halves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import intervals as I
from ..functions import kernel
from ..plans.cells import Target, level_cells, moments_of, set_cells, value
from ..plans.ranges import ranged, running


def mean_interval(cells: DataFrame, target: Target) -> DataFrame:
    """Adds mean, sd, lo and hi to cells; a binary target has a score interval, others a t interval."""
    n, mean = F.col("n"), F.try_divide("total", "n")
    if target.binary:
        lo, hi = I.wilson(F.col("total"), n)
        return cells.withColumns({"mean": mean, "sd": F.sqrt(mean * (1 - mean)), "lo": lo, "hi": hi})
    sd = F.sqrt(I.variance(n, F.col("s"), F.col("ss")))
    half = kernel.column(lambda df: kernel.t_inv(0.975, df), F.when(n >= 2, n - 1)) * sd / F.sqrt(n)
    return cells.withColumns({"mean": mean, "sd": sd}).withColumns({"lo": F.col("mean") - half, "hi": F.col("mean") + half})


def summary(sweep: DataFrame, target: Target) -> DataFrame:
    """One row: n, missing, mean, sd, interval and, for a binary target, hits."""
    cells = moments_of(sweep, target)
    hits = F.col("total").cast("long") if target.binary else F.lit(None).cast("long")
    return mean_interval(cells, target).select("n", "missing", "mean", "sd", "lo", "hi", hits.alias("hits"))


def levels(sweep: DataFrame, target: Target, dims: list[str], cells: DataFrame | None = None) -> DataFrame:
    """Every level of every dimension: n, mean, interval, sd, lift, hits, whether it is withheld or dead."""
    out = mean_interval(cells if cells is not None else level_cells(sweep, target, dims), target)
    dead = (F.col("n") >= I.MIN_N) & (F.col("base_mean") > 0) & (F.col("hi") < F.col("base_mean") / 5) if target.binary else F.lit(False)
    return out.select(
        "dim", "level", "n", "mean", "lo", "hi", "sd", (F.col("mean") - F.col("base_mean")).alias("lift"),
        (F.col("n") < I.MIN_N).alias("withheld"), (F.col("total").cast("long") if target.binary else F.lit(None).cast("long")).alias("hits"),
        F.coalesce(dead, F.lit(False)).alias("dead"),
    )


def effects(cells: DataFrame, target: Target, *by: str) -> DataFrame:
    """The strength of each group of cells, from one aggregation: analysis of variance, p, extremes; G for a binary target.

    Nothing is defined with fewer than two levels or no rows beyond one a level. Without any variation
    p is 1; without variation inside levels F is infinite and p is 0. With all or no hits G is 0. Best and
    worst level and their spread are over levels that aren't withheld.
    """
    n, s, k, mean = F.col("n"), F.col("s"), F.col("total"), F.col("total") / F.col("n")
    shown, order = n >= I.MIN_N, F.struct((mean * (target.better or 1)).alias("v"), F.col("level") if "level" not in by else F.lit(""))
    sums = [F.sum("n").alias("N"), F.count("*").alias("k"), F.sum("s").alias("_s"), F.sum("ss").alias("_ss"), F.sum(s * s / n).alias("_between")]
    if target.binary:
        sums += [F.sum("total").alias("_hits"), F.sum(I.xlogy(k, mean) + I.xlogy(n - k, 1 - mean)).alias("_own")]
    if "level" not in by and "level" in cells.columns:
        sums += [
            F.max_by("level", F.when(shown, order)).alias("best"), F.min_by("level", F.when(shown, order)).alias("worst"),
            F.when(F.sum(shown.cast("int")) >= 2, F.max(F.when(shown, mean)) - F.min(F.when(shown, mean))).alias("spread"),
        ]
    out = cells.where(n > 0).groupBy(*by).agg(*sums)
    ok, centre = (F.col("k") >= 2) & (F.col("N") > F.col("k")), F.col("_s") * F.col("_s") / F.col("N")
    out = out.withColumns({"SST": F.when(ok, F.greatest(F.lit(0.0), F.col("_ss") - centre)), "SSB": F.when(ok, F.greatest(F.lit(0.0), F.col("_between") - centre))})
    out = out.withColumns({"SSW": F.greatest(F.lit(0.0), F.col("SST") - F.col("SSB")), "df1": F.col("k") - 1, "df2": F.col("N") - F.col("k")})
    out = out.withColumn("MSW", F.when(ok, F.try_divide("SSW", "df2")))
    varied, total = F.col("SST") > 0, F.col("SST") + F.col("MSW")
    ratio = F.when(varied & (F.col("MSW") == 0), F.lit(float("inf"))).when(varied, F.try_divide(F.col("SSB") / F.col("df1"), F.col("MSW")))
    out = out.withColumns({"F": F.when(ok, ratio), "omega2": F.when(ok, F.when(varied, (F.col("SSB") - F.col("df1") * F.col("MSW")) / total).otherwise(0.0)), "eta2": F.when(ok, F.when(varied, F.col("SSB") / F.col("SST")).otherwise(0.0))})
    if not target.binary:
        p = kernel.column(kernel.f_survival, F.col("F"), F.col("df1"), F.col("df2"))
        return out.withColumn("p", F.when(F.col("SST") == 0, F.lit(1.0)).when(F.col("MSW") == 0, F.lit(0.0)).otherwise(p)).drop("_s", "_ss", "_between")
    hits, rate = F.col("_hits"), F.col("_hits") / F.col("N")
    g = 2 * (F.col("_own") - I.xlogy(hits, rate) - I.xlogy(F.col("N") - hits, 1 - rate))
    mixed = (hits > 0) & (hits < F.col("N"))
    out = out.withColumns({"G": F.when(F.col("df1") >= 1, F.when(mixed, F.greatest(F.lit(0.0), g)).otherwise(0.0)), "dfG": F.col("df1")})
    p = F.when(F.col("G") == 0, F.lit(1.0)).otherwise(kernel.column(kernel.chi2_survival, F.col("G"), F.col("dfG")))
    return out.withColumn("p", F.when(F.col("G").isNotNull(), p)).drop("_s", "_ss", "_between", "_hits", "_own")


def board(sweep: DataFrame, target: Target, dims: list[str]) -> DataFrame:
    """All dimensions with their strength, p, q and extremes, detectable ones first and then by strength."""
    found = I.with_q(effects(level_cells(sweep, target, dims), target, "dim"))
    # One row a dimension: sorted where it is, as a global sort would compute it twice.
    return found.coalesce(1).sortWithinPartitions(F.desc("detectable"), F.desc(F.coalesce("omega2", F.lit(-1.0))), "dim")


def acts_where(sweep: DataFrame, target: Target, dim: str, parents: list[str]) -> DataFrame:
    """The effect of a dimension inside each level of each parent with at least 60 rows, with q over all."""
    cells = set_cells(sweep, target, [*parents, dim], 2, [(p, dim) for p in parents if p != dim])
    cells = cells.withColumns({"parent": F.element_at("dims", 1), "level": F.element_at("levels", 1)})
    return I.with_q(effects(cells, target, "parent", "level").where(F.col("N") >= 2 * I.MIN_N))


def extremes(sweep: DataFrame, target: Target, dim: str, each: int = 2) -> list[str]:
    """The levels with the highest and the lowest means, so many of each, of those that aren't withheld; runs a job at once."""
    shown = levels(sweep, target, [dim]).where(~F.col("withheld")).orderBy("mean", "level").select("level").collect()
    names = [r.level for r in shown]
    return names if len(names) <= 2 * each else [*names[:each], *names[-each:]]


def settling(sweep: DataFrame, target: Target, dim: str, order: str, points: int = 60) -> DataFrame:
    """Running mean of each level at about 60 checkpoints of the context, once it has 30 rows; see ``extremes`` for a choice of levels.

    ``order`` must be unique. Rows are cut into ranges of it, and what comes before a range is added from
    summaries.
    """
    rows = sweep.select(F.col(order).alias("_i"), F.col(dim).cast("string").alias("level"), value(target).alias("y"))
    rows = running(ranged(rows, "_i"), "_i", {"at": F.lit(1)})
    rows = running(rows, "_i", {"n": F.col("y").isNotNull().cast("long"), "total": F.coalesce("y", F.lit(0.0))}, "level")
    every = sweep.agg(F.greatest(F.lit(1), F.floor(F.count("*") / points)).alias("_every"))
    rows = rows.crossJoin(F.broadcast(every))  # one row
    return rows.where((F.col("at") % F.col("_every") == 0) & (F.col("n") >= I.MIN_N)).select("level", "at", "n", (F.col("total") / F.col("n")).alias("mean"))
