"""Pockets: conjunctions of level conditions, what they gain, and which condition earns its place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import intervals as I
from ..functions import kernel
from ..plans.cells import Target, key_of, level_cells, value
from .effects import mean_interval

Conditions = list[tuple[str, list[str]]]


def check(sweep: DataFrame, conditions: Conditions) -> None:
    """Raises on unknown or repeated dimensions and empty lists of levels."""
    names = [d for d, _ in conditions]
    unknown = [d for d in names if d not in sweep.columns]
    if unknown:
        raise ValueError(f"the context names {', '.join(unknown)}, which this sweep does not have")
    if len(set(names)) < len(names):
        raise ValueError("a dimension is in two conditions")
    if any(not keys for _, keys in conditions):
        raise ValueError("a condition has no levels")


def merge(*lists: Conditions) -> Conditions:
    """One condition a dimension, with the levels that all its conditions allow."""
    out: dict[str, list[str]] = {}
    for dim, keys in (c for conditions in lists for c in conditions):
        out[dim] = [k for k in out[dim] if k in keys] if dim in out else list(keys)
    return list(out.items())


def holds(sweep: DataFrame, conditions: Conditions) -> Column:
    """Whether a row meets all conditions; a dimension that doesn't apply meets none."""
    kinds = dict(sweep.dtypes)
    tests = [F.coalesce(key_of(d, kinds[d]).isin(keys), F.lit(False)) for d, keys in conditions]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def rows_in(sweep: DataFrame, conditions: Conditions, order: str | None = None, edge: int | None = None) -> DataFrame:
    """The rows that meet all conditions, before the replay edge."""
    check(sweep, conditions)
    rows = sweep.where(holds(sweep, conditions))
    return rows if edge is None or order is None else rows.where(F.col(order) < edge)


def without(rows: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that a removed block doesn't hold."""
    return rows.join(removed.select(*keys).distinct(), keys, "left_anti")


def _moments(y: Column, within: Column, name: str) -> list[Column]:
    own = F.when(within, y)
    return [F.count(own).alias(f"n_{name}"), F.avg(own).alias(f"mean_{name}"), F.var_samp(own).alias(f"var_{name}")]


def _z(a: str, b: str, binary: bool) -> Column:
    if binary:
        na, nb = F.col(f"n_{a}"), F.col(f"n_{b}")
        pool = F.try_divide(F.col(f"mean_{a}") * na + F.col(f"mean_{b}") * nb, na + nb)
        spread = pool * (1 - pool) * (F.try_divide(F.lit(1.0), na) + F.try_divide(F.lit(1.0), nb))
    else:
        spread = F.try_divide(f"var_{a}", f"n_{a}") + F.try_divide(f"var_{b}", f"n_{b}")
    return F.try_divide(F.col(f"mean_{a}") - F.col(f"mean_{b}"), F.nullif(F.sqrt(spread), F.lit(0.0)))


def stats(sweep: DataFrame, conditions: Conditions, target: Target, order: str) -> DataFrame:
    """One row: rows in the pocket and its share, mean, lift, recall of hits, and both arrival halves with z.

    The halves part the context at its middle row in order of arrival.
    """
    check(sweep, conditions)
    y, inside = value(target), holds(sweep, conditions)
    count = sweep.count()
    cut = F.col(order) >= F.lit(None) if not count else None
    middle = _middle(sweep, order, count) if count else None
    late = cut if middle is None else F.col(order) >= F.lit(middle)
    rows = sweep.select(y.alias("y"), inside.alias("inside"), late.alias("late"))
    out = rows.agg(
        F.count("*").alias("rows"), F.count("y").alias("base_n"), F.avg("y").alias("base_mean"), F.sum("y").alias("base_total"),
        F.sum(F.col("inside").cast("long")).alias("pocket_rows"), F.sum(F.when(F.col("inside"), F.col("y"))).alias("total"),
        *_moments(F.col("y"), F.col("inside"), "pocket"),
        *_moments(F.col("y"), F.col("inside") & ~F.col("late"), "first"), *_moments(F.col("y"), F.col("inside") & F.col("late"), "second"),
    )
    out = out.withColumns({"share": F.try_divide("pocket_rows", "rows"), "lift": F.col("mean_pocket") - F.col("base_mean"), "z": _z("second", "first", target.binary)})
    recall = F.try_divide("total", "base_total") if target.binary else F.lit(None).cast("double")
    return out.select("rows", "pocket_rows", "share", F.col("n_pocket").alias("n"), F.col("mean_pocket").alias("mean"), "base_mean", "lift", recall.alias("recall"), "n_first", "mean_first", "n_second", "mean_second", "z")


def _middle(sweep: DataFrame, order: str, count: int, bins: int = 4096):
    """The order value, a whole number, of the row at half: by counts of bins, ever narrower, some three scans."""
    target, lo, hi = count // 2, *sweep.agg(F.min(order), F.max(order)).first()
    while lo < hi:
        width = (hi - lo) // bins + 1
        inside = sweep.where(F.col(order).between(lo, hi)).groupBy(F.floor((F.col(order) - lo) / width).cast("long").alias("b")).agg(F.count("*").alias("n"))
        for row in inside.orderBy("b").collect():  # one row a bin
            if target < row["n"]:
                lo, hi = lo + row["b"] * width, min(hi, lo + (row["b"] + 1) * width - 1)
                break
            target -= row["n"]
    return lo


def block_tests(sweep: DataFrame, conditions: Conditions, target: Target) -> DataFrame:
    """For every condition: the pocket without it, the rows it removes, and z between them and the pocket.

    All are counted in one pass. A condition that removes nothing has no test.
    """
    check(sweep, conditions)
    y, parts = value(target), [holds(sweep, [c]) for c in conditions]
    inside = reduce(lambda a, b: a & b, parts)
    sums = [*_moments(y, inside, "pocket")]
    for i, _ in enumerate(conditions):
        rest = reduce(lambda a, b: a & b, [p for j, p in enumerate(parts) if j != i], F.lit(True))
        sums += [*_moments(y, rest, f"without{i}"), *_moments(y, rest & ~parts[i], f"removed{i}")]
    one = sweep.agg(*sums)
    rows = [
        F.struct(
            F.lit(d).alias("dim"), F.col(f"n_without{i}").alias("n_without"), F.col(f"mean_without{i}").alias("mean_without"),
            F.col(f"n_removed{i}").alias("n_removed"), F.col(f"mean_removed{i}").alias("mean_removed"), F.col("n_pocket").alias("n"),
            F.col("mean_pocket").alias("mean"), _z("pocket", f"removed{i}", target.binary).alias("z"),
        )
        for i, (d, _) in enumerate(conditions)
    ]
    out = one.select(F.inline(F.array(*rows)))
    few = (F.col("n") < I.MIN_N) | (F.col("n_removed") < I.MIN_N)
    out = I.with_q(out.withColumn("p", kernel.column(kernel.z_p, F.col("z"))))
    gain = (F.col("mean") - F.col("mean_removed")) * (target.better or 1)
    verdict = F.when(few, "few").when(~F.col("detectable"), "narrows").when(F.lit(target.better == 0), "changes").when(gain > 0, "earns")
    return out.withColumn("verdict", verdict.otherwise("hurts"))


def steps(sweep: DataFrame, conditions: Conditions, target: Target) -> DataFrame:
    """The pocket as its conditions are added one by one: step, n, mean; step 0 is the context."""
    check(sweep, conditions)
    y, parts = value(target), [holds(sweep, [c]) for c in conditions]
    sums = []
    for i in range(len(parts) + 1):
        sums += _moments(y, reduce(lambda a, b: a & b, parts[:i], F.lit(True)), str(i))
    one = sweep.agg(*sums)
    rows = [F.struct(F.lit(i).alias("step"), F.lit(conditions[i - 1][0] if i else None).cast("string").alias("dim"), F.col(f"n_{i}").alias("n"), F.col(f"mean_{i}").alias("mean")) for i in range(len(parts) + 1)]
    return one.select(F.inline(F.array(*rows)))


def suggest(sweep: DataFrame, conditions: Conditions, target: Target, dims: list[str], limit: int = 10) -> DataFrame:
    """Levels to add next, by the bound of their interval on the worse side; at least 30 rows and not all."""
    rows = rows_in(sweep, conditions)
    free = [d for d in dims if d not in {c for c, _ in conditions}]
    cells = mean_interval(level_cells(rows, target, free), target)
    bound = F.col("lo") if target.better >= 0 else -F.col("hi")
    good = cells.where((F.col("n") >= I.MIN_N) & (F.col("n") < F.col("base_n"))).withColumn("bound", bound)
    return good.orderBy(F.desc("bound"), "dim", "level").limit(limit).select("dim", "level", "n", "mean", "bound")
