"""Sufficient statistics: everything that tests need of the facts, in one aggregation.

A *sweep* is a DataFrame with one row a trial. A dimension is a column of levels; its null means
"doesn't apply" unless the column was made with ``levels`` from ``paramlens.plans.dims``, where a
null value has a level of its own. A target is a double column; null is missing.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Facts are aggregated to joint cells first where there are at most a tenth as many.
FEWER = 10


@dataclass(frozen=True)
class Target:
    """``better``: 1 if more is better, -1 if less, 0 if neither."""

    column: str
    binary: bool = False
    better: int = 1


def key_of(column: str, kind: str) -> Column:
    """The text of a level, as JavaScript prints values: 3600, 0.1, 1e-7, true."""
    c = F.col(column)
    if kind not in ("double", "float"):
        return c.cast("string")
    text = c.cast("string")
    # Spark writes numbers below a thousandth, and from ten million on, as 1.5E-4.
    sign, whole, rest, power = (F.regexp_extract(text, r"^(-?)([0-9])\.([0-9]+)E(-?[0-9]+)$", i) for i in (1, 2, 3, 4))
    digits = F.concat(whole, F.when(rest == "0", F.lit("")).otherwise(rest))
    mantissa = F.concat(sign, whole, F.when(rest == "0", F.lit("")).otherwise(F.concat(F.lit("."), rest)))
    size = F.abs(c)
    return (
        F.when(c.isNull(), F.lit(None)).when((c == F.floor(c)) & (size < 1e15), F.floor(c).cast("string"))
        .when((c % 1 == 0) & (size < 1e21), c.cast("decimal(38,0)").cast("string"))
        .when(power == "", text)
        .when((size < 1e-3) & (size >= 1e-6), F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power.try_cast("int") - 1), digits))
        .when((size < 1e21) & (size >= 1), F.concat(sign, F.substring(digits, F.lit(1), power.try_cast("int") + 1), F.lit("."), F.substring(digits, power.try_cast("int") + 2, F.length(digits))))
        .otherwise(F.concat(mantissa, F.when(power.startswith("-"), F.lit("e")).otherwise(F.lit("e+")), power))
    )


def keyed(sweep: DataFrame, dims: list[str]) -> dict[str, Column]:
    kinds = dict(sweep.dtypes)
    return {d: key_of(d, kinds[d]) for d in dims}


def value(target: Target) -> Column:
    """The target as a double; NaN is missing."""
    c = F.col(target.column).cast("double")
    return F.when(~F.isnan(c), c)


def moments_of(sweep: DataFrame, target: Target) -> DataFrame:
    """One row: n, missing, total, base_mean, and s and ss about that mean."""
    y = value(target)
    one = sweep.agg(F.count(y).alias("n"), (F.count("*") - F.count(y)).alias("missing"), F.sum(y).alias("total"), F.avg(y).alias("base_mean"), (F.var_pop(y) * F.count(y)).alias("ss"))
    return one.withColumn("s", F.lit(0.0))


@dataclass(frozen=True)
class _Shifted:
    """Rows, or joint cells where these are far fewer, by columns ``_0``... of the dimensions as they are, with sums about a mean."""

    rows: DataFrame
    sums: list[Column]
    n: int
    mean: float | None


def _shifted(sweep: DataFrame, target: Target, dims: list[str]) -> _Shifted:
    """One small job at once finds the mean that sums are about, and about how many joint cells there are.

    Where rows share cells, one aggregation of the facts gives these, and whatever sets of dimensions are
    asked for are aggregated from them.
    """
    y = value(target)
    base = sweep.agg(F.count("*").alias("rows"), F.count(y).alias("n"), F.avg(y).alias("mean"), F.approx_count_distinct(F.xxhash64(*dims)).alias("cells")).first()
    d = F.col("_y") - F.lit(base.mean if base.mean is not None else 0.0)
    rows = sweep.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(dims)], y.alias("_y"))
    sums = [F.count("_y").alias("n"), F.sum(d).alias("s"), F.sum(d * d).alias("ss"), F.sum("_y").alias("total"), F.count("*").alias("rows")]
    if base.cells * FEWER <= base.rows:
        rows = rows.groupBy(*[f"_{i}" for i in range(len(dims))]).agg(*sums)
        sums = [F.sum(c).alias(c) for c in ("n", "s", "ss", "total", "rows")]
    return _Shifted(rows, sums, base.n, base.mean)


def level_cells(sweep: DataFrame, target: Target, dims: list[str]) -> DataFrame:
    """(dim, level, n, s, ss, total, rows, base_n, base_mean): one scan for all dimensions.

    Only cells are shuffled, and texts are made of levels, not of rows.
    """
    kinds, made = dict(sweep.dtypes), _shifted(sweep, target, dims)
    own = [F.col(f"_{i}") for i in range(len(dims))]
    cells = made.rows.groupingSets([[c] for c in own], *own).agg(*made.sums, F.grouping_id(*own).alias("_id"))
    every = (1 << len(dims)) - 1
    at = {every ^ (1 << (len(dims) - 1 - i)): i for i in range(len(dims))}
    dim = F.create_map(*[x for k, i in at.items() for x in (F.lit(k), F.lit(dims[i]))])[F.col("_id").cast("int")]
    level = F.coalesce(*[F.when(F.col("_id") == k, key_of(f"_{i}", kinds[dims[i]])) for k, i in at.items()])
    base = {"base_n": F.lit(made.n), "base_mean": F.lit(made.mean).cast("double")}
    found = cells.withColumns({"dim": dim, "level": level} | base).where(F.col("level").isNotNull())
    return found.select("dim", "level", "n", "s", "ss", "total", "rows", "base_n", "base_mean")


def set_cells(sweep: DataFrame, target: Target, dims: list[str], size: int, sets: list[tuple[str, ...]] | None = None) -> DataFrame:
    """Cells of all sets of ``size`` dimensions, by grouping sets over one scan: (dims, levels, n, s, ss, total, base_mean).

    Rows in which a dimension of the set doesn't apply, or the target is missing, are in no cell.
    """
    sets = sets or list(combinations(dims, size))
    used = sorted({d for s in sets for d in s}, key=dims.index)
    place, kinds = {d: i for i, d in enumerate(used)}, dict(sweep.dtypes)
    made = _shifted(sweep.where(value(target).isNotNull()), target, used)
    own = [F.col(f"_{i}") for i in range(len(used))]
    cells = made.rows.groupingSets([[own[place[d]] for d in s] for s in sets], *own).agg(*made.sums, F.grouping_id(*own).alias("_id"))
    ids = {sum(1 << (len(used) - 1 - i) for i, d in enumerate(used) if d not in s): s for s in sets}
    names = F.create_map(*[x for k, s in ids.items() for x in (F.lit(k), F.array(*map(F.lit, s)))])
    levels = F.array_compact(F.array(*[key_of(f"_{i}", kinds[d]) for d, i in place.items()]))
    cells = cells.withColumns({"dims": names[F.col("_id").cast("int")], "levels": levels}).where(F.size("levels") == F.size("dims"))
    return cells.select("dims", "levels", "n", "s", "ss", "total", F.lit(made.mean).cast("double").alias("base_mean"))
