"""Trials: ranking, rows like a row, records so far, luck."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import intervals as I
from ..functions import kernel
from ..plans.cells import Target, keyed, value
from ..plans.ranges import order_statistics, ranged, running

Keys = list[tuple[str, int]]


def natural(column: str) -> Column:
    """A text so that sorting it puts a2 before a10: every run of digits has 20."""
    pieces = F.regexp_extract_all(F.col(column).cast("string"), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda x: F.when(F.rlike(x, F.lit("^[0-9]")), F.lpad(x, 20, "0")).otherwise(x)), "")


def _ordered(keys: Keys) -> list[Column]:
    return [F.desc_nulls_last(c) if better >= 0 else F.asc_nulls_last(c) for c, better in keys]


def top(sweep: DataFrame, keys: Keys, order: str, k: int) -> DataFrame:
    """The first k rows by the keys, missing values last, ties by arrival."""
    return sweep.orderBy(*_ordered(keys), order).limit(k)


def ranked(sweep: DataFrame, keys: Keys, limit: int) -> DataFrame:
    """Rows with all keys, by competition rank; a tie that crosses the limit is cut as a whole.

    Ranks are counted over distinct key values, so facts are never sorted together: only those
    rows are read that the limit lets through.
    """
    names = [c for c, _ in keys]
    full = sweep.dropna(subset=names)
    counts = full.groupBy(*names).agg(F.count("*").alias("_ties")).orderBy(*_ordered(keys)).limit(limit)
    upto = W.orderBy(*_ordered(keys)).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranks = counts.withColumn("_upto", F.sum("_ties").over(upto)).where(F.col("_upto") <= limit)
    ranks = ranks.withColumn("rank", F.col("_upto") - F.col("_ties") + 1).drop("_upto")
    return full.join(F.broadcast(ranks), names).withColumnRenamed("_ties", "ties")  # at most limit rows


def like(sweep: DataFrame, target: Target, dims: list[str], listed: DataFrame, order: str, least: int = I.MIN_N) -> DataFrame:
    """For each listed row, the rows that share the longest prefix of dimensions with at least so many others.

    Depths are counted at once by rolling up; absence counts as a level here. A row is left out of its own mean.
    """
    keys = keyed(sweep, dims)
    rows = sweep.select(*[F.coalesce(keys[d], F.lit("\x00")).alias(d) for d in dims], value(target).alias("y"))
    own = listed.select(F.col(order).alias("_i"), *[F.coalesce(keyed(listed, dims)[d], F.lit("\x00")).alias(d) for d in dims], value(target).alias("own"))
    sums = rows.join(own.select(dims[0]).distinct(), dims[0], "left_semi").where(F.col("y").isNotNull())
    n = F.count("*")
    cells = sums.groupingSets([[F.col(d) for d in dims[:j]] for j in range(1, len(dims) + 1)], *dims).agg(
        n.alias("n"), F.avg("y").alias("mean"), (F.var_pop("y") * n).alias("m2"), F.grouping_id(*dims).alias("_id")
    )
    cells = cells.withColumn("depth", F.lit(len(dims)) - F.bit_count("_id").cast("int")).drop("_id")
    found = None
    for j in range(1, len(dims) + 1):
        part = own.join(cells.where(F.col("depth") == j).drop(*dims[j:]), dims[:j]).select("_i", "own", "depth", "n", "mean", "m2")
        found = part if found is None else found.unionByName(part)
    # Mean and squared distances without the row itself.
    mine, off = F.col("own").isNotNull(), F.col("own") - F.col("mean")
    left = F.col("n") - mine.cast("long")
    mean = F.col("mean") - F.when(mine, F.try_divide(off, left)).otherwise(0.0)
    m2 = F.greatest(F.lit(0.0), F.col("m2") - F.when(mine, off * (F.col("own") - mean)).otherwise(0.0))
    less = found.select("_i", "depth", left.alias("n"), mean.alias("mean"), m2.alias("m2"))
    best = less.where(F.col("n") >= least).groupBy("_i").agg(F.max_by(F.struct("depth", "n", "mean", "m2"), "depth").alias("b"))
    sd = F.when(F.col("b.n") >= 2, F.sqrt(F.col("b.m2") / (F.col("b.n") - 1)))
    return best.select(F.col("_i").alias(order), F.col("b.depth").alias("depth"), F.col("b.n").alias("n"), F.col("b.mean").alias("mean"), sd.alias("sd"))


def record_curve(sweep: DataFrame, target: Target, order: str, points: int = 400) -> DataFrame:
    """Running best, mean and sd by arrival, and the line that luck alone would reach: every step-th row and every record.

    ``order`` is a unique number, date or timestamp. Rows are cut into ranges of it; what comes before each
    range is added from its summary, so that no task holds more than a range. Sums are about the mean of all rows.
    """
    sign = -1.0 if target.better < 0 else 1.0
    rows = sweep.select(F.col(order).alias("_i"), (value(target) * sign).alias("y")).where(F.col("y").isNotNull())
    base = rows.agg(F.avg("y").alias("_base"), F.count("*").alias("_count"))
    rows = ranged(rows, "_i").crossJoin(F.broadcast(base)).withColumn("d", F.col("y") - F.col("_base"))  # one row
    prior = rows.groupBy("_part").agg(F.max("y").alias("m"))
    prior = prior.select("_part", F.max("m").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)).alias("pm"))  # one row a range
    own = W.partitionBy("_part").orderBy("_i")
    rows = running(rows, "_i", {"at": F.lit(1), "s": F.col("d"), "ss": F.col("d") * F.col("d")})
    rows = rows.withColumns({"m": F.max("y").over(own.rowsBetween(W.unboundedPreceding, W.currentRow)), "_last": F.max("y").over(own.rowsBetween(W.unboundedPreceding, -1))})
    out = rows.join(F.broadcast(prior), "_part")
    out = out.withColumns({"best": F.greatest("m", "pm"), "_last": F.greatest("_last", "pm")})
    out = out.withColumn("record", F.col("_last").isNull() | (F.col("y") > F.col("_last")))
    step = F.greatest(F.lit(1), F.floor(F.col("_count") / points))
    out = out.where((F.col("at") % step == 0) | F.col("record") | (F.col("at") == F.col("_count")))
    out = out.withColumns({"mean": F.col("_base") + F.col("s") / F.col("at"), "sd": F.sqrt(I.variance(F.col("at"), F.col("s"), F.col("ss")))})
    luck = F.col("mean") + F.col("sd") * kernel.column(kernel.expected_max_z, F.col("at"))
    return out.select("at", F.col("_i").alias(order), (F.col("best") * sign).alias("best"), (F.col("mean") * sign).alias("mean"), "sd", (luck * sign).alias("luck"), "record")


def luck(sweep: DataFrame, target: Target) -> DataFrame:
    """The value that the best of as many rows would reach by chance, and how many rows are beyond it."""
    y, sign = value(target), -1.0 if target.better < 0 else 1.0
    base = sweep.agg(F.count(y).alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("sd"))
    line = base.withColumn("line", F.col("mean") + sign * F.col("sd") * kernel.column(kernel.expected_max_z, F.col("n")))
    beyond = sweep.crossJoin(F.broadcast(line)).agg(F.sum(((y - F.col("line")) * sign > 0).cast("long")).alias("beyond"))  # one row each
    return line.crossJoin(beyond).select("n", "mean", "sd", "line", F.coalesce("beyond", F.lit(0)).alias("beyond"))


def distribution(sweep: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Histogram of a target: its own values if 12 integers or fewer, else equal bins from the 1st to the 99th percentile.

    With fewer than 200 rows the bins span all values. Rows outside are counted with a null bin.
    """
    v = F.col(column).cast("double")
    rows = sweep.select(v.alias("v")).where(v.isNotNull() & ~F.isnan(v))
    n, (low, high) = order_statistics(rows, {"v": F.col("v")}, (0.01, 0.99), lambda f, n: sorted({int(f * (n - 1)), min(n - 1, int(f * (n - 1)) + 1)}))["v"]
    ends = [x[0] + (f * (n - 1) - int(f * (n - 1))) * (x[-1] - x[0]) if x else None for f, x in ((0.01, low), (0.99, high))]
    one = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.bool_and(F.col("v") == F.floor("v")).alias("whole"))
    one = one.withColumn("discrete", F.col("whole") & (F.col("hi") - F.col("lo") < 12))
    if n >= 200:
        one = one.withColumns({c: F.when(F.col("discrete"), F.col(c)).otherwise(F.lit(e)) for c, e in zip(("lo", "hi"), ends)})
    placed = rows.crossJoin(F.broadcast(one))  # one row
    at = F.floor(F.try_divide((F.col("v") - F.col("lo")) * bins, F.col("hi") - F.col("lo")))
    inside = F.when(F.col("v").between(F.col("lo"), F.col("hi")), F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)))
    label = F.when(F.col("discrete"), F.col("v")).otherwise(inside.cast("double"))
    return placed.groupBy(label.alias("bin")).agg(F.count("*").alias("n"))


def compared(sweep: DataFrame, column: str, inside: Column, bins: int = 24) -> DataFrame:
    """(bin, n_in, n_out): a histogram of a group against the rest, in bins over both, from the 1st to the 99th percentile."""
    flagged = sweep.select(F.col(column).cast("double").alias("v"), F.coalesce(inside, F.lit(False)).alias("g")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    n, (low, high) = order_statistics(flagged, {"v": F.col("v")}, (0.01, 0.99))["v"]
    lo, hi = (low[0], high[0]) if n else (0.0, 0.0)
    at = F.when(F.col("v").between(lo, hi), F.least(F.coalesce(F.floor(F.try_divide((F.col("v") - lo) * bins, F.nullif(F.lit(hi - lo), F.lit(0.0)))), F.lit(0)), F.lit(bins - 1)))
    return flagged.groupBy(at.alias("bin")).agg(F.sum(F.col("g").cast("long")).alias("n_in"), F.sum((~F.col("g")).cast("long")).alias("n_out"))


def heap(sweep: DataFrame, column: str, share: float = 0.1) -> DataFrame:
    """The value that at least a tenth of the rows share, the commonest of these."""
    counts = sweep.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    every = counts.withColumn("all", F.sum("n").over(W.partitionBy(F.lit(1))))
    return every.where(F.col("n") >= F.col("all") * share).orderBy(F.desc("n"), "value").limit(1).select("value", "n")


def invariant_breaks(sweep: DataFrame, broken: Column, order: str, keep: int = 20) -> DataFrame:
    """Rows that break an invariant: the first few, each with the number of all."""
    bad = sweep.where(F.coalesce(broken, F.lit(False)))
    return bad.orderBy(order).limit(keep).crossJoin(F.broadcast(bad.agg(F.count("*").alias("breaks"))))  # one row
