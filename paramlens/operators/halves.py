"""What the second half keeps of the first, and rank statistics.

Ranks are running counts over distinct values, range by range, which gives ties their middle rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernel
from ..plans.ranges import ranged, running


def steady_mean(value: Column) -> Column:
    """The mean of doubles, in every bit the same in whatever order rows come, so groups of equal values have equal means.

    Values that 8 decimals and 22 digits before them hold exactly are summed as decimals; where a group has others, as doubles.
    """
    exact = value.try_cast("decimal(30,8)")
    held = F.when(exact.cast("double") == value, exact)
    return F.when(F.count(held) == F.count(value), F.try_divide(F.sum(held).cast("double"), F.count(value).cast("double"))).otherwise(F.avg(value))


def _ranks(rows: DataFrame, column: str) -> DataFrame:
    """(_v, _rank): each value and its middle rank, from 1; null has none."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    return running(counts, "_v", {"_u": F.col("_c")}).select("_v", (F.col("_u") - (F.col("_c") - 1) / 2).alias("_rank"))


def mid_ranks(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the middle rank, from 1, of each value; null has none."""
    ranks = _ranks(rows, column).select("_v", F.col("_rank").alias(name))
    return rows.join(ranks, F.col(column) == F.col("_v"), "left").drop("_v")


def shares(rows: DataFrame, column: str) -> DataFrame:
    """(_v, share): of each value the middle rank less a half over the number of values; null below two distinct values."""
    info = rows.agg(F.count(column).alias("_m"), F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    share = F.when(F.col("_lo") < F.col("_hi"), (F.col("_rank") - 0.5) / F.col("_m"))
    return _ranks(rows, column).crossJoin(F.broadcast(info)).select("_v", share.alias("share"))  # one row


def rank_scale(rows: DataFrame, column: str) -> DataFrame:
    """Adds ``share``: the middle rank less a half over the number of values; null below two distinct values."""
    return rows.join(shares(rows, column), F.col(column) == F.col("_v"), "left").drop("_v")


def rank_agreement(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Spearman's rho of two halves with its interval; at least four rows."""
    both = rows.select(F.col(first).cast("double").alias("a"), F.col(second).cast("double").alias("b")).where("a is not null and b is not null")
    ranked = mid_ranks(mid_ranks(both, "a", "ra"), "b", "rb")
    one = ranked.agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("rho"))
    z = F.atanh(F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), F.col("rho"))))
    half = kernel.Z95 * F.sqrt(F.try_divide(F.lit(1.06), F.when(F.col("n") >= 4, F.col("n") - 3)))
    return one.select("n", F.when(F.col("n") >= 4, F.col("rho")).alias("rho"), F.tanh(z - half).alias("lo"), F.tanh(z + half).alias("hi"))


def first_half_ranks(rows: DataFrame, first: str, better: int = 1) -> DataFrame:
    """Adds the competition rank by the first half."""
    sign = 1 if better < 0 else -1  # the best come first
    counts = rows.where(F.col(first).isNotNull()).groupBy((F.col(first) * sign).alias("_v")).agg(F.count("*").alias("_c"))
    ranks = running(counts, "_v", {"_u": F.col("_c")}).select("_v", (F.col("_u") - F.col("_c") + 1).alias("rank_first"))
    return rows.join(ranks, F.col(first) * sign == F.col("_v"), "left").drop("_v")


def _placed(rows: DataFrame, first: str, second: str, order: str, better: int) -> DataFrame:
    """Rows with both halves and their place, from 1, by the first; by ranges of it, none of which is all rows."""
    sign = -1.0 if better < 0 else 1.0
    both = rows.select(F.col(order).alias("_i"), (F.col(first) * sign).alias("a"), (F.col(second) * sign).alias("b")).where("a is not null and b is not null")
    part = ranged(both.withColumn("_down", -F.col("a")), "_down", "_i")
    counts = part.groupBy("_part").agg(F.count("*").alias("c"))
    ahead = counts.withColumns({"ahead": F.coalesce(F.sum("c").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("c").over(W.partitionBy(F.lit(1)))})
    place = F.row_number().over(W.partitionBy("_part").orderBy("_down", "_i"))
    return part.withColumn("_at", place).join(F.broadcast(ahead.drop("c")), "_part").withColumn("place", F.col("_at") + F.col("ahead"))  # one row a range


def kept_lead(rows: DataFrame, first: str, second: str, order: str, better: int = 1) -> DataFrame:
    """How much of the lead of the first half's best rows the second keeps.

    The best are a tenth of the rows, at least 30; nothing below 60 rows.
    """
    placed = _placed(rows, first, second, order, better)
    head = F.col("place") <= F.greatest(F.lit(30), F.ceil(F.col("n") / 10))
    one = placed.agg(F.max("n").alias("n"), F.sum(head.cast("long")).alias("top"), F.avg("a").alias("all_a"), F.avg("b").alias("all_b"), F.avg(F.when(head, F.col("a"))).alias("top_a"), F.avg(F.when(head, F.col("b"))).alias("top_b"))
    one = one.withColumns({"lead_first": F.col("top_a") - F.col("all_a"), "lead_second": F.col("top_b") - F.col("all_b")})
    return one.where(F.col("n") >= 60).select("n", "top", "lead_first", "lead_second", F.try_divide("lead_second", F.nullif("lead_first", F.lit(0.0))).alias("kept"))


def persistence(rows: DataFrame, first: str, second: str, order: str, better: int = 1, bins: int = 10) -> DataFrame:
    """Mean of both halves by tenths of the first; a tenth b starts at floor(b n / 10). Nothing below 300 rows."""
    placed = _placed(rows, first, second, order, better).where(F.col("n") >= 300)
    zero = F.col("place") - 1
    guess = F.floor(zero * bins / F.col("n"))
    bin_ = guess + (F.floor((guess + 1) * F.col("n") / bins) <= zero).cast("int")
    sign = -1.0 if better < 0 else 1.0
    return placed.groupBy(bin_.cast("int").alias("tenth")).agg(F.count("*").alias("n"), (F.avg("a") * sign).alias("first"), (F.avg("b") * sign).alias("second"))


def mann_whitney(rows: DataFrame, column: str, group: str) -> DataFrame:
    """Whether a flagged group's values tend to be larger: U, the share of pairs it wins, z with ties and continuity, p."""
    own = rows.select(F.col(column).cast("double").alias("v"), F.col(group).alias("g")).where("v is not null and g is not null")
    ranked = mid_ranks(own, "v", "r")
    c = F.col("c").cast("double")  # the cube of a count passes a long's range from 2,097,152 equal values on
    ties = own.groupBy("v").agg(F.count("*").alias("c")).agg(F.sum(c * c * c - c).alias("ties"))
    one = ranked.agg(F.sum(F.col("g").cast("long")).alias("na"), F.sum((~F.col("g")).cast("long")).alias("nb"), F.sum(F.when(F.col("g"), F.col("r"))).alias("ra"))
    one = one.crossJoin(F.broadcast(ties)).where("na > 0 and nb > 0")  # one row
    na, nb, n = F.col("na").cast("double"), F.col("nb").cast("double"), F.col("na") + F.col("nb")
    one = one.withColumn("U", F.col("ra") - na * (na + 1) / 2)
    off = F.col("U") - na * nb / 2
    spread = F.sqrt(na * nb / 12 * ((n + 1) - F.col("ties") / (n * (n - 1.0))))
    z = F.try_divide(F.signum(off) * F.greatest(F.lit(0.0), F.abs(off) - 0.5), F.nullif(spread, F.lit(0.0)))
    one = one.withColumns({"shift": F.col("U") / (na * nb), "z": z})
    return one.withColumn("p", F.when(spread == 0, F.lit(1.0)).otherwise(kernel.column(kernel.z_p, F.col("z")))).select("na", "nb", "U", "shift", "z", "p")
