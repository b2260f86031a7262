"""Rows of a sweep beside what their rounds recorded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranges import order_statistics

PARTS = ("whole", "first", "second")


def round_key(index: Column, shard: Column | None = None) -> Column:
    """A round's key in a run: its index, with its directory's label before it where a run has several; null without index."""
    text = index.cast("long").cast("string")
    return text if shard is None else F.when(shard.isNull(), text).otherwise(F.concat(shard.cast("string"), F.lit("#"), text))


def with_executions(sweep: DataFrame, executions: DataFrame, key: str, measures: list[str], order: str | None = None) -> DataFrame:
    """The rows with each measure of their round, ``<part>_<measure>`` for the whole window and its halves; null where not recorded.

    ``executions`` has a row for a key and a ``part`` (whole, first, second); of several the one of the greatest ``order``
    holds, which a table that is appended to needs.
    """
    last = [(F.first(m) if order is None else F.max_by(m, order)).alias(m) for m in measures]
    wide = executions.groupBy(key).pivot("part", list(PARTS)).agg(*last)
    named = wide.select(key, *[F.col(f"{p}_{m}" if len(measures) > 1 else p).alias(f"{p}_{m}") for p in PARTS for m in measures])
    return sweep.join(named, key, "left")


def recorded(rows: DataFrame, rounds: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with the round recorded under its keys, as ``round``, and ``problem`` where there is none or more than one."""
    rest = [c for c in rounds.columns if c not in keys]
    found = rounds.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("round"))
    out = rows.join(found, keys, "left")
    problem = F.when(F.col("_n").isNull(), "no round of this id").when(F.col("_n") > 1, "several rounds of this id")
    return out.withColumns({"round": F.when(F.col("_n") == 1, F.col("round")), "problem": problem}).drop("_n")


def row_of(sweep: DataFrame, round_id: str, order: str, shard: str | None = None) -> DataFrame:
    """The first row of a round id, of one directory if its label is given."""
    rows = sweep.where(F.col("id") == round_id)
    return (rows if shard is None else rows.where(F.col("shard") == shard)).orderBy(order).limit(1)


def market_halves(executions: DataFrame, column: str = "market") -> DataFrame:
    """(part, n, median): the middle of the market's returns on each half, as a value that a round has; runs small jobs at once."""
    v = F.col(column)
    found = order_statistics(executions, {p: F.when(F.col("part") == p, v) for p in PARTS[1:]}, (0.5,))
    rows = [(p, n, at[0][0]) for p, (n, at) in found.items() if n]
    return executions.sparkSession.createDataFrame(rows, "part string, n long, median double")


def mean_of_members(parts: DataFrame, by: str, measures: list[str]) -> DataFrame:
    """Members' figures averaged by part; a member that lacks a figure is left out of that figure's mean."""
    return parts.groupBy(by).agg(F.count("*").alias("members"), *[F.avg(F.when(~F.isnan(m), F.col(m))).alias(m) for m in measures])
