"""Reading the first half of a test window only, and what shows in both halves.

``Halves`` maps a target's column to the columns that hold it on the first and the second half. Rows
that lack a half are missing there; values of the whole window never stand in for them.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import intervals as I
from ..plans.cells import Target, level_cells
from .effects import effects, levels
from .gates import Gate

Halves = dict[str, tuple[str, str]]


def first_half(sweep: DataFrame, targets: list[str], halves: Halves) -> DataFrame:
    """The targets as the first half has them; one that isn't measured on halves is missing in every row."""
    return sweep.withColumns({t: F.col(halves[t][0]).cast("double") if t in halves else F.lit(None).cast("double") for t in targets})


def gate_reads(gates: list[Gate], halves: Halves) -> list[tuple[Gate, bool]]:
    """Each gate as a pool reads it: on the first half where its target has one, else over the whole window, with which it is."""
    return [(replace(g, column=halves[g.column][0]), True) if g.column in halves else (g, False) for g in gates]


def touched_by_second(target: str, reads: list[tuple[Gate, bool]], halves: Halves) -> list[str]:
    """What lets the second half choose members: the target or gates that are read over the whole window."""
    own = [] if target in halves else [target]
    return own + [g.name for g, halved in reads if not halved]


def lift_agreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """(dim, agree): the cosine of the lifts of both halves over levels withheld in neither, weighted by the rows of the fewer.

    Near 1 the same levels lead, below 0 the order turns over; null with fewer than two levels or without lifts.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.where(~F.col("withheld") & F.col("lift").isNotNull()).select("dim", "level", F.col("n").alias(f"n_{name}"), F.col("lift").alias(name))

    both = side(first, "a").join(side(second, "b"), ["dim", "level"]).withColumn("w", F.least("n_a", "n_b"))
    a, b, w = F.col("a"), F.col("b"), F.col("w")
    sums = both.groupBy("dim").agg(F.count("*").alias("k"), F.sum(w * a * b).alias("ab"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"))
    known = (F.col("k") >= 2) & (F.col("aa") > 0) & (F.col("bb") > 0)
    return sums.select("dim", F.when(known, F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("agree"))


def _shows(twice: Column) -> Column:
    return (
        F.when(twice, "twice").when(F.col("first") & F.col("second"), "unlike").when(F.col("first"), "first")
        .when(F.col("second"), "second").when(F.col("whole"), "whole")
    )


def board_twice(sweep: DataFrame, target: Target, halves: Halves, dims: list[str]) -> DataFrame:
    """(dim, whole, first, second, agree, detectable, shows): where each dimension is detectable, and whether that counts.

    It counts when the dimension is detectable over the whole window and in each half, corrected on each
    board, and the lifts of its levels agree. Each window is aggregated once.
    """
    flags, tables = [], {}
    for name, column in zip(("whole", "first", "second"), (target.column, *halves[target.column]), strict=True):
        own = replace(target, column=column)
        cells = level_cells(sweep, own, dims)
        flags.append(I.with_q(effects(cells, own, "dim")).select("dim", F.col("detectable").alias(name)))
        tables[name] = levels(sweep, own, dims, cells)
    out = flags[0]
    for other in (*flags[1:], lift_agreement(tables["first"], tables["second"])):
        out = out.join(other, "dim", "left")
    out = out.fillna(False, ["whole", "first", "second"])
    twice = F.col("whole") & F.col("first") & F.col("second") & F.coalesce(F.col("agree") > 0, F.lit(False))
    return out.withColumns({"detectable": twice, "shows": _shows(twice)})


def differences_twice(whole: DataFrame, first: DataFrame, second: DataFrame, keys: list[str], value: str = "delta") -> DataFrame:
    """The same for differences (keys, value, detectable): they count when all three are detectable and of one sign.

    ``agree`` is 1 for one sign, -1 for different ones, null where a half lacks the difference.
    """
    out = whole.select(*keys, F.col(value).alias(value), F.col("detectable").alias("whole"))
    for name, df in (("first", first), ("second", second)):
        out = out.join(df.select(*keys, F.col(value).alias(f"_{name}"), F.col("detectable").alias(name)), keys, "left")
    sign = F.signum(value)
    agree = F.when(F.col("_first").isNotNull() & F.col("_second").isNotNull(), F.when((F.signum("_first") == sign) & (F.signum("_second") == sign), 1).otherwise(-1))
    out = out.fillna(False, ["whole", "first", "second"]).withColumn("agree", agree)
    twice = F.col("whole") & F.col("first") & F.col("second") & F.coalesce(F.col("agree") > 0, F.lit(False))
    return out.select(*keys, value, "whole", "first", "second", "agree", twice.alias("detectable"), _shows(twice).alias("shows"))
