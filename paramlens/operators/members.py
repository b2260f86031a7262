"""Set-valued parameters: what including a member does, sizes being equal; groups that differ by one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import intervals as I
from ..functions import kernel
from ..plans.cells import Target, keyed, value


def member_flags(sweep: DataFrame, column: str, members: list[str]) -> DataFrame:
    """Adds ``in_<member>`` and ``size`` of the set; null for a null set."""
    return sweep.withColumns({f"in_{m}": F.array_contains(column, m).cast("int") for m in members} | {"size": F.size(F.array_distinct(column))})


def member_effects(sweep: DataFrame, column: str, members: list[str], target: Target) -> DataFrame:
    """Difference of means with and without each member, compared among sets of equal size.

    Strata weigh by the harmonic share of rows with and without; z from the variances within strata.
    """
    rows = sweep.where(F.col(column).isNotNull()).select(value(target).alias("y"), F.array_sort(F.array_distinct(column)).alias("set")).where(F.col("y").isNotNull())
    # Sets repeat, so rows are counted by set before members are looked at; sums are about the mean of all.
    n = F.count("*")
    sets = rows.groupBy("set").agg(n.alias("n"), F.avg("y").alias("mean"), (F.var_pop("y") * n).alias("m2"))
    sets = sets.crossJoin(F.broadcast(rows.agg(F.avg("y").alias("base")))).withColumn("off", F.col("mean") - F.col("base"))  # one row
    pairs = F.transform(F.array(*map(F.lit, members)), lambda m: F.struct(m.alias("member"), F.array_contains("set", m).alias("inside")))
    long = sets.select("n", "off", "m2", "base", F.size("set").alias("size"), F.inline(pairs))
    sums = long.groupBy("member", "size", "inside").agg(F.sum("n").alias("n"), F.first("base").alias("base"), F.sum(F.col("n") * F.col("off")).alias("s"), F.sum(F.col("m2") + F.col("n") * F.col("off") * F.col("off")).alias("ss"))
    spread = F.greatest(F.lit(0.0), F.col("ss") - F.col("s") * F.col("s") / F.col("n"))
    cells = sums.select("member", "size", "inside", "n", (F.col("base") + F.col("s") / F.col("n")).alias("mean"), F.when(F.col("n") >= 2, spread / (F.col("n") - 1)).alias("var"))

    def side(flag: bool, name: str) -> DataFrame:
        return cells.where(F.col("inside") == flag).select("member", "size", *[F.col(c).alias(f"{c}_{name}") for c in ("n", "mean", "var")])

    both = side(True, "in").join(side(False, "out"), ["member", "size"]).where("n_in >= 2 and n_out >= 2")
    weight = F.col("n_in") * F.col("n_out") / (F.col("n_in") + F.col("n_out"))
    own = F.col("var_in") / F.col("n_in") + F.col("var_out") / F.col("n_out")
    sums = both.groupBy("member").agg(
        F.sum(F.col("n_in")).alias("n_in"), F.sum("n_out").alias("n_out"), F.count("*").alias("strata"), F.sum(weight).alias("w"),
        F.sum(weight * (F.col("mean_in") - F.col("mean_out"))).alias("wd"), F.sum(weight * weight * own).alias("wv"),
    )
    out = sums.withColumn("delta", F.col("wd") / F.col("w")).withColumn("se", F.sqrt("wv") / F.col("w"))
    out = out.withColumn("z", F.try_divide("delta", F.nullif("se", F.lit(0.0))))
    return I.with_q(out.withColumn("p", kernel.column(kernel.z_p, F.col("z")))).select("member", "n_in", "n_out", "strata", "delta", "se", "z", "p", "q", "detectable")


def group_contrasts(sweep: DataFrame, column: str, target: Target, every: list[str] | None = None) -> DataFrame:
    """Pairs of levels, each a ``|``-joined list of groups, that differ by exactly one group: difference, interval, z, q.

    ``every`` names all groups, which a level ``all`` and a null one stand for; without it null levels are left out. Levels
    are joined on what is left when one group is taken away, so only near levels meet.
    """
    y, level = value(target), F.col(column)
    named = F.array_sort(F.array_distinct(F.filter(F.split(level, r"\|"), lambda g: g != "")))
    if every is not None:
        named = F.when(level.isNull() | (level == "all"), F.array_sort(F.array(*map(F.lit, every)))).otherwise(named)
        level = F.coalesce(level, F.lit("all"))
    levels = sweep.select(level.alias("level"), named.alias("groups"), y.alias("y")).where(F.col("level").isNotNull()).groupBy("level", "groups").agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.var_samp("y").alias("var"))
    levels = levels.where("n >= 2")
    with_one = levels.withColumn("group", F.explode("groups")).withColumn("rest", F.array_join(F.array_remove("groups", F.col("group")), "|"))
    without = levels.select(F.array_join("groups", "|").alias("rest"), F.col("level").alias("without"), F.col("n").alias("n_without"), F.col("mean").alias("mean_without"), F.col("var").alias("var_without"))
    both = with_one.join(without, "rest")
    delta, se = F.col("mean") - F.col("mean_without"), F.sqrt(F.col("var") / F.col("n") + F.col("var_without") / F.col("n_without"))
    z = F.try_divide(delta, F.nullif(se, F.lit(0.0)))
    out = both.select("group", F.col("level").alias("with"), "without", "n", "n_without", delta.alias("delta"), (delta - kernel.Z95 * se).alias("lo"), (delta + kernel.Z95 * se).alias("hi"), z.alias("z"))
    return I.with_q(out.withColumn("p", kernel.column(kernel.z_p, F.col("z"))))


def canonical_members(sweep: DataFrame, dropped: str, naming: list[str], order: str) -> DataFrame:
    """(order, member, raw): each dropped column under one name, whatever a parameter's value put into it.

    A column with the value of exactly one naming parameter among its parts, in every row that dropped it, is named by
    that parameter: ``roc_24`` becomes ``roc_{period}``. The table of names is small and joined to the drops.
    """
    keys = keyed(sweep, naming)
    drops = sweep.select(F.col(order), *[keys[p].alias(f"_{p}") for p in naming], F.explode(F.array_distinct(dropped)).alias("raw"))
    parts = F.split("raw", "_")
    fits = [F.coalesce(F.array_contains(parts, F.col(f"_{p}")), F.lit(False)).alias(f"_f_{p}") for p in naming]
    rows = drops.select("*", *fits)
    names = rows.groupBy("raw").agg(F.array_compact(F.array(*[F.when(F.bool_and(f"_f_{p}"), F.lit(p)) for p in naming])).alias("_fits"))
    rows = rows.join(names.select("raw", F.when(F.size("_fits") == 1, F.element_at("_fits", 1)).alias("_by")), "raw")
    member = F.col("raw")
    for p in naming:
        put = F.array_join(F.transform(parts, lambda t: F.when(t == F.col(f"_{p}"), F.lit(f"{{{p}}}")).otherwise(t)), "_")
        member = F.when(F.col("_by") == p, put).otherwise(member)
    return rows.select(order, member.alias("member"), "raw").distinct()


def set_groups(effects: DataFrame, column: str) -> DataFrame:
    """(column, members, detectable, best): a set's members as one, with the strongest detectable of them."""
    best = F.max_by("member", F.when(F.col("detectable"), F.struct(F.abs("z"), "member")))
    return effects.agg(F.lit(column).alias("column"), F.count("*").alias("members"), F.bool_or("detectable").alias("detectable"), best.alias("best"))
