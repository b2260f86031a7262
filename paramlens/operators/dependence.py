"""Which dimensions depend on which: what determines them, where they apply, and what they were drawn with."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cells import Target, keyed, value

#: The level of a row to which a dimension doesn't apply.
_NONE = "\0"


def _joint(sweep: DataFrame, target: Target, dims: list[str]) -> DataFrame:
    """(a, b, la, lb, n, ny, sy): every pair of dimensions in both orders, with rows to which one doesn't apply; one pass of grouping sets."""
    keys = keyed(sweep, dims)
    rows = sweep.select(*[F.coalesce(keys[d], F.lit(_NONE)).alias(f"_{i}") for i, d in enumerate(dims)], value(target).alias("_y"))
    own = [F.col(f"_{i}") for i in range(len(dims))]
    pairs = list(combinations(range(len(dims)), 2))
    sets = [[own[i], own[j]] for i, j in pairs]
    cells = rows.groupingSets(sets, *own).agg(F.count("*").alias("n"), F.count("_y").alias("ny"), F.coalesce(F.sum("_y"), F.lit(0.0)).alias("sy"), F.grouping_id(*own).alias("_id"))
    whole = (1 << len(dims)) - 1
    at = {whole ^ (1 << (len(dims) - 1 - i)) ^ (1 << (len(dims) - 1 - j)): (i, j) for i, j in pairs}
    names = F.create_map(*[x for k, (i, j) in at.items() for x in (F.lit(k), F.array(F.lit(dims[i]), F.lit(dims[j])))])
    levels = F.array_compact(F.array(*own))  # of a set only its own two are there
    both = cells.select(names[F.col("_id").cast("int")].alias("d"), levels.alias("l"), "n", "ny", "sy")
    turned = [F.struct(F.col("d")[x].alias("a"), F.col("d")[1 - x].alias("b"), F.col("l")[x].alias("la"), F.col("l")[1 - x].alias("lb")) for x in (0, 1)]
    return both.select(F.explode(F.array(*turned)).alias("s"), "n", "ny", "sy").select("s.*", "n", "ny", "sy")


def dependence(sweep: DataFrame, target: Target, dims: list[str]) -> DataFrame:
    """(dim, other, relation, within, share, mean): a graph of how dimensions hang together, an edge each.

    ``determined by``: every level of the other goes with one level of the dimension (or with rows to which it doesn't
    apply). ``applies within``: the dimension applies to all rows of some levels of the other, which ``within`` lists, and to
    none of the rest. ``share`` is the part of the rows that it applies to, ``mean`` the target's over them, which is that of its
    levels weighted by their rows. Dimensions or others with one level have no edges.
    """
    cells = _joint(sweep, target, dims)
    here = F.col("la") != _NONE
    by_level = cells.groupBy("a", "b", "lb").agg(
        F.sum("n").alias("n"), F.sum(F.when(here, F.col("n")).otherwise(0)).alias("on"), F.count(F.when(here, 1)).alias("levels"),
        F.sum(F.when(here, F.col("ny")).otherwise(0)).alias("ny"), F.sum(F.when(here, F.col("sy")).otherwise(0.0)).alias("sy"),
    )
    known = F.col("lb") != _NONE
    edge = by_level.groupBy("a", "b").agg(
        F.sum("n").alias("n"), F.sum("on").alias("on"), F.sum("ny").alias("ny"), F.sum("sy").alias("sy"), F.count(F.when(known, 1)).alias("of"),
        F.bool_and(~known | ((F.col("levels") <= 1) & ((F.col("on") == 0) | (F.col("on") == F.col("n"))))).alias("fixed"),
        F.bool_and((F.col("on") == 0) | (F.col("on") == F.col("n"))).alias("cut"),
        F.array_sort(F.collect_list(F.when(known & (F.col("on") > 0), F.col("lb")))).alias("within"), F.sum(F.when(~known, F.col("on")).otherwise(0)).alias("off"),
    )
    sizes = cells.where(here).groupBy("a").agg(F.count_distinct("la").alias("k"))
    rows = edge.join(F.broadcast(sizes), "a").where((F.col("k") >= 2) & (F.col("of") >= 2))  # a row a dimension
    scoped = F.col("cut") & (F.col("on") < F.col("n")) & (F.col("off") == 0) & (F.size("within") > 0)
    relations = F.array_compact(F.array(F.when(F.col("fixed") & (F.col("off") == 0), "determined by"), F.when(scoped, "applies within")))
    told = rows.select(F.col("a").alias("dim"), F.col("b").alias("other"), F.explode(relations).alias("relation"), "within", (F.col("on") / F.col("n")).alias("share"), F.try_divide("sy", "ny").alias("mean"))
    return told.withColumn("within", F.when(F.col("relation") == "applies within", F.col("within")))


def scope_texts(edges: DataFrame) -> DataFrame:
    """(dim, text): where a dimension applies, in words."""
    own = edges.where(F.col("relation") == "applies within")
    return own.select("dim", F.concat(F.lit("only when "), "other", F.lit(" is "), F.array_join("within", " or "), F.lit(" · "), F.round(F.col("share") * 100).cast("int").cast("string"), F.lit("%")).alias("text"))


def drawn_with(association: DataFrame) -> DataFrame:
    """(dim, other, V): of each dimension that wasn't drawn independently, what it is linked to the most; needs (a, b, V, linked)."""
    sides = F.array(F.struct(F.col("a").alias("dim"), F.col("b").alias("other")), F.struct(F.col("b").alias("dim"), F.col("a").alias("other")))
    both = association.where("linked").select(F.inline(sides), "V")
    return both.groupBy("dim").agg(F.max_by("other", F.struct("V", "other")).alias("other"), F.max("V").alias("V"))
