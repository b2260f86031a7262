"""Whether a choice has seen the second half: an append-only table of choices, replayed as of any time.

A change is (session, at, what, value): ``pocket``, ``gates`` and ``context`` are chosen, or cleared by null;
``target`` and ``first_half`` say what was in view; ``restored`` brings back choices of which nothing is known. A choice
was found on the first half only while every change to it was made with the first half in view, and a
target that is measured there. Once the second half has been seen, that stays so until all is cleared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHOSEN = ("pocket", "gates", "context")


def _in_view(what: str) -> Column:
    """The last value set, null if it was cleared or never set."""
    order = W.partitionBy("session").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    return F.last(F.when(F.col("what") == what, F.struct("value")), ignorenulls=True).over(order)["value"]


def reads_whole(target: Column, gates: Column, halved: list[str], standing: dict[str, str], default: str) -> Column:
    """Whether a target in view reads the whole window although the first half is on.

    ``halved`` are the targets that are measured on each half; ``gates`` is a text ``id=target`` joined by ``|``,
    ``standing`` gates are always there. A gate reads as its target does, all gates together as the worst of them.
    """
    if not halved:
        return F.lit(True)
    known = F.array(*map(F.lit, halved))
    shown = F.coalesce(F.nullif(target, F.lit("")), F.lit(default))
    pairs = F.filter(F.split(F.coalesce(gates, F.lit("")), r"\|"), lambda g: g.contains("="))
    of = lambda g: F.substring_index(g, "=", -1)
    every = F.forall(pairs, lambda g: F.array_contains(known, of(g)))
    fixed = F.array(*[F.lit(f"{k}={v}") for k, v in standing.items()]) if standing else F.array().cast("array<string>")
    named = F.filter(F.concat(fixed, pairs), lambda g: F.concat(F.lit("gate:"), F.substring_index(g, "=", 1)) == shown)
    one = F.coalesce(F.array_contains(known, of(F.get(named, F.lit(0)))), F.lit(False))
    return F.when(shown.isin("gates:all", "gates:count"), ~every).when(shown.startswith("gate:"), ~one).otherwise(~F.array_contains(known, shown))


def replayed(choices: DataFrame, halved: list[str], standing: dict[str, str], default: str) -> DataFrame:
    """Adds to each change what is then in view and ``found``: first, whole, or null with nothing chosen."""
    rows = choices.withColumns({f"_{w}": _in_view(w) for w in (*CHOSEN, "target", "first_half")})
    some = F.lit(False)
    for w in CHOSEN:
        some = some | F.coalesce(F.col(f"_{w}") != "", F.lit(False))
    half = F.coalesce(F.col("_first_half") == "true", F.lit(False))
    tainted = ~half | reads_whole(F.col("_target"), F.col("_gates"), halved, standing, default) | (F.col("what") == "restored")
    order = W.partitionBy("session").orderBy("at")
    rows = rows.withColumns({"_some": some | (F.col("what") == "restored"), "_tainted": tainted})
    # What stands without a break since it was first chosen is one choice.
    rows = rows.withColumn("_choice", F.count(F.when(~F.col("_some"), 1)).over(order))
    seen = F.max(F.col("_tainted") & F.col("_some")).over(W.partitionBy("session", "_choice").orderBy("at"))
    out = rows.withColumn("found", F.when(F.col("_some"), F.when(seen, "whole").otherwise("first")))
    return out.select("session", "at", "what", "value", *[F.col(f"_{w}").alias(w) for w in (*CHOSEN, "target")], half.alias("first_half"), "found")


def as_of(numbers: DataFrame, history: DataFrame) -> DataFrame:
    """(session, at, ...) with ``found`` of the choices as they stood then; a change at the same time counts."""
    before = history.select("session", "at", F.lit(0).alias("_o"), F.struct("found").alias("_f"))
    asked = numbers.withColumn("_o", F.lit(1)).unionByName(before, allowMissingColumns=True)
    last = F.last("_f", ignorenulls=True).over(W.partitionBy("session").orderBy("at", "_o").rowsBetween(W.unboundedPreceding, W.currentRow))
    return asked.withColumn("found", last["found"]).where(F.col("_o") == 1).select(*numbers.columns, "found")


def touched(reads: DataFrame) -> DataFrame:
    """(cohort, why): cohorts that the second half helped choose, by ``reads`` (cohort, label, kind, available, halved).

    ``kind`` is target or gate. Gates without evidence on the first half come first, then a target that isn't measured on each
    half, then gates that read the whole window.
    """
    labels = lambda test: F.array_join(F.array_sort(F.collect_list(F.when(test, F.col("label")))), "; ")
    gate = F.col("kind") == "gate"
    one = reads.groupBy("cohort").agg(labels(gate & ~F.col("available")).alias("none"), labels(~gate & ~F.col("halved")).alias("target"), labels(gate & F.col("available") & ~F.col("halved")).alias("whole"))
    why = (
        F.when(F.col("none") != "", F.concat(F.lit("no evidence on the first half: "), "none"))
        .when(F.col("target") != "", F.concat(F.lit("not measured on each half: "), "target"))
        .when(F.col("whole") != "", F.concat(F.lit("read over the whole window: "), "whole"))
    )
    return one.select("cohort", why.alias("why")).where(F.col("why").isNotNull())
