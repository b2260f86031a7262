"""Choosing the members of a cohort: the pool, its order, and how members are combined."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.ranges import ranged
from .first_half import Halves, gate_reads
from .gates import Gate, passed
from .pockets import rows_in

# Where a round names its architecture, names of those that give probabilities, and features that find price lines.
ARCHITECTURE_KEYS = (
    "architecture",
    "model_architecture",
    "_architecture",
    "reference_architecture",
    "decoder_architecture",
    "model_name",
)
PROBABILITY_HINTS = (
    "logreg",
    "tabpfn",
    "random_binary",
    "random forest",
    "random_forest",
    "lightgbm",
    "lgbm",
    "ridge",
    "svm",
    "hmm",
    "garch",
    "lstm",
    "cnn",
)
LINE_FEATURES = r"(^|\.)(quantile_)?price_lines$"


def pool(sweep: DataFrame, conditions: list, gates: list[Gate], halves: Halves, order: str, edge: int | None = None) -> DataFrame:
    """Rows in the pocket that pass every gate, each read on the first half where it can be; an unknown gate isn't passed."""
    rows = rows_in(sweep, conditions, order, edge)
    for gate, _ in gate_reads(gates, halves):
        rows = rows.where(F.coalesce(passed(gate), F.lit(False)))
    return rows


def ranked(rows: DataFrame, column: str, order: str, better: int = 1) -> DataFrame:
    """Adds ``place``, from 1, by the value, best first and ties by arrival; rows without a value go.

    Places are counted range by range.
    """
    v = F.col(column).cast("double")
    known = rows.where(v.isNotNull() & ~F.isnan(v)).withColumn("_down", v if better < 0 else -v)
    placed = ranged(known, "_down", order)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_c"))
    ahead = counts.select("_part", F.coalesce(F.sum("_c").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))  # one row a range
    own = F.row_number().over(W.partitionBy("_part").orderBy("_down", order))
    return placed.withColumn("place", own).join(F.broadcast(ahead), "_part").withColumn("place", F.col("place") + F.col("_ahead")).drop("_part", "_down", "_ahead")


def members(placed: DataFrame, n: int, order: str, out: list = (), put: list = ()) -> DataFrame:
    """The n best rows less those taken out, and those put in, by place; ``out`` and ``put`` are values of ``order``."""
    chosen = (F.col("place") <= n) & ~F.col(order).isin(*out) if out else F.col("place") <= n
    return placed.where(chosen | F.col(order).isin(*put) if put else chosen).orderBy("place")


def architecture(params: Column, reference: str | None = None, module: str | None = None) -> Column:
    """The architecture that a round's parameters (a map) name, else the manifest's, else the module's."""
    named = [F.trim(params[k]) for k in ARCHITECTURE_KEYS] + [F.trim(F.lit(x)) for x in (reference, module) if x]
    return F.coalesce(*[F.when(x != "", x) for x in named], F.lit("unknown_architecture"))


def aggregation(name: Column) -> Column:
    hinted = F.rlike(F.lower(F.trim(name)), F.lit("|".join(map(re.escape, PROBABILITY_HINTS))))
    return F.when(hinted, "probability_weighted").otherwise("majority_vote")


def vote_threshold(name: Column) -> Column:
    """Above which prediction a member is long: 0 for a regressor's move, else a half."""
    return F.when(F.lower(name).contains("regressor"), 0.0).otherwise(0.5)


def uses_lines(params: Column, features: list[dict]) -> Column:
    """Whether a round used a price-line feature of the manifest: its flag is on, if it has one, and its group is among the round's."""
    groups, used = params["feature_groups"], F.lit(False)
    for feature in features:
        if not re.search(LINE_FEATURES, str(feature.get("func") or "")):
            continue
        own = {**feature, **(feature.get("params") or {})}
        on = F.lit(True)
        if isinstance(own.get("include_if"), str):
            on = F.coalesce(params[own["include_if"]] == "true", F.lit(False))
        if isinstance(own.get("group"), str):
            on = on & (groups.isNull() | (groups == "all") | F.array_contains(F.split(groups, r"\|"), own["group"]))
        used = used | F.coalesce(on, F.lit(True))
    return used


def cohort_rules(chosen: DataFrame, params: str = "params", reference: str | None = None, module: str | None = None, features: list[dict] = ()) -> DataFrame:
    """One row: how the members are combined, and what speaks against combining them, as ``notes``."""
    p = F.col(params)
    rows = chosen.select(architecture(p, reference, module).alias("a"), uses_lines(p, list(features)).alias("lines"))
    one = rows.agg(F.count("*").alias("members"), F.array_sort(F.collect_set("a")).alias("architectures"), F.sum(F.col("lines").cast("long")).alias("_lines"))
    first = F.get("architectures", F.lit(0))
    mixed = F.when(F.size("architectures") > 1, F.concat(F.lit("members of several architectures: "), F.array_join("architectures", ", ")))
    lines = F.when(F.col("_lines") > 0, F.concat(F.col("_lines").cast("string"), F.lit(" members use price lines, which depend on the history they are given")))
    return one.select("members", "architectures", aggregation(first).alias("aggregation"), vote_threshold(first).alias("cut"), F.array_compact(F.array(mixed, lines)).alias("notes"))


def bar_step(manifest: dict) -> int | None:
    """The seconds of a bar that a manifest's data source declares."""
    at: object = manifest
    for key in ("sfd", "manifest", "data_source", "params", "kline_size"):
        at = at.get(key) if isinstance(at, dict) else None
    return at if isinstance(at, int) and not isinstance(at, bool) and at > 0 else None
