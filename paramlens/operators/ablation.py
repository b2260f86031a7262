"""What features do: the groups a manifest declares, and an additive model of the columns that rounds dropped."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intervals as I
from ..functions import kernel
from ..plans.cells import Target, keyed, value
from .first_half import Halves, differences_twice

_DECLARED = "place int, function string, parameter string, value string"


def declared(spark: SparkSession, manifest: dict) -> DataFrame:
    """(place, function, parameter, value): a row for each parameter of each feature and indicator, one of nulls where there are none.

    Functions go by their last name. Only texts have a value, as only they can name a group or a parameter.
    """
    own = (manifest.get("sfd") or {}).get("manifest") or {}
    rows = []
    for entry in [*(own.get("indicators") or []), *(own.get("features") or [])]:
        place, function = len({r[0] for r in rows}), str(entry.get("func") or "").split(".")[-1]
        named = entry.get("params") or {None: None}
        rows += [(place, function, k, v if isinstance(v, str) else None) for k, v in named.items()]
    return spark.createDataFrame(rows, _DECLARED)


def _group() -> Column:
    return F.when(F.col("parameter") == "group", F.col("value"))


def groups(entries: DataFrame) -> DataFrame:
    """(group, functions): the feature groups that a manifest declares, in its order."""
    one = entries.where(_group().isNotNull()).groupBy(F.col("value").alias("group")).agg(F.array_sort(F.collect_list(F.struct("place", "function"))).alias("_f"))
    return one.orderBy(F.col("_f")[0]["place"]).select("group", F.transform("_f", lambda x: x["function"]).alias("functions"))


def always(entries: DataFrame) -> DataFrame:
    """(function): those in no group, which every round has."""
    return entries.groupBy("place", "function").agg(F.max(_group()).alias("_g")).where(F.col("_g").isNull()).orderBy("place").select("function")


def naming(entries: DataFrame) -> DataFrame:
    """(name): the parameters of a round that functions take, which columns may be named by."""
    name = F.regexp_extract("value", r"^\{(\w+)\}$", 1)
    return entries.where(name != "").groupBy(name.alias("name")).agg(F.min("place").alias("_p")).orderBy("_p", "name").select("name")


def drop_keys(manifest: dict) -> tuple[str, ...]:
    """The parameters that decide which columns a round drops: how many, and the seed; none where nothing is dropped."""
    drops = ((manifest.get("sfd") or {}).get("manifest") or {}).get("feature_ablation")
    usual = {"drop_count_key": "feature_drop_count", "seed_key": "feature_drop_seed"}
    return tuple(drops.get(k) or v for k, v in usual.items()) if drops else ()


def factors(levels: DataFrame, named: DataFrame, movers: list[str], keys: tuple[str, ...]) -> DataFrame:
    """(dim, place): what a model holds fixed, from a table of levels (dim, levels).

    These are the feature groups, the naming parameters and the dimensions that move the target, in this order, if they
    have two levels or more and don't decide the drops.
    """
    spark = levels.sparkSession
    first = spark.createDataFrame([("feature_groups", 0)], "dim string, place int")
    own = named.select(F.col("name").alias("dim"), F.lit(1).alias("place"))
    moved = spark.createDataFrame([(m, 2 + i) for i, m in enumerate(movers)], "dim string, place int")
    wanted = first.union(own).union(moved).groupBy("dim").agg(F.min("place").alias("place"))
    return wanted.join(levels, "dim").where((F.col("levels") >= 2) & ~F.col("dim").isin(*keys)).orderBy("place", "dim").select("dim", "place")


@dataclass(frozen=True)
class Factor:
    """The lower triangle of the normal equations' factor, of the terms that those before don't determine."""

    kept: list[int]
    inverse: np.ndarray

    def __post_init__(self):
        object.__setattr__(self, "spread", np.einsum("ki,kj->ij", self.inverse, self.inverse))


def factored(normal: np.ndarray) -> Factor:
    """Outer products are taken off one by one; a term whose pivot isn't clearly above 0 is left out, as others determine it."""
    rest, kept, columns = normal.astype(float).copy(), [], []
    for j in range(len(normal)):
        if rest[j, j] > 1e-9 * max(1.0, normal[j, j]):
            column = rest[:, j] / np.sqrt(rest[j, j])
            rest -= np.outer(column, column)
            kept.append(j)
            columns.append(column)
    lower = np.array(columns).T[kept] if kept else np.zeros((0, 0))
    inverse = np.eye(len(kept))
    for j in range(len(kept)):  # forward substitution, for all columns at once
        inverse[j] = (inverse[j] - np.einsum("i,ik->k", lower[j, :j], inverse[:j])) / lower[j, j]
    return Factor(kept, inverse)


_SUMS = "a int, b int, w double"


def _dense(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """A row of 0 and 1 for each design."""
    terms = batch.column("terms")
    out = np.zeros((batch.num_rows, width))
    owner = np.repeat(np.arange(batch.num_rows), np.diff(terms.offsets.to_numpy()))
    out[owner, terms.flatten().to_numpy()] = 1
    return out


def _summed(total: np.ndarray) -> pa.RecordBatch:
    """Sums over pairs of terms as rows (a, b, w); the last row and column of the square are its sides."""
    a, b = np.nonzero(np.triu(total))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(total[a, b], pa.float64())], names=["a", "b", "w"])


def _sums(designs: DataFrame, width: int, weigh) -> np.ndarray:
    """Sums over designs of weights times pairs of terms: a matrix from each task, added up by aggregation.

    ``weigh(x, batch)`` gives weights and, for a side column, sums. What reaches the driver has as many rows as the model has pairs of terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                piece = batch.slice(begin, 4096)
                x = _dense(piece, width)
                weight, side = weigh(x, piece)
                total[:width, :width] += x.T @ (x * weight[:, None])
                total[:width, width] += x.T @ side
                total[width, width] += side.sum()
        yield _summed(total)

    out = np.zeros((width + 1, width + 1))
    for r in designs.mapInArrow(run, _SUMS).groupBy("a", "b").agg(F.sum("w").alias("w")).collect():
        out[r["a"], r["b"]] = out[r["b"], r["a"]] = r["w"]
    return out


def _together(designs: DataFrame) -> DataFrame:
    """(members, drops): the members of each term; those dropped in exactly the same rows are one.

    Two hashes of the designs that hold a member, taken together, are the digest of its rows.
    """
    each = designs.select("n", F.xxhash64("fixed", "taken").alias("_x"), F.xxhash64(F.lit(1), "fixed", "taken").alias("_y"), F.explode("taken").alias("member"))
    digest = each.groupBy("member").agg(F.sum("n").alias("drops"), F.bit_xor("_x").alias("_x"), F.bit_xor("_y").alias("_y"))
    return digest.groupBy("drops", "_x", "_y").agg(F.array_sort(F.collect_list("member")).alias("members")).select("members", "drops")


MODEL = "term string, member boolean, members array<string>, drops long, effect double, keep double, lo double, hi double, se double, z double, p double, reason string"


def model(sweep: DataFrame, target: Target, held: list[str], drops: str, least: int = 10) -> DataFrame:
    """An additive model of factors and dropped members, with standard errors that allow for unequal variances (HC3).

    Rows without the target, a factor or a record of drops are left out. Rows are counted by design; a design
    is the few terms that hold in it. Two passes over designs sum the normal equations, then the squared
    residuals weighted by leverage, for which tasks get the factor of the equations. Only sums
    over pairs of terms reach the driver. ``effect`` is that of dropping, ``keep`` its opposite with the interval. Members dropped
    in the same rows are one term; one dropped in fewer rows than ``least``, or that others determine, has no
    number but a ``reason``. Runs its jobs at once.
    """
    y, keys = value(target), keyed(sweep, held)
    told = [F.concat(F.lit(f"{f}="), keys[f]) for f in held]
    rows = sweep.select(F.array(F.lit("(mean)"), *told).alias("fixed"), F.array_sort(F.array_distinct(F.col(drops))).alias("taken"), y.alias("y"))
    rows = rows.where(F.col("y").isNotNull() & F.col("taken").isNotNull() & ~F.exists("fixed", lambda t: t.isNull()))
    n = F.count("*")
    designs = rows.groupBy("fixed", "taken").agg(n.alias("n"), F.avg("y").alias("mean"), (F.var_pop("y") * n).alias("m2"))
    spark = sweep.sparkSession
    levels = [r["t"] for r in designs.select(F.explode("fixed").alias("t")).distinct().orderBy("t").collect()]  # terms, as below
    if not levels:
        return I.with_q(spark.createDataFrame([], MODEL))
    joint = sorted(((r["members"], r["drops"]) for r in _together(designs).collect()), key=lambda x: x[0])
    names = ["(mean)"] + [t for f in held for t in [t for t in levels if t.startswith(f"{f}=")][1:]]
    width, first = len(names) + len(joint), len(names)
    # Numbers of terms instead of names; a member that others stand for has theirs, and a base level none.
    fixed = F.filter(F.transform("fixed", lambda t: F.array_position(F.array(*map(F.lit, names)), t).cast("int") - 1), lambda k: k >= 0)
    table = spark.createDataFrame([(m, first + k) for k, (own, _) in enumerate(joint) for m in own], "member string, k int")
    numbers = table.agg(F.map_from_entries(F.collect_list(F.struct("member", "k"))).alias("_m"))
    taken = F.array_distinct(F.transform("taken", lambda m: F.col("_m")[m]))
    used = designs.crossJoin(F.broadcast(numbers)).select(F.concat(fixed, taken).alias("terms"), F.col("n").cast("double").alias("n"), "mean", "m2")  # one row
    base = designs.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("b")).first()["b"]

    def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return batch.column(name).to_numpy()

    normal = _sums(used, width, lambda x, b: (column(b, "n"), column(b, "n") * (column(b, "mean") - base)))
    factor = factored(normal[:width, :width])
    beta = np.einsum("ij,j->i", factor.spread, normal[:width, width][factor.kept])

    def spread(x: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        own = x[:, factor.kept]
        off = column(batch, "mean") - base - own @ beta
        left = 1 - ((own @ factor.inverse.T) ** 2).sum(axis=1)
        known = left > 1e-9  # a row that is fitted exactly tells nothing
        weight = np.where(known, (column(batch, "m2") + column(batch, "n") * off**2) / np.where(known, left, 1) ** 2, 0.0)
        return weight, np.zeros(len(x))

    meat = _sums(used, width, spread)[np.ix_(factor.kept, factor.kept)]
    errors = dict(zip(factor.kept, np.sqrt(np.maximum(0, np.einsum("ij,ji->i", np.einsum("ij,jk->ik", factor.spread, meat), factor.spread))).tolist(), strict=True))
    effects = dict(zip(factor.kept, beta.tolist(), strict=True))
    found = []
    for k, (own, count) in enumerate([([t], None) for t in names] + joint):
        member = k >= first
        b, se = effects.get(k), errors.get(k)
        reason = "few" if member and count < least else "determined by others" if b is None else None
        term = "+".join(own)
        if reason:
            found.append((term, member, own, count, *[None] * 7, reason))
            continue
        b += base if k == 0 else 0.0
        z = b / se if se > 0 else None
        found.append((term, member, own, count, b, -b, -b - kernel.Z95 * se, -b + kernel.Z95 * se, se, z, kernel.z_p(z) if z is not None else None, None))
    out = spark.createDataFrame(found, MODEL)
    return I.with_q(out.withColumn("_family", F.col("member")), "p", "_family").drop("_family")


def features(sweep: DataFrame, target: Target, manifest: dict, drops: str, halves: Halves | None = None, movers: list[str] = (), least: int = 10) -> dict[str, DataFrame]:
    """The whole analysis of features: ``groups``, ``always``, ``contrasts`` of groups, ``terms`` of the model, and ``twice``.

    ``twice`` tells which terms are detectable over the whole window and in each half, with one sign.
    """
    from dataclasses import replace

    from .members import group_contrasts

    entries = declared(sweep.sparkSession, manifest)
    named = [r["name"] for r in naming(entries).collect()]  # names in the manifest
    wanted = [c for c in dict.fromkeys(["feature_groups", *named, *movers]) if c in sweep.columns]
    levels = sweep.agg(*[F.count_distinct(c).alias(c) for c in wanted]).unpivot([], wanted, "dim", "levels") if wanted else sweep.sparkSession.createDataFrame([], "dim string, levels long")
    held = [r["dim"] for r in factors(levels, naming(entries), list(movers), drop_keys(manifest)).collect()]
    every = [r["group"] for r in groups(entries).collect()]
    out = {"groups": groups(entries), "always": always(entries), "terms": model(sweep, target, held, drops, least)}
    if "feature_groups" in sweep.columns:
        out["contrasts"] = group_contrasts(sweep, "feature_groups", target, every)
    if halves and target.column in halves:
        parts = [model(sweep, replace(target, column=c), held, drops, least).where("member") for c in halves[target.column]]
        out["twice"] = differences_twice(out["terms"].where("member").withColumn("detectable", F.coalesce("detectable", F.lit(False))), *parts, ["term"], "keep")
    return out
