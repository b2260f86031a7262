"""Gates: pass or fail conditions on targets, alone and together. Unknown stays unknown."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import intervals as I
from ..plans.ranges import order_statistics

_OPS = {">=": lambda v, need: v >= need, ">": lambda v, need: v > need, "<=": lambda v, need: v <= need, "<": lambda v, need: v < need}
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


@dataclass(frozen=True)
class Gate:
    column: str
    op: str
    need: float

    @property
    def name(self) -> str:
        return f"{self.column}{self.op}{self.need:g}"


def problem(gate: Gate, columns: list[str]) -> str | None:
    """Why a gate can't be used, or None."""
    if gate.column not in columns:
        return f"no target {gate.column}"
    if gate.op not in _OPS:
        return f"{gate.op} is not one of {' '.join(_OPS)}"
    return None if abs(gate.need) < float("inf") else "the need is not a number"


def passed(gate: Gate) -> Column:
    """True, false, or null where the value is missing."""
    v = F.col(gate.column).cast("double")
    return _OPS[gate.op](F.when(~F.isnan(v), v), F.lit(float(gate.need)))


def margin(gate: Gate) -> Column:
    """How far a value is beyond the need; negative where it fails."""
    v = F.col(gate.column).cast("double")
    return (v - gate.need) if gate.op in (">=", ">") else (gate.need - v)


def read_gate(sweep: DataFrame, name: str, passed: Column, value: Column, need: Column, op: str, pattern: str | None = None, against: Column | None = None) -> DataFrame:
    """Adds ``<name>_pass``, ``<name>_value`` and ``<name>_margin`` of a gate that a runner recorded.

    The value is a number, a ratio to ``against``, or the first group of ``pattern`` in a text; what can't be read
    is null. The margin is how far it is beyond the need, negative where it falls short.
    """
    number = F.regexp_extract(value.cast("string"), pattern, 1).try_cast("double") if pattern else value.cast("double")
    if against is not None:
        number = F.try_divide(number, F.nullif(against.cast("double"), F.lit(0.0)))
    gap = number - need.cast("double") if op in (">=", ">") else need.cast("double") - number
    return sweep.withColumns({f"{name}_pass": passed.cast("boolean"), f"{name}_value": number, f"{name}_margin": gap})


def flags(sweep: DataFrame, gates: list[Gate]) -> DataFrame:
    """Adds ``pass_0``..., ``gates_all`` and ``gates_count``.

    All gates: false if any fails, else null if any is unknown, which is three-valued AND.
    """
    tests = [passed(g) for g in gates]
    return sweep.withColumns(
        {f"pass_{i}": t for i, t in enumerate(tests)}
        | {"gates_all": reduce(lambda a, b: a & b, tests), "gates_count": sum((F.coalesce(t.cast("int"), F.lit(0)) for t in tests), F.lit(0))}
    )


def stats(sweep: DataFrame, gates: list[Gate]) -> DataFrame:
    """Per gate: decided rows, passes, rate with interval, never or always, the rule of three, quantiles of the value.

    A quantile is the value at index ``floor(f * n)`` of the sorted values, at most the last.
    """
    # A gate is decided where its value is known. One scan counts; quantiles are bracketed and picked, running small jobs at once.
    known = {g.name: F.when(passed(g).isNotNull(), F.col(g.column).cast("double")) for g in gates}
    found = order_statistics(sweep, known, QUANTILES)
    sums = [x for i, g in enumerate(gates) for x in (F.count(known[g.name]).alias(f"n{i}"), F.sum(passed(g).cast("long")).alias(f"k{i}"), F.max(known[g.name]).alias(f"m{i}"))]
    rows = []
    for i, g in enumerate(gates):
        picks = [F.lit(x[0] if x else None).cast("double").alias(f"q{int(f * 100):02d}") for f, x in zip(QUANTILES, found[g.name][1], strict=True)]
        rows.append(F.struct(F.lit(g.name).alias("gate"), F.col(f"n{i}").alias("n"), F.col(f"k{i}").alias("passes"), F.col(f"m{i}").alias("max"), *picks))
    out = sweep.agg(*sums).select(F.inline(F.array(*rows))).where(F.col("n") > 0)
    lo, hi = I.wilson(F.col("passes").cast("double"), F.col("n"))
    return out.withColumns({"rate": F.col("passes") / F.col("n"), "lo": lo, "hi": hi, "never": F.col("passes") == 0, "always": F.col("passes") == F.col("n"), "rule_of_three": F.when(F.col("passes") == 0, F.least(F.lit(1.0), F.lit(3.0) / F.col("n")))})


def co_failure(sweep: DataFrame, gates: list[Gate], least_passed: int) -> DataFrame:
    """Sets of gates that fail together in rows that pass at least so many; rows with an unknown gate are left out."""
    marked = flags(sweep, gates)
    known = reduce(lambda a, b: a & b, [F.col(f"pass_{i}").isNotNull() for i in range(len(gates))])
    failing = F.array_compact(F.array(*[F.when(~F.col(f"pass_{i}"), F.lit(g.name)) for i, g in enumerate(gates)]))
    rows = marked.where(known & (F.col("gates_count") >= least_passed)).select(F.array_join(failing, " & ").alias("failing"))
    return rows.groupBy("failing").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "failing")


def together(sweep: DataFrame, gates: list[Gate]) -> DataFrame:
    """Rows that pass all, rows decided, the most gates any row passes and how many rows do."""
    counted = flags(sweep, gates).groupBy("gates_count").agg(
        F.count("*").alias("rows"), F.sum(F.coalesce(F.col("gates_all").cast("long"), F.lit(0))).alias("passing"), F.count("gates_all").alias("known")
    )
    return counted.agg(F.sum("passing").alias("all_pass"), F.sum("known").alias("decided"), F.max("gates_count").alias("most"), F.max_by("rows", "gates_count").alias("rows_at_most"))


def correlates(sweep: DataFrame, column: str, others: list[str]) -> DataFrame:
    """Correlation with other targets over rows that have both, at least 30, strongest first; near copies are marked."""
    pair = [F.when(F.col(column).isNotNull(), F.col(o).cast("double")) for o in others]
    rows = [F.struct(F.lit(o).alias("other"), F.count(p).alias("n"), F.corr(F.when(p.isNotNull(), F.col(column).cast("double")), p).alias("r")) for o, p in zip(others, pair, strict=True)]
    one = sweep.agg(*[r.alias(f"_{i}") for i, r in enumerate(rows)])
    out = one.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(rows))])))
    return out.where((F.col("n") >= I.MIN_N) & F.col("r").isNotNull() & ~F.isnan("r")).withColumn("alias", F.abs("r") > 0.999).orderBy("alias", F.desc(F.abs("r")), "other")


def draft(sweep: DataFrame, column: str, better: int) -> DataFrame:
    """A gate to start from: the upper median as need."""
    _, (found,) = order_statistics(sweep, {"v": F.col(column)}, (0.5,), lambda f, n: [n // 2])["v"]
    rows = [("<=" if better < 0 else ">=", found[0] if found else None)]
    return sweep.sparkSession.createDataFrame(rows, "op string, need double")
