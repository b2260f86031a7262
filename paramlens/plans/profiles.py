"""Profiles of sweeps: what is read from texts, derived from other columns, and promised of rows, by projections over one scan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Read:
    """A number in a text column: the first group of a pattern; ``yes`` reads it as 1 where the group is that text."""

    name: str
    column: str
    pattern: str
    yes: str | None = None


@dataclass(frozen=True)
class Derived:
    """A target worked out from others, in SQL; null where any that it needs is null or NaN."""

    name: str
    needs: tuple[str, ...]
    sql: str
    binary: bool = False
    better: int = 1


@dataclass(frozen=True)
class Invariant:
    """What no row may be: ``broken`` in SQL over columns, which may be null."""

    name: str
    needs: tuple[str, ...]
    broken: str


@dataclass(frozen=True)
class Profile:
    """What is known of a kind of sweep; it fits a table that has all of ``marks``."""

    name: str
    marks: tuple[str, ...] = ()
    reads: tuple[Read, ...] = ()
    derived: tuple[Derived, ...] = ()
    invariants: tuple[Invariant, ...] = ()
    target: str | None = None
    objective: tuple[tuple[str, int], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)


def profile_of(columns: list[str], profiles: list[Profile]) -> Profile | None:
    """The first profile that fits a table."""
    return next((p for p in profiles if set(p.marks) <= set(columns)), None)


def ordered(derived: tuple[Derived, ...], columns: set[str]) -> list[Derived]:
    """Derived targets after those that they need; without those whose needs aren't there, or need each other in a ring."""
    known, out, left = set(columns), [], list(derived)
    while ready := [d for d in left if set(d.needs) <= known]:
        out += ready
        known |= {d.name for d in ready}
        left = [d for d in left if d not in ready]
    return out


def _read(r: Read) -> Column:
    group = F.regexp_extract(F.col(r.column).cast("string"), r.pattern, 1)
    found = F.rlike(F.col(r.column).cast("string"), F.lit(r.pattern))
    return F.when(found, (group == r.yes).cast("double") if r.yes is not None else group.try_cast("double"))


def profiled(sweep: DataFrame, profile: Profile) -> DataFrame:
    """The table with what the profile reads and derives, and ``breaks``: the names of the invariants that a row breaks.

    Steps only add columns, so it is one scan, and nothing is shuffled. A column that is there already stays as it is.
    """
    out = sweep
    reads = {r.name: _read(r) for r in profile.reads if r.column in sweep.columns and r.name not in sweep.columns}
    out = out.withColumns(reads) if reads else out
    for d in ordered(tuple(d for d in profile.derived if d.name not in sweep.columns), set(out.columns)):
        kinds = dict(out.dtypes)
        known = F.lit(True)
        for c in d.needs:
            known = known & F.col(c).isNotNull() & (~F.isnan(c) if kinds[c] in ("double", "float") else F.lit(True))
        out = out.withColumn(d.name, F.when(known, F.expr(d.sql).cast("double")))
    tests = [F.when(F.coalesce(F.expr(i.broken), F.lit(False)), F.lit(i.name)) for i in profile.invariants if set(i.needs) <= set(out.columns)]
    return out.withColumn("breaks", F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>"))


def breaks(rows: DataFrame, profile: Profile) -> DataFrame:
    """(invariant, n): how many rows break each invariant that applies, 0 where it holds; one aggregation."""
    own = [i.name for i in profile.invariants if set(i.needs) <= set(rows.columns)]
    if not own:
        return rows.sparkSession.createDataFrame([], "invariant string, n long")
    one = rows.agg(*[F.count(F.when(F.array_contains("breaks", name), 1)).alias(f"_{k}") for k, name in enumerate(own)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(name).alias("invariant"), F.col(f"_{k}").alias("n")) for k, name in enumerate(own)])))
