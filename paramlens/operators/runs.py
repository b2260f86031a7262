"""Runs as wholes: comparing them, their pace and state, and what never traded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernel
from ..plans.cells import Target, value
from ..plans.ranges import order_statistics
from .gates import Gate, passed

#: Seconds without a row after which a run counts as quiet, and the row from which on a new field is late.
QUIET, LATE = 600, 1000


def compare(sweeps: DataFrame, run: str, target: Target, keys: list[tuple[str, int]]) -> DataFrame:
    """Per run: rows, mean and interval of the target, and the best value of each objective."""
    from .effects import mean_interval

    y = value(target)
    best = [(F.max(c) if better >= 0 else F.min(c)).alias(f"best_{c}") for c, better in keys]
    n = F.count(y)
    cells = sweeps.groupBy(run).agg(F.count("*").alias("rows"), n.alias("n"), F.lit(0.0).alias("s"), (F.var_pop(y) * n).alias("ss"), F.sum(y).alias("total"), *best)
    return mean_interval(cells, target).select(run, "rows", "n", "mean", "lo", "hi", *[f"best_{c}" for c, _ in keys])


def auc_above(auc: Column, positive: Column, negative: Column) -> Column:
    """Whether an area under the curve is above a half beyond its standard error; null without counts."""
    q1, q2 = auc / (2 - auc), 2 * auc * auc / (1 + auc)
    v = F.try_divide(auc * (1 - auc) + (positive - 1) * (q1 - auc * auc) + (negative - 1) * (q2 - auc * auc), positive * negative)
    known = auc.isNotNull() & ~F.isnan(auc) & (positive > 0) & (negative > 0)
    return F.when(known, auc - 0.5 > kernel.Z95 * F.sqrt(F.greatest(v, F.lit(0.0))))


def shortfall(rounds: DataFrame) -> float | None:
    """How far below its threshold the middle round that never fired stayed; runs small jobs at once."""
    never = F.when(F.col("fired") == 0, -F.col("margin"))
    _, (found,) = order_statistics(rounds, {"v": never}, (0.5,), lambda f, n: [(n + 1) // 2 - 1])["v"]
    return found[0] if found else None


def never_traded(rounds: DataFrame) -> DataFrame:
    """Rounds that never fired, by reason: held back by the threshold, nothing found, or unknown.

    ``rounds`` has fired, reach, margin, auc, positive and negative; rounds without outputs are left out.
    """
    own = rounds.where(F.col("fired").isNotNull())
    never, above = F.col("fired") == 0, auc_above(F.col("auc"), F.col("positive"), F.col("negative"))

    def total(test: Column) -> Column:
        return F.sum(F.coalesce(test, F.lit(False)).cast("long"))

    return own.agg(
        F.count("*").alias("rounds"), total(never).alias("never"), total(never & above).alias("held"), total(never & ~above).alias("nothing"),
        total(never & above.isNull()).alias("unknown"), total(never & (F.col("reach") > 0)).alias("within_reach"),
        F.lit(shortfall(own)).cast("double").alias("shortfall"),
    )


def pass_histogram(sweep: DataFrame, gate: Gate, bins: int = 32) -> DataFrame:
    """(bin, low, pass, fail): a histogram of a gate's values with an edge on the need; outside has a null bin.

    From 200 rows on it spans the 1st to the 99th percentile, by the value at index floor(f n), and always the need.
    """
    rows = sweep.select(F.col(gate.column).cast("double").alias("v"), passed(gate).alias("ok")).where(F.col("ok").isNotNull())
    n, (low, high) = order_statistics(rows, {"v": F.col("v")}, (0.01, 0.99))["v"]
    ends = rows.agg(F.min("v").alias("a"), F.max("v").alias("b"))
    lo = F.least(F.lit(low[0]) if n >= 200 else F.col("a"), F.lit(float(gate.need)))
    hi = F.greatest(F.lit(high[0]) if n >= 200 else F.col("b"), F.lit(float(gate.need)))
    ends = ends.select(F.when(hi > lo, lo).otherwise(lo - 1).alias("lo"), F.when(hi > lo, hi).otherwise(hi + 1).alias("hi"))
    ends = ends.withColumn("w", (F.col("hi") - F.col("lo")) / bins)
    ends = ends.withColumn("start", F.lit(float(gate.need)) - F.ceil((F.lit(float(gate.need)) - F.col("lo")) / F.col("w") - 1e-9) * F.col("w"))
    ends = ends.withColumn("nb", F.floor((F.col("hi") - F.col("start")) / F.col("w") + 1e-9) + 1)
    placed = rows.crossJoin(F.broadcast(ends))  # one row
    at = F.least(F.col("nb") - 1, F.greatest(F.lit(0), F.floor((F.col("v") - F.col("start")) / F.col("w") + 1e-9)))
    inside = F.col("v").between(F.col("lo"), F.col("hi"))
    return placed.groupBy(F.when(inside, at).alias("bin")).agg(
        F.first(F.when(inside, F.col("start") + at * F.col("w"))).alias("low"), F.sum(F.col("ok").cast("long")).alias("pass"), F.sum((~F.col("ok")).cast("long")).alias("fail")
    )


def health(rows: int, planned: int | None, rate: float | None, seconds_per_row: float | None) -> dict[str, float | None]:
    """Seconds left at a rate of rows a second, and workers that are busy at once."""
    left = (planned - rows) / rate if planned is not None and rate else None
    return {"remaining": left, "workers": rate * seconds_per_row if rate and seconds_per_row else None}


def arrival_rate(arrivals: DataFrame, column: str, window: int = 300) -> DataFrame:
    """Rows a second over the last arrivals, of at least 10 rows over 10 seconds; null otherwise."""
    last = arrivals.agg(F.max(column).alias("_last"))
    recent = arrivals.crossJoin(F.broadcast(last)).where(F.col(column) >= F.col("_last") - F.make_dt_interval(secs=F.lit(window)))  # one row
    span = F.unix_micros(F.max(column)) / 1e6 - F.unix_micros(F.min(column)) / 1e6
    one = recent.agg(F.count("*").alias("rows"), span.alias("span"))
    return one.select("rows", F.when((F.col("rows") >= 10) & (F.col("span") >= 10), (F.col("rows") - 1) / F.col("span")).alias("rate"))


def problems(crashed: DataFrame, writing: DataFrame, breaks: DataFrame, bad: DataFrame, late: DataFrame) -> DataFrame:
    """(severity, kind, what, n): everything that is wrong with a run, once.

    ``crashed`` and ``writing`` are a log's crashes and open tracebacks, ``breaks`` has (invariant, n) with 0 where one
    holds, ``bad`` the lines that aren't rows, and ``late`` (name, event, row): fields that changed, or came after row 1,000.
    """
    line = lambda c: F.col(c).cast("string")
    crash = crashed.select(F.lit("critical").alias("severity"), F.lit("crash").alias("kind"), F.concat_ws(" ", F.coalesce("exception", F.lit("traceback")), F.lit("at line"), line("at")).alias("what"), F.lit(1).cast("long").alias("n"))
    open_one = writing.select(F.lit("critical"), F.lit("writing"), F.concat_ws(" ", F.col("log"), F.lit("at line"), line("at")), F.lit(1).cast("long"))
    broken = breaks.select(F.when(F.col("n") > 0, "critical").otherwise("ok"), F.lit("invariant"), F.col("invariant"), F.col("n").cast("long"))
    lines = bad.agg(F.count("*").alias("n")).where(F.col("n") > 0).select(F.lit("critical"), F.lit("bad"), F.lit("lines that are not rows"), F.col("n"))
    changed = late.where((F.col("event") == "kind") | (F.col("row") >= LATE)).select(F.lit("warning"), F.lit("schema"), F.col("name"), F.col("row").cast("long"))
    return crash.union(open_one).union(broken).union(lines).union(changed)


def status(
    live: bool, archived: bool, segment: str | None, rows: int, planned: int | None, quiet_for: float | None, edge: int | None = None,
    connected: bool = True, following: bool = True, writing: bool = False,
) -> str:
    """What a run is doing, the first that holds: replay, down, archived, recorded, earlier, crashed, finished, quiet or live.

    ``live`` tells whether the sweep is followed, ``following`` whether this run of it is the one being written.
    """
    done = segment == "finished" or bool(planned and rows >= planned)
    states = (
        ("replay", edge is not None and edge < rows), ("down", live and not connected), ("archived", archived), ("recorded", not live), ("earlier", not following),
        ("crashed", segment == "crashed" or writing), ("finished", done), ("quiet", quiet_for is not None and quiet_for > QUIET),
    )
    return next((name for name, holds in states if holds), "live")


#: Which statistic of a report each threshold is held against; fixed values.
STATISTIC_OF = {
    "min_deflated_sharpe_probability": "deflated_sharpe_probability",
    "max_pbo": "pbo",
}


def verdicts(report: dict) -> list[dict]:
    """What a report says of each known threshold that it declares as a number: pass, fail, or unavailable and why."""
    parts = {name: report.get(name) or {} for name in ("thresholds", "verdicts", "errors")}

    def row(key: str, statistic: str) -> dict:
        held = parts["verdicts"].get(key)
        said = ("pass" if held else "fail") if isinstance(held, bool) else "unavailable"
        return {"key": key, "threshold": parts["thresholds"][key], "verdict": said, "why": parts["errors"].get(statistic)}

    return [row(key, statistic) for key, statistic in STATISTIC_OF.items() if isinstance(parts["thresholds"].get(key), (int, float))]


def catalog(rows: DataFrame, run: str, arrived: str) -> DataFrame:
    """(run, rows, shards, first, last): what there is of each run, without reading its columns; needs ``shard``."""
    return rows.groupBy(run).agg(F.count("*").alias("rows"), F.count_distinct("shard").alias("shards"), F.min(arrived).alias("first"), F.max(arrived).alias("last"))


def evidence(there: bool, allowed: bool | None, failed: bool, pending: bool) -> str:
    """Whether a diagnostic has what it needs: available, or why not: policy, failed, pending or missing; the first that holds."""
    states = (("available", there), ("policy", allowed is False), ("failed", failed), ("pending", pending))
    return next((name for name, holds in states if holds), "missing")


def convergence(reports: DataFrame) -> DataFrame:
    """Convergence reports (pattern, rounds, warned) of several shards, summed."""
    return reports.groupBy("pattern").agg(F.sum("rounds").alias("rounds"), F.sum("warned").alias("warned")).orderBy("pattern")


def arrived_after(sweep: DataFrame, order: str, at: int) -> DataFrame:
    return sweep.where(F.col(order) > at).agg(F.count("*").alias("after"))


def portable(result: DataFrame, least: int = 30) -> DataFrame:
    """A result for handing on: NaN and infinities are null, and estimates on few rows are withheld."""
    kinds = dict(result.dtypes)
    few = F.col("n") < least if "n" in kinds else F.lit(False)
    masked = {"mean", "lo", "hi", "lift", "delta", "keep"}
    columns = []
    for c, t in kinds.items():
        v = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) if t in ("double", "float") else F.col(c)
        columns.append((F.when(~F.coalesce(few, F.lit(False)), v) if c in masked else v).alias(c))
    return result.select(*columns)


def summary_text(board: DataFrame, limit: int = 20) -> str:
    """The board as lines of text."""
    rows = board.limit(limit).collect()
    return "\n".join(f"{r['dim']}: {'detectable' if r['detectable'] else 'not detectable'}, omega2 {r['omega2'] or 0:.4f}, best {r['best']}, worst {r['worst']}" for r in rows)
