"""Order over all rows without a task that holds them all: ranges of a column, running sums, order statistics."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Relative precision of the sketch that brackets are taken from; how many values one task sorts; steps that a bracket is narrowed by.
SKETCH, FEW, GRID = 10_000, 50_000, 1000


def ranged(rows: DataFrame, column: str, tie: str | None = None) -> DataFrame:
    """Adds ``_part``, which rises with the column: as many ranges of about equal counts as shuffles have partitions.

    The cuts come from mergeable sketches, one row for all tasks. Equal values share a range, or with ``tie``, a column
    of numbers that orders them, a value that many rows share is cut too: ranges rise with (column, tie), and
    none holds much over twice the mean.
    """
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    marks = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    cuts = rows.agg(F.percentile_approx(column, marks, SKETCH).alias("_cuts"))
    if tie is None:
        cuts = cuts.select(F.array_distinct("_cuts").alias("_cuts"))
        return rows.crossJoin(F.broadcast(cuts)).withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(column)))).drop("_cuts")  # one row
    # A value that m cuts fall on gets m cuts of its own among its rows: it has at most as many as there are ranges.
    common = cuts.select(F.explode("_cuts").alias("_value")).groupBy("_value").agg(F.count("*").alias("_m")).where("_m > 1")
    own = rows.select(F.col(column).alias("_value"), F.col(tie).alias("_tie")).join(F.broadcast(common), "_value").groupBy("_value", "_m").agg(F.percentile_approx("_tie", marks, SKETCH).alias("_all"))
    places = F.transform(F.sequence(F.lit(1), F.col("_m")), lambda k: F.element_at("_all", F.greatest(F.lit(1), F.floor(k * parts / (F.col("_m") + 1)).cast("int"))))
    ties = own.agg(F.map_from_entries(F.collect_list(F.struct("_value", places.alias("_places")))).alias("_ties"))
    placed = rows.crossJoin(F.broadcast(cuts)).crossJoin(F.broadcast(ties))  # one row each
    within = F.size(F.filter(F.coalesce(F.try_element_at("_ties", F.col(column)), F.array()), lambda t: t < F.col(tie)))
    return placed.withColumn("_part", F.size(F.filter("_cuts", lambda c: c < F.col(column))) + within).drop("_cuts", "_ties")


def running(rows: DataFrame, column: str, sums: dict[str, Column], within: str | None = None) -> DataFrame:
    """Adds sums over all rows up to this one in the order of a column without repeats, inside each ``within`` if given.

    What comes before a range is added from its summary, so a task holds one range.
    """
    placed = rows if "_part" in rows.columns else ranged(rows, column)
    keys = [within] if within else []
    own = W.partitionBy("_part", *keys).orderBy(column).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    whole = placed.groupBy("_part", *keys).agg(*[F.sum(x).alias(f"_w_{n}") for n, x in sums.items()])
    whole = whole.select("_part", *keys, *[F.sum(f"_w_{n}").over(before).alias(f"_b_{n}") for n in sums])  # one row a range
    out = placed.withColumns({n: F.sum(x).over(own) for n, x in sums.items()}).join(whole, ["_part", *keys])
    return out.withColumns({n: F.col(n) + F.coalesce(f"_b_{n}", F.lit(0)) for n in sums}).drop(*[f"_b_{n}" for n in sums])


def nearest(f: float, n: int) -> list[int]:
    """The position ``floor(f n)``, at most the last."""
    return [min(int(f * n), n - 1)]


#: A bracket: column, and the values that it lies between, None where it is open.
Bracket = tuple[int, float | None, float | None]


def _inside(bracket: Bracket) -> Column:
    i, lo, hi = bracket
    v = F.col(f"v{i}")
    above = v.isNotNull() if lo is None else v > F.lit(lo)
    return above if hi is None else above & (v < F.lit(hi))


def _values(slim: DataFrame, brackets: list[Bracket]) -> DataFrame:
    """(b, v): the values strictly inside each bracket."""
    held = [F.struct(F.lit(b).alias("b"), F.when(_inside(x), F.col(f"v{x[0]}")).alias("v")) for b, x in enumerate(brackets)]
    some = reduce(lambda a, b: a | b, [_inside(x) for x in brackets])  # nearly all rows go here
    return slim.where(some).select(F.inline(F.filter(F.array(*held), lambda x: x["v"].isNotNull())))


def order_statistics(
    rows: DataFrame, columns: dict[str, Column], fractions: tuple[float, ...], positions: Callable[[float, int], list[int]] = nearest
) -> dict[str, tuple[int, list[list[float]]]]:
    """By name: how many values a column has, and its exact values at ``positions(f, n)`` for each fraction.

    Positions count from 0 in sorted order; nulls and NaN are left out. Sketches bracket each position, values below and
    at the edges of a bracket are counted, and a bracket that still holds more than ``FEW`` values is narrowed by a sketch of
    those, so no task sorts more than ``FEW``, however many rows there are and however they repeat. Runs three
    small jobs up to some tens of millions of rows, and two more for every thousandfold; they give the driver a few numbers each.
    """
    # Filters and repeated references stop here, so a column's expression is worked out once a row.
    slim = rows.select(*[F.when(F.monotonically_increasing_id() >= 0, F.when(~F.isnan(c.cast("double")), c.cast("double"))).alias(f"v{i}") for i, c in enumerate(columns.values())])
    room = 3 / SKETCH
    marks = F.array(*[F.lit(min(1.0, max(0.0, f + d))) for f in fractions for d in (-room, room)])
    sums = [x for i in range(len(columns)) for x in (F.count(f"v{i}").alias(f"n{i}"), F.percentile_approx(f"v{i}", marks, SKETCH).alias(f"p{i}"))]
    first = slim.agg(*sums).first()
    due: dict[Bracket, set[int]] = {}
    for i in range(len(columns)):
        for j, f in enumerate(fractions):
            if n := first[f"n{i}"]:
                lo, hi = first[f"p{i}"][2 * j : 2 * j + 2] if n > FEW else (None, None)
                due.setdefault((i, lo, hi), set()).update(positions(f, n))
    found: dict[tuple[int, int], float] = {}
    while due:
        due = _narrowed(slim, due, [first[f"n{i}"] for i in range(len(columns))], found)
    out = {}
    for i, name in enumerate(columns):
        n = first[f"n{i}"]
        out[name] = (n, [[found[i, p] for p in positions(f, n)] if n else [] for f in fractions])
    return out


def _narrowed(slim: DataFrame, due: dict[Bracket, set[int]], n: list[int], found: dict[tuple[int, int], float]) -> dict[Bracket, set[int]]:
    """Finds the values at places in brackets that hold few, and gives narrower brackets for the others."""
    keys = list(due)
    tests = {}
    for b, (i, lo, hi) in enumerate(keys):
        v = F.col(f"v{i}")
        tests |= {f"below{b}": v < F.lit(lo) if lo is not None else None, f"at{b}": v == F.lit(lo) if lo is not None else None, f"in{b}": _inside(keys[b]), f"top{b}": v == F.lit(hi) if hi is not None else None}
    asked = {name: F.sum(t.cast("long")).alias(name) for name, t in tests.items() if t is not None}
    open_ended = all(lo is None and hi is None for _, lo, hi in keys)
    told = {f"in{b}": n[i] for b, (i, _, _) in enumerate(keys)} if open_ended else slim.agg(*asked.values()).first().asDict()
    few: dict[Bracket, dict[int, int]] = {}
    wide: dict[Bracket, dict[int, int]] = {}
    due_next: dict[Bracket, set[int]] = {}
    for b, (key, places) in enumerate(due.items()):
        i, lo, hi = key
        below, at, held, top = (told.get(f"{name}{b}") or 0 for name in ("below", "at", "in", "top"))
        for p in places:
            rest = p - below
            if rest < 0:  # a sketch was further off than it should be
                due_next.setdefault((i, None, lo), set()).add(p)
            elif rest < at:
                found[i, p] = lo
            elif rest < at + held:
                (few if held <= FEW else wide).setdefault(key, {})[p] = rest - at
            elif rest < at + held + top:
                found[i, p] = hi
            else:
                due_next.setdefault((i, hi, None), set()).add(p)
    spark = slim.sparkSession
    if few:
        order = list(few)
        wanted = spark.createDataFrame([(b, list(few[x]), list(few[x].values())) for b, x in enumerate(order)], "b int, places array<long>, rests array<int>")
        sorted_values = _values(slim, order).groupBy("b").agg(F.array_sort(F.collect_list("v")).alias("a"))
        for r in sorted_values.join(F.broadcast(wanted), "b").select("b", "places", F.transform("rests", lambda k: F.get("a", k)).alias("values")).collect():
            found.update({(order[r["b"]][0], p): v for p, v in zip(r["places"], r["values"], strict=True)})
    if wide:
        order = list(wide)
        grid = F.array(*[F.lit(k / GRID) for k in range(GRID + 1)])
        for r in _values(slim, order).groupBy("b").agg(F.count("*").alias("n"), F.percentile_approx("v", grid, SKETCH).alias("g")).collect():
            i, lo, hi = order[r["b"]]
            for p, rest in wide[order[r["b"]]].items():
                k = int(rest / r["n"] * GRID)
                due_next.setdefault((i, r["g"][k - 1] if k > 0 else lo, r["g"][k + 2] if k + 2 <= GRID else hi), set()).add(p)
    return due_next
