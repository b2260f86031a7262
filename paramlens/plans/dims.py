"""Schema inference: what each column of a sweep is, and its levels.

Roles follow from one aggregation over all columns: constants are fixed, texts with many values
are texts, whole numbers that never repeat are ids, other numbers with many values are metrics,
and what is left are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cells import key_of
from .ranges import order_statistics

#: Most levels of a parameter by kind; a number with more is binned or a metric.
TEXT_LEVELS, JSON_LEVELS, NUMBER_LEVELS, BINS = 64, 32, 32, 10
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def survey(sweep: DataFrame) -> DataFrame:
    """(column, kind, rows, present, levels, whole), one row a column.

    A first pass estimates how many values each column has. Columns that may be within the limits, or
    unique, are counted exactly in a second one; of others only that they have many values matters.
    """
    kinds, values = {}, {}
    for c, t in sweep.dtypes:
        number = t in _NUMBERS or t.startswith("decimal")
        kinds[c] = "num" if number else "bool" if t == "boolean" else "set" if t == "array<string>" else "str" if t == "string" else "json"
        values[c] = F.col(f"`{c}`") if kinds[c] not in ("json", "set") else F.when(F.col(f"`{c}`").isNotNull(), F.to_json(F.struct(f"`{c}`")))
    names = list(kinds)
    if not names:
        raise ValueError("a sweep without columns")
    sums = [F.count("*").alias("rows")]
    for i, c in enumerate(names):
        whole = F.bool_and(values[c] == F.floor(values[c])) if kinds[c] == "num" else F.lit(None).cast("boolean")
        sums += [F.count(values[c]).alias(f"n{i}"), F.approx_count_distinct(values[c], 0.02).alias(f"d{i}"), whole.alias(f"w{i}")]
    first = sweep.agg(*sums).first()
    close = [i for i, _ in enumerate(names) if first[f"d{i}"] <= 4 * TEXT_LEVELS or (first[f"w{i}"] and first[f"d{i}"] >= 0.9 * first[f"n{i}"])]
    exact = sweep.agg(*[F.count_distinct(values[names[i]]).alias(f"d{i}") for i in close]).first() if close else {}
    rows = [(c, kinds[c], first["rows"], first[f"n{i}"], exact[f"d{i}"] if i in close else first[f"d{i}"], first[f"w{i}"]) for i, c in enumerate(names)]
    return sweep.sparkSession.createDataFrame(rows, "column string, kind string, rows long, present long, levels long, whole boolean")


def roles(sweep: DataFrame, declared: dict[str, str] | None = None) -> DataFrame:
    """Adds ``role``; declared roles go before inferred ones, but a constant parameter is fixed."""
    out = survey(sweep)
    levels = F.col("levels") + (F.col("present") < F.col("rows")).cast("int")
    unique = F.coalesce("whole", F.lit(False)) & (F.col("levels") == F.col("present")) & (F.col("present") > 50)
    role = (
        F.when(levels <= 1, "fixed").when(F.col("kind") == "set", "param")
        .when(F.col("kind").isin("str", "bool"), F.when(levels <= TEXT_LEVELS, "param").otherwise("text"))
        .when(F.col("kind") == "json", F.when(levels <= JSON_LEVELS, "param").otherwise("text"))
        .when(levels <= NUMBER_LEVELS, "param").when(unique, "id").otherwise("metric")
    )
    for c, r in (declared or {}).items():
        role = F.when((F.col("column") == c) & ~((levels <= 1) & F.lit(r in ("param", "effective"))), r).otherwise(role)
    return out.withColumn("role", role)


def levels_of(sweep: DataFrame, column: str) -> DataFrame:
    """(code, key, n): levels in order, numbers as numbers; null is a level of its own, code 0 and key ``null``."""
    kind = dict(sweep.dtypes)[column]
    counts = sweep.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    code = F.row_number().over(W.orderBy(F.asc_nulls_first("v"))) - 1
    return counts.select(code.alias("code"), F.coalesce(key_of("v", kind), F.lit("null")).alias("key"), "n")


#: Levels that are sent to all tasks, at most; dictionaries beyond that are joined by a shuffle.
LOOKUP = 10_000


def coded(sweep: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the code of each row's level, as ``levels_of`` numbers them. Counts the levels at once."""
    table = sweep.select(F.col(column).alias("_v")).distinct()
    codes = table.select("_v", (F.row_number().over(W.orderBy(F.asc_nulls_first("_v"))) - 1).alias(name))
    few = table.limit(LOOKUP + 1).count() <= LOOKUP
    return sweep.join(F.broadcast(codes) if few else codes, F.col(column).eqNullSafe(F.col("_v")), "left").drop("_v")


def bin_edges(sweep: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """One row: the inner edges of bins of about equal counts, ``sorted[floor(b n / bins)]``, each once.

    Positions are found between the bounds that a sketch gives; runs small jobs at once.
    """
    marks = tuple(b / bins for b in range(1, bins))
    whole = {f: b for b, f in enumerate(marks, 1)}
    n, found = order_statistics(sweep, {"v": F.col(column)}, marks, lambda f, n: [whole[f] * n // bins])["v"]
    lo = sweep.agg(F.min(F.col(column).cast("double")).alias("lo")).first().lo
    edges = sorted({x[0] for x in found if x} - {lo})
    return sweep.sparkSession.createDataFrame([(edges,)], "edges array<double>")


def binned(sweep: DataFrame, column: str, name: str, bins: int = BINS) -> DataFrame:
    """Adds the bin of a number: how many edges are at most its value; null stays null."""
    edges = bin_edges(sweep, column, bins)
    at = F.when(F.col(column).isNotNull(), F.size(F.filter("edges", lambda e: e <= F.col(column))))
    return sweep.crossJoin(F.broadcast(edges)).withColumn(name, at).drop("edges")  # one row


def scoped(sweep: DataFrame, column: str, scope: str, level: str, name: str) -> DataFrame:
    """Adds a dimension that applies inside one level of another only."""
    kinds = dict(sweep.dtypes)
    return sweep.withColumn(name, F.when(key_of(scope, kinds[scope]) == level, F.col(column)))


def scopes(sweep: DataFrame, column: str, scope: str) -> DataFrame:
    """Levels of the scope inside which the column takes two values or more."""
    kinds = dict(sweep.dtypes)
    rows = sweep.select(key_of(scope, kinds[scope]).alias("level"), F.coalesce(key_of(column, kinds[column]), F.lit("null")).alias("v"))
    return rows.distinct().groupBy("level").agg(F.count("*").alias("values")).where(F.col("values") >= 2)


def is_alias(sweep: DataFrame, a: str, b: str, least: int = 30) -> DataFrame:
    """One row: whether levels of a and b map one to one, over enough rows and at least two levels."""
    pairs = sweep.where(F.col(a).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    one = pairs.agg(F.sum("n").alias("n"), F.count("*").alias("pairs"), F.count_distinct("a").alias("na"), F.count_distinct("b").alias("nb"), F.sum(F.when(F.col("b").isNull(), F.col("n")).otherwise(0)).alias("missing"))
    alias = (F.col("n") >= least) & (F.col("na") >= 2) & (F.col("pairs") == F.col("na")) & (F.col("na") == F.col("nb")) & (F.col("missing") == 0)
    return one.select("n", F.coalesce(alias, F.lit(False)).alias("alias"))


def derived(columns: list[str], value: Column) -> Column:
    """A derived target; null where any of its inputs is."""
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    return F.when(known, value)
