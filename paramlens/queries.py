"""The analyses applied to the driver's tables, each with the SQL it is checked against.

``lineitem`` stands in for a sweep: flags, line number, discount and tax are parameters, the
discounted price is the outcome. ``orders`` and ``events`` stand in where order of arrival counts.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tails
from .operators import ablation as ablations
from .operators import bars, clusters, effects, gates, halves, interactions, members, pockets, runs, trials
from .plans import cells, dims
from .plans.cells import Target
from .sources import rows as sources

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

DIMS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax"]
PRICE, HIT = Target("y"), Target("hit", binary=True)


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sweep(spark: SparkSession, d: str) -> DataFrame:
    """Trials with five dimensions, one that applies to flag N only, a price with missing values, and whether it is high."""
    li = _table(spark, d, "lineitem")
    price = F.when(~((F.col("l_linenumber") == 7) & (F.col("l_tax") > 0.06)), F.col("l_extendedprice") * (1 - F.col("l_discount")))
    li = li.withColumn("y", price).withColumn("hit", (F.col("y") > 40000).cast("double"))
    return li.withColumn("status_n", F.when(F.col("l_returnflag") == "N", F.col("l_linestatus")))


_SWEEP = """
WITH sweep AS (
  SELECT *, (y > 40000)::INT::DOUBLE AS hit, CASE WHEN l_returnflag = 'N' THEN l_linestatus END AS status_n
  FROM (SELECT *, CASE WHEN NOT (l_linenumber = 7 AND l_tax > 0.06) THEN l_extendedprice * (1 - l_discount) END AS y FROM lineitem)
)"""


def _key(c: str) -> str:
    if c in ("l_discount", "l_tax"):
        return f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"
    return f"CAST({c} AS VARCHAR)"


_LONG = "\n UNION ALL ".join(f"SELECT '{c}' AS dim, {_key(c)} AS level, y, hit FROM sweep" for c in DIMS)
_CELLS = f"""{_SWEEP}, base AS (SELECT avg(y) AS m, avg(hit) AS mh FROM sweep), long AS ({_LONG}),
cells AS (SELECT dim, level, count(y) AS n, sum(y - m) AS s, sum((y - m) * (y - m)) AS ss, avg(y) AS mean, any_value(m) AS m, sum(hit) AS k, avg(hit) AS rate, any_value(mh) AS mh
  FROM long, base WHERE level IS NOT NULL GROUP BY dim, level)"""


@query(f"""{_SWEEP} SELECT count(y) AS n, count(*) - count(y) AS missing, round(avg(y), 4) AS mean, round(stddev_samp(y), 4) AS sd FROM sweep""")
def summary(spark, d):
    return rounded(effects.summary(sweep(spark, d), PRICE).select("n", "missing", "mean", "sd"), 4)


@query(f"""{_SWEEP}, a AS (SELECT count(hit) AS n, sum(hit) AS k, avg(hit) AS p, 1.959963984540054 AS z FROM sweep)
SELECT n, CAST(k AS BIGINT) AS hits, round(p, 6) AS mean,
 round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS lo,
 round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS hi FROM a""")
def summary_rate(spark, d):
    return rounded(effects.summary(sweep(spark, d), HIT).select("n", "hits", "mean", "lo", "hi"))


@query(f"""{_CELLS} SELECT dim, level, n, round(mean, 4) AS mean, round(sqrt((ss - s * s / n) / (n - 1)), 4) AS sd, round(mean - m, 4) AS lift, n < 30 AS withheld FROM cells""")
def board_levels(spark, d):
    return rounded(effects.levels(sweep(spark, d), PRICE, DIMS).select("dim", "level", "n", "mean", "sd", "lift", "withheld"), 4)


_ANOVA = """SELECT {by}, sum(n) AS N, count(*) AS k, sum(s) AS S, sum(ss) AS SS, sum(s * s / n) AS B FROM cells WHERE n > 0 GROUP BY {by}"""


@query(f"""{_CELLS}, a AS ({_ANOVA.format(by='dim')}), v AS (SELECT *, SS - S * S / N AS sst, B - S * S / N AS ssb FROM a)
SELECT dim, CAST(N AS BIGINT) AS N, k, round((ssb / (k - 1)) / ((sst - ssb) / (N - k)), 6) AS F,
 round((ssb - (k - 1) * (sst - ssb) / (N - k)) / (sst + (sst - ssb) / (N - k)), 8) AS omega2, round(ssb / sst, 8) AS eta2 FROM v""")
def board_anova(spark, d):
    out = effects.effects(cells.level_cells(sweep(spark, d), PRICE, DIMS), PRICE, "dim")
    return out.select("dim", "N", "k", F.round("F", 6).alias("F"), F.round("omega2", 8).alias("omega2"), F.round("eta2", 8).alias("eta2"))


@query(f"""{_CELLS}, t AS (SELECT dim, sum(n) AS nn, sum(k) AS kk, count(*) AS g FROM cells GROUP BY dim)
SELECT c.dim, round(2 * sum(CASE WHEN k = 0 THEN 0 ELSE k * ln(k / n / (kk / nn)) END + CASE WHEN k = n THEN 0 ELSE (n - k) * ln((1 - k / n) / (1 - kk / nn)) END), 5) AS G, any_value(g) - 1 AS df
FROM cells c JOIN t ON c.dim = t.dim GROUP BY c.dim""")
def board_g(spark, d):
    out = effects.effects(cells.level_cells(sweep(spark, d), HIT, DIMS), HIT, "dim")
    return out.select("dim", F.round("G", 5).alias("G"), F.col("dfG").alias("df"))


_ALL = [*DIMS, "status_n"]
_SIX = f"""{_SWEEP.replace('WITH ', 'WITH RECURSIVE ', 1)}, base AS (SELECT avg(y) AS m, avg(hit) AS mh FROM sweep), long AS ({_LONG} UNION ALL SELECT 'status_n', status_n, y, hit FROM sweep),
cells AS (SELECT dim, level, count(y) AS n, sum(y - m) AS s, sum((y - m) * (y - m)) AS ss, sum((hit - mh) * (hit - mh)) AS sh, avg(y) AS mean, any_value(m) AS m, sum(hit) AS k, avg(hit) AS rate, any_value(mh) AS mh FROM long, base WHERE level IS NOT NULL GROUP BY dim, level)"""


def _board(mean: str, s: str, ss: str, rest: str = "") -> str:
    def end(way: str) -> str:
        return f"(list(level ORDER BY {mean} {way}, level {way}) FILTER (n >= 30))[1]"

    return f"""a AS (SELECT dim, CAST(sum(n) AS BIGINT) AS N, count(*) AS k, sum({s}) AS S, sum({ss}) AS SS, sum({s} * {s} / n) AS B, {end('DESC')} AS best, {end('ASC')} AS worst, max({mean}) FILTER (n >= 30) - min({mean}) FILTER (n >= 30) AS spread{rest} FROM cells WHERE n > 0 GROUP BY dim),
v AS (SELECT *, SS - S * S / N AS sst, B - S * S / N AS ssb, k - 1 AS df1, N - k AS df2 FROM a),
t AS (SELECT *, (ssb / df1) / ((sst - ssb) / df2) AS F, (ssb - df1 * (sst - ssb) / df2) / (sst + (sst - ssb) / df2) AS omega2, ssb / sst AS eta2 FROM v)"""


_STRENGTH = "dim, N, k, best, worst, round(spread, 6) AS spread, round(F, 6) AS F, df1, df2, round(omega2, 8) AS omega2, round(eta2, 8) AS eta2"


def _board_row(out: DataFrame, *more: str) -> DataFrame:
    r = lambda c, n: F.round(c, n).alias(c)
    return out.select("dim", "N", "k", "best", "worst", r("spread", 6), r("F", 6), "df1", "df2", r("omega2", 8), r("eta2", 8), *[r(c, 5) if c == "G" else c for c in more], r("p", 6), r("q", 6), "detectable")


def _detected(sql: str) -> str:
    return f"SELECT *, coalesce(q < 0.05, FALSE) AS detectable FROM ({sql})"


@query(f"""{_SIX}, {_board('mean', 's', 'ss')}, u AS (SELECT *, {tails.f_tail('F', 'df1', 'df2')} AS p FROM t) {_detected(tails.with_q('u', _STRENGTH))}""")
def board(spark, d):
    """Flagship: all dimensions by strength, with p and q."""
    return _board_row(effects.board(sweep(spark, d), PRICE, _ALL))


_HITS = ", sum(k) AS kk, sum(CASE WHEN k = 0 THEN 0 ELSE k * ln(rate) END + CASE WHEN k = n THEN 0 ELSE (n - k) * ln(1 - rate) END) AS own"


@query(f"""{_SIX}, {_board('rate', '(k - n * mh)', 'sh', _HITS)}, g AS (SELECT *, 2 * (own - kk * ln(kk / N) - (N - kk) * ln(1 - kk / N)) AS G, df1 AS dfG FROM t),
u AS (SELECT *, {tails.chi2_tail('G', 'dfG')} AS p FROM g) {_detected(tails.with_q('u', _STRENGTH + ', round(G, 5) AS G, dfG'))}""")
def board_binary(spark, d):
    return _board_row(effects.board(sweep(spark, d), HIT, _ALL), "G", "dfG")


@query("""WITH p AS (SELECT p_partkey AS id, (p_retailprice - floor(p_retailprice)) * p_size / 50 AS p FROM part),
r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS r, count(*) OVER () AS m FROM p)
SELECT id, round(least(1.0, min(p * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 8) AS q FROM r""")
def bh_q(spark, d):
    from .functions.intervals import with_q

    p = (F.col("p_retailprice") - F.floor("p_retailprice")) * F.col("p_size") / 50
    tests = _table(spark, d, "part").select(F.col("p_partkey").alias("id"), p.alias("p"))
    return with_q(tests).select("id", F.round("q", 8).alias("q"))


_PAIRS = [("l_returnflag", "l_linestatus"), ("l_returnflag", "l_discount"), ("l_linestatus", "l_discount")]


@query(f"""{_SWEEP} {' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, {_key(a)} AS la, {_key(b)} AS lb, count(y) AS n, round(avg(y), 4) AS mean FROM sweep WHERE y IS NOT NULL GROUP BY ALL" for a, b in _PAIRS)}""")
def pair_cells(spark, d):
    out = cells.set_cells(sweep(spark, d), PRICE, ["l_returnflag", "l_linestatus", "l_discount"], 2)
    e = F.element_at
    return out.select(e("dims", 1).alias("a"), e("dims", 2).alias("b"), e("levels", 1).alias("la"), e("levels", 2).alias("lb"), "n", F.round(F.col("total") / F.col("n"), 4).alias("mean"))


_TEST = "N, cells, min_cell, round(F, 6) AS F, df, dfW, round(omega2, 8) AS omega2, sparse"
_FIT = _SWEEP.replace("WITH ", "WITH RECURSIVE ", 1)
_SETS = {k: list(combinations(DIMS, k)) for k in (2, 3)}
_MODERATED = sorted({tuple(sorted((a, b))) for a in DIMS for b in DIMS[:2] if a != b})


def _tested(out: DataFrame, *more: tuple[str, str]) -> DataFrame:
    r = lambda c, n: F.round(c, n).alias(c)
    own = [F.array_join("dims", "|").alias("dims"), "N", "cells", "min_cell", r("F", 6), F.col("df").cast("long").alias("df"), F.col("dfW").cast("long").alias("dfW"), r("omega2", 8), "sparse"]
    return out.select(*own, *[F.round(c, 5).alias(name) for c, name in more], r("p", 6), r("q", 6), "detectable")


@query(f"""{_FIT}, {tails.additive_fit(_SETS[2], _key)}, {tails.interaction_tests(2, 0)} {_detected(tails.with_q('tests', 'd AS dims, ' + _TEST))}""")
def pairs(spark, d):
    """Interactions of all pairs, fitted on cells."""
    return _tested(interactions.interactions(sweep(spark, d), PRICE, DIMS))


_RATE = _FIT.replace("SELECT *, (y > 40000)::INT::DOUBLE AS hit", "SELECT * EXCLUDE (y), (y > 40000)::INT::DOUBLE AS hit, (y > 40000)::INT::DOUBLE AS y")


@query(f"""{_RATE}, {tails.additive_fit(_SETS[2], _key)}, {tails.interaction_tests(2, 0)}, {tails.logistic_fit()},
dev AS (SELECT d, 2 * sum(CASE WHEN k = 0 THEN 0 ELSE k * ln(k / h) END + CASE WHEN k = n THEN 0 ELSE (n - k) * ln((n - k) / miss) END) AS dv FROM logistic GROUP BY d),
u AS (SELECT * EXCLUDE (p), CASE WHEN df > 0 THEN {tails.chi2_tail('greatest(dv, 0)', 'df')} END AS p FROM tests JOIN dev USING (d)) {_detected(tails.with_q('u', 'd AS dims, ' + _TEST + ', round(dv, 5) AS deviance'))}""")
def pairs_binary(spark, d):
    return _tested(interactions.interactions(sweep(spark, d), HIT, DIMS), ("D", "deviance"))


@query(f"""{_FIT}, {tails.additive_fit(_SETS[3], _key)}, {tails.interaction_tests(3, interactions.MIN_CELL)} {_detected(tails.with_q('tests', 'd AS dims, ' + _TEST))}""")
def combos(spark, d):
    """Interactions of all sets of three."""
    return _tested(interactions.interactions(sweep(spark, d), PRICE, DIMS, 3))


_DEVIANCE = """dev AS (SELECT d, 2 * sum(CASE WHEN k = 0 THEN 0 ELSE k * ln(k / h) END + CASE WHEN k = n THEN 0 ELSE (n - k) * ln((n - k) / miss) END) AS dv FROM logistic GROUP BY d)"""
_COARSE = ["l_returnflag", "l_linestatus", "early"]


def coarse(spark, d) -> DataFrame:
    return sweep(spark, d).withColumn("early", (F.col("l_linenumber") <= 3).cast("int"))


@query(f"""{_RATE.replace("SELECT * EXCLUDE (y)", "SELECT * EXCLUDE (y), (l_linenumber <= 3)::INT AS early")}, {tails.additive_fit([tuple(_COARSE)], _key)}, {tails.interaction_tests(3, interactions.MIN_CELL)}, {tails.logistic_fit(size=3)}, {_DEVIANCE},
u AS (SELECT * EXCLUDE (p), CASE WHEN df > 0 THEN {tails.chi2_tail('greatest(dv, 0)', 'df')} END AS p FROM tests JOIN dev USING (d)) {_detected(tails.with_q('u', 'd AS dims, ' + _TEST + ', round(dv, 5) AS deviance'))}""")
def combos_binary(spark, d):
    """A rate's interaction of three dimensions, by proportional fitting."""
    return _tested(interactions.interactions(coarse(spark, d), HIT, _COARSE, 3), ("D", "deviance"))


@query(f"""{_FIT}, {tails.additive_fit([("l_returnflag", "l_discount")], _key)} SELECT l0 AS a, l1 AS b, CAST(n AS BIGINT) AS n, round(f.y, 4) AS mean, round(fit, 4) AS fitted, n < 30 AS withheld FROM fitted f""")
def pair_table(spark, d):
    """The cells of a pair with the values of an additive fit."""
    out = interactions.pair_table(sweep(spark, d), PRICE, "l_returnflag", "l_discount")
    return out.select("a", "b", "n", F.round("mean", 4).alias("mean"), F.round("fitted", 4).alias("fitted"), "withheld")


@query(f"""{_RATE}, {tails.additive_fit([("l_returnflag", "l_linenumber")], _key)}, {tails.logistic_fit()} SELECT l0 AS a, l1 AS b, CAST(n AS BIGINT) AS n, round(k / n, 6) AS mean, round(h / n, 6) AS fitted FROM logistic""")
def pair_table_binary(spark, d):
    out = interactions.pair_table(sweep(spark, d), HIT, "l_returnflag", "l_linenumber")
    return out.select("a", "b", "n", F.round("mean", 6).alias("mean"), F.round("fitted", 6).alias("fitted"))


@query(f"""{_FIT}, {tails.additive_fit(_MODERATED, _key)}, {tails.interaction_tests(2, 0)} {_detected(tails.with_q('tests', 'd AS dims, ' + _TEST))}""")
def moderator_scan(spark, d):
    return _tested(interactions.moderators(sweep(spark, d), PRICE, DIMS, DIMS[:2]))


@query(f"""{_SWEEP} SELECT l_returnflag AS a, l_linestatus AS b, CAST(l_linenumber AS VARCHAR) AS c, count(*) AS n, round(avg(y), 4) AS mean FROM sweep WHERE y IS NOT NULL GROUP BY ALL""")
def kway_cells(spark, d):
    out = cells.set_cells(sweep(spark, d), PRICE, DIMS[:3], 3)
    return out.select(*[F.element_at("levels", i + 1).alias(c) for i, c in enumerate("abc")], "n", F.round(F.col("total") / F.col("n"), 4).alias("mean"))


def _v(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS a, '{b}' AS b, CAST(any_value(nn) AS BIGINT) AS N, round(sum((coalesce(o, 0) - ra * cb / nn) ** 2 / (ra * cb / nn)), 5) AS chi2, (count(DISTINCT la) - 1) * (count(DISTINCT lb) - 1) AS df,
 round(sqrt(sum((coalesce(o, 0) - ra * cb / nn) ** 2 / (ra * cb / nn)) / (any_value(nn) * (least(count(DISTINCT la), count(DISTINCT lb)) - 1))), 7) AS V
FROM (SELECT {_key(a)} AS la, count(*)::DOUBLE AS ra FROM lineitem GROUP BY 1), (SELECT {_key(b)} AS lb, count(*)::DOUBLE AS cb FROM lineitem GROUP BY 1), (SELECT count(*)::DOUBLE AS nn FROM lineitem)
LEFT JOIN (SELECT {_key(a)} AS xa, {_key(b)} AS xb, count(*)::DOUBLE AS o FROM lineitem GROUP BY ALL) ON la = xa AND lb = xb"""


@query(f"""SELECT *, coalesce(p < 1e-6 AND V > 0.03, FALSE) AS linked FROM (SELECT *, round({tails.chi2_tail('chi2', 'df')}, 6) AS p FROM ({' UNION ALL '.join(_v(a, b) for a, b in _PAIRS)}))""")
def independence(spark, d):
    out = interactions.association(sweep(spark, d), ["l_returnflag", "l_linestatus", "l_discount"])
    return out.select("a", "b", F.col("N").cast("long").alias("N"), F.round("chi2", 5).alias("chi2"), "df", F.round("V", 7).alias("V"), F.round("p", 6).alias("p"), "linked")


@query(f"""{_SWEEP}, base AS (SELECT avg(y) AS m FROM sweep), cells AS (SELECT l_returnflag AS level, l_linenumber AS l2, count(y) AS n, sum(y - m) AS s, sum((y - m) * (y - m)) AS ss FROM sweep, base WHERE y IS NOT NULL GROUP BY ALL),
a AS ({_ANOVA.format(by='level')}), v AS (SELECT *, SS - S * S / N AS sst, B - S * S / N AS ssb FROM a),
t AS (SELECT level, CAST(N AS BIGINT) AS rows, k - 1 AS d1, N - k AS d2, (ssb / (k - 1)) / ((sst - ssb) / (N - k)) AS F FROM v WHERE N >= 60), u AS (SELECT *, {tails.f_tail('F', 'd1', 'd2')} AS p FROM t) {tails.with_q('u', "'l_returnflag' AS parent, level, rows, round(F, 6) AS F")}""")
def acts_where(spark, d):
    out = effects.acts_where(sweep(spark, d), PRICE, "l_linenumber", ["l_returnflag"])
    return out.select("parent", "level", F.col("N").alias("rows"), F.round("F", 6).alias("F"), F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))


@query(f"""SELECT *, p < 1e-6 AS uneven FROM (SELECT N, k, round(chi2, 6) AS chi2, round({tails.chi2_tail('chi2', '(k - 1)')}, 6) AS p FROM (SELECT CAST(sum(n) AS BIGINT) AS N, count(*) AS k, sum(n * n) * count(*) / sum(n) - sum(n) AS chi2 FROM (SELECT event_type, count(*)::DOUBLE AS n FROM events GROUP BY 1)))""")
def uniformity(spark, d):
    out = interactions.uniformity(_table(spark, d, "events"), "event_type")
    return out.select("N", "k", F.round("chi2", 6).alias("chi2"), F.round("p", 6).alias("p"), "uneven")


POCKET = [("o_orderstatus", ["F", "O"]), ("o_orderpriority", ["1-URGENT", "2-HIGH"])]
_IN = "(o_orderstatus IN ('F', 'O') AND o_orderpriority IN ('1-URGENT', '2-HIGH'))"
TOTAL = Target("o_totalprice")


@query(f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS c FROM orders)
SELECT count(*) AS rows, count(*) FILTER ({_IN}) AS pocket_rows, round(count(*) FILTER ({_IN}) / count(*), 8) AS share, round(avg(o_totalprice) FILTER ({_IN}), 4) AS mean,
 round(avg(o_totalprice) FILTER ({_IN}) - avg(o_totalprice), 4) AS lift, count(*) FILTER ({_IN} AND i < c // 2) AS n_first, round(avg(o_totalprice) FILTER ({_IN} AND i >= c // 2), 4) AS mean_second FROM o""")
def pocket_stats(spark, d):
    out = pockets.stats(_table(spark, d, "orders"), POCKET, TOTAL, "o_orderkey")
    r = lambda c, n: F.round(c, n).alias(c)
    return out.select("rows", "pocket_rows", r("share", 8), r("mean", 4), r("lift", 4), "n_first", r("mean_second", 4))


def _block(name: str, rest: str, own: str) -> str:
    return f"""SELECT '{name}' AS dim, count(*) FILTER ({rest}) AS n_without, round(avg(o_totalprice) FILTER ({rest}), 4) AS mean_without, count(*) FILTER ({rest} AND NOT {own}) AS n_removed,
 round((avg(o_totalprice) FILTER ({_IN}) - avg(o_totalprice) FILTER ({rest} AND NOT {own})) / sqrt(var_samp(o_totalprice) FILTER ({_IN}) / count(*) FILTER ({_IN}) + var_samp(o_totalprice) FILTER ({rest} AND NOT {own}) / count(*) FILTER ({rest} AND NOT {own})), 6) AS z FROM orders"""


_A, _B = "o_orderstatus IN ('F', 'O')", "o_orderpriority IN ('1-URGENT', '2-HIGH')"


@query(_block("o_orderstatus", _B, f"({_A})") + " UNION ALL " + _block("o_orderpriority", _A, f"({_B})"))
def block_tests(spark, d):
    out = pockets.block_tests(_table(spark, d, "orders"), POCKET, TOTAL)
    return out.select("dim", "n_without", F.round("mean_without", 4).alias("mean_without"), "n_removed", F.round("z", 6).alias("z"))


def _verdict(name: str, rest: str, own: str) -> str:
    pocket, removed = _IN, f"{rest} AND NOT {own}"
    return f"""SELECT '{name}' AS dim, count(*) FILTER ({pocket}) AS n, avg(o_totalprice) FILTER ({pocket}) AS mean, count(*) FILTER ({removed}) AS n_removed, avg(o_totalprice) FILTER ({removed}) AS mean_removed,
 (avg(o_totalprice) FILTER ({pocket}) - avg(o_totalprice) FILTER ({removed})) / sqrt(var_samp(o_totalprice) FILTER ({pocket}) / count(*) FILTER ({pocket}) + var_samp(o_totalprice) FILTER ({removed}) / count(*) FILTER ({removed})) AS z FROM orders"""


@query(f"""WITH t AS ({_verdict("o_orderstatus", _B, f"({_A})")} UNION ALL {_verdict("o_orderpriority", _A, f"({_B})")}), u AS (SELECT *, {tails.z_tail('z')} AS p FROM t),
w AS ({tails.with_q('u', 'dim, n, n_removed, mean, mean_removed')}) SELECT dim, n_removed, p, q, CASE WHEN n < 30 OR n_removed < 30 THEN 'few' WHEN NOT q < 0.05 THEN 'narrows' WHEN mean > mean_removed THEN 'earns' ELSE 'hurts' END AS verdict FROM w""")
def block_verdicts(spark, d):
    """What each condition of a pocket is worth."""
    out = pockets.block_tests(_table(spark, d, "orders"), POCKET, TOTAL)
    return out.select("dim", "n_removed", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"), "verdict")


@query(f"""{_SWEEP}, s AS (SELECT *, CASE WHEN y IS NOT NULL THEN (y > 60000 AND l_discount < 0.03)::INT END AS rare FROM sweep), b AS (SELECT avg(rare) AS m FROM s),
l AS (SELECT 'l_discount' AS dim, {_key('l_discount')} AS level, count(rare) AS n, sum(rare) AS k FROM s GROUP BY 2 UNION ALL SELECT 'l_linenumber', {_key('l_linenumber')}, count(rare), sum(rare) FROM s GROUP BY 2),
w AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM l)
SELECT dim, level, n, CAST(k AS BIGINT) AS hits, n >= 30 AND m > 0 AND (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n) < m / 5 AS dead FROM w, b""")
def dead_levels(spark, d):
    """Levels in which a rare outcome all but never comes."""
    rare = F.when(F.col("y").isNotNull(), ((F.col("y") > 60000) & (F.col("l_discount") < 0.03)).cast("double"))
    return effects.levels(sweep(spark, d).withColumn("rare", rare), Target("rare", binary=True), ["l_discount", "l_linenumber"]).select("dim", "level", "n", "hits", "dead")


@query(f"""SELECT 0 AS step, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders UNION ALL SELECT 1, count(*), round(avg(o_totalprice), 4) FROM orders WHERE {_A}
UNION ALL SELECT 2, count(*), round(avg(o_totalprice), 4) FROM orders WHERE {_IN}""")
def pocket_steps(spark, d):
    return rounded(pockets.steps(_table(spark, d, "orders"), POCKET, TOTAL).select("step", "n", "mean"), 4)


@query(f"""{_CELLS}, w AS (SELECT *, 1.959963984540054 AS z FROM cells WHERE n >= 30), b AS (SELECT dim, level, n, rate, (rate + z * z / (2 * n) - z * sqrt(rate * (1 - rate) / n + z * z / (4 * n * n))) / (1 + z * z / n) AS bound FROM w)
SELECT dim, level, n, round(rate, 6) AS mean, round(bound, 6) AS bound FROM b ORDER BY b.bound DESC, dim, level LIMIT 10""")
def suggestions(spark, d):
    return rounded(pockets.suggest(sweep(spark, d), [], HIT, DIMS))


@query(f"""SELECT * FROM orders WHERE {_IN}""")
def pocket_rows(spark, d):
    return pockets.rows_in(_table(spark, d, "orders"), POCKET)


@query("""SELECT o_orderkey, o_totalprice FROM orders o WHERE o_orderstatus IN ('F', 'O') AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R')""")
def rows_removed(spark, d):
    rest = pockets.rows_in(_table(spark, d, "orders"), POCKET[:1])
    gone = _table(spark, d, "lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_orderkey").alias("o_orderkey"))
    return pockets.without(rest, gone, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


GATES = [gates.Gate("l_quantity", ">=", 10), gates.Gate("l_extendedprice", "<=", 60000), gates.Gate("y", ">", 20000)]
_PASS = "l_quantity >= 10 AS p0, l_extendedprice <= 60000 AS p1, y > 20000 AS p2"


def _gate(name: str, c: str, test: str) -> str:
    q = "".join(f", list_sort(list(v))[CAST(least(floor({f} * count(*)), count(*) - 1) AS BIGINT) + 1] AS q{int(f * 100):02d}" for f in gates.QUANTILES)
    return f"SELECT '{name}' AS gate, count(*) AS n, CAST(sum(ok::INT) AS BIGINT) AS passes, max(v) AS max{q} FROM (SELECT {c} AS v, {test} AS ok FROM sweep) WHERE ok IS NOT NULL"


@query(f"""{_SWEEP} {' UNION ALL '.join([_gate('l_quantity>=10', 'l_quantity', 'l_quantity >= 10'), _gate('l_extendedprice<=60000', 'l_extendedprice', 'l_extendedprice <= 60000'), _gate('y>20000', 'y', 'y > 20000')])}""")
def gate_stats(spark, d):
    out = gates.stats(sweep(spark, d), GATES)
    return out.select("gate", "n", "passes", "max", "q05", "q25", "q50", "q75", "q95")


@query(f"""{_SWEEP}, p AS (SELECT {_PASS} FROM sweep), c AS (SELECT p0 AND p1 AND p2 AS a, coalesce(p0::INT, 0) + coalesce(p1::INT, 0) + coalesce(p2::INT, 0) AS k FROM p)
SELECT CAST(sum(coalesce(a::INT, 0)) AS BIGINT) AS all_pass, count(a) AS decided, max(k) AS most, (SELECT count(*) FROM c WHERE k = (SELECT max(k) FROM c)) AS rows_at_most FROM c""")
def gates_together(spark, d):
    return gates.together(sweep(spark, d), GATES)


@query(f"""{_SWEEP}, p AS (SELECT {_PASS} FROM sweep) SELECT concat_ws(' & ', CASE WHEN NOT p0 THEN 'l_quantity>=10' END, CASE WHEN NOT p1 THEN 'l_extendedprice<=60000' END, CASE WHEN NOT p2 THEN 'y>20000' END) AS failing, count(*) AS n
FROM p WHERE p0 IS NOT NULL AND p1 IS NOT NULL AND p2 IS NOT NULL AND p0::INT + p1::INT + p2::INT >= 1 GROUP BY 1""")
def co_failure(spark, d):
    return gates.co_failure(sweep(spark, d), GATES, 1)


@query(f"""{_SWEEP} SELECT 'l_quantity' AS other, count(*) AS n, round(corr(y, l_quantity), 8) AS r FROM sweep WHERE y IS NOT NULL UNION ALL SELECT 'l_extendedprice', count(*), round(corr(y, l_extendedprice), 8) FROM sweep WHERE y IS NOT NULL""")
def correlates(spark, d):
    return gates.correlates(sweep(spark, d), "y", ["l_quantity", "l_extendedprice"]).select("other", "n", F.round("r", 8).alias("r"))


@query("""SELECT '>=' AS op, list_sort(list(o_totalprice))[count(*) // 2 + 1] AS need FROM orders""")
def gate_draft(spark, d):
    return gates.draft(_table(spark, d, "orders"), "o_totalprice", 1)


@query("""SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus ASC NULLS LAST, o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50""")
def top_rows(spark, d):
    return trials.top(_table(spark, d, "orders"), [("o_orderstatus", -1), ("o_totalprice", 1)], "o_orderkey", 50).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("""WITH r AS (SELECT *, rank() OVER (ORDER BY l_discount DESC, l_tax DESC, l_quantity DESC) AS rank, count(*) OVER (PARTITION BY l_discount, l_tax, l_quantity) AS ties FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, rank, ties FROM r WHERE rank + ties - 1 <= 100""")
def trials_ranked(spark, d):
    out = trials.ranked(_table(spark, d, "lineitem"), [("l_discount", 1), ("l_tax", 1), ("l_quantity", 1)], 100)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "rank", "ties")


_LIKE = ["o_orderstatus", "o_orderpriority", "o_custkey"]


@query("""WITH top AS (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20),
c AS (SELECT t.o_orderkey, 1 AS depth, count(*) AS n, avg(o.o_totalprice) AS mean, stddev_samp(o.o_totalprice) AS sd FROM top t JOIN orders o USING (o_orderstatus) WHERE o.o_orderkey <> t.o_orderkey GROUP BY 1
 UNION ALL SELECT t.o_orderkey, 2, count(*), avg(o.o_totalprice), stddev_samp(o.o_totalprice) FROM top t JOIN orders o USING (o_orderstatus, o_orderpriority) WHERE o.o_orderkey <> t.o_orderkey GROUP BY 1
 UNION ALL SELECT t.o_orderkey, 3, count(*), avg(o.o_totalprice), stddev_samp(o.o_totalprice) FROM top t JOIN orders o USING (o_orderstatus, o_orderpriority, o_custkey) WHERE o.o_orderkey <> t.o_orderkey GROUP BY 1)
SELECT o_orderkey, depth, n, round(mean, 4) AS mean, round(sd, 4) AS sd FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY depth DESC) AS r FROM c WHERE n >= 30) WHERE r = 1""")
def rows_like(spark, d):
    orders = _table(spark, d, "orders")
    listed = trials.top(orders, [("o_totalprice", 1)], "o_orderkey", 20)
    return trials.like(orders, TOTAL, _LIKE, listed, "o_orderkey").select("o_orderkey", "depth", "n", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"))


@query("""WITH RECURSIVE w AS (SELECT event_id, row_number() OVER o AS place, count(*) OVER () AS c, max(value) OVER o AS best, avg(value) OVER o AS mean, stddev_samp(value) OVER o AS sd, value > coalesce(max(value) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e300) AS record FROM events WINDOW o AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
k AS (SELECT * FROM w WHERE place % greatest(1, c // 400) = 0 OR record OR place = c), n AS (SELECT place, 1 AS e, 1.0 / place AS area FROM k WHERE place > 1 UNION ALL SELECT place, 2, 1.0 / (place * exp(1)) FROM k WHERE place > 1),
""" + tails.quantile("zs", "n", "place, e, area", f"({tails.z_tail('t_')}) / 2", "area", 16.0) + """, l AS (SELECT place, sum(CASE WHEN e = 1 THEN 1 - 0.5772156649015329 ELSE 0.5772156649015329 END * t) AS z FROM zs GROUP BY 1)
SELECT event_id, k.place, best, round(mean + 1e-9, 6) AS mean, round(sd + 1e-9, 5) AS sd, CASE WHEN k.place > 2 THEN round(mean + sd * z + 1e-9, 4) END AS luck, record FROM k LEFT JOIN l ON l.place = k.place""")
def record_curve(spark, d):
    out = trials.record_curve(_table(spark, d, "events"), Target("value"), "event_id")
    return out.select("event_id", F.col("at").cast("long").alias("place"), "best", F.round(F.col("mean") + 1e-9, 6).alias("mean"), F.round(F.col("sd") + 1e-9, 5).alias("sd"), F.when(F.col("at") > 2, F.round(F.col("luck") + 1e-9, 4)).alias("luck"), "record")


_EULER = "0.5772156649015329"


@query(f"""{_FIT}, a AS (SELECT count(y) AS n, avg(y) AS mean, stddev_samp(y) AS sd FROM sweep), two AS (SELECT 1 AS e, 1.0 / n AS area FROM a UNION ALL SELECT 2, 1.0 / (n * exp(1)) FROM a),
{tails.quantile('z', 'two', 'e, area', tails.z_tail('t_') + ' / 2', 'area', 16.0)}, l AS (SELECT *, mean + sd * ((1 - {_EULER}) * (SELECT t FROM z WHERE e = 1) + {_EULER} * (SELECT t FROM z WHERE e = 2)) AS line FROM a)
SELECT n, round(mean, 4) AS mean, round(sd, 4) AS sd, round(line, 4) AS line, (SELECT count(*) FROM sweep, l WHERE y > line) AS beyond FROM l""")
def luck(spark, d):
    return rounded(trials.luck(sweep(spark, d), PRICE), 4)


@query("""WITH p AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem)
SELECT CASE WHEN l_extendedprice BETWEEN lo AND hi THEN least(floor((l_extendedprice - lo) * 30 / (hi - lo)), 29) END AS bin, count(*) AS n FROM lineitem, p GROUP BY 1""")
def distribution(spark, d):
    return trials.distribution(_table(spark, d, "lineitem"), "l_extendedprice")


@query("""SELECT l_discount AS value, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= (SELECT count(*) FROM lineitem) * 0.05 ORDER BY n DESC, value LIMIT 1""")
def heap_value(spark, d):
    return trials.heap(_table(spark, d, "lineitem"), "l_discount", 0.05)


@query("""SELECT o_orderkey, (SELECT count(*) FROM orders WHERE o_totalprice > 400000) AS breaks FROM orders WHERE o_totalprice > 400000 ORDER BY o_orderkey LIMIT 20""")
def invariant_breaks(spark, d):
    return trials.invariant_breaks(_table(spark, d, "orders"), F.col("o_totalprice") > 400000, "o_orderkey").select("o_orderkey", "breaks")


_HALF = """WITH h AS (SELECT o_custkey AS c, avg(o_totalprice) FILTER (o_orderkey % 2 = 0) AS a, avg(o_totalprice) FILTER (o_orderkey % 2 = 1) AS b FROM orders GROUP BY 1), v AS (SELECT * FROM h WHERE a IS NOT NULL AND b IS NOT NULL)"""


def _halves(spark, d):
    even = F.col("o_orderkey") % 2 == 0
    return _table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c")).agg(halves.steady_mean(F.when(even, F.col("o_totalprice"))).alias("a"), halves.steady_mean(F.when(~even, F.col("o_totalprice"))).alias("b"))


@query(_HALF + """, r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM v)
SELECT n, round(rho, 8) AS rho, round(tanh(atanh(rho) - 1.959963984540054 * sqrt(1.06 / (n - 3))), 8) AS lo, round(tanh(atanh(rho) + 1.959963984540054 * sqrt(1.06 / (n - 3))), 8) AS hi FROM (SELECT count(*) AS n, corr(ra, rb) AS rho FROM r)""")
def rank_agreement(spark, d):
    return rounded(halves.rank_agreement(_halves(spark, d), "a", "b"), 8)


@query(_HALF + """, r AS (SELECT *, row_number() OVER (ORDER BY a DESC, c) AS p, count(*) OVER () AS n FROM v), t AS (SELECT any_value(n) AS n, count(*) FILTER (p <= greatest(30, ceil(n / 10))) AS top,
 avg(a) FILTER (p <= greatest(30, ceil(n / 10))) - avg(a) AS f, avg(b) FILTER (p <= greatest(30, ceil(n / 10))) - avg(b) AS s FROM r)
SELECT n, top, round(f, 4) AS lead_first, round(s, 4) AS lead_second, round(s / f, 6) AS kept FROM t""")
def kept_lead(spark, d):
    return halves.kept_lead(_halves(spark, d), "a", "b", "c").select("n", "top", F.round("lead_first", 4).alias("lead_first"), F.round("lead_second", 4).alias("lead_second"), F.round("kept", 6).alias("kept"))


@query(_HALF + """, r AS (SELECT *, row_number() OVER (ORDER BY a DESC, c) - 1 AS p, count(*) OVER () AS n FROM v)
SELECT t AS tenth, count(*) AS n, round(avg(a), 4) AS first, round(avg(b), 4) AS second FROM r, range(10) AS x(t) WHERE p >= t * n // 10 AND p < (t + 1) * n // 10 GROUP BY 1""")
def persistence(spark, d):
    out = halves.persistence(_halves(spark, d), "a", "b", "c")
    return out.select(F.col("tenth").cast("long").alias("tenth"), "n", F.round("first", 4).alias("first"), F.round("second", 4).alias("second"))


@query(_HALF + """ SELECT c, rank() OVER (ORDER BY a DESC) AS rank_first FROM h WHERE a IS NOT NULL""")
def first_half_ranks(spark, d):
    return halves.first_half_ranks(_halves(spark, d), "a").where("a is not null").select("c", "rank_first")


@query("""WITH r AS (SELECT event_type = 'click' AS g, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS r FROM events), a AS (SELECT count(*) FILTER (g) AS na, count(*) FILTER (NOT g) AS nb, sum(r) FILTER (g) AS ra, (SELECT sum(c::DOUBLE * c * c - c) FROM (SELECT count(*) AS c FROM events GROUP BY value)) AS ties FROM r),
u AS (SELECT *, ra - na * (na + 1) / 2 AS u, na * nb / 2 AS mid, sqrt(na * nb / 12 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1.0)))) AS sd FROM a), z AS (SELECT *, sign(u - mid) * greatest(0, abs(u - mid) - 0.5) / sd AS z FROM u)
SELECT na, nb, round(u, 4) AS U, round(u / (na * nb), 8) AS shift, round(z, 6) AS z, round(""" + tails.z_tail("z") + """, 6) AS p FROM z""")
def mann_whitney(spark, d):
    rows = _table(spark, d, "events").withColumn("g", F.col("event_type") == "click")
    out = halves.mann_whitney(rows, "value", "g")
    return out.select("na", "nb", *[F.round(c, n).alias(c) for c, n in (("U", 4), ("shift", 8), ("z", 6), ("p", 6))])


@query("""WITH n AS (SELECT count(*) AS m FROM orders) SELECT o_orderkey, round((rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2 - 0.5) / m, 8) AS share FROM orders, n""")
def rank_scale(spark, d):
    return halves.rank_scale(_table(spark, d, "orders"), "o_totalprice").select("o_orderkey", F.round("share", 8).alias("share"))


def _baskets(spark, d):
    """Per order the set of flags of its lines, and its price."""
    sets = _table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("set"))
    return sets.join(_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("""WITH b AS (SELECT o_orderkey, o_totalprice AS y, list_sort(list_distinct(list(l_returnflag))) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
c AS (SELECT m AS member, len(s) AS size, count(*) FILTER (list_contains(s, m)) AS ni, count(*) FILTER (NOT list_contains(s, m)) AS no, avg(y) FILTER (list_contains(s, m)) - avg(y) FILTER (NOT list_contains(s, m)) AS dd FROM b, (SELECT unnest(['A', 'N', 'R']) AS m) GROUP BY ALL)
SELECT member, CAST(sum(ni) AS BIGINT) AS n_in, CAST(sum(no) AS BIGINT) AS n_out, count(*) AS strata, round(sum(ni * no / (ni + no) * dd) / sum(ni * no / (ni + no)), 4) AS delta FROM c WHERE ni >= 2 AND no >= 2 GROUP BY member""")
def member_effects(spark, d):
    out = members.member_effects(_baskets(spark, d), "set", ["A", "N", "R"], Target("o_totalprice"))
    return out.select("member", "n_in", "n_out", "strata", F.round("delta", 4).alias("delta"))


@query("""WITH b AS (SELECT o_orderkey, o_totalprice AS y, array_to_string(list_sort(list_distinct(list(l_returnflag))), '|') AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
l AS (SELECT s, count(*) AS n, avg(y) AS m, var_samp(y) AS v FROM b GROUP BY s HAVING count(*) >= 2), w AS (SELECT s, n, m, v, string_split(s, '|') AS g FROM l), e AS (SELECT s, n, m, v, g, unnest(g) AS x FROM w),
t AS (SELECT x, e.s AS a, l.s AS b, e.n, l.n AS n2, e.m - l.m AS delta, (e.m - l.m) / sqrt(e.v / e.n + l.v / l.n) AS z FROM e JOIN l ON l.s = array_to_string(list_filter(g, lambda k: k <> x), '|')), u AS (SELECT *, """ + tails.z_tail("z") + """ AS p FROM t)
""" + tails.with_q("u", 'x AS "group", a AS "with", b AS without, n, n2 AS n_without, round(delta, 4) AS delta, round(z, 6) AS z'))
def group_contrasts(spark, d):
    rows = _baskets(spark, d).withColumn("level", F.array_join("set", "|"))
    out = members.group_contrasts(rows, "level", Target("o_totalprice"))
    return out.select("group", "with", "without", "n", "n_without", *[F.round(c, k).alias(c) for c, k in (("delta", 4), ("z", 6), ("p", 6), ("q", 6))])


def _leave_one_in() -> str:
    """Least squares on status and flags with errors that allow for unequal variances: the normal equations by elimination."""
    dot = "list_dot_product"
    return f"""WITH RECURSIVE b AS (SELECT o_totalprice AS y, o_orderstatus AS f, list_distinct(list(l_returnflag)) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_totalprice, o_orderstatus),
x AS (SELECT y - avg(y) OVER () AS y, [1, (f = 'O')::INT, (f = 'P')::INT, list_contains(s, 'A')::INT, list_contains(s, 'N')::INT, list_contains(s, 'R')::INT]::DOUBLE[] AS x FROM b),
cell AS (SELECT i, j, sum(x[i] * x[j]) AS v, sum(x[i] * y) AS t FROM x, range(1, 7) AS u(i), range(1, 7) AS w(j) GROUP BY i, j),
line AS (SELECT i, list(v ORDER BY j) || list(CASE WHEN i = j THEN 1.0 ELSE 0.0 END ORDER BY j) AS r, any_value(t) AS t FROM cell GROUP BY i),
start AS (SELECT list(r ORDER BY i) AS a, list(t ORDER BY i) AS t FROM line),
gone AS (SELECT 0 AS k, a FROM start UNION ALL SELECT k + 1, list_transform(a, lambda r, i: CASE WHEN i = k + 1 THEN list_transform(r, lambda v: v / a[k + 1][k + 1]) ELSE list_transform(r, lambda v, j: v - r[k + 1] * a[k + 1][j] / a[k + 1][k + 1]) END) FROM gone WHERE k < 6),
inv AS (SELECT list_transform(a, lambda r: r[7:12]) AS v FROM gone WHERE k = 6),
beta AS (SELECT v, list_transform(v, lambda r: {dot}(r, t)) AS c FROM inv, start),
w AS (SELECT x, v, c, ((y - {dot}(x, c)) / (1 - {dot}(x, list_transform(v, lambda r: {dot}(r, x))))) ** 2 AS w FROM x, beta),
meat AS (SELECT i, list(m ORDER BY j) AS r FROM (SELECT i, j, sum(w * x[i] * x[j]) AS m FROM w, range(1, 7) AS u(i), range(1, 7) AS q(j) GROUP BY i, j) GROUP BY i),
sandwich AS (SELECT list(r ORDER BY i) AS m FROM meat),
told AS (SELECT ['A', 'N', 'R'][i - 3] AS term, c[i] AS effect, sqrt({dot}(v[i], list_transform(m, lambda r: {dot}(r, v[i])))) AS se FROM beta, sandwich, range(4, 7) AS u(i)),
tested AS (SELECT *, effect / se AS z, {tails.z_tail('effect / se')} AS p FROM told)
{tails.with_q('tested', 'term, round(effect, 4) AS effect, round(se, 4) AS se, round(z, 6) AS z')}"""


@query(_leave_one_in())
def ablation(spark, d):
    rows = _baskets(spark, d).join(_table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    out = ablations.model(rows, Target("o_totalprice"), ["o_orderstatus"], "set").where("member")
    return out.select("term", *[F.round(c, k).alias(c) for c, k in (("effect", 4), ("se", 4), ("z", 6), ("p", 6), ("q", 6))])


@query("""WITH w AS (SELECT event_type AS level, row_number() OVER (ORDER BY event_id) AS place, count(*) OVER () AS c, count(value) OVER p AS n, avg(value) OVER p AS mean FROM events WINDOW p AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT level, place, n, round(mean, 6) AS mean FROM w WHERE place % greatest(1, c // 60) = 0 AND n >= 30""")
def settling(spark, d):
    out = effects.settling(_table(spark, d, "events"), Target("value"), "event_type", "event_id")
    return out.select("level", F.col("at").cast("long").alias("place"), "n", F.round("mean", 6).alias("mean"))


@query("""WITH v AS (SELECT list_sort(list(l_quantity)) AS s, count(*) AS n FROM lineitem), e AS (SELECT DISTINCT s[CAST(floor(b * n / 10) AS BIGINT) + 1] AS e FROM v, range(1, 10) AS r(b)),
k AS (SELECT list(e) AS edges FROM e WHERE e > (SELECT min(l_quantity) FROM lineitem)) SELECT len(list_filter(edges, lambda x: x <= l_quantity)) AS bin, count(*) AS n FROM lineitem, k GROUP BY 1""")
def bin_equal_count(spark, d):
    return dims.binned(_table(spark, d, "lineitem"), "l_quantity", "bin").groupBy(F.col("bin").cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query(f"""{_SWEEP} SELECT row_number() OVER (ORDER BY v NULLS FIRST) - 1 AS code, coalesce(v, 'null') AS key, n FROM (SELECT status_n AS v, count(*) AS n FROM sweep GROUP BY 1)""")
def level_codes(spark, d):
    return dims.levels_of(sweep(spark, d), "status_n").select(F.col("code").cast("long").alias("code"), "key", "n")


@query("""SELECT 'o_orderkey' AS column, 'num' AS kind, count(*) AS rows, count(DISTINCT o_orderkey) AS levels, 'id' AS role FROM orders UNION ALL SELECT 'o_orderstatus', 'str', count(*), count(DISTINCT o_orderstatus), 'param' FROM orders
UNION ALL SELECT 'o_orderpriority', 'str', count(*), count(DISTINCT o_orderpriority), 'param' FROM orders""")
def column_roles(spark, d):
    out = dims.roles(_table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"))
    return out.select("column", "kind", "rows", "levels", "role")


@query("""SELECT l_returnflag AS level, count(DISTINCT l_linestatus) AS "values" FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) >= 2""")
def scope_levels(spark, d):
    return dims.scopes(_table(spark, d, "lineitem"), "l_linestatus", "l_returnflag")


@query("""SELECT count(*) AS n, TRUE AS alias FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey""")
def alias_levels(spark, d):
    rows = _table(spark, d, "customer").join(_table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.join(_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return dims.is_alias(rows, "r_regionkey", "r_name")


@query("""SELECT event_type, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, count(*) AS n FROM events GROUP BY ALL""")
def json_fields(spark, d):
    """The JSON of events, parsed as result lines are."""
    lines = _table(spark, d, "events").select(F.col("event_type").alias("shard"), F.col("event_id").alias("line"), F.col("props").alias("text"))
    parsed = lines.mapInArrow(sources._parsed, sources._ROW)
    return sources.typed(parsed, [("k", "num")]).groupBy(F.col("__shard").alias("event_type"), "k").agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""")
def last_write(spark, d):
    return sources.last_write(_table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


def _bars(spark, d):
    """Events as bars of five members; in the market when the value is high."""
    e, on = _table(spark, d, "events"), F.col("value") > 50
    member = (F.col("user_id") % 5).cast("string")
    gross = F.when(on, (F.col("value") - 60) / 10000).otherwise(0.0)
    return e.select(member.alias("member"), F.col("event_id").alias("at"), on.cast("double").alias("pos"), gross.alias("gross"), (gross - F.when(on, 0.0001).otherwise(0.0)).alias("net"), ((F.col("value") - 50) / 10000).alias("ret"))


_BARS = """WITH b AS (SELECT CAST(user_id % 5 AS VARCHAR) AS member, event_id AS at_, (value > 50)::INT::DOUBLE AS pos, CASE WHEN value > 50 THEN (value - 60) / 10000 ELSE 0 END AS gross, CASE WHEN value > 50 THEN (value - 60) / 10000 - 0.0001 ELSE 0 END AS net, (value - 50) / 10000 AS ret FROM events),
o AS (SELECT *, CASE WHEN pos > 0 AND coalesce(lag(pos) OVER (PARTITION BY member ORDER BY at_), 0) <= 0 THEN 1 ELSE 0 END AS opens FROM b), r AS (SELECT *, sum(opens) OVER (PARTITION BY member ORDER BY at_) AS trade FROM o),
t AS (SELECT member, trade, count(*) AS bars, product(1 + net) - 1 AS ret FROM r WHERE pos > 0 GROUP BY ALL)"""


@query(_BARS + " SELECT member, CAST(trade AS BIGINT) AS trade, bars, round(ret, 9) AS ret FROM t")
def trade_islands(spark, d):
    return bars.trades(_bars(spark, d)).select("member", F.col("trade").cast("long").alias("trade"), "bars", F.round("ret", 9).alias("ret"))


@query(_BARS + """ SELECT b.member, count(*) AS bars, any_value(k) AS trades, round(avg(net) * 10000, 3) AS pnl, round(avg(gross - net) * 10000, 3) AS cost, round(any_value(m) * 10000, 2) AS trade_mean, round((avg(gross) - avg(pos) * avg(ret)) * 10000, 3) AS timing
FROM b JOIN (SELECT member, count(*) AS k, avg(ret) AS m FROM t GROUP BY 1) AS s USING (member) GROUP BY 1""")
def bar_windows(spark, d):
    out = bars.windows(_bars(spark, d))
    return out.select("member", "bars", "trades", F.round("pnl", 3).alias("pnl"), F.round("cost", 3).alias("cost"), F.round("trade_mean", 2).alias("trade_mean"), F.round("timing", 3).alias("timing"))


def _votes(spark, d):
    """Three members and a signal each."""
    e = _table(spark, d, "events").select((F.col("event_id") % 3).cast("string").alias("member"), F.floor(F.col("event_id") / 3).alias("at"), (F.col("value") / 100).alias("prob"), ((F.col("value") - 50) / 10000).alias("ret"))
    return e.withColumn("pred", (F.col("prob") > 0.4).cast("double"))


_VOTES = """WITH e AS (SELECT CAST(event_id % 3 AS VARCHAR) AS member, event_id // 3 AS t, value / 100 AS prob, (value - 50) / 10000 AS ret FROM events), v AS (SELECT *, (prob > 0.4)::INT AS pred FROM e)"""


@query(_VOTES + """ SELECT t AS "time", CASE WHEN avg(pred) > 0.5 THEN 1 ELSE 0 END AS signal, arg_min(ret, member) AS ret FROM v GROUP BY 1 HAVING count(DISTINCT member) = 3""")
def ensemble_votes(spark, d):
    return bars.ensemble(_votes(spark, d), weighted=False).select(F.col("at").alias("time"), "signal", "ret")


def _judged_sql() -> str:
    """Members and cohort long on the bar after a signal, in the market while it lasts, by whole and halves."""
    fee, slip = bars.FEE_BPS / bars.BPS, bars.SLIP_BPS / bars.BPS
    w = "(PARTITION BY member ORDER BY t)"
    return f"""{_VOTES}, s AS (SELECT t FROM v GROUP BY t HAVING count(DISTINCT member) = 3),
m AS (SELECT t, arg_min(ret, member) AS ret, (avg(prob) > 0.5)::INT AS sig FROM v SEMI JOIN s USING (t) GROUP BY t),
g AS (SELECT member, t, pred AS signal FROM v SEMI JOIN s USING (t) UNION ALL SELECT 'cohort', t, sig FROM m),
cuts AS (SELECT min(t) AS a, max(t) AS b FROM (SELECT t, row_number() OVER {w} - 1 AS place, count(*) OVER (PARTITION BY member) AS n FROM v) WHERE place = n // 2),
o AS (SELECT member, t, ret, coalesce(lag(signal) OVER {w}, 0) = 1 AND ret IS NOT NULL AS held FROM g JOIN m USING (t)),
p AS (SELECT *, held AND NOT coalesce(lag(held) OVER {w}, FALSE) AS entry, held AND NOT coalesce(lead(held) OVER {w}, FALSE) AS leaving FROM o),
q AS (SELECT *, sum(entry::INT) OVER {w} AS run FROM p),
h AS (SELECT *, product(1 + ret) OVER (PARTITION BY member, run, held ORDER BY t ROWS UNBOUNDED PRECEDING) / (1 + {slip}) AS grown FROM q),
eq AS (SELECT *, CASE WHEN leaving THEN grown * (1 - {fee}) * (1 - {slip}) - {fee} ELSE grown - {fee} END AS equity FROM h),
n AS (SELECT member, t, held::INT::DOUBLE AS pos, CASE WHEN held THEN ret ELSE 0 END AS gross, CASE WHEN held THEN equity / CASE WHEN entry THEN 1 ELSE lag(equity) OVER (PARTITION BY member, run, held ORDER BY t) END - 1 ELSE 0 END AS net, ret FROM eq),
b AS (SELECT n.*, 'whole' AS part FROM n UNION ALL SELECT n.*, CASE WHEN t < a THEN 'first' ELSE 'second' END FROM n, cuts WHERE t < a OR t >= b),
r AS (SELECT *, sum(opens) OVER (PARTITION BY member, part ORDER BY t) AS trade FROM (SELECT *, CASE WHEN pos > 0 AND coalesce(lag(pos) OVER (PARTITION BY member, part ORDER BY t), 0) <= 0 THEN 1 ELSE 0 END AS opens FROM b)),
tr AS (SELECT member, part, trade, product(1 + net) - 1 AS ret FROM r WHERE pos > 0 GROUP BY ALL),
d AS (SELECT member, part, count(*) AS trades, avg(ret) AS tm, CASE WHEN count(*) >= 30 AND var_samp(ret) > (max(abs(ret)) * 1e-9) ** 2 THEN avg(ret) / sqrt(var_samp(ret) / count(*)) END AS tt FROM tr GROUP BY ALL)
SELECT member, part, count(*) AS bars, coalesce(any_value(trades), 0) AS trades, round(avg(net) * 10000, 3) AS pnl, round(avg(gross - net) * 10000, 3) AS cost, round(avg((net > 0)::INT), 4) AS wins, round(avg(pos), 4) AS inventory,
  round((avg(gross) FILTER (WHERE ret IS NOT NULL) - avg(pos) FILTER (WHERE ret IS NOT NULL) * avg(ret)) * 10000, 3) AS timing, round(product(1 + ret) - 1, 4) AS market, round(any_value(tm) * 10000, 2) AS trade_mean, round(any_value(tt), 3) AS trade_t
FROM b LEFT JOIN d USING (member, part) GROUP BY member, part"""


@query(_judged_sql())
def ensemble_judged(spark, d):
    out = bars.judge(_votes(spark, d), weighted=True)
    digits = {"pnl": 3, "cost": 3, "wins": 4, "inventory": 4, "timing": 3, "market": 4, "trade_mean": 2, "trade_t": 3}
    return out.select("member", "part", "bars", "trades", *[F.round(c, k).alias(c) for c, k in digits.items()])


@query("""SELECT 5.0 AS fee, CAST(o_orderkey % 3 AS DOUBLE) AS slip, count(*) AS n FROM orders GROUP BY ALL ORDER BY n DESC, slip LIMIT 1""")
def modal_costs(spark, d):
    rounds = _table(spark, d, "orders").select(F.lit(None).cast("double").alias("fee_bps"), (F.col("o_orderkey") % 3).cast("double").alias("slip_bps"))
    return bars.costs_of(rounds)


@query("""WITH r AS (SELECT greatest(0, value - 50) AS fired, greatest(0, value - 40) AS reach, value - 50 AS margin FROM events) SELECT count(*) AS rounds, count(*) FILTER (fired = 0) AS never, count(*) FILTER (fired = 0 AND reach > 0) AS within_reach, round(quantile_disc(CASE WHEN fired = 0 THEN -margin END, 0.5), 6) AS shortfall FROM r""")
def held_back(spark, d):
    v = F.col("value")
    rounds = _table(spark, d, "events").select(F.greatest(F.lit(0.0), v - 50).alias("fired"), F.greatest(F.lit(0.0), v - 40).alias("reach"), (v - 50).alias("margin"))
    return bars.held_back(rounds).select("rounds", "never", "within_reach", F.round("shortfall", 6).alias("shortfall"))


@query()
def outcome_groups(spark, d):
    """Trials grouped by like outcomes."""
    return clusters.assign(_table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]).groupBy("cluster").agg(F.count("*").alias("n"))


@query("""SELECT 'l_returnflag' AS dim, l_returnflag AS level, count(*) AS n, count(*) FILTER (l_quantity > 40) AS n_in FROM lineitem GROUP BY ALL UNION ALL SELECT 'l_linestatus', l_linestatus, count(*), count(*) FILTER (l_quantity > 40) FROM lineitem GROUP BY ALL""")
def composition(spark, d):
    return clusters.composition(_table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_quantity") > 40)


@query("""SELECT c_mktsegment, count(*) AS rows, round(avg(c_acctbal), 4) AS mean, max(c_acctbal) AS best_c_acctbal, min(c_custkey) AS best_c_custkey FROM customer GROUP BY 1""")
def run_comparison(spark, d):
    out = runs.compare(_table(spark, d, "customer"), "c_mktsegment", Target("c_acctbal"), [("c_acctbal", 1), ("c_custkey", -1)])
    return out.select("c_mktsegment", "rows", F.round("mean", 4).alias("mean"), "best_c_acctbal", "best_c_custkey")


@query("""WITH v AS (SELECT list_sort(list(l_extendedprice)) AS s, count(*) AS n FROM lineitem), e AS (SELECT least(s[CAST(floor(0.01 * n) AS BIGINT) + 1], 30000) AS lo, greatest(s[CAST(floor(0.99 * n) AS BIGINT) + 1], 30000) AS hi FROM v),
w AS (SELECT *, (hi - lo) / 32 AS w FROM e), g AS (SELECT *, 30000 - ceil((30000 - lo) / w - 1e-9) * w AS start FROM w), b AS (SELECT *, floor((hi - start) / w + 1e-9) + 1 AS nb FROM g)
SELECT CASE WHEN l_extendedprice BETWEEN lo AND hi THEN CAST(least(nb - 1, greatest(0, floor((l_extendedprice - start) / w + 1e-9))) AS BIGINT) END AS bin, count(*) FILTER (l_extendedprice >= 30000) AS pass, count(*) FILTER (l_extendedprice < 30000) AS fail FROM lineitem, b GROUP BY 1""")
def pass_histogram(spark, d):
    out = runs.pass_histogram(_table(spark, d, "lineitem"), gates.Gate("l_extendedprice", ">=", 30000))
    return out.select(F.col("bin").cast("long").alias("bin"), "pass", "fail")


_AUC = """WITH r AS (SELECT greatest(0, value - 50) AS fired, greatest(0, value - 40) AS reach, value - 50 AS margin, 0.45 + (event_id % 20) / 100 AS auc, event_id % 90 AS p, 100 AS n FROM events),
v AS (SELECT *, (auc * (1 - auc) + (p - 1) * (auc / (2 - auc) - auc * auc) + (n - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / nullif(p * n, 0) AS v FROM r), a AS (SELECT *, CASE WHEN p > 0 THEN auc - 0.5 > 1.959963984540054 * sqrt(greatest(v, 0)) END AS above FROM v)"""


@query(_AUC + """ SELECT count(*) AS rounds, count(*) FILTER (fired = 0) AS never, count(*) FILTER (fired = 0 AND above) AS held, count(*) FILTER (fired = 0 AND NOT above) AS nothing, count(*) FILTER (fired = 0 AND above IS NULL) AS unknown, count(*) FILTER (fired = 0 AND reach > 0) AS within_reach FROM a""")
def never_traded(spark, d):
    v, i = F.col("value"), F.col("event_id")
    rounds = _table(spark, d, "events").select(
        F.greatest(F.lit(0.0), v - 50).alias("fired"), F.greatest(F.lit(0.0), v - 40).alias("reach"), (v - 50).alias("margin"), (0.45 + (i % 20) / 100).alias("auc"), (i % 90).alias("positive"), F.lit(100).alias("negative")
    )
    return runs.never_traded(rounds).drop("shortfall")


@query("""SELECT o_custkey AS member, round(count(*) FILTER (p > 0.5) / count(*), 6) AS fired, round(count(*) FILTER (p + 0.05 > 0.5) / count(*), 6) AS reach, round(max(p) - 0.5, 6) AS margin FROM (SELECT o_custkey, o_totalprice / 600000 AS p FROM orders) GROUP BY 1""")
def model_outputs(spark, d):
    rounds = _table(spark, d, "orders").groupBy(F.col("o_custkey").alias("member")).agg(F.collect_list(F.col("o_totalprice") / 600000).alias("probs"))
    rounds = rounds.withColumns({"optimal_threshold": F.lit(0.5), "threshold_rule": F.lit(">")})
    return bars.model_outputs(rounds).select("member", "fired", "reach", "margin")


@query("""SELECT count(*) AS after FROM orders WHERE o_orderkey > 9000""")
def arrived_after(spark, d):
    return runs.arrived_after(_table(spark, d, "orders"), "o_orderkey", 9000)


@query(f"""{_CELLS.replace('WITH ', 'WITH RECURSIVE ', 1)}, c AS (SELECT dim, level, n, mean, mean - m AS lift, sqrt((ss - s * s / n) / (n - 1)) AS sd FROM cells), df AS (SELECT DISTINCT n - 1 AS df FROM c WHERE n >= 30),
{tails.quantile('q', 'df', 'df', tails.f_tail('(t_ * t_)', '1', 'df'), '0.05')}
SELECT dim, level, n, round(CASE WHEN n >= 30 THEN mean END, 4) AS mean, round(mean - t * sd / sqrt(n), 4) AS lo, round(mean + t * sd / sqrt(n), 4) AS hi, round(sd, 4) AS sd, round(CASE WHEN n >= 30 THEN lift END, 4) AS lift, n < 30 AS withheld, FALSE AS dead FROM c LEFT JOIN q ON df = n - 1""")
def portable_board(spark, d):
    return rounded(runs.portable(effects.levels(sweep(spark, d), PRICE, DIMS)).drop("hits"), 4)
