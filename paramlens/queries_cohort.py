"""Halves, cohorts, groups and ablation on the driver's tables, each with the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tails
from .operators import clusters, cohort, first_half, gates, interactions, members, rounds
from .plans.cells import Target
from .queries import _FIT, _LONG, _SWEEP, DIMS, PRICE, _baskets, _detected, _key, _table, query, rounded, sweep

HALVES = {"y": ("y1", "y2")}


def halved(spark, d) -> DataFrame:
    """The sweep with its price on two halves, each of which some rows lack."""
    first = F.when(F.col("l_suppkey") % 10 != 0, F.col("y") * (1 + F.col("l_tax")))
    second = F.when(F.col("l_partkey") % 10 != 0, F.col("y") * (1 - F.col("l_tax")))
    return sweep(spark, d).withColumns({"y1": first, "y2": second})


_HALVED = _SWEEP.replace("SELECT *, (y >", "SELECT *, CASE WHEN l_suppkey % 10 <> 0 THEN y * (1 + l_tax) END AS y1, CASE WHEN l_partkey % 10 <> 0 THEN y * (1 - l_tax) END AS y2, (y >")
_LONG3 = _LONG.replace("y, hit FROM", "y, y1, y2 FROM")


def _strength(y: str) -> str:
    """Tables ``cells_<y>`` and ``flags_<y>`` (dim, q)."""
    return f"""base_{y} AS (SELECT avg({y}) AS m FROM sweep),
cells_{y} AS (SELECT dim, level, count({y}) AS n, avg({y}) AS mean, var_pop({y}) * count({y}) AS w, any_value(m) AS m FROM long, base_{y} WHERE level IS NOT NULL GROUP BY dim, level),
sums_{y} AS (SELECT dim, sum(n) AS N, count(*) AS k, sum(w) AS w, sum(n * mean) / sum(n) AS g FROM cells_{y} WHERE n > 0 GROUP BY dim),
tests_{y} AS (SELECT dim, k - 1 AS d1, N - k AS d2, (b / (k - 1)) / (w / (N - k)) AS F FROM sums_{y} JOIN (SELECT c.dim, sum(c.n * (mean - g) * (mean - g)) AS b FROM cells_{y} c JOIN sums_{y} s ON c.dim = s.dim GROUP BY c.dim) USING (dim)),
p_{y} AS (SELECT dim, {tails.f_tail('F', 'd1', 'd2')} AS p FROM tests_{y}), flags_{y} AS ({tails.with_q(f'p_{y}', 'dim')})"""


_SHOWS = "CASE WHEN twice THEN 'twice' WHEN first AND second THEN 'unlike' WHEN first THEN 'first' WHEN second THEN 'second' WHEN whole THEN 'whole' END AS shows"


@query(f"""{_HALVED}, long AS ({_LONG3}), {', '.join(_strength(y) for y in ('y', 'y1', 'y2'))},
paired AS (SELECT a.dim, least(a.n, b.n) AS w, a.mean - a.m AS x, b.mean - b.m AS z FROM cells_y1 a JOIN cells_y2 b ON a.dim = b.dim AND a.level = b.level WHERE a.n >= 30 AND b.n >= 30),
agree AS (SELECT dim, CASE WHEN count(*) >= 2 THEN sum(w * x * z) / sqrt(sum(w * x * x) * sum(w * z * z)) END AS agree FROM paired GROUP BY dim),
j AS (SELECT f.dim, f.q < 0.05 AS whole, a.q < 0.05 AS first, b.q < 0.05 AS second, agree FROM flags_y f JOIN flags_y1 a USING (dim) JOIN flags_y2 b USING (dim) LEFT JOIN agree USING (dim)),
t AS (SELECT *, whole AND first AND second AND coalesce(agree > 0, FALSE) AS twice FROM j) SELECT dim, whole, first, second, round(agree, 6) AS agree, twice AS detectable, {_SHOWS} FROM t""")
def board_twice(spark, d):
    return rounded(first_half.board_twice(halved(spark, d), PRICE, HALVES, DIMS))


@query(f"""{_HALVED} SELECT l_returnflag, count(y1) AS y, CAST(0 AS BIGINT) AS l_quantity, round(avg(y1), 4) AS mean FROM sweep GROUP BY 1""")
def first_half_targets(spark, d):
    """Targets as the first half has them; the quantity isn't measured on halves, so it is missing."""
    rows = first_half.first_half(halved(spark, d), ["y", "l_quantity"], HALVES)
    return rows.groupBy("l_returnflag").agg(F.count("y").alias("y"), F.count("l_quantity").alias("l_quantity"), F.round(F.avg("y"), 4).alias("mean"))


_POOL = [gates.Gate("y", ">", 20000), gates.Gate("l_quantity", ">=", 10)]


@query(f"""{_HALVED} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM sweep WHERE l_returnflag = 'N' AND y1 > 20000 AND l_quantity >= 10""")
def pool_rows(spark, d):
    rows = cohort.pool(halved(spark, d), [("l_returnflag", ["N"])], _POOL, HALVES, "l_orderkey")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("""WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'F' AND o_totalprice IS NOT NULL)
SELECT * FROM r WHERE (place <= 25 AND o_orderkey % 7 <> 0) OR place BETWEEN 40 AND 42""")
def cohort_members(spark, d):
    """The best 25 by a value of which less is better, without some of them and with three others."""
    rows = _table(spark, d, "orders").where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")
    placed = cohort.ranked(rows, "o_totalprice", "o_orderkey", -1)
    near = [(r.o_orderkey, r.place) for r in placed.where("place <= 42").collect()]
    return cohort.members(placed, 25, "o_orderkey", [k for k, at in near if at <= 25 and k % 7 == 0], [k for k, at in near if at >= 40])


_ARCH = "CASE p_size % 4 WHEN 0 THEN 'LightGBM large' WHEN 1 THEN 'ridge_regressor' WHEN 2 THEN 'rules' ELSE 'unknown_architecture' END"


@query(f"""SELECT {_ARCH} AS architecture, CASE p_size % 4 WHEN 0 THEN 'probability_weighted' WHEN 1 THEN 'probability_weighted' ELSE 'majority_vote' END AS aggregation, CASE WHEN p_size % 4 = 1 THEN 0.0 ELSE 0.5 END AS cut,
 p_size % 3 = 0 OR (p_size % 5 = 0) AS lines, count(*) AS n FROM part GROUP BY ALL""")
def cohort_architectures(spark, d):
    s = F.col("p_size")
    name = F.when(s % 4 == 0, " LightGBM large").when(s % 4 == 1, "ridge_regressor").when(s % 4 == 2, "rules")
    key = F.when(s % 4 == 0, "model_name").otherwise("architecture")
    groups = F.when(s % 3 == 0, "trend|lines").otherwise("trend")
    params = F.map_concat(F.create_map(F.lit("feature_groups"), groups, F.lit("use_quantiles"), (s % 5 == 0).cast("string")), F.create_map(key, F.coalesce(name, F.lit(" "))))
    listed = [{"func": "features.price_lines", "params": {"group": "lines"}}, {"func": "features.quantile_price_lines", "include_if": "use_quantiles"}, {"func": "features.returns"}]
    rows = _table(spark, d, "part").select(params.alias("params")).select(cohort.architecture(F.col("params")).alias("architecture"), cohort.uses_lines(F.col("params"), listed).alias("lines"))
    rows = rows.select("architecture", cohort.aggregation(F.col("architecture")).alias("aggregation"), cohort.vote_threshold(F.col("architecture")).alias("cut"), "lines")
    return rows.groupBy("architecture", "aggregation", "cut", "lines").agg(F.count("*").alias("n"))


def _executions(spark, d) -> DataFrame:
    """What each order's lines recorded: over all lines, and over the odd and the even ones."""
    li = _table(spark, d, "lineitem").select(rounds.round_key(F.col("l_orderkey")).alias("key"), "l_linenumber", "l_extendedprice", "l_tax")
    part = F.explode(F.array(F.lit("whole"), F.when(F.col("l_linenumber") % 2 == 1, "first").otherwise("second")))
    return li.withColumn("part", part).groupBy("key", "part").agg(F.sum("l_extendedprice").alias("pnl"), F.avg("l_tax").alias("market"))


_EXECUTED = """WITH e AS (SELECT l_orderkey AS k, sum(l_extendedprice) AS w, sum(l_extendedprice) FILTER (l_linenumber % 2 = 1) AS a, sum(l_extendedprice) FILTER (l_linenumber % 2 = 0) AS b, avg(l_tax) FILTER (l_linenumber % 2 = 1) AS ma, avg(l_tax) FILTER (l_linenumber % 2 = 0) AS mb FROM lineitem GROUP BY 1)"""


@query(_EXECUTED + """ SELECT o_orderkey, round(w, 2) AS whole_pnl, round(a, 2) AS first_pnl, round(b, 2) AS second_pnl FROM orders LEFT JOIN e ON k = o_orderkey""")
def rows_with_executions(spark, d):
    rows = _table(spark, d, "orders").withColumn("key", rounds.round_key(F.col("o_orderkey")))
    return rounded(rounds.with_executions(rows, _executions(spark, d), "key", ["pnl"]).select("o_orderkey", "whole_pnl", "first_pnl", "second_pnl"), 2)


@query("""WITH r AS (SELECT l_orderkey AS k, count(*) AS n, any_value(l_partkey) AS part FROM lineitem WHERE l_quantity > 40 GROUP BY 1)
SELECT o_orderkey, CASE WHEN n = 1 THEN part END AS part, CASE WHEN n IS NULL THEN 'no round of this id' WHEN n > 1 THEN 'several rounds of this id' END AS problem FROM orders LEFT JOIN r ON k = o_orderkey""")
def recorded_rounds(spark, d):
    told = _table(spark, d, "lineitem").where(F.col("l_quantity") > 40).select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    out = rounds.recorded(_table(spark, d, "orders").select("o_orderkey"), told, ["o_orderkey"])
    return out.select("o_orderkey", F.col("round.l_partkey").alias("part"), "problem")


@query(_EXECUTED + """ SELECT 'first' AS part, count(ma) AS n, list_sort(list(ma) FILTER (ma IS NOT NULL))[count(ma) // 2 + 1] AS median FROM e UNION ALL SELECT 'second', count(mb), list_sort(list(mb) FILTER (mb IS NOT NULL))[count(mb) // 2 + 1] FROM e""")
def market_halves(spark, d):
    return rounded(rounds.market_halves(_executions(spark, d)), 8)


@query(_EXECUTED + """ SELECT 'whole' AS part, count(*) AS members, round(avg(w), 4) AS pnl FROM e UNION ALL SELECT 'first', count(a), round(avg(a), 4) FROM e UNION ALL SELECT 'second', count(b), round(avg(b), 4) FROM e""")
def member_means(spark, d):
    return rounded(rounds.mean_of_members(_executions(spark, d), "part", ["pnl"]), 4)


_INSIDE = "l_quantity > 40"


def _mw(c: str) -> str:
    return f"""(SELECT '{c}' AS outcome, 'Mann-Whitney' AS test, na AS n_in, nb AS n_out, va AS value_in, vb AS value_out, u / (na * nb) AS shift, CASE WHEN sd = 0 THEN 1.0 ELSE {tails.z_tail('(greatest(0, abs(u - na * nb / 2.0) - 0.5) / sd)')} END AS p FROM
 (SELECT *, ra - na * (na + 1) / 2.0 AS u, sqrt(na * nb / 12.0 * ((na + nb + 1) - ties / ((na + nb) * (na + nb - 1.0)))) AS sd FROM (SELECT count(*) FILTER (g) AS na, count(*) FILTER (NOT g) AS nb, sum(r) FILTER (g) AS ra, avg(v) FILTER (g) AS va, avg(v) FILTER (NOT g) AS vb,
 (SELECT sum(c::DOUBLE * c * c - c) FROM (SELECT count(*) AS c FROM sweep WHERE {c} IS NOT NULL GROUP BY {c})) AS ties FROM (SELECT {c} AS v, {_INSIDE} AS g, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r FROM sweep WHERE {c} IS NOT NULL))))"""


_GTEST = f"""(SELECT 'hit' AS outcome, 'G' AS test, n_in, n_out, ri AS value_in, ro AS value_out, NULL::DOUBLE AS shift, {tails.chi2_tail('g', '1')} AS p FROM (SELECT n_in, n_out, ri, ro, 2 * (n_in * (ri * ln(ri / r) + (1 - ri) * ln((1 - ri) / (1 - r))) + n_out * (ro * ln(ro / r) + (1 - ro) * ln((1 - ro) / (1 - r)))) AS g
 FROM (SELECT count(hit) FILTER ({_INSIDE}) AS n_in, count(hit) FILTER (NOT {_INSIDE}) AS n_out, avg(hit) FILTER ({_INSIDE}) AS ri, avg(hit) FILTER (NOT {_INSIDE}) AS ro, avg(hit) AS r FROM sweep)))"""


@query(f"""{_SWEEP}, t AS (SELECT * FROM {_mw('l_discount')} UNION ALL SELECT * FROM {_mw('l_tax')} UNION ALL SELECT * REPLACE (NULL AS p) FROM {_mw('y')} UNION ALL SELECT * FROM {_GTEST})
{_detected(tails.with_q('t', 'outcome, test, n_in, n_out, round(value_in, 6) AS value_in, round(value_out, 6) AS value_out, round(shift, 6) AS shift'))}""")
def outcome_tests(spark, d):
    """Outcomes of large quantities against the rest; the price counts as drawn from, so it isn't tested."""
    targets = [Target("l_discount"), Target("l_tax"), PRICE, Target("hit", binary=True)]
    return rounded(clusters.outcome_tests(sweep(spark, d), targets, F.col("l_quantity") > 40, ["y"]))


@query(f"""{_SWEEP}, long AS ({_LONG.replace('y, hit FROM', f'({_INSIDE})::INT AS i FROM')}), c AS (SELECT dim, level, count(*) AS n, sum(i) AS k FROM long WHERE level IS NOT NULL GROUP BY ALL), a AS (SELECT dim, sum(n) AS nn, sum(k) AS kk, count(*) - 1 AS df FROM c GROUP BY dim),
g AS (SELECT dim, CAST(any_value(nn) AS BIGINT) AS n, CAST(any_value(kk) AS BIGINT) AS n_in, any_value(df) AS df, 2 * sum(CASE WHEN k = 0 THEN 0 ELSE k * ln(k / n / (kk / nn)) END + CASE WHEN k = n THEN 0 ELSE (n - k) * ln((1 - k / n) / (1 - kk / nn)) END) AS G FROM c JOIN a USING (dim) GROUP BY dim),
u AS (SELECT *, least(1.0, sqrt(G / n)) AS V, {tails.chi2_tail('G', 'df')} AS p FROM g) {_detected(tails.with_q('u', 'dim, n, n_in, round(G, 5) AS G, df, round(V, 7) AS V'))}""")
def apart(spark, d):
    """What sets rows of large quantities apart."""
    out = clusters.apart(sweep(spark, d), DIMS, F.col("l_quantity") > 40)
    return out.select("dim", "n", "n_in", F.round("G", 5).alias("G"), "df", F.round("V", 7).alias("V"), F.round("p", 6).alias("p"), F.round("q", 6).alias("q"), "detectable")


_OUTCOMES = ["l_quantity", "l_extendedprice", "l_tax"]
_SCALED = " UNION ALL ".join(
    f"SELECT l_returnflag AS g, {i} AS i, '{c}' AS outcome, {c} AS v, (rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 - 0.5) / count(*) OVER () AS r FROM lineitem" for i, c in enumerate(_OUTCOMES)
)


@query(f"""WITH s AS ({_SCALED}), m AS (SELECT g, i, outcome, count(*) AS n, count(r) / count(*) AS seen, list_sort(list(v))[count(v) // 2 + 1] AS median, avg(r) AS rank FROM s GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY abs(rank - 0.5) DESC, i) AS place FROM m)
SELECT g AS l_returnflag, outcome, n, round(seen, 6) AS share_seen, round(median, 6) AS median, round(rank, 8) AS rank, place <= 2 AS stands_out, rank > 0.5 AS high FROM o""")
def group_profiles(spark, d):
    out = clusters.profile(_table(spark, d, "lineitem"), "l_returnflag", _OUTCOMES)
    return out.withColumns({"share_seen": F.round("share_seen", 6), "median": F.round("median", 6), "rank": F.round("rank", 8)})


_MOVED = _FIT.replace("SELECT *, (y > 40000)", "SELECT * EXCLUDE (y), y + CASE WHEN l_returnflag = 'N' AND l_linenumber <= 2 THEN 8000 ELSE 0 END AS y, (y > 40000)")
_ACTS = [("l_returnflag", "l_linenumber"), ("l_discount", "l_linenumber")]


@query(f"""{_MOVED}, {tails.additive_fit(_ACTS, _key)}, {tails.interaction_tests(2, 0)}, m AS ({tails.with_q('tests', 'd')}), top AS (SELECT d, p, q FROM m WHERE q < 0.05 ORDER BY p, d LIMIT 1),
one AS (SELECT d, l0, sum(n) AS N, count(*) AS k, sum(w) AS w, sum(n * y) / sum(n) AS g FROM cells GROUP BY d, l0 HAVING sum(n) >= 60),
two AS (SELECT c.d, c.l0, any_value(one.k) - 1 AS d1, any_value(one.N - one.k) AS d2, sum(c.n * (c.y - g) * (c.y - g)) AS b, any_value(one.w) AS w FROM cells c JOIN one ON c.d = one.d AND c.l0 = one.l0 GROUP BY c.d, c.l0),
three AS (SELECT *, (b / d1) / (w / d2) AS F, (b - d1 * w / d2) / (b + w + w / d2) AS omega2 FROM two), u AS (SELECT *, {tails.f_tail('F', 'd1', 'd2')} AS p FROM three), inside AS ({tails.with_q('u', 'd, l0, d1, d2, b, w, omega2')}),
s AS (SELECT i.d, any_value(top.p) AS p, any_value(top.q) AS q, coalesce(list_sort(list(l0) FILTER (i.q < 0.05)), []) AS on_, coalesce(list_sort(list(l0) FILTER (i.q >= 0.05)), []) AS off_, arg_max(l0, omega2) FILTER (i.q < 0.05) AS strongest,
 (sum(b) FILTER (i.q >= 0.05) / sum(d1) FILTER (i.q >= 0.05)) / (sum(w) FILTER (i.q >= 0.05) / sum(d2) FILTER (i.q >= 0.05)) AS pf, sum(d1) FILTER (i.q >= 0.05) AS p1, sum(d2) FILTER (i.q >= 0.05) AS p2 FROM inside i JOIN top ON i.d = top.d GROUP BY i.d),
r AS (SELECT *, CASE WHEN pf IS NOT NULL THEN {tails.f_tail('pf', 'p1', 'p2')} END AS pooled FROM s)
SELECT 'l_linenumber' AS dim, string_split(d, '|')[1] AS parent, p, q, CASE WHEN len(on_) = 0 THEN 'unresolved' WHEN len(off_) > 0 AND pooled > 0.05 THEN 'only' ELSE 'modulated' END AS kind, array_to_string(on_, '|') AS "on", array_to_string(off_, '|') AS off, round(pooled, 6) AS pooled_p, strongest FROM r""")
def acts(spark, d):
    """Where the line number acts on a price that was raised for some lines of one flag."""
    y = F.col("y") + F.when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") <= 2), 8000).otherwise(0)
    out = interactions.acts(sweep(spark, d).withColumn("y", y), PRICE, "l_linenumber", ["l_returnflag", "l_discount"])
    return rounded(out.withColumns({"on": F.array_join("on", "|"), "off": F.array_join("off", "|")}))


@query("""SELECT o_orderkey, o_orderstatus = 'F' AS g_pass, CAST(o_orderpriority[1:1] AS DOUBLE) AS g_value, CAST(o_orderpriority[1:1] AS DOUBLE) - 3 AS g_margin, o_totalprice > 1000 AS r_pass, round(o_totalprice / nullif(o_custkey, 0) + 1e-9, 6) AS r_value, round(500 - o_totalprice / nullif(o_custkey, 0) + 1e-9, 6) AS r_margin FROM orders""")
def recorded_gates(spark, d):
    """One gate whose value stands in a text, and one that is a ratio."""
    o = _table(spark, d, "orders")
    out = gates.read_gate(o, "g", F.col("o_orderstatus") == "F", F.col("o_orderpriority"), F.lit(3), ">=", r"^(\d+)")
    out = gates.read_gate(out, "r", F.col("o_totalprice") > 1000, F.col("o_totalprice"), F.lit(500), "<=", against=F.col("o_custkey"))
    return rounded(out.select("o_orderkey", "g_pass", "g_value", "g_margin", "r_pass", *[(F.col(c) + 1e-9).alias(c) for c in ("r_value", "r_margin")]))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, unnest(['roc_' || l_linenumber, 'vol_' || l_linenumber || '_' || l_linestatus, 'same_3', 'gap']) AS raw, CAST(l_linenumber AS VARCHAR) AS p FROM lineitem WHERE l_quantity > 45)
SELECT member, count(*) AS drops, count(DISTINCT raw) AS names FROM (SELECT DISTINCT l_orderkey, raw, CASE WHEN raw LIKE 'roc%' THEN 'roc_{l_linenumber}' WHEN raw LIKE 'vol%' THEN 'vol_{l_linenumber}_' || split_part(raw, '_', 3) ELSE raw END AS member FROM r) GROUP BY 1""")
def dropped_members(spark, d):
    """Columns named after a parameter's value are one member; one that has a value by chance keeps its name."""
    name = F.col("l_linenumber").cast("string")
    dropped = F.array(F.concat(F.lit("roc_"), name), F.concat_ws("_", F.lit("vol"), name, "l_linestatus"), F.lit("same_3"), F.lit("gap"))
    rows = _table(spark, d, "lineitem").where(F.col("l_quantity") > 45).withColumn("dropped", dropped)
    out = members.canonical_members(rows, "dropped", ["l_linenumber"], "l_orderkey")
    return out.groupBy("member").agg(F.count("*").alias("drops"), F.count_distinct("raw").alias("names"))


def _inclusion(name: str, test: str) -> str:
    """Tables ``<name>`` (member, delta, z, p) over orders that meet a test."""
    return f"""{name}_b AS (SELECT o_orderkey, o_totalprice AS y, list_sort(list_distinct(list(l_returnflag))) AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE {test} GROUP BY ALL),
{name}_c AS (SELECT m AS member, len(s) AS size, count(*) FILTER (list_contains(s, m)) AS ni, count(*) FILTER (NOT list_contains(s, m)) AS no, avg(y) FILTER (list_contains(s, m)) - avg(y) FILTER (NOT list_contains(s, m)) AS dd,
 var_samp(y) FILTER (list_contains(s, m)) AS vi, var_samp(y) FILTER (NOT list_contains(s, m)) AS vo FROM {name}_b, (SELECT unnest(['A', 'N', 'R']) AS m) GROUP BY ALL),
{name}_d AS (SELECT member, ni * no / (ni + no) AS w, dd, vi / ni + vo / no AS v FROM {name}_c WHERE ni >= 2 AND no >= 2),
{name}_e AS (SELECT member, sum(w * dd) / sum(w) AS delta, sqrt(sum(w * w * v)) / sum(w) AS se FROM {name}_d GROUP BY member),
{name} AS (SELECT member, delta, se, delta / se AS z, {tails.z_tail('(delta / se)')} AS p FROM {name}_e)"""


_HALF_TESTS = {"whole_": "TRUE", "first_": "o_orderkey % 2 = 0", "second_": "o_orderkey % 2 = 1"}


@query(f"""WITH {_inclusion('whole_', 'TRUE')} {_detected(tails.with_q('whole_', 'member, round(delta, 4) AS delta, round(se, 4) AS se, round(z, 6) AS z'))}""")
def member_tests(spark, d):
    out = members.member_effects(_baskets(spark, d), "set", ["A", "N", "R"], Target("o_totalprice"))
    return out.select("member", *[F.round(c, n).alias(c) for c, n in (("delta", 4), ("se", 4), ("z", 6), ("p", 6), ("q", 6))], "detectable")


@query(f"""WITH {', '.join(_inclusion(n, t) for n, t in _HALF_TESTS.items())}, {', '.join(f"{n}q AS ({tails.with_q(n, 'member, delta')})" for n in _HALF_TESTS)},
j AS (SELECT w.member, w.delta, w.q < 0.05 AS whole, a.q < 0.05 AS first, b.q < 0.05 AS second, CASE WHEN sign(a.delta) = sign(w.delta) AND sign(b.delta) = sign(w.delta) THEN 1 ELSE -1 END AS agree FROM whole_q w JOIN first_q a USING (member) JOIN second_q b USING (member)),
t AS (SELECT *, whole AND first AND second AND agree > 0 AS twice FROM j) SELECT member, round(delta, 4) AS delta, whole, first, second, agree, twice AS detectable, {_SHOWS} FROM t""")
def members_twice(spark, d):
    sets, even = _baskets(spark, d), F.col("o_orderkey") % 2 == 0
    parts = [members.member_effects(rows, "set", ["A", "N", "R"], Target("o_totalprice")) for rows in (sets, sets.where(even), sets.where(~even))]
    return rounded(first_half.differences_twice(*parts, ["member"]), 4)


@query(f"""WITH {_inclusion('whole_', 'TRUE')}, q AS ({tails.with_q('whole_', 'member, z')}) SELECT 'set' AS column, count(*) AS members, bool_or(q < 0.05) AS detectable, arg_max(member, abs(z)) FILTER (q < 0.05) AS best FROM q""")
def member_sets(spark, d):
    return members.set_groups(members.member_effects(_baskets(spark, d), "set", ["A", "N", "R"], Target("o_totalprice")), "set")


@query("""WITH v AS (SELECT l_extendedprice AS v, l_quantity > 40 AS g FROM lineitem WHERE l_extendedprice IS NOT NULL), e AS (SELECT list_sort(list(v)) AS s, count(*) AS n FROM v), b AS (SELECT s[least(CAST(floor(0.01 * n) AS BIGINT), n - 1) + 1] AS lo, s[least(CAST(floor(0.99 * n) AS BIGINT), n - 1) + 1] AS hi FROM e)
SELECT CASE WHEN v BETWEEN lo AND hi THEN CAST(least(floor((v - lo) * 24 / (hi - lo)), 23) AS BIGINT) END AS bin, count(*) FILTER (g) AS n_in, count(*) FILTER (NOT g) AS n_out FROM v, b GROUP BY 1""")
def compared_distribution(spark, d):
    from .operators.trials import compared

    return compared(_table(spark, d, "lineitem"), "l_extendedprice", F.col("l_quantity") > 40).select(F.col("bin").cast("long").alias("bin"), "n_in", "n_out")


@query("""SELECT name, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS place FROM (SELECT o_custkey, o_orderkey, 'run ' || o_custkey || ' of ' || o_orderkey AS name FROM orders) ORDER BY 2 LIMIT 100""")
def natural_order(spark, d):
    """Texts with numbers in them, in the order of the numbers."""
    from .operators.trials import natural, top

    rows = _table(spark, d, "orders").select(F.concat_ws(" ", F.lit("run"), "o_custkey", F.lit("of"), "o_orderkey").alias("name"))
    first = top(rows.withColumn("key", natural("name")), [("key", -1)], "name", 100)
    return first.select("name", F.row_number().over(W.orderBy("key")).alias("place"))  # a hundred rows


@query(f"""{_SWEEP}, m AS (SELECT {_key('l_discount')} AS level, avg(y) AS mean FROM sweep GROUP BY 1 HAVING count(y) >= 30), r AS (SELECT *, row_number() OVER (ORDER BY mean, level) AS i, count(*) OVER () AS c FROM m) SELECT level FROM r WHERE i <= 2 OR i > c - 2""")
def extreme_levels(spark, d):
    from .operators.effects import extremes

    return spark.createDataFrame([(x,) for x in extremes(sweep(spark, d), PRICE, "l_discount")], "level string")


@query("""SELECT o_orderstatus AS run, count(*) AS rows, count(DISTINCT o_orderpriority) AS shards, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1""")
def run_catalog(spark, d):
    from .operators.runs import catalog

    rows = _table(spark, d, "orders").select(F.col("o_orderstatus").alias("run"), F.col("o_orderpriority").alias("shard"), "o_orderkey")
    return catalog(rows, "run", "o_orderkey")
