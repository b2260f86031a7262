"""Tails of distributions and fits of cells as SQL text, for checking analyses in a database that has neither.

A tail is the integral of the density by Simpson's rule over ``w``, the square root of the statistic.
"""

from __future__ import annotations

from itertools import combinations

_NODES = 2000


def _integral(log_density: str, start: str) -> str:
    t = f"(i / {_NODES}.0)"
    w = f"(sqrt({start}) + {t} / (1 - {t}))"
    weight = "CASE WHEN i = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    inner = log_density.replace("<w>", w)
    return f"CASE WHEN {start} <= 0 THEN 1.0 ELSE list_sum(list_transform(range(0, {_NODES}), lambda i: ({weight}) * exp({inner}) / pow(1 - {t}, 2))) / {3 * _NODES} END"


def f_tail(f: str, d1: str, d2: str) -> str:
    constant = f"ln(2) + {d1} / 2.0 * ln({d1} / CAST({d2} AS DOUBLE)) + lgamma(({d1} + {d2}) / 2.0) - lgamma({d1} / 2.0) - lgamma({d2} / 2.0)"
    return _integral(f"{constant} + ({d1} - 1) * ln(<w>) - ({d1} + {d2}) / 2.0 * ln(1 + {d1} * <w> * <w> / CAST({d2} AS DOUBLE))", f)


def chi2_tail(x: str, k: str) -> str:
    return _integral(f"ln(2) + ({k} - 1) * ln(<w>) - <w> * <w> / 2 - {k} / 2.0 * ln(2) - lgamma({k} / 2.0)", x)


def z_tail(z: str) -> str:
    """Two-sided."""
    return chi2_tail(f"({z} * {z})", "1")


def with_q(table: str, columns: str, p: str = "p") -> str:
    """Benjamini-Hochberg over the rows of a table that have a p-value."""
    return f"""SELECT {columns}, round({p}, 6) AS p, round(CASE WHEN {p} IS NOT NULL THEN least(1.0, min({p} * m_ / r_) OVER (PARTITION BY {p} IS NULL ORDER BY r_ DESC ROWS UNBOUNDED PRECEDING)) END, 6) AS q
FROM (SELECT *, row_number() OVER (PARTITION BY {p} IS NULL ORDER BY {p}) AS r_, count({p}) OVER () AS m_ FROM {table})"""


def quantile(name: str, table: str, keys: str, tail: str, area: str, high: float = 64.0) -> str:
    """Recursive table ``name`` (keys, t): where a falling tail of ``t_`` meets an area, by bisection."""
    return f"""{name}_steps AS (SELECT {keys}, 0 AS step, 0.0::DOUBLE AS lo, {high}::DOUBLE AS hi FROM {table}
 UNION ALL SELECT {keys}, step + 1, CASE WHEN p_ > {area} THEN t_ ELSE lo END, CASE WHEN p_ > {area} THEN hi ELSE t_ END FROM (SELECT *, {tail} AS p_ FROM (SELECT *, (lo + hi) / 2 AS t_ FROM {name}_steps WHERE step < 50))),
{name} AS (SELECT {keys}, (lo + hi) / 2 AS t FROM {name}_steps WHERE step = 50)"""


def additive_fit(sets: list[tuple[str, ...]], key, rounds: int = 100) -> str:
    """Tables ``cells`` and ``fitted``: cell means of each set and their least-squares fit on all smaller margins, by sweeps.

    ``key`` gives the text of a level. Needs ``sweep`` with y.
    """
    k = len(sets[0])
    at = [f"l{i}" for i in range(k)]
    margins = [[at[i] for i in m] for m in combinations(range(k), k - 1)]
    names = [f"f{i}" for i in range(len(margins))]
    cells = " UNION ALL ".join(
        f"SELECT '{'|'.join(s)}' AS d, " + ", ".join(f"{key(c)} AS {a}" for c, a in zip(s, at)) + ", count(*) AS n, avg(y) AS y, var_pop(y) * count(*) AS w, sum(hit) AS k FROM sweep WHERE y IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL" for c in s) + " GROUP BY ALL"
        for s in sets
    )
    step = f"(SELECT * FROM it WHERE step < {rounds})"
    for j, (name, margin) in enumerate(zip(names, margins)):
        others = " + ".join([f"n{f}" for f in names[:j]] + names[j + 1 :])
        part = "d, " + ", ".join(margin)
        step = f"(SELECT *, sum(n * (y - ({others}))) OVER (PARTITION BY {part}) / sum(n) OVER (PARTITION BY {part}) AS n{name} FROM {step})"
    keep = f"d, {', '.join(at)}, n, y, w, k"
    return f"""cells AS ({cells}), it AS (SELECT 0 AS step, {keep}, {', '.join(f'0.0::DOUBLE AS {f}' for f in names)} FROM cells
 UNION ALL SELECT step + 1, {keep}, {', '.join(f'n{f}' for f in names)} FROM {step}),
fitted AS (SELECT {keep}, {' + '.join(names)} AS fit FROM it WHERE step = {rounds})"""


def interaction_tests(size: int, least: int) -> str:
    """Table ``tests`` (d, N, cells, F, df, dfW, omega2, p, min_cell, sparse) from ``fitted``."""
    at = [f"l{i}" for i in range(size)]
    levels = [f"count(DISTINCT {a})" for a in at]
    rank = f"{levels[0]} + {levels[1]} - 1" if size == 2 else "count(*) - " + " * ".join(f"({x} - 1)" for x in levels)
    return f"""sums AS (SELECT d, CAST(sum(n) AS BIGINT) AS N, count(*) AS cells, CASE WHEN count(*) < {' * '.join(levels)} THEN 0 ELSE min(n) END AS min_cell, sum(n * (y - fit) * (y - fit)) AS ssi, sum(w) AS inner_, sum(n * y) / sum(n) AS grand, count(*) - ({rank}) AS df_ FROM fitted GROUP BY d),
every AS (SELECT d, sum(w + fitted.n * (y - grand) * (y - grand)) AS sst FROM fitted JOIN sums USING (d) GROUP BY d),
facts AS (SELECT d, N, cells, min_cell, min_cell < {least} AS sparse, CASE WHEN min_cell >= {least} THEN df_ END AS df, CASE WHEN min_cell >= {least} THEN N - cells END AS dfW, ssi, inner_ / (N - cells) AS ms, sst FROM sums JOIN every USING (d)),
tested AS (SELECT *, CASE WHEN df > 0 THEN ssi / df / ms END AS F, CASE WHEN df > 0 THEN (ssi - df * ms) / (sst + ms) END AS omega2 FROM facts),
tests AS (SELECT *, CASE WHEN F IS NOT NULL THEN {f_tail('F', 'df', 'dfW')} END AS p FROM tested)"""


def logistic_fit(rounds: int = 300, size: int = 2) -> str:
    """Table ``logistic`` (cells with h, the hits that the margins of one dimension less give), by proportional fitting."""
    at = [f"l{i}" for i in range(size)]

    def scaled(table: str, margin: str) -> str:
        part = f"PARTITION BY d, {margin}"
        return f"(SELECT * EXCLUDE (h, m), h * sum(k) OVER ({part}) / sum(h) OVER ({part}) AS h, m * sum(n - k) OVER ({part}) / sum(m) OVER ({part}) AS m FROM {table})"

    inner = f"(SELECT * FROM ipf WHERE step < {rounds})"
    for left in reversed(range(size)):
        inner = scaled(inner, ", ".join(x for i, x in enumerate(at) if i != left))
    keep = f"d, {', '.join(at)}, n, y, w, k"
    return f"""ipf AS (SELECT 0 AS step, {keep}, n / 2.0 AS h, n / 2.0 AS m FROM cells
 UNION ALL SELECT step + 1, {keep}, h * n / (h + m), m * n / (h + m) FROM {inner}),
logistic AS (SELECT *, n - h AS miss FROM ipf WHERE step = {rounds})"""
