import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paramlens.functions.intervals import with_q
from paramlens.operators import ablation, effects, gates, halves, interactions, members, pockets, trials
from paramlens.plans.cells import Target


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(3)
    n = 4000
    a, b, c = rng.integers(0, 3, n), rng.integers(0, 4, n), rng.integers(0, 2, n)
    y = 2.0 * (a == 1) + 1.5 * ((a == 2) & (b == 3)) + rng.standard_normal(n)
    pdf = pd.DataFrame({"i": np.arange(n), "a": a.astype(str), "b": b.astype(str), "c": c.astype(str), "y": y, "hit": (y > 1).astype(float)})
    pdf.loc[::97, "y"] = np.nan
    return pdf, spark.createDataFrame(pdf)


def test_board_finds_what_was_planted(planted):
    pdf, df = planted
    got = {r["dim"]: r for r in effects.board(df, Target("y"), ["a", "b", "c"]).collect()}
    assert got["a"]["detectable"] and got["a"]["best"] == "1" and not got["c"]["detectable"]
    used = pdf.dropna()
    groups = [g["y"].to_numpy() for _, g in used.groupby("a")]
    between = sum(len(g) * (g.mean() - used["y"].mean()) ** 2 for g in groups)
    within = sum(((g - g.mean()) ** 2).sum() for g in groups)
    assert got["a"]["F"] == pytest.approx(between / 2 / (within / (len(used) - 3)), rel=1e-9)


def test_pair_matches_least_squares(planted):
    pdf, df = planted
    row = interactions.interactions(df, Target("y"), ["a", "b"]).first()
    used = pdf.dropna()
    x = np.concatenate([pd.get_dummies(used["a"]).to_numpy(float), pd.get_dummies(used["b"]).to_numpy(float)[:, 1:]], axis=1)
    y = used["y"].to_numpy()
    add = ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()
    full = sum(((g["y"] - g["y"].mean()) ** 2).sum() for _, g in used.groupby(["a", "b"]))
    assert row["SSI"] == pytest.approx(add - full, rel=1e-8)
    assert row["df"] == 6 and row["detectable"]


def test_binary_interaction_is_a_likelihood_ratio(planted):
    pdf, df = planted
    row = interactions.interactions(df, Target("hit", binary=True), ["a", "c"]).first()
    table = pdf.groupby(["a", "c"])["hit"].agg(["sum", "count"])
    # Iterative proportional fitting of the hits table with margins a.c, a.hit, c.hit.
    cells = {(a, c, h): (table.loc[(a, c), "sum"] if h else table.loc[(a, c), "count"] - table.loc[(a, c), "sum"]) for a, c in table.index for h in (0, 1)}
    fit = dict.fromkeys(cells, 1.0)
    for _ in range(500):
        for drop in range(3):
            for key in {tuple(v for j, v in enumerate(k) if j != drop) for k in cells}:
                own = [k for k in cells if tuple(v for j, v in enumerate(k) if j != drop) == key]
                scale = sum(cells[k] for k in own) / sum(fit[k] for k in own)
                for k in own:
                    fit[k] *= scale
    d = 2 * sum(v * math.log(v / fit[k]) for k, v in cells.items() if v)
    assert row["D"] == pytest.approx(d, abs=1e-6)


def test_sparse_sets_are_not_tested(spark):
    rows = [(str(a), str(b), str(c), float(a)) for a, b, c in itertools.product(range(2), repeat=3)]
    out = interactions.interactions(spark.createDataFrame(rows, "a string, b string, c string, y double"), Target("y"), ["a", "b", "c"], 3).first()
    assert out["sparse"] and out["p"] is None


def test_degenerate_effects(spark):
    same = spark.createDataFrame([(str(i % 2), 5.0) for i in range(80)], "a string, y double")
    row = effects.board(same, Target("y"), ["a"]).first()
    assert row["p"] == 1 and row["omega2"] == 0
    split = spark.createDataFrame([(str(i % 2), float(i % 2)) for i in range(80)], "a string, y double")
    row = effects.board(split, Target("y"), ["a"]).first()
    assert row["p"] == 0 and math.isinf(row["F"])
    none = spark.createDataFrame([(str(i % 2), 0.0) for i in range(80)], "a string, y double")
    row = effects.board(none, Target("y", binary=True), ["a"]).first()
    assert row["G"] == 0 and row["p"] == 1
    assert effects.summary(spark.createDataFrame([], "a string, y double"), Target("y")).first()["n"] == 0


def test_q_leaves_missing_out(spark):
    got = with_q(spark.createDataFrame([(0.01,), (None,), (0.02,)], "p double")).orderBy("p").collect()
    assert [r["q"] for r in got] == [None, 0.02, 0.02]


def test_pockets(planted):
    _, df = planted
    with pytest.raises(ValueError):
        pockets.stats(df, [("nowhere", ["1"])], Target("y"), "i")
    assert pockets.merge([("a", ["1", "2"])], [("a", ["2", "3"]), ("b", ["0"])]) == [("a", ["2"]), ("b", ["0"])]
    row = pockets.stats(df, [("a", ["1"])], Target("y"), "i").first()
    assert row["lift"] > 1 and abs(row["z"]) < 4
    verdicts = {r["dim"]: r["verdict"] for r in pockets.block_tests(df, [("a", ["1"]), ("c", ["0"])], Target("y")).collect()}
    assert verdicts == {"a": "earns", "c": "narrows"}


def test_gates_are_three_valued(spark):
    rows = spark.createDataFrame([(1.0, None), (0.0, None), (1.0, 1.0)], "u double, v double")
    both = [gates.Gate("u", ">=", 1), gates.Gate("v", ">=", 1)]
    assert [(r["gates_all"], r["gates_count"]) for r in gates.flags(rows, both).collect()] == [(None, 1), (False, 0), (True, 2)]
    assert gates.problem(gates.Gate("w", ">=", 1), ["u"]) and gates.problem(gates.Gate("u", "=", 1), ["u"])
    assert [tuple(r) for r in gates.co_failure(rows, both, 0).collect()] == [("", 1)]


def test_ranks_cut_a_tie_at_the_limit(spark):
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 4, 4, 3, 3, 3])] + [(9, None)], "i long, v double")
    got = [(r["rank"], r["ties"]) for r in trials.ranked(rows, [("v", 1)], 4).orderBy("rank").collect()]
    assert got == [(1, 1), (2, 2), (2, 2)]
    assert [r["i"] for r in trials.top(rows, [("v", -1)], "i", 7).collect()] == [3, 4, 5, 1, 2, 0, 9]


def test_record_curve(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal(700)
    got = trials.record_curve(spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i long, v double"), Target("v", better=-1), "i").toPandas().sort_values("at")
    best = np.minimum.accumulate(v)
    assert np.allclose(got["best"], best[got["at"] - 1])
    assert set(got.loc[got["record"], "at"]) == {i + 1 for i in range(700) if i == 0 or best[i] < best[i - 1]}


def test_halves(spark):
    rng = np.random.default_rng(5)
    a = rng.standard_normal(400)
    rows = spark.createDataFrame([(i, float(x), float(x + 0.1 * e)) for i, (x, e) in enumerate(zip(a, rng.standard_normal(400)))], "i long, a double, b double")
    assert halves.rank_agreement(rows, "a", "b").first()["rho"] > 0.95
    assert halves.kept_lead(rows, "a", "b", "i").first()["kept"] == pytest.approx(1, abs=0.1)
    tenths = halves.persistence(rows, "a", "b", "i").orderBy("tenth").collect()
    assert [r["n"] for r in tenths] == [40] * 10 and tenths[0]["first"] > tenths[9]["first"]
    assert halves.kept_lead(rows.limit(50), "a", "b", "i").count() == 0
    assert halves.rank_agreement(rows.limit(3), "a", "b").first()["rho"] is None
    shifted = rows.withColumn("g", F.col("i") % 2 == 0).withColumn("v", F.col("a") + F.col("g").cast("int") * 3)
    assert halves.mann_whitney(shifted, "v", "g").first()["shift"] > 0.9


def test_ablation_matches_least_squares(spark):
    rng = np.random.default_rng(2)
    n = 600
    f, d = rng.integers(0, 2, n), rng.integers(0, 2, (n, 2))
    y = f + 0.5 * d[:, 0] + rng.standard_normal(n) * (1 + d[:, 0])
    rows = spark.createDataFrame([(str(f[i]), [m for m, x in zip("pq", d[i]) if x], float(y[i])) for i in range(n)], "f string, drops array<string>, y double")
    got = {r["term"]: r for r in ablation.model(rows, Target("y"), ["f"], "drops").collect()}
    x = np.column_stack([np.ones(n), f, d])
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    h = np.einsum("ij,jk,ik->i", x, inv, x)
    e = (y - x @ beta) / (1 - h)
    se = np.sqrt(np.diag(inv @ (x * (e**2)[:, None]).T @ x @ inv))
    assert "never" not in got
    for term, j in (("f=1", 1), ("p", 2), ("q", 3)):
        assert got[term]["effect"] == pytest.approx(beta[j], abs=1e-9) and got[term]["se"] == pytest.approx(se[j], rel=1e-6)
