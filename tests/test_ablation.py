"""Feature groups and the model of dropped columns, against dense fits."""

import numpy as np
import pytest

from paramlens.operators import ablation, members
from paramlens.plans.cells import Target

MANIFEST = {"sfd": {"manifest": {
    "indicators": [{"func": "x.ind.roc", "params": {"period": "{ret_period}", "group": "momentum", "n": 3}}],
    "features": [{"func": "x.lines", "params": {"hours": "{hours}", "group": "lines"}}, {"func": "x.cyclical"}, {"func": "y.wide", "params": {"group": "momentum", "again": "{ret_period}", "not": "{a b}"}}, {"params": {"group": 4}}],
    "feature_ablation": {"seed_key": "s"},
}}}


def test_what_a_manifest_declares(spark):
    entries = ablation.declared(spark, MANIFEST)
    assert [tuple(r) for r in ablation.groups(entries).collect()] == [("momentum", ["roc", "wide"]), ("lines", ["lines"])]
    assert [r["function"] for r in ablation.always(entries).collect()] == ["cyclical", ""]
    assert [r["name"] for r in ablation.naming(entries).collect()] == ["ret_period", "hours"]
    assert ablation.drop_keys(MANIFEST) == ("feature_drop_count", "s") and ablation.drop_keys({}) == ()
    levels = spark.createDataFrame([("feature_groups", 3), ("ret_period", 2), ("s", 4), ("m", 5), ("one", 1)], "dim string, levels long")
    got = ablation.factors(levels, ablation.naming(entries), ["m", "s", "one", "ret_period"], ("feature_drop_count", "s"))
    assert [r["dim"] for r in got.collect()] == ["feature_groups", "ret_period", "m"]
    assert ablation.declared(spark, {}).count() == 0


def dense(x, y):
    inverse = np.linalg.lstsq(x.T @ x, np.eye(x.shape[1]), rcond=None)[0]
    beta = inverse @ x.T @ y
    h = np.einsum("ij,jk,ik->i", x, inverse, x)
    w = np.where(h < 1 - 1e-9, ((y - x @ beta) / np.where(h < 1 - 1e-9, 1 - h, 1)) ** 2, 0)
    return beta, np.sqrt(np.diag(inverse @ (x * w[:, None]).T @ x @ inverse))


def test_members_dropped_together_few_and_determined(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(500):
        own = (["p", "q"] if i % 3 == 0 else []) + (["w"] if i % 4 == 1 else []) + (["rare"] if i < 9 else []) + (["odd"] if i % 2 else ["even"])
        rows.append((i, "ab"[i % 5 == 0], None if i == 499 else own, float(-(i % 3 == 0) + rng.random())))
    df = spark.createDataFrame(rows, "i long, f string, d array<string>, y double").repartition(6)
    got = {r["term"]: r for r in ablation.model(df, Target("y"), ["f"], "d").collect()}
    assert got["p+q"]["members"] == ["p", "q"] and got["p+q"]["keep"] > 0.9 and got["p+q"]["detectable"] and got["p+q"]["lo"] < got["p+q"]["keep"] < got["p+q"]["hi"]
    assert got["rare"]["reason"] == "few" and got["rare"]["effect"] is None
    assert got["odd"]["reason"] == "determined by others" and got["even"]["reason"] is None
    use = rows[:499]
    x = np.array([[1, f == "b", "even" in d, "p" in d, "rare" in d, "w" in d] for _, f, d, _ in use], dtype=float)
    beta, se = dense(x, np.array([r[3] for r in use]))
    for k, term in ((2, "even"), (3, "p+q"), (5, "w")):
        assert got[term]["effect"] == pytest.approx(beta[k], abs=1e-9) and got[term]["se"] == pytest.approx(se[k], rel=1e-6)
    assert got["p+q"]["drops"] == sum("p" in r[2] for r in use)


def test_many_terms(spark):
    rng = np.random.default_rng(4)
    x = rng.random((4000, 120)) < 0.1
    y = x[:, 0] * 0.7 - x[:, 5] * 0.4 + rng.normal(0, 0.3, 4000)
    df = spark.createDataFrame([([f"m{j:03d}" for j in np.flatnonzero(r)], float(v)) for r, v in zip(x, y, strict=True)], "d array<string>, y double").repartition(4)
    got = {r["term"]: r for r in ablation.model(df, Target("y"), [], "d").collect()}
    beta, se = dense(np.column_stack([np.ones(4000), x]).astype(float), y)
    assert len(got) == 121
    assert max(abs(got[f"m{j:03d}"]["effect"] - beta[j + 1]) for j in range(120)) < 1e-9 and max(abs(got[f"m{j:03d}"]["se"] - se[j + 1]) for j in range(120)) < 1e-9
    assert got["m000"]["detectable"] and got["m005"]["detectable"]


def test_groups_that_all_stands_for(spark):
    rng = np.random.default_rng(1)
    rows = [(level, float(rng.normal({"all": 1.0, None: 1.0, "A": 0.5, "B": 0.0, "A|C": 3.0}[level]))) for level in ["all", None, "A", "B", "A|C"] for _ in range(60)]
    df = spark.createDataFrame(rows, "g string, y double")
    got = {(r["group"], r["with"], r["without"]): r for r in members.group_contrasts(df, "g", Target("y"), ["A", "B"]).collect()}
    assert set(got) == {("B", "all", "A"), ("A", "all", "B"), ("C", "A|C", "A")}
    one = got["A", "all", "B"]
    assert one["n"] == 120 and one["lo"] < one["delta"] < one["hi"] and one["detectable"]
    assert {r["with"] for r in members.group_contrasts(df, "g", Target("y")).collect()} == {"A|C"}


def test_features_as_one_analysis(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(900):
        drops = [m for m in ("a_1", "b") if rng.random() < 0.3]
        base = -0.8 * ("b" in drops) + 0.3 * (i % 3 == 0)
        y1, y2 = base + rng.normal(0, 0.5), base + rng.normal(0, 0.5)
        rows.append((("all", "momentum", "lines")[i % 3], [1, 5][i % 2], drops, (y1 + y2) / 2, float(y1), float(y2)))
    df = spark.createDataFrame(rows, "feature_groups string, ret_period int, d array<string>, y double, y1 double, y2 double")
    got = ablation.features(df, Target("y"), MANIFEST, "d", {"y": ("y1", "y2")})
    terms = {r["term"]: r for r in got["terms"].collect()}
    assert {"feature_groups=lines", "feature_groups=momentum", "ret_period=5", "b", "a_1"} < set(terms)
    twice = {r["term"]: r for r in got["twice"].collect()}
    assert twice["b"]["detectable"] and not twice["a_1"]["detectable"] and twice["b"]["keep"] > 0.6
    assert {(r["group"], r["with"]) for r in got["contrasts"].collect()} == {("lines", "all"), ("momentum", "all")}
