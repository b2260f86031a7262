"""Dependence of dimensions, provenance of choices, and profiles."""

import random

from paramlens.operators import dependence as D
from paramlens.operators import interactions, provenance
from paramlens.plans import profiles as P
from paramlens.plans.cells import Target


def test_graph_of_dimensions(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        model = rng.choice(["lin", "tree", "net"])
        rows.append((model, {"lin": "fast", "tree": "fast", "net": "slow"}[model], rng.choice([2, 3]) if model != "lin" else None, rng.choice("xy"), "const", float(i % 7) if i % 10 else None))
    df = spark.createDataFrame(rows, "model string, speed string, depth int, free string, one string, y double")
    got = {(r["dim"], r["other"], r["relation"]): r for r in D.dependence(df, Target("y"), ["model", "speed", "depth", "free", "one"]).collect()}
    assert set(got) == {("speed", "model", "determined by"), ("depth", "model", "applies within")}
    edge = got["depth", "model", "applies within"]
    own = [r for r in rows if r[2] is not None]
    known = [r[5] for r in own if r[5] is not None]
    assert edge["within"] == ["net", "tree"] and abs(edge["share"] - len(own) / 600) < 1e-9 and abs(edge["mean"] - sum(known) / len(known)) < 1e-9
    texts = D.scope_texts(D.dependence(df, Target("y"), ["model", "depth"])).collect()
    assert [r["text"] for r in texts] == [f"only when model is net or tree · {round(len(own) / 6)}%"]
    linked = D.drawn_with(interactions.association(df, ["model", "speed", "free"])).collect()
    assert sorted((r["dim"], r["other"]) for r in linked) == [("model", "speed"), ("speed", "model")]


def history(spark, changes):
    return spark.createDataFrame([("s", i, w, v) for i, (w, v) in enumerate(changes)], "session string, at int, what string, value string")


def found(spark, changes, halved=("pnl",), standing=None):
    got = provenance.replayed(history(spark, changes), list(halved), standing or {}, "pnl").orderBy("at").collect()
    return [r["found"] for r in got]


def test_how_a_choice_was_found(spark):
    on, off = ("first_half", "true"), ("first_half", "false")
    assert found(spark, [on, ("pocket", "a=1"), ("gates", "g1=pnl")]) == [None, "first", "first"]
    # turned off while it stands, then on again: the second half has been seen
    assert found(spark, [on, ("pocket", "a=1"), off, on, ("pocket", "a=2")]) == [None, "first", "whole", "whole", "whole"]
    # cleared, and chosen again with the first half in view
    assert found(spark, [off, ("pocket", "a=1"), ("pocket", None), on, ("context", "b=1")]) == [None, "whole", None, None, "first"]
    # one of two choices cleared: the other stands
    assert found(spark, [off, ("pocket", "a=1"), on, ("context", "b=1"), ("pocket", None)]) == [None, "whole", "whole", "whole", "whole"]
    # nothing is known of what an address brought back
    assert found(spark, [on, ("restored", None), ("pocket", "a=1"), ("pocket", None), ("pocket", "a=1")]) == [None, "whole", "whole", None, "first"]
    # a target in view that reads the whole window anyway
    assert found(spark, [on, ("target", "auc"), ("pocket", "a=1")]) == [None, None, "whole"]
    assert found(spark, [on, ("pocket", "a=1")], halved=()) == [None, "whole"]


def test_targets_that_read_the_whole_window(spark):
    cases = [("pnl", None, False), (None, None, False), ("auc", None, True), ("gate:g1", "g1=pnl|g2=auc", False), ("gate:g2", "g1=pnl|g2=auc", True),
             ("gate:up", "g1=pnl", False), ("gate:none", "g1=pnl", True), ("gates:all", "g1=pnl|g2=auc", True), ("gates:count", "g1=pnl", False), ("gates:all", None, False)]
    df = spark.createDataFrame([(i, t, g) for i, (t, g, _) in enumerate(cases)], "i int, t string, g string")
    got = df.select("i", provenance.reads_whole(df["t"], df["g"], ["pnl"], {"up": "pnl"}, "pnl").alias("w")).orderBy("i").collect()
    assert [r["w"] for r in got] == [w for *_, w in cases]


def test_numbers_as_of_a_time_and_cohorts_that_were_touched(spark):
    past = provenance.replayed(history(spark, [("first_half", "true"), ("pocket", "a=1"), ("first_half", "false"), ("pocket", None)]), ["pnl"], {}, "pnl")
    numbers = spark.createDataFrame([("s", t, f"n{t}") for t in (0, 1, 2, 3, 9)] + [("other", 5, "x")], "session string, at int, name string")
    assert {r["name"]: r["found"] for r in provenance.as_of(numbers, past).collect()} == {"n0": None, "n1": "first", "n2": "whole", "n3": None, "n9": None, "x": None}
    reads = [("a", "pnl", "target", True, True), ("a", "g", "gate", True, True), ("b", "pnl", "target", True, True), ("b", "h", "gate", True, False), ("b", "g", "gate", True, False), ("c", "auc", "target", True, False), ("d", "k", "gate", False, False), ("d", "auc", "target", True, False)]
    got = provenance.touched(spark.createDataFrame(reads, "cohort string, label string, kind string, available boolean, halved boolean")).collect()
    assert {r["cohort"]: r["why"] for r in got} == {"b": "read over the whole window: g; h", "c": "not measured on each half: auc", "d": "no evidence on the first half: k"}


PROFILE = P.Profile(
    "runs", marks=("gates", "total"), reads=(P.Read("vary", "note", "vary=(True|False)", "True"), P.Read("exits", "note", r"midexits=(\d+)"), P.Read("gone", "absent", "x")),
    derived=(P.Derived("best", ("good", "exits"), "good * exits"), P.Derived("good", ("gates", "total"), "gates >= 6 and total >= 3000", binary=True), P.Derived("ring", ("gnir",), "gnir"), P.Derived("gnir", ("ring",), "ring"), P.Derived("lost", ("nothing",), "1")),
    invariants=(P.Invariant("no gain, no gate", ("gates", "total"), "total <= 0 and gates > 0"), P.Invariant("few exits", ("exits",), "exits > 5"), P.Invariant("never", ("nothing",), "true")),
)


def test_profiles(spark):
    rows = [(7, 4000.0, "vary=True midexits=3"), (7, 100.0, "vary=False midexits=9"), (2, -5.0, "other"), (8, float("nan"), None)]
    df = spark.createDataFrame(rows, "gates int, total double, note string")
    assert P.profile_of(df.columns, [P.Profile("x", ("none",)), PROFILE]).name == "runs" and P.profile_of(["a"], [PROFILE]) is None
    assert [d.name for d in P.ordered(PROFILE.derived, set(df.columns) | {"exits"})] == ["good", "best"]
    out = P.profiled(df, PROFILE)
    got = [(r["vary"], r["exits"], r["good"], r["best"], r["breaks"]) for r in out.collect()]
    assert got == [(1.0, 3.0, 1.0, 3.0, []), (0.0, 9.0, 0.0, 0.0, ["few exits"]), (None, None, 0.0, None, ["no gain, no gate"]), (None, None, None, None, [])]
    assert {r["invariant"]: r["n"] for r in P.breaks(out, PROFILE).collect()} == {"no gain, no gate": 1, "few exits": 1}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and plan.count("Scan") == 1
