import gzip
import json

import pytest

from paramlens.operators import bars, runs
from paramlens.sources import experiment


def test_status_and_verdicts():
    assert runs.status(True, False, None, 5, 10, 10) == "live"
    assert runs.status(True, False, None, 5, 10, 700) == "quiet"
    assert runs.status(True, False, "crashed", 5, 10, 700) == "crashed"
    assert runs.status(True, False, None, 10, 10, 700) == "finished"
    assert runs.status(True, False, None, 10, 10, 0, edge=3) == "replay"
    got = runs.verdicts({"thresholds": {"max_pbo": 0.2, "min_deflated_sharpe_probability": 0.9}, "verdicts": {"max_pbo": False}, "errors": {"deflated_sharpe_probability": "few"}})
    assert {v["key"]: (v["verdict"], v["why"]) for v in got} == {"max_pbo": ("fail", None), "min_deflated_sharpe_probability": ("unavailable", "few")}


def test_directories(spark, tmp_path):
    for name, seed in (("a", 1), ("b", 2)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "metadata.json").write_text(json.dumps({"manifest_id": name, "yaml_reference": {"sfd": {"params": {"C": [1, 2]}}, "uel": {"search": {"type": "random", "seed": seed}, "output_path": name}}}))
    read = {n: experiment.metadata(spark, str(tmp_path / n)) for n in "ab"}
    assert read["a"]["params"] == {"C": [1, 2]} and experiment.reports(spark, str(tmp_path / "a")) == {"convergence": None, "acceptance": None}
    declared = {n: m["manifest"] for n, m in read.items()}
    assert experiment.why_not_one_run(declared) is None
    assert "seed" in experiment.why_not_one_run({"a": declared["a"], "b": declared["a"]})
    assert "sfd.params.C" in experiment.why_not_one_run({"a": declared["a"], "b": declared["b"] | {"sfd": {"params": {"C": [3]}}}})
    grid = {"uel": {"search": {"type": "grid"}}}
    assert "grid" in experiment.why_not_one_run({"a": grid, "b": grid})
    with pytest.raises(FileNotFoundError):
        experiment.metadata(spark, str(tmp_path))


def test_round_log_of_gzip_members(spark, tmp_path):
    records = [{"round_id": f"r{i}", "_round_index": i, "execution": {"pos": [0, 1, 1], "gross": [0, 0.1, -0.1], "net": [0, 0.1, -0.2]}, "market": {"ret": [0.1, None, 0.2]}} for i in range(3)]
    records.append({"round_id": "odd", "_round_index": 9, "execution": {"pos": [1], "gross": [1, 2], "net": [1]}})
    (tmp_path / "r.jsonl.gz").write_bytes(b"".join(gzip.compress((json.dumps(r) + "\n").encode()) for r in [*records, {"no": "index"}]))
    rounds = experiment.round_log(spark, str(tmp_path / "r.jsonl.gz"))
    assert rounds.where("bad is not null").count() == 1
    own = experiment.executions(rounds.where("bad is null"))
    assert own.count() == 3
    row = bars.windows(bars.bars_of(own)).where("member = 'r0'").first()
    assert (row["bars"], row["trades"], row["trade_t"]) == (3, 1, None)
    assert row["trade_mean"] == pytest.approx((1.1 * 0.8 - 1) * 1e4, rel=1e-5) and row["market"] == pytest.approx(0.32)
    assert row["timing"] == pytest.approx((-0.05 - 0.5 * 0.15) * 1e4, rel=1e-5)


def test_long_flat_matches_a_loop(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    signal, ret = rng.integers(0, 2, 60).tolist(), [None if i % 11 == 5 else float(x) for i, x in enumerate(rng.normal(0, 0.01, 60))]
    got = bars.long_flat(spark.createDataFrame([("m", i, s, r) for i, (s, r) in enumerate(zip(signal, ret))], "member string, at long, signal int, ret double"), 5, 5).orderBy("at").collect()
    fee = slip = 5 / 1e4
    equity = None
    for i in range(60):
        on = i > 0 and signal[i - 1] == 1 and ret[i] is not None
        assert got[i]["pos"] == float(on)
        if not on:
            equity = None
            assert got[i]["net"] == 0
            continue
        nxt = i + 1 < 60 and signal[i] == 1 and ret[i + 1] is not None
        if equity is None:
            held, before = (1 + ret[i]) / (1 + slip), 1.0
        else:
            held, before = held * (1 + ret[i]), equity
        equity = held - fee if nxt else held * (1 - fee) * (1 - slip) - fee
        assert got[i]["net"] == pytest.approx(equity / before - 1, abs=1e-12)
