"""Gzip members by ranges of bytes and by offset, and CSV files whose columns differ in order."""

import gzip
import json
import random
import time
import zlib

import pytest

from paramlens.operators import rounds
from paramlens.sources import experiment, members
from paramlens.sources import rows as sources
from paramlens.streaming import tail


def packed(texts, level=6):
    return [gzip.compress(t.encode(), level, mtime=0) for t in texts]


def test_ranges_of_any_width_find_every_member_once():
    rng = random.Random(2)
    texts = [json.dumps({"i": i, "x": "y" * rng.randint(0, 300), "r": rng.random()}) + "\n" for i in range(60)]
    texts[7] = gzip.compress(b"inner member\n" * 3).hex() + "\n"
    parts = packed(texts[:30]) + packed(texts[30:], 0)  # the latter are stored as they are
    raw = b"".join(parts)
    for width in (1, 7, 100, 1000, 10**6):
        whole = members.Bytes.of(raw)
        got = [x for lo in range(0, len(raw), width) for x in members.in_range(whole, lo, min(lo + width, len(raw)))]
        assert [x[2].decode() for x in got] == texts and got[0][0] == 0 and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))


def test_a_member_inside_a_member_is_none(spark, tmp_path):
    inner = gzip.compress(b'{"round_id": "inner"}\n', mtime=0)
    odd = zlib.compressobj(0, zlib.DEFLATED, 31)
    stored = odd.compress(b"head " + inner + b" tail\n") + odd.flush()
    (tmp_path / "a.gz").write_bytes(b"".join([*packed(["one\n"]), stored, *packed(["two\n"])]))
    seen = members.scanned(spark, str(tmp_path / "a.gz"), payload=True, width=16)
    assert seen.count() == 4
    got = members.members(spark, str(tmp_path / "a.gz"), width=16).orderBy("start").collect()
    assert [r["payload"][:4] for r in got] == ["one\n", "head", "two\n"]


def test_unfinished_broken_and_large_members(spark, tmp_path):
    parts = packed([f'{{"round_id": "r{i}"}}\n' for i in range(50)])
    path = tmp_path / "r.jsonl.gz"
    path.write_bytes(b"".join(parts[:40]) + parts[40][:-3])
    found = members.sound(members.scanned(spark, str(path), width=300))
    assert [(r["state"], r["count"]) for r in found.groupBy("state").count().orderBy("state").collect()] == [("unfinished", 1), ("whole", 40)]
    first = members.index(spark, str(path), width=300)
    old = first.collect()
    assert len(old) == 40
    after = members.read_to(spark, str(path), width=300)
    path.write_bytes(b"".join(parts[:45]) + b"".join(packed(['{"round_id": "r3", "again": 1}\n'])))
    new = members.index(spark, str(path), after=after, width=300)
    assert sorted(r["round_id"] for r in new.collect()) == ["r3", "r40", "r41", "r42", "r43", "r44"]
    whole = {r["round_id"]: r for r in members.merged(spark.createDataFrame(old, first.schema), new).collect()}
    assert len(whole) == 45 and json.loads(members.payload_at(spark, whole["r3"]["file"], whole["r3"]["start"])) == {"round_id": "r3", "again": 1}
    assert json.loads(members.payload_at(spark, whole["r17"]["file"], whole["r17"]["start"])) == {"round_id": "r17"}
    with pytest.raises(ValueError, match="no member"):
        members.payload_at(spark, whole["r17"]["file"], whole["r17"]["start"] + 1)
    path.write_bytes(parts[0] + b"\x1f\x8b\x08" + b"\x00" * 30 + parts[1])
    with pytest.raises(Exception, match="broken member"):
        members.members(spark, str(path)).collect()
    path.write_bytes(gzip.compress(b"x" * 5000))
    with pytest.raises(Exception, match="inflates to more than 1000"):
        members.members(spark, str(path), limit=1000).collect()
    assert members.members(spark, str(path), limit=5000).count() == 1
    path.write_bytes(b"")
    assert members.members(spark, str(path)).count() == 0


def test_many_members_take_time_in_proportion(spark, tmp_path):
    raw = b"".join(packed([f"line {i}\n" for i in range(1000)])) * 100
    began = time.perf_counter()
    got = list(tail.GzipTailReader("x")._members(raw))
    assert len(got) == 100_000 and time.perf_counter() - began < 15
    (tmp_path / "m.gz").write_bytes(raw + raw[:10])
    found = members.members(spark, str(tmp_path / "m.gz"), width=1 << 18)
    assert found.rdd.getNumPartitions() >= 1 and found.count() == 100_000


def test_round_log_while_the_run_still_writes(spark, tmp_path):
    records = [{"round_id": f"r{i}", "_round_index": i % 5, "optimal_threshold": float(i)} for i in range(8)]
    text = b"".join(packed([json.dumps(r) + "\n" for r in records] + ['{"no": "index"}\n{"round_id": "z", "_round_index": 9}\n']))
    (tmp_path / "r.jsonl.gz").write_bytes(text + packed(["{}\n"])[0][:12])
    (tmp_path / "r.jsonl").write_text('{"round_id": "p", "_round_index": 1}\n')
    got = experiment.round_log(spark, str(tmp_path / "r.jsonl.gz"), str(tmp_path / "r.jsonl")).collect()
    assert sorted((r["round_id"] or "", r["optimal_threshold"]) for r in got if r["bad"] is None) == [("p", None), ("r3", 3.0), ("r4", 4.0), ("r5", 5.0), ("r6", 6.0), ("r7", 7.0), ("z", None)]
    assert [r["bad"] for r in got if r["bad"]] == ['{"no": "index"}']


def test_csv_files_are_matched_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,score,lr\n1,10.5,0.1\n2,11,"0.2"\n')
    (tmp_path / "b.csv").write_text("id,lr,score\n3,0.2,20\n4,0.3\n")
    (tmp_path / "c.csv").write_text('id,"new\ncolumn",lr\n5,x,0.9\n')
    (tmp_path / "d.csv").write_text("")
    with gzip.open(tmp_path / "e.csv.gz", "wt") as file:
        file.write("lr,id\n0.7,6\n")
    out = sources.csv(spark, str(tmp_path))
    got = sorted((r["id"], r["score"], r["lr"], r["new\ncolumn"]) for r in out.where("__bad is null").collect())
    assert got == [(1.0, 10.5, 0.1, None), (2.0, 11.0, 0.2, None), (3.0, 20.0, 0.2, None), (5.0, None, 0.9, "x"), (6.0, None, 0.7, None)]
    assert len(out.where("__bad is not null").collect()) == 1
    with pytest.raises(FileNotFoundError):
        sources.csv(spark, str(tmp_path / "none*.csv"))


def test_the_last_execution_of_a_round_holds(spark):
    sweep = spark.createDataFrame([("a",), ("b",)], "k string")
    runs = spark.createDataFrame([("a", "whole", 1.0, 1), ("a", "whole", 2.0, 3), ("a", "whole", 5.0, 2), ("a", "first", 9.0, 1)], "k string, part string, net double, at int")
    got = rounds.with_executions(sweep, runs, "k", ["net"], "at").orderBy("k").collect()
    assert [(r["whole_net"], r["first_net"], r["second_net"]) for r in got] == [(2.0, 9.0, None), (None, None, None)]


def test_manifests_and_slim_runs(spark, tmp_path):
    assert experiment.manifest_file({"a.yaml", "metadata.json"}, "d") == "a.yaml"
    for names in (set(), {"a.yml", "b.yaml"}):
        with pytest.raises(ValueError, match="one YAML file"):
            experiment.manifest_file(names, "d")
    rows = spark.createDataFrame([("r1", 1.5), ("r2", 2.5), ("r3", 3.5)], "id string, x double")
    lines = spark.createDataFrame([('{"round_id": "r1", "a": [1]}',), ('{"round_id": "r3"}',), ("not json",)], "text string")
    experiment.slim(rows, spark.createDataFrame([("r1",), ("r2",), ("r1",)], "id string"), str(tmp_path), lines)
    assert sorted(r["id"] for r in spark.read.csv(str(tmp_path / "results"), header=True).collect()) == ["r1", "r2"]
    assert [r["value"] for r in spark.read.text(str(tmp_path / "rounds")).collect()] == ['{"round_id": "r1", "a": [1]}']
