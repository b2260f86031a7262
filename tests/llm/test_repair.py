"""Conversation repair against exhaustive search and its SQL, and its edge cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import duckdb
import pytest

from paramlens.llm import repair
from paramlens.llm.sql import ORACLE

ROWS = "conv_id long, turn long, role string, text string"


def brute_audit(kinds: str) -> tuple[int, str]:
    """The least (cost, audit) among all ways to edit rows with up to two inserts at each gap."""
    gaps = ["", "u", "a", "ua", "au"]
    roles = kinds.translate(repair.INITIALS)
    ways = []
    for letter, role in zip(kinds, roles, strict=True):
        more = 3 if letter.isupper() else 0
        stays = [("K", role, more), ("R", "u", 3 + more), ("R", "a", 3 + more)] if letter.isalpha() else []
        ways.append([("D", "", 4), *stays])
    best = None
    for adds in itertools.product(gaps, repeat=len(kinds) + 1):
        for edits in itertools.product(*ways):
            shown = adds[0] + "".join(e[1] + a for e, a in zip(edits, adds[1:], strict=True))
            if not re.fullmatch("(s?(ua)+)?", shown):
                continue
            cost = sum(e[2] for e in edits) + 3 * sum(map(len, adds))
            audit = "I" * len(adds[0]) + "".join(e[0] + "I" * len(a) for e, a in zip(edits, adds[1:], strict=True))
            best = min(best or (cost, audit), (cost, audit))
    return best


def test_audits_are_the_cheapest_and_least():
    letters = "".join(repair.LETTERS)
    every = [""] + [a for a in letters] + [a + b for a in letters[:8] for b in letters[:10]]
    rng = random.Random(5)
    every += ["".join(rng.choice("sssuuuaaaxSUAX04") for _ in range(rng.choice([3, 3, 4]))) for _ in range(60)]
    for kinds in every:
        assert repair.solve(kinds)[4:] == brute_audit(kinds), kinds


def test_long_signatures():
    cost, audit = repair.solve("ua" * 20_000 + "u")[4:]
    assert cost == 3 and audit == "K" * 40_001 + "I"
    assert repair.solve("4" * 5_000)[4:] == (20_000, "D" * 5_000)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", None, "One. Two", "done. \n", "…", "a:b\nc."]
    roles = ["user", "assistant", "system", "tool", "", None, "agent"]
    out = []
    for conv in range(120):
        for turn in range(rng.randint(0, 9)):
            role = rng.choice(roles) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            out.append((conv, turn + (rng.random() < 0.1) * 3, role, rng.choice(texts) if rng.random() < 0.5 else f"text {conv} {turn}."))
    out += [(200, None, "user", "a."), (200, None, "user", "a."), (200, None, "assistant", "b."), (201, None, None, None), (None, 1, "user", "q."), (None, 2, "assistant", "r."), (None, None, "system", "s.")]
    out += [(202, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for t in range(700)] + [(203, -(2**63), "user", "x."), (203, 2**63 - 1, "assistant", "y.")]
    return out + [(204, 5, "user", "twice.")] * 3


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


def test_digests_match_sql(spark, rows):
    some = [r for r in rows if r[0] not in (202, 203)]  # the SQL has no answer to extreme turns, and is slow on long ones
    df = spark.createDataFrame([(*r, 1, "x") for r in some], ROWS + ", gaps int, `_key` string").repartition(5)
    got = repair.digest_row(df)
    db = duckdb.connect()
    db.register("conversations", spark.createDataFrame(some, ROWS).toArrow())
    want = db.sql(ORACLE["op13_repair"])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    assert by_id(tuple(r) for r in got.collect()) == by_id(tuple(r[i] for i in order) for r in want.fetchall())


def test_repaired_rows(spark, rows):
    got = repair.repair(spark.createDataFrame(rows, ROWS)).orderBy("conv_id", "position").collect()
    audits = {r["conv_id"]: r["audit"] for r in repair.audits(spark.createDataFrame(rows, ROWS)).collect()}
    assert set(audits) == {r[0] for r in rows}
    for conv, audit in audits.items():
        own = [r for r in got if r["conv_id"] == conv]
        assert "".join(r["edit"] for r in own) == audit.replace("D", "") and [r["position"] for r in own] == list(range(len(own)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in own))
        assert all(r["text"] == "" for r in own if r["edit"] == "I")
    assert len(audits[202]) == 700 and audits[204] == "KDDI"
    gaps = {r["conv_id"]: r["gaps"] for r in repair.audits(spark.createDataFrame(rows, ROWS)).collect()}
    assert gaps[203] is None and gaps[200] == 0 and gaps[202] == 0


def test_a_conversation_over_many_tasks(spark):
    """A conversation that holds nearly all rows is cut into pieces, and equal rows are counted."""
    long = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t}!") for t in range(3000)] + [(1, 5000, "user", "same.")] * 400
    df = spark.createDataFrame(long + [(2, 0, "user", "hi.")], ROWS).repartition(16)
    got = {r["conv_id"]: r for r in repair.audits(df).collect()}
    assert got[1]["audit"] == "K" * 3001 + "D" * 399 + "I"
    assert got[1]["duplicate"] == 399 and got[1]["gaps"] == 2000 and got[1]["cost"] == 399 * 4 + 3 and got[2]["audit"] == "KI"


def test_all_rows_dropped_and_empty_table(spark):
    import zlib

    gone = next(i for i in range(10**6) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = [tuple(r) for r in repair.digest_row(spark.createDataFrame([(gone, 0, "user", "a.")], ROWS)).collect()]
    assert got == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    none = spark.createDataFrame([], ROWS)
    assert repair.digest_row(none).collect() == [] and repair.repair(none).collect() == []
