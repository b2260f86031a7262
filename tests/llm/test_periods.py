"""Runs of periodic words against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from paramlens.llm import periods

DIGEST = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def brute_runs(words: list, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """Every maximal stretch by trying every period at every place."""
    n, found = len(words), set()
    for q in range(1, n // times + 1):
        for start in range(n - q):
            if words[start] != words[start + q] or (start and words[start - 1] == words[start - 1 + q]):
                continue
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end + q - start
            smaller = any(all(words[k] == words[k + d] for k in range(start, start + length - d)) for d in range(1, q))
            if length >= max(least, times * q) and not smaller:
                found.add((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_digest(doc_id: int | None, text: str | None) -> tuple:
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    rest = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    collapsed = b" ".join(w for i, w in enumerate(words) if i not in dropped).decode()
    return (doc_id, len(found), *rest, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(collapsed))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=5), st.integers(1, 7)), max_size=6), max_size=4))
def test_runs_are_those_of_brute_force(parts):
    texts = [[w.encode() for piece, times in text for w in piece * times] for text in parts]
    assert periods.runs_of(texts) == [brute_runs(t) for t in texts]


def test_runs_when_hashes_tell_nothing(monkeypatch):
    """Hashes that call everything equal lead to no wrong run: words decide."""
    monkeypatch.setattr(periods._Numbered, "alike", lambda self, i, j, n: True)
    rng = random.Random(2)
    for _ in range(200):
        words = [w for _ in range(5) for w in [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 4))] * rng.randint(1, 6)]
        got = periods.runs_of([words])[0]
        assert set(got) <= set(brute_runs(words)) and len(got) == len(set(got))


def test_other_limits():
    words = [w.encode() for w in "x a b a b a b y c c c z".split()]
    assert periods.runs_of([words], periods.Params(least=3, times=3))[0] == brute_runs(words, 3, 3) == [(1, 6, 2), (8, 3, 1)]


def test_long_periodic_texts_take_little_more_than_their_words():
    fib, more = "a", "ab"
    while len(more) < 40_000:
        fib, more = more, more + fib
    texts = [[b"be"] * 100_000, [w.encode() for w in more], [b"w%d" % i for i in range(9_000)] * 5]
    got = periods.runs_of(texts)
    assert got == [[(0, 100_000, 1)], [], [(0, 45_000, 9_000)]]


def test_digests_match_brute_force(spark):
    rng = random.Random(9)
    rows: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, " \n\t "), (4, "be " * 300), (5, "a b   \U0001f600 " * 30), (5, "be " * 8), (5, "be " * 8), (None, "x y " * 9), (None, None)]
    for i in range(10, 160):
        rows.append((i, " ".join(f"w{rng.randint(0, 5)}" if rng.random() < 0.3 else f"v{rng.randint(0, 60)}\n" for _ in range(rng.randint(1, 120)))))
    rows += [(7000, "long " * 30_000 + " ".join(f"t{i}" for i in range(30_000)))]
    df = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, n_runs string").repartition(3)
    got = periods.digest_row(df)
    assert got.columns == DIGEST
    some = [tuple(r) for r in got.collect()]
    assert any(r[1] and r[0] not in (None, 4, 5, 7000) for r in some)  # some were damaged
    key = lambda r: (r[0] is None, r[0] or 0, str(r))
    slow = [r for r in rows if r[0] != 7000]
    assert sorted((r for r in some if r[0] != 7000), key=key) == sorted((brute_digest(*r) for r in slow), key=key)
    assert [r[1:5] for r in some if r[0] == 7000] == [(1, 0, 30_000, 1)] or zlib.crc32(b"7000") % 10 == 0


def test_runs_and_collapsed_texts_keep_other_columns(spark):
    df = spark.createDataFrame([(1, "a b a b a b a b c", 7, "x"), (2, None, None, "y")], "doc_id long, text string, runs int, `v` string")
    got = periods.runs(df).orderBy("doc_id").collect()
    assert [[tuple(x) for x in r["runs"]] for r in got] == [[(0, 8, 2)], []] and [r["v"] for r in got] == ["x", "y"]
    out = periods.collapse(df).orderBy("doc_id")
    assert [r["collapsed"] for r in out.collect()] == ["a b c", ""] and out.columns == ["doc_id", "text", "runs", "v", "collapsed"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert periods.digest_row(df).collect() == [] and periods.runs(df).collect() == [] and periods.collapse(df).columns[-1] == "collapsed"
