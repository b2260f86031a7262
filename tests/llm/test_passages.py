"""The passage classifier: its encoding against brute force, its slopes, held-out rows, and edge cases."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from paramlens.llm import passages

P = passages.Params(words=5, pairs=6)
KINDS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\x0b\x0c\r", "\n", ".,;:!?'\"", "#*$%&|<>"]


def brute_passages(text: str) -> list[list[float]]:
    """The vectors of a text's passages, byte by byte."""
    raw = text.encode()
    spots = [(m, i) for i, m in enumerate(raw.split())]
    starts, at = [], 0
    for word, _ in spots:
        at = raw.index(word, at)
        starts.append(at)
        at += len(word)
    groups = [spots[i : i + P.words] for i in range(0, len(spots), P.words)] or [[]]
    edges = [0] + [starts[i] for i in range(P.words, len(spots), P.words)] + [len(raw)]
    out = []
    for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        own, words = raw[lo:hi], [w for w, _ in groups[k]]
        kinds = [0] * 9
        for b in own:
            kinds[8 if b > 127 else next((n for n, s in enumerate(KINDS) if chr(b) in s), 7)] += 1
        n, size = max(1, len(words)), max(1, len(own))
        measures = [
            sum(map(len, words)) / n / 12, sum(len(w) <= 3 for w in words) / n, sum(chr(w[0]) in KINDS[0] for w in words) / n,
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, (len(words) - len(set(words))) / n, kinds[4] / n, len(words) / P.words,
        ]
        pairs = [0] * P.pairs
        for i in range(lo, min(hi, len(raw) - 1)):
            pairs[((raw[i] * 0x9E3779B1 + raw[i + 1] * 0x85EBCA6B) % 2**32 >> 16) % P.pairs] += 1
        out.append([x / size for x in kinds] + measures + [(x / size) ** 0.5 for x in pairs])
    return out


def test_vectors_are_those_of_brute_force():
    texts = ["", " ", "one", "\n one  two\tthree THREE three. four five 55 # end", "é \U0001f600 é é ", "a " * 23, "last one"]
    got = list(passages.bags(pa.array([*texts, None]), P))
    vectors = np.concatenate([v for *_, v, _ in got])
    assert np.allclose(vectors, [x for t in [*texts, ""] for x in brute_passages(t)])
    assert got[0][3].tolist() == [i for i, t in enumerate([*texts, ""]) for _ in brute_passages(t)]


def test_long_texts_in_parts():
    rng = random.Random(3)
    text = " ".join("w" * rng.randint(1, 9) for _ in range(4000)) + " " + "x" * 5000
    p = passages.Params(words=7, part_bytes=1000)
    (_, _, vectors, owner), = passages.bags(pa.array([text]), p)
    assert owner.tolist() == [0] * len(vectors) and round((vectors[:, 15] * 7).sum()) == 4000 + 5  # a word longer than a part is cut
    whole = np.concatenate([v for *_, v, _ in passages.bags(pa.array([text, "b"]), passages.Params(words=7))])
    assert round((whole[:, 15] * 7).sum()) == 4002


def test_slopes_are_those_of_small_steps():
    rng = np.random.default_rng(1)
    p = passages.Params(pairs=4, hidden=5, gates=3)
    layers = passages.fresh_layers(p, rng)
    owner = np.array([0, 0, 0, 1, 2, 2])
    x, y, weight = rng.normal(size=(6, passages.width(p))), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    _, slopes = passages.gradient(layers, x, owner, y, weight)
    for name, values in layers.items():
        for spot in np.ndindex(values.shape):
            def loss(by, name=name, spot=spot):
                moved = {k: v.copy() for k, v in layers.items()}
                moved[name][spot] += by
                return passages.gradient(moved, x, owner, y, weight)[0]
            assert abs((loss(1e-5) - loss(-1e-5)) / 2e-5 - slopes[name][spot]) < 1e-6


def test_attention_falls_on_the_passage_that_decides():
    rng = np.random.default_rng(4)
    p = passages.Params(steps=600)
    texts, y = [], []
    for i in range(400):
        bag = rng.normal(0, 0.3, (rng.integers(3, 9), passages.width(p)))
        if i % 2:
            bag[rng.integers(len(bag)), 3] += 3
        texts.append(bag)
        y.append(float(i % 2))
    model = passages.fit(texts[:300], np.array(y[:300]), 0.5, p)
    right = [(model.scores(t, np.zeros(len(t), int))[0] >= 0.5) == label for t, label in zip(texts[300:], y[300:], strict=True)]
    found = [model.attention(t, np.zeros(len(t), int)).argmax() == t[:, 3].argmax() for t, label in zip(texts[300:], y[300:], strict=True) if label]
    assert np.mean(right) > 0.95 and np.mean(found) > 0.9


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = passages.digest_row(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(labels, "doc_id", "left").select("held_out", "score", "predicted", "quality").collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    known = [r for r in rows if r["held_out"] and r["quality"] is not None]
    bad, good = ([r["predicted"] for r in known if r["quality"] == kind] for kind in (0, 1))
    assert np.mean(bad) < 0.05 and np.mean(good) > 0.99


@pytest.fixture(scope="module")
def small(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["ka", "lo", "mi"]) + ("!!" if i % 3 == 0 else "") for _ in range(30)), "x") for i in range(80)]
    rows += [(200, None, "x"), (201, "", "x"), (None, rows[0][1], "x"), (5, "another text of one id", "x"), (6, rows[6][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(4)
    return docs, spark.createDataFrame([(i, int(i % 3 != 0), "x") for i in range(80)] + [(4, 0, "x"), (7, None, "x"), (None, 1, "x")], "doc_id long, quality int, held_out string")


def test_edges(spark, small):
    docs, labels = small
    got = passages.digest_row(docs, labels).collect()
    again = passages.digest_row(docs.repartition(1), labels.repartition(1)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(got, key=key) == sorted(again, key=key) and len(got) == 85
    by = {r["doc_id"]: r for r in got}
    assert by[None]["held_out"] and by[None]["score"] == by[0]["score"] and by[200]["score"] == by[201]["score"]
    assert {r["predicted"] for i, r in by.items() if i is not None and i < 80 and i % 3 == 0} == {0}
    one = passages.digest_row(docs, labels.where("quality = 1")).collect()
    assert {r["score"] for r in one} == {1.0} and len(one) == 85
    none = passages.digest_row(docs, labels.where("false")).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.0, 0)}
    assert passages.digest_row(docs.where("false"), labels).collect() == []
