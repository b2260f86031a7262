"""Quality by attention over passages: multiple-instance learning from labels of whole documents.

Every passage of a text is encoded to shares of kinds of bytes and of hashed pairs of bytes and to
measures of its words. A hidden layer maps passages to vectors h; gated attention weighs them,
``softmax(w . (tanh(V h) * sigmoid(U h)))``, and the score is a logistic function of the weighted mean. Only
labels of documents are known, so the weights of passages are learned with the rest, by gradient steps.

Fitting uses a bounded sample: ``Params.fit_rows`` labelled rows of each class outside fold 0, chosen by a
hash of the id, and of a very long one ``Params.fit_passages`` passages at even distances. They are
encoded where they lie; the driver gets their passages' vectors only, which these bounds limit. Classes
count as often as among all labelled rows. Scoring encodes every passage of every whole text.

Null texts are scored like empty ones: one passage without words. Labels, language, source and id never
enter a score. Texts longer than ``Params.part_bytes`` are encoded in parts that end at white space where
there is any, and a passage ends with its part; that bounds memory. With labels of one class
only, or none, every score is the rate seen, or 0. Repeated rows are scored one by one, equal texts alike. A row with
a null id is held out. An id labelled more than once is good if any of its labels says so; of several texts
of one id the least is fitted on. Empty tables give empty ones, and other columns are left out, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced
from .hashing import pieces, utf8, words_of


@dataclass(frozen=True)
class Params:
    """Passages have ``words`` words and are encoded with ``pairs`` buckets of byte pairs.

    The hidden layer has ``hidden`` units and the attention ``gates``. Fitting takes ``steps`` steps of ``bags``
    documents at rate ``rate``, from ``seed``; weights decay by ``decay``.
    """

    words: int = 60
    pairs: int = 48
    hidden: int = 24
    gates: int = 12
    fit_rows: int = 2000
    fit_passages: int = 64
    steps: int = 900
    bags: int = 64
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 11
    part_bytes: int = 1 << 20


#: Kinds of bytes: upper, lower, digit, blank, line end, sentence mark, symbol, other mark, beyond ASCII.
_KINDS = np.full(256, 7, dtype=np.int64)
for _kind, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\x0b\x0c\r", b"\n", b".,;:!?'\"", b"#*$%&|<>")):
    _KINDS[list(_bytes)] = _kind
_KINDS[128:] = 8
_MEASURES = 9 + 7
_SPACES = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def width(p: Params) -> int:
    """The length of a passage's vector."""
    return _MEASURES + p.pairs


def encoded(data: np.ndarray, offsets: np.ndarray, p: Params = Params()) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of all passages of texts that lie end to end, and the text that each belongs to."""
    words = words_of(data, offsets)
    n = words.last - words.first
    per = np.maximum(1, -(-n // p.words))
    owner = np.repeat(np.arange(len(n)), per)
    before = np.cumsum(per) - per
    count = len(owner)
    out = np.zeros((count, width(p)), dtype=np.float64)
    if not len(data):
        return out, owner
    text = np.repeat(np.arange(len(n)), n)
    passage = before[text] + (np.arange(len(text)) - words.first[text]) // p.words
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    inside = ~_SPACES[data]
    starts = np.flatnonzero(inside & (~np.concatenate(([False], inside[:-1])) | edge[:-1]))
    ends = np.flatnonzero(inside & (~np.concatenate((inside[1:], [False])) | edge[1:])) + 1
    # A passage's bytes go from its first word to the next passage's; the first one's from where the text begins.
    begins = np.empty(count, dtype=np.int64)
    begins[before] = offsets[:-1]
    fresh = np.flatnonzero(np.diff(passage, prepend=-1) > 0)
    later = fresh[passage[fresh] > before[text[fresh]]]
    begins[passage[later]] = starts[later]
    sizes = np.diff(np.append(begins, len(data)))
    at = np.repeat(np.arange(count), sizes)
    kinds = np.bincount(at * 9 + _KINDS[data], minlength=count * 9).reshape(count, 9)
    out[:, :9] = kinds / np.maximum(1, sizes)[:, None]
    held = np.bincount(passage, minlength=count)
    some = np.maximum(1, held)
    length = ends - starts
    alike = np.flatnonzero((words.hashes[1:] == words.hashes[:-1]) & (passage[1:] == passage[:-1]))
    order = np.lexsort((words.hashes, passage))
    again = order[1:][(words.hashes[order[1:]] == words.hashes[order[:-1]]) & (passage[order[1:]] == passage[order[:-1]])]
    tally = lambda rows, weight=None: np.bincount(passage[rows], weights=weight, minlength=count) / some
    every = np.arange(len(passage))
    out[:, 9] = tally(every, length) / 12
    out[:, 10] = tally(np.flatnonzero(length <= 3))
    out[:, 11] = tally(np.flatnonzero(_KINDS[data[starts]] == 0))
    out[:, 12] = tally(alike)
    out[:, 13] = tally(again)
    out[:, 14] = kinds[:, 4] / some
    out[:, 15] = held / p.words
    near = ~edge[1:-1]
    bucket = (data[:-1].astype(np.uint32) * np.uint32(0x9E3779B1) + data[1:].astype(np.uint32) * np.uint32(0x85EBCA6B)) >> np.uint32(16)
    found = np.bincount(at[:-1][near] * p.pairs + (bucket[near] % p.pairs).astype(np.int64), minlength=count * p.pairs).reshape(count, p.pairs)
    out[:, _MEASURES:] = np.sqrt(found / np.maximum(1, sizes)[:, None])
    return out, owner


def _cut(data: np.ndarray, size: int) -> np.ndarray:
    """Offsets of parts of one text of about ``size`` bytes, cut after white space where there is any."""
    at = [0]
    while len(data) - at[-1] > size:
        blanks = np.flatnonzero(_SPACES[data[at[-1] : at[-1] + size]])
        at.append(at[-1] + (int(blanks[-1]) + 1 if len(blanks) else size))
    return np.array([*at, len(data)], dtype=np.int64)


def bags(texts: pa.Array, p: Params = Params()) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, vectors, owner) for groups of texts of about ``part_bytes`` in all; owners count from the first text."""
    data, offsets = utf8(texts)
    for begin, end in pieces(offsets, p.part_bytes):
        own = data[offsets[begin] : offsets[end]]
        if end - begin == 1 and len(own) > p.part_bytes:
            at = _cut(own, p.part_bytes)
            vectors = np.concatenate([encoded(own[lo:hi], np.array([0, hi - lo]), p)[0] for lo, hi in zip(at, at[1:], strict=False)])
            yield begin, end, vectors, np.zeros(len(vectors), dtype=np.int64)
        else:
            yield begin, end, *encoded(own, offsets[begin : end + 1] - offsets[begin], p)


@dataclass(frozen=True)
class Model:
    """What the fitted layers hold; without ``layers`` only a rate."""

    rate: float
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: dict[str, np.ndarray] | None = None

    def _forward(self, vectors: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = _forward(self.layers, (vectors - self.centre) / self.scale, np.flatnonzero(np.diff(owner, prepend=-1)), owner)
        return values["score"], values["a"]

    def scores(self, vectors: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """A score for each text; owners are 0, 1, and so on, in order."""
        if self.layers is None:
            return np.full(owner[-1] + 1 if len(owner) else 0, self.rate)
        return self._forward(vectors, owner)[0]

    def attention(self, vectors: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The weight of each passage in its text."""
        return 1 / np.bincount(owner)[owner] if self.layers is None else self._forward(vectors, owner)[1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _forward(layers: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> dict[str, np.ndarray]:
    """All that backward needs; ``starts`` are the first passages of the texts."""
    h = np.tanh(x @ layers["W"] + layers["b"])
    t, g = np.tanh(h @ layers["V"]), _sigmoid(h @ layers["U"])
    e = (t * g) @ layers["w"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[owner])
    a = e / np.add.reduceat(e, starts)[owner]
    z = np.add.reduceat(a[:, None] * h, starts)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "score": _sigmoid(z @ layers["c"] + layers["d"])}


def gradient(layers: dict[str, np.ndarray], x: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The weighted mean log loss and its slopes."""
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    v = _forward(layers, x, starts, owner)
    total = weight.sum()
    s = np.clip(v["score"], 1e-12, 1 - 1e-12)
    loss = float(-(weight * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum() / total)
    ds = weight * (v["score"] - y) / total
    dz = ds[:, None] * layers["c"]
    da = (dz[owner] * v["h"]).sum(axis=1)
    de = v["a"] * (da - np.add.reduceat(v["a"] * da, starts)[owner])
    gate = de[:, None] * layers["w"]
    dt, dg = gate * v["g"] * (1 - v["t"] ** 2), gate * v["t"] * v["g"] * (1 - v["g"])
    dh = v["a"][:, None] * dz[owner] + dt @ layers["V"].T + dg @ layers["U"].T
    dx = dh * (1 - v["h"] ** 2)
    return loss, {
        "W": x.T @ dx, "b": dx.sum(axis=0), "V": v["h"].T @ dt, "U": v["h"].T @ dg,
        "w": (v["t"] * v["g"]).T @ de, "c": v["z"].T @ ds, "d": ds.sum(keepdims=True),
    }


def fresh_layers(p: Params, rng: np.random.Generator) -> dict[str, np.ndarray]:
    wide = width(p)
    return {
        "W": rng.normal(0, wide**-0.5, (wide, p.hidden)), "b": np.zeros(p.hidden),
        "V": rng.normal(0, p.hidden**-0.5, (p.hidden, p.gates)), "U": rng.normal(0, p.hidden**-0.5, (p.hidden, p.gates)),
        "w": rng.normal(0, p.gates**-0.5, p.gates), "c": rng.normal(0, p.hidden**-0.5, p.hidden), "d": np.zeros(1),
    }


def fit(texts: list[np.ndarray], y: np.ndarray, rate: float, p: Params = Params()) -> Model:
    """A model from the passages of each text and its label; ``rate`` is the share of 1 among all labelled rows."""
    good = int(y.sum())
    if min(good, len(y) - good) < 4:
        return Model(rate)
    every = np.concatenate(texts)
    centre, scale = every.mean(axis=0), every.std(axis=0) + 1e-6
    texts = [(t - centre) / scale for t in texts]
    weight = np.where(y == 1, rate / y.mean(), (1 - rate) / (1 - y.mean()))
    rng = np.random.default_rng(p.seed)
    layers = fresh_layers(p, rng)
    mean, square = ({k: np.zeros_like(v) for k, v in layers.items()} for _ in range(2))
    order, at = rng.permutation(len(y)), 0
    for step in range(1, p.steps + 1):
        if at >= len(order):
            order, at = rng.permutation(len(y)), 0
        rows = order[at : at + p.bags]
        at += p.bags
        owner = np.repeat(np.arange(len(rows)), [len(texts[r]) for r in rows])
        _, slopes = gradient(layers, np.concatenate([texts[r] for r in rows]), owner, y[rows], weight[rows])
        pace = p.rate * (1 - 0.9 * step / p.steps)
        for k, v in layers.items():
            slope = slopes[k] + p.decay * v
            mean[k] = 0.9 * mean[k] + 0.1 * slope
            square[k] = 0.99 * square[k] + 0.01 * slope**2
            layers[k] = v - pace * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return Model(rate, centre, scale, layers)


def fold(doc_id: str | Column = "doc_id") -> Column:
    """The fold of a row, 0 to 4; null for a null id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(doc_id.cast("string")) % 5


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """A model from a bounded sample of the labelled rows outside fold 0."""
    known = labels.where(F.col("quality").isin(0, 1) & (fold() != 0)).groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("good"))
    counts = {r.good: r.n for r in known.groupBy("good").agg(F.count("*").alias("n")).collect()}  # two rows
    ids = [known.where(F.col("good") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.fit_rows) for kind in (0, 1)]
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")
    chosen = chosen.groupBy("doc_id", "good").agg(F.min("text").alias("text")).select(F.col("doc_id").cast("long").alias("doc_id"), "good", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 512):
            for begin, end, vectors, owner in bags(batch.column("text"), p):
                at = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(owner))
                some = [vectors[lo:hi][np.unique(np.linspace(0, hi - lo - 1, p.fit_passages).round().astype(int))] for lo, hi in zip(at, at[1:], strict=False)]
                rows = batch.slice(begin, end - begin)
                raw = pa.array([x.astype(np.float32).tobytes() for x in some], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("good"), raw], names=["doc_id", "good", "passages"])

    got = chosen.mapInArrow(encode, "doc_id long, good int, passages binary").toArrow().sort_by("doc_id")
    texts = [np.frombuffer(x, dtype=np.float32).reshape(-1, width(p)).astype(np.float64) for x in got.column("passages").to_pylist()]
    rate = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit(texts, got.column("good").to_numpy().astype(float), rate, p)


def score(docs: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    """(doc_id, score), one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2048):
            for begin, end, vectors, owner in bags(batch.column("text"), p):
                # Sums differ in their last digits by what else is in a batch.
                found = pa.array(np.round(model.scores(vectors, owner), 9), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, end - begin), found], names=["doc_id", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, score double")


def digest_row(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per document: its score, its prediction, and whether its label was held out."""
    scored = score(docs, train(docs, labels, p), p)
    held_out = F.coalesce(fold() == 0, F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
