"""Toxicity by compression distance.

Two zstandard dictionaries are made: one of ordinary text, drawn evenly over all texts that are
fitted on, and one that adds the stretches which set toxic text apart. Windows that the second
compresses better hold such stretches. The lengths saved over a document's windows, and nothing
else, are calibrated to a probability on rows that took no part in the dictionaries; 0.5 is the
threshold. Dictionaries of zstandard's own training on whole texts of each class tell far less, as
the few toxic words drown in common syllables; the README has figures.

Fitting uses a bounded sample (``Params.fit_rows`` of each class); scoring reads every whole
text, however long. Labels, language, source and id never enter a score. Null texts are scored
like empty ones. With labels of one class only, or none, every score is the rate seen, or 0.
Repeated rows are scored one by one. A row with a null id is held out. An id labelled more
than once is toxic if any of its labels says so; of several texts of one id the least is fitted on.
Rows that compress alike score alike. Empty tables give empty ones, and other columns are left
out, whatever they are called.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    """``fit_rows``: labelled rows of each class that are fitted on, at most, half of them for the dictionaries.

    Windows have ``window`` bytes, each begins ``step`` after the one before. Runs of ``gram`` bytes
    set toxic text apart when they are in ``least`` of its texts and ``times`` as common as elsewhere; the
    ``stretches`` commonest joins of them are kept. The ordinary dictionary has ``ordinary_bytes``. ``level`` is
    the compressor's.
    """

    fit_rows: int = 2000
    window: int = 48
    step: int = 36
    level: int = 3
    gram: int = 5
    least: float = 0.015
    times: float = 20.0
    stretches: int = 600
    ordinary_bytes: int = 60_000


@dataclass(frozen=True)
class Model:
    """Dictionaries, and the centre, scale and weights of the calibration; without dictionaries only a rate."""

    rate: float
    ordinary: bytes = b""
    toxic: bytes = b""
    centre: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()


def _plain(text: str | None) -> bytes:
    """Lower case, words between single spaces."""
    return b" " + b" ".join((text or "").lower().encode("utf-8", "replace").split()) + b" "


def _texts_with(texts: list[bytes], gram: int) -> Counter:
    found: Counter = Counter()
    for b in texts:
        found.update({b[i : i + gram] for i in range(len(b) - gram + 1)})
    return found


def _stretches(toxic: list[bytes], ordinary: list[bytes], p: Params) -> bytes:
    """The commonest stretches made of runs that set toxic text apart; the commonest last."""
    here, there = _texts_with(toxic, p.gram), _texts_with(ordinary, p.gram)
    least, times = max(5, p.least * len(toxic)), p.times * len(toxic) / max(1, len(ordinary))
    telling = {g for g, n in here.items() if n >= least and n >= times * (there[g] + 0.5)}
    found: Counter = Counter()
    for b in toxic:
        begin = None
        for i in range(len(b) - p.gram + 2):
            if b[i : i + p.gram] in telling:
                begin = i if begin is None else begin
            elif begin is not None:
                found[b[begin : i + p.gram - 1]] += 1
                begin = None
    ranked = sorted(found, key=lambda s: (-found[s], s))[: p.stretches]
    return b"".join(reversed(ranked))


def _drawn(texts: list[bytes], size: int, window: int) -> bytes:
    """Windows at even distances over all texts, about ``size`` bytes in all."""
    step = max(window, sum(map(len, texts)) * window // size)
    out, at, due = [], 0, step // 2
    for b in texts:
        while due < at + len(b):
            begin = max(0, min(due - at, len(b) - window))
            out.append(b[begin : begin + window])
            due += step
        at += len(b)
    return b"".join(out)


class Scorer:
    """Measures and scores texts with a model."""

    def __init__(self, model: Model, p: Params):
        self.model, self.p = model, p
        self._ordinary, self._toxic = (self._press(d) for d in (model.ordinary, model.toxic))

    def _press(self, content: bytes):
        if not content:
            return None
        entry = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        entry.precompute_compress(level=self.p.level)
        return zstandard.ZstdCompressor(
            dict_data=entry, level=self.p.level, write_content_size=False, write_checksum=False, write_dict_id=False
        ).compress

    def measures(self, text: str | None) -> list[float]:
        b, p = _plain(text), self.p
        windows = [b[i : i + p.window] for i in range(0, max(1, len(b) - (p.window - p.step)), p.step)]
        ordinary, toxic = self._ordinary, self._toxic
        saved = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows], dtype=float)
        top = np.sort(saved)[-3:]
        return [top[-1], top.mean(), saved.mean(), float((saved >= 2).mean()), float((saved >= 3).mean())]

    def scores(self, measured: np.ndarray) -> np.ndarray:
        x = _expanded((measured - np.array(self.model.centre)) / np.array(self.model.scale))
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.model.weights), -40, 40)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self._toxic is None or not texts:
            return np.full(len(texts), self.model.rate)
        return self.scores(np.array([self.measures(t) for t in texts]))


def _expanded(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, x * x, np.ones((len(x), 1))], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        slope = x.T @ (weight * (p - y)) + 0.1 * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w - np.linalg.solve(bend, slope)
    return w


def fit(toxic: list[str | None], ordinary: list[str | None], rate: float, p: Params = Params()) -> Model:
    """A model from texts of both classes; ``rate`` is the share of toxic rows among all labelled ones."""
    bad, good = (list(dict.fromkeys(texts)) for texts in (toxic, ordinary))
    if len(bad) < 4 or len(good) < 4:
        return Model(rate)
    bad_half, good_half = [_plain(t) for t in bad[::2]], [_plain(t) for t in good[::2]]
    common = _drawn(good_half, p.ordinary_bytes, p.window)
    own = _stretches(bad_half, good_half, p)
    if not own:
        return Model(rate)
    scorer = Scorer(Model(rate, common, common + own), p)
    rest = [*bad[1::2], *good[1::2]]
    y = np.array([1.0] * len(bad[1::2]) + [0.0] * len(good[1::2]))
    x = np.array([scorer.measures(t) for t in rest])
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    # Classes count as often as among all labelled rows.
    weight = np.where(y == 1, rate / y.mean(), (1 - rate) / (1 - y.mean()))
    w = _logistic(_expanded((x - centre) / scale), y, weight)
    return Model(rate, common, common + own, tuple(centre), tuple(scale), tuple(w))


def bucket(doc_id: str | Column = "doc_id") -> Column:
    """The fold of a row, 0 to 4; null for a null id."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(doc_id.cast("string")) % 5


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Model:
    """A model from a sample of the labelled rows outside fold 0, chosen by a hash of the id."""
    known = labels.where(F.col("toxic").isin(0, 1) & (bucket() != 0)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    texts: dict[int, list[str | None]] = {}
    for kind in (0, 1):
        ids = known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.fit_rows).select("doc_id")
        rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).toArrow()
        order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
        texts[kind] = rows.column("text").take(pa.array(order)).to_pylist()
    rate = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit(texts[1], texts[0], rate, p)


def score(docs: DataFrame, model: Model, p: Params = Params()) -> DataFrame:
    """(doc_id, score), one row a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model, p)
        for batch in batches:
            found = scorer.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, score double")


def digest_row(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per document: its score, its prediction, and whether its label was held out."""
    scored = score(docs, train(docs, labels, p), p)
    held_out = F.coalesce(bucket() == 0, F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
