"""Runs of periodic words, found through Lyndon words, and texts collapsed to one period of each.

A run is a stretch of words with smallest period q that no neighbouring word extends. Every run of
at least two periods holds its Lyndon root under one of two opposite orders of words, and there the
root is the longest Lyndon word that starts at its first word. So a stack scanned from right to
left, once under each order, names every pair (start, period) that can begin a run. Suffixes that
begin alike are compared by rolling hashes and binary search, and what hashes call equal is held
against the words themselves, so that results are exact: hashes can only call too much equal.

Texts lie end to end as numbered words, each followed by 0, which is less than any word under
either order. Candidates are screened over whole batches by numpy. A text takes time in proportion
to its words times the logarithm of their number. Nothing is shuffled: texts are independent, and
where rows lie decides no result.

Null texts are empty ones and have no runs. A text is handled whole, however long; batches are cut
to ``Params.batch_words`` words, or one text if that is longer. Ties can't occur between runs, as
no two share start and period. Repeated rows give repeated results. Rows of a null id are kept. Empty tables give
empty ones. Callers' columns stay, but those that a function adds replace columns of the same name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sliced

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Params:
    """Runs have at least ``least`` words and ``times`` periods, which must be 3 or more.

    Tasks work on texts of about ``batch_words`` words at a time.
    """

    least: int = 6
    times: int = 4
    batch_words: int = 100_000


class _Numbered:
    """Texts as numbers of words, each text ended by 0, with prefix sums for hashes of any stretch."""

    def __init__(self, texts: list[list[bytes]]):
        known: dict[bytes, int] = {}
        ids: list[int] = []
        self.bounds: list[tuple[int, int]] = []
        for words in texts:
            begin = len(ids)
            ids += [known.setdefault(w, len(known) + 1) for w in words]
            self.bounds.append((begin, len(ids)))
            ids.append(0)
        self.ids, self.top = ids, len(known) + 1
        self.array = np.array(ids, dtype=np.int32)
        self.raw = self.array.tobytes()
        spread = np.random.default_rng(12).integers(1, 1 << 63, self.top + 1, dtype=np.uint64)
        self.up = np.full(len(ids) + 1, _BASE, dtype=np.uint64)
        self.up[0] = 1
        np.cumprod(self.up, out=self.up)
        self.sums = np.zeros(len(ids) + 1, dtype=np.uint64)
        np.cumsum(spread[self.array] * self.up[:-1], out=self.sums[1:])
        self.up_list, self.sums_list = self.up.tolist(), self.sums.tolist()
        #: By distance, the last stretch [lo, hi) over which words were seen to equal those so far on.
        self.equal: dict[int, tuple[int, int]] = {}

    def alike(self, i: int, j: int, n: int) -> bool:
        """Whether hashes call the n words from i and from j on, i < j, equal."""
        s = self.sums_list
        return ((s[i + n] - s[i]) * self.up_list[j - i] - s[j + n] + s[j]) & _MASK == 0

    def same(self, i: int, j: int, n: int) -> int:
        """How many of the n words from i and from j on are equal, by the words themselves."""
        lo, hi = self.equal.get(j - i, (0, 0))
        if lo <= i + n <= hi and i >= lo:
            return n
        # Of a stretch that overlaps the last one at this distance only the new words are compared.
        new = max(0, lo - i) if i <= lo <= i + n <= hi else n
        raw = self.raw
        if raw[4 * i : 4 * (i + new)] != raw[4 * j : 4 * (j + new)]:
            return int(np.argmax(self.array[i : i + new] != self.array[j : j + new]))
        if n >= j - i:
            self.equal[j - i] = (i, max(hi, i + n)) if new < n else (i, i + n)
        return n

    def ahead(self, i: int, j: int, room: int) -> int:
        """The number of equal words from i and from j on, i < j, at most ``room``."""
        known, end = self.equal.get(j - i, (0, 0))
        if i < known <= i + 64 and self.raw[4 * i : 4 * known] == self.raw[4 * j : 4 * (known + j - i)]:
            self.equal[j - i] = (i, end)
            return end - i
        lo, hi = 0, 1
        while hi <= room and self.alike(i, j, hi):
            lo, hi = hi, 2 * hi
        hi = min(hi, room + 1)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.alike(i, j, mid) else (lo, mid)
        return self.same(i, j, lo)

    def behind(self, i: int, j: int, room: int) -> int:
        """The number of equal words before i and before j, i < j, at most ``room``."""
        lo, hi = 0, room + 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.alike(i - mid, j - mid, mid) else (lo, mid)
        differ = np.flatnonzero(self.array[i - lo : i] != self.array[j - lo : j])
        return lo - 1 - int(differ[-1]) if len(differ) else lo

    def next_less(self, words: list[int]) -> np.ndarray:
        """For each word where the next lesser suffix begins, under the order of ``words``: the end of the longest Lyndon word there."""
        after = list(range(1, len(words) + 1))
        for begin, end in self.bounds:
            for i in range(end - 1, begin - 1, -1):
                x, j = words[i], i + 1
                while (y := words[j]) >= x:
                    if y == x:
                        u, v = words[i + 1], words[j + 1]
                        if u == v:
                            n = self.ahead(i, j, end - j)
                            u, v = words[i + n], words[j + n]
                        if v < u:
                            break
                    j = after[j]
                after[i] = j
        return np.array(after, dtype=np.int64)

    def candidates(self, times: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and periods where the root occurs ``times`` - 1 times in a row, in the order of starts."""
        n = len(self.ids)
        ends = np.repeat([end for _, end in self.bounds], [end + 1 - begin for begin, end in self.bounds])
        opposite = [self.top - x if x else 0 for x in self.ids]
        keys = []
        for words in (self.ids, opposite):
            after = self.next_less(words)
            self.equal.clear()
            i = np.flatnonzero((self.array > 0) & (after + (times - 2) * (after - np.arange(n)) <= ends))
            j = after[i]
            fit = self.array[i] == self.array[j]
            i, j = i[fit], j[fit]
            more = (times - 2) * (j - i)
            fit = (self.sums[i + more] - self.sums[i]) * self.up[j - i] == self.sums[j + more] - self.sums[j]
            keys.append(i[fit] * (n + 1) + (j - i)[fit])
        both = np.unique(np.concatenate(keys))
        return both // (n + 1), both % (n + 1)

    def runs(self, p: Params) -> list[list[tuple[int, int, int]]]:
        """(start, length, period) of every run of each text, by start and period."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in self.bounds]
        last: dict[int, tuple[int, int]] = {}
        at = 0
        for i, q in zip(*(x.tolist() for x in self.candidates(p.times)), strict=True):
            lo, hi = last.get(q, (0, 0))
            if i >= lo and i + 2 * q <= hi:
                continue  # the same run
            while self.bounds[at][1] <= i:
                at += 1
            begin, end = self.bounds[at]
            start = i - self.behind(i, i + q, i - begin)
            stop = i + q + self.ahead(i, i + q, end - i - q)
            last[q] = (start, stop)
            if stop - start >= max(p.least, p.times * q):
                found[at].append((start - begin, stop - start, q))
        return [sorted(set(x), key=lambda r: (r[0], r[2])) for x in found]


def runs_of(texts: list[list[bytes]], p: Params = Params()) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each list of words, by start and period."""
    return _Numbered(texts).runs(p)


def kept(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    out, at = [], 0
    for lo, hi in sorted((start + period, start + length) for start, length, period in runs):
        out += words[at:lo]
        at = max(at, hi)
    return out + words[at:]


def _batches(batches: Iterator[pa.RecordBatch], p: Params, changed=None) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]], list[list[tuple[int, int, int]]]]]:
    """Rows with the words and the runs of their texts, about ``p.batch_words`` words at a time."""
    for batch in sliced(batches, 4096):
        texts = batch.column("_text").cast(pa.large_binary())
        begin, words, count = 0, [], 0
        for row in range(batch.num_rows):
            own = (texts[row].as_py() or b"").split()
            words.append(own if changed is None else changed(own, batch.column("_id")[row].as_py()))
            count += len(own) + 1
            if count >= p.batch_words or row == batch.num_rows - 1:
                yield batch.slice(begin, row + 1 - begin), words, runs_of(words, p)
                begin, words, count = row + 1, [], 0


_RUNS = "array<struct<start: long, length: long, period: long>>"
_RUNS_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _extended(docs: DataFrame, p: Params, column: str, kind: str, arrow: pa.DataType, value) -> DataFrame:
    """The table with one more column, made from the words and the runs of each text."""
    names = [c for c in docs.columns if c.lower() != column]
    hidden = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.col("text").cast("string").alias("_text"))
    schema = T.StructType([*[T.StructField(f"c{i}", docs.schema[c].dataType) for i, c in enumerate(names)], T.StructField("v", T.DataType.fromDDL(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, runs in _batches(batches, p):
            made = pa.array([value(w, r) for w, r in zip(words, runs, strict=True)], arrow)
            yield pa.RecordBatch.from_arrays([*[batch.column(f"c{i}") for i in range(len(names))], made], names=[*[f"c{i}" for i in range(len(names))], "v"])

    out = hidden.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], F.col("v").alias(column))


def runs(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The table with a column ``runs``: start, length and period of each run of the text's words."""
    return _extended(docs, p, "runs", _RUNS, _RUNS_TYPE, lambda _, found: [dict(zip(("start", "length", "period"), r, strict=True)) for r in found])


def collapse(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The table with a column ``collapsed``: the text's words less what runs repeat, joined by single spaces."""
    return _extended(docs, p, "collapsed", "string", pa.string(), lambda words, found: b" ".join(kept(words, found)).decode("utf-8", "replace"))


def damaged(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of every tenth document, by a hash of its id, made periodic from some word on; a null id changes nothing."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (1 + (n - a) // p))[: n - a]


_DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _digest(words: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:  # listed by start and period, so the first of equals stays
            best = r
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    shas = hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept(words, found))).hexdigest()
    return (len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, *shas)


def digest_row(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per document, some damaged first: its runs, the one of most periods, and hashes of runs and collapsed words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.string()] * 2
        names = [x.split()[0] for x in _DIGEST.split(", ")]
        for batch, words, found in _batches(batches, p, damaged):
            made = zip(*(_digest(w, r) for w, r in zip(words, found, strict=True)), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *(pa.array(v, k) for v, k in zip(made, kinds, strict=True))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text")).mapInArrow(run, _DIGEST)
