"""Removal of repeated passages by seed and extend.

Texts are packed in blocks. Winnowing picks anchors (runs of ``SEED`` words) so that any two
equal windows of ``LENGTH`` words pick the same anchor at the same place. Anchors that occur
twice or more anywhere are seeds; around each, the windows it stands for extend the match both
ways, and windows are equal where anchor and window agree in 64 bits each. Of equal windows the
one that starts first, by document and place, stays; words under all others go, so that maximal
repeats of at least ``LENGTH`` words leave one copy.

Within a block only the first of equal windows is sent on, so an equal window comes at most once
a block. An anchor at more than ``PLACES`` places, such as a common phrase in ever new
surroundings, has its windows dealt by their hash, as only equal ones need to meet.

Null and empty texts have no words. Null ids come before all others; rows with equal ids, and
repeated rows, count as separate documents in block order. A very long text is in one block with
its like. An empty table gives an empty one; other columns are left out, whatever they are called.
The input is read more than once and must give the same rows each time: write it first if it
doesn't.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import runs, sliced
from .hashing import Words, utf8, words_of

LENGTH = 20
SEED = 7
REACH = LENGTH - SEED
#: Bytes of text in a block.
BLOCK = 1_000_000
#: Places of an anchor whose windows meet in one task; with more, windows are dealt into parts.
PLACES = 10_000

_BLOCK = "block long, ids binary, present binary, offsets binary, data binary"
_CANDIDATE = "anchor long, part long, doc_id long, block long, at int, offsets int, hashes binary"
_DECIDED = "block long, at int, again int"
_RESULT = "doc_id long, n_words long, n_removed long, kept binary, repeats array<struct<first:int,last:int>>"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents, sorted by id, with the text compressed."""
    held: list[tuple[int, bool, bytes]] = []
    size, made, part = 0, 0, TaskContext.get().partitionId()
    squeeze = zstandard.ZstdCompressor(level=3)

    def block() -> pa.RecordBatch:
        held.sort(key=lambda x: (x[1], x[0]))
        offsets = np.cumsum([0, *(len(x[2]) for x in held)]).astype(np.int64)
        return pa.RecordBatch.from_pydict(
            {
                "block": pa.array([(part << 32) | made], pa.int64()),
                "ids": [np.array([x[0] for x in held], dtype=np.int64).tobytes()],
                "present": [np.array([x[1] for x in held], dtype=bool).tobytes()],
                "offsets": [offsets.tobytes()],
                "data": [squeeze.compress(b"".join(x[2] for x in held))],
            }
        )

    for batch in sliced(batches, 1000):
        for key, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            held.append((key.as_py() if key.is_valid else 0, key.is_valid, raw))
            size += len(raw) + 16
            if size >= BLOCK:
                yield block()
                held, size, made = [], 0, made + 1
    if held:
        yield block()


class _Block:
    """A block with its words, anchors and windows."""

    def __init__(self, block: int, ids: bytes, present: bytes, offsets: bytes, data: bytes):
        self.block = block
        self.ids, self.present = np.frombuffer(ids, dtype=np.int64), np.frombuffer(present, dtype=bool)
        self.offsets = np.frombuffer(offsets, dtype=np.int64)
        self.data = zstandard.ZstdDecompressor().decompress(data) if self.offsets[-1] else b""
        self.words: Words = words_of(np.frombuffer(self.data, dtype=np.uint8), self.offsets)
        self.starts = np.flatnonzero(self.words.whole(LENGTH))
        self.seeds = self.words.runs(SEED)
        if len(self.starts):
            around = np.lib.stride_tricks.sliding_window_view(self.seeds, REACH + 1)
            self.anchor_at = self.starts + around[self.starts].argmin(axis=1)
        else:
            self.anchor_at = np.zeros(0, dtype=np.int64)

    @classmethod
    def of(cls, row: pa.Table, i: int = 0) -> _Block:
        return cls(*(row.column(c)[i].as_py() for c in ("block", "ids", "present", "offsets", "data")))

    def windows(self) -> np.ndarray:
        """The hash of each window."""
        return self.words.runs(LENGTH, salt=0x5DEECE66D)[self.starts]

    def first(self, hashes: np.ndarray) -> np.ndarray:
        """Which windows are the first of their kind in the block."""
        own = np.zeros(len(hashes), dtype=bool)
        own[np.unique(np.stack([hashes, self.seeds[self.anchor_at]]).T.copy().view("V16").ravel(), return_index=True)[1]] = True
        return own


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, block, n): each anchor of a block once, and at how many places."""
    for batch in sliced(batches, 1000):
        for i in range(batch.num_rows):
            b = _Block.of(batch, i)
            anchors, n = np.unique(b.seeds[np.unique(b.anchor_at)], return_counts=True)
            yield pa.RecordBatch.from_pydict(
                {
                    "anchor": anchors.view(np.int64),
                    "block": np.full(len(anchors), b.block, dtype=np.int64),
                    "n": n.astype(np.int64),
                }
            )


def _candidates(block: pa.Table, seeds: pa.Table) -> pa.Table:
    """The windows around the seeds of a block, the first of equal ones only, by anchor place and part."""
    schema = pa.schema([("anchor", pa.int64()), ("part", pa.int64()), ("doc_id", pa.int64()), ("block", pa.int64()), ("at", pa.int32()), ("offsets", pa.int32()), ("hashes", pa.binary())])
    if not block.num_rows or not seeds.num_rows:
        return schema.empty_table()
    b = _Block.of(block)
    shared = seeds.column("anchor").to_numpy().view(np.uint64)
    by_anchor = np.argsort(shared)
    shared, parts = shared[by_anchor], seeds.column("parts").to_numpy()[by_anchor].astype(np.uint64)
    hashes = b.windows()
    anchors = b.seeds[b.anchor_at]
    place = np.minimum(np.searchsorted(shared, anchors), len(shared) - 1)
    use = np.flatnonzero((shared[place] == anchors) & b.first(hashes))
    if not len(use):
        return schema.empty_table()
    part = (hashes[use] % parts[place[use]]).astype(np.int64)
    order = np.lexsort((part, b.anchor_at[use]))
    use, part = use[order], part[order]
    at, bit = b.anchor_at[use], b.anchor_at[use] - b.starts[use]
    begins = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (part[1:] != part[:-1]))))
    masks = np.add.reduceat(np.left_shift(1, bit), begins)
    doc = np.searchsorted(b.words.first, at[begins], side="right") - 1
    ends = np.concatenate((begins[1:], [len(use)])).astype(np.int64)
    buffers = [None, pa.py_buffer((np.concatenate(([0], ends)) * 8).astype(np.int32)), pa.py_buffer(hashes[use].tobytes())]
    ids = np.where(b.present[doc], b.ids[doc], np.iinfo(np.int64).min)
    return pa.table(
        {
            "anchor": anchors[use][begins].view(np.int64),
            "part": part[begins],
            "doc_id": ids,
            "block": np.full(len(begins), b.block, dtype=np.int64),
            "at": at[begins].astype(np.int32),
            "offsets": masks.astype(np.int32),
            "hashes": pa.Array.from_buffers(pa.binary(), len(begins), buffers),
        },
        schema=schema,
    )


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per candidate row, the windows that start earlier elsewhere. Sorted by anchor and part, then place."""
    for part in runs(batches, ["anchor", "part"]):
        sizes = np.array([len(x) // 8 for x in part.column("hashes").to_pylist()], dtype=np.int64)
        flat = np.frombuffer(b"".join(part.column("hashes").to_pylist()), dtype=np.uint64)
        row = np.repeat(np.arange(part.num_rows), sizes)
        anchor = part.column("anchor").to_numpy()[row]
        order = np.lexsort((np.arange(len(flat)), flat, anchor))
        again = np.zeros(len(flat), dtype=bool)
        again[order[1:]] = (flat[order[1:]] == flat[order[:-1]]) & (anchor[order[1:]] == anchor[order[:-1]])
        if not again.any():
            continue
        masks = part.column("offsets").to_numpy()
        # The windows of a row are in order of their start, that is, of falling offset.
        bits = np.concatenate([np.flatnonzero([m >> j & 1 for j in range(REACH + 1)])[::-1] for m in masks.tolist()])
        flagged = np.zeros(part.num_rows, dtype=np.int64)
        np.add.at(flagged, row[again], np.left_shift(1, bits[again]))
        keep = np.flatnonzero(flagged)
        yield pa.RecordBatch.from_pydict(
            {
                "block": part.column("block").to_numpy()[keep],
                "at": part.column("at").to_numpy()[keep],
                "again": flagged[keep].astype(np.int32),
            }
        )


def _removed(block: pa.Table, again: pa.Table) -> pa.Table:
    """The documents of a block without repeated words."""
    stretch = pa.struct([("first", pa.int32()), ("last", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()), ("repeats", pa.list_(stretch))])
    if not block.num_rows:
        return schema.empty_table()
    b = _Block.of(block)
    n = len(b.words.hashes)
    edges = np.zeros(n + 1, dtype=np.int32)
    gone = [b.starts[~b.first(b.windows())]] if len(b.starts) else []
    at, masks = again.column("at").to_numpy(), again.column("again").to_numpy()
    gone += [at[(masks >> j & 1) > 0] - j for j in range(REACH + 1)]
    for starts in gone:
        np.add.at(edges, starts, 1)
        np.add.at(edges, starts + LENGTH, -1)
    keep = np.cumsum(edges)[:n] == 0
    kept, counts, repeats = [], [], []
    for first, last, begin, end in zip(b.words.first, b.words.last, b.offsets[:-1], b.offsets[1:], strict=True):
        words = b.data[begin:end].split()
        own = keep[first:last]
        counts.append(int(len(own) - own.sum()))
        ends = np.flatnonzero(np.diff(np.concatenate(([True], own, [True])).astype(np.int8))).tolist() if counts[-1] else []
        repeats.append([{"first": i, "last": j} for i, j in zip(ends[::2], ends[1::2])])
        kept.append(b" ".join(words if own.all() else compress(words, own.tolist())))
    return pa.table(
        {
            "doc_id": pa.array(b.ids, pa.int64(), mask=~b.present),
            "n_words": (b.words.last - b.words.first).astype(np.int64),
            "n_removed": np.array(counts, dtype=np.int64),
            "kept": pa.array(kept, pa.binary()),
            "repeats": pa.array(repeats, pa.list_(stretch)),
        },
        schema=schema,
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, repeats): kept words joined by single spaces, as UTF-8 bytes.

    ``repeats`` are the maximal stretches of words that are gone, from ``first`` up to before ``last``, each of at
    least ``LENGTH`` words.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = slim.mapInArrow(_packed, _BLOCK)
    anchors = blocks.mapInArrow(_anchors, "anchor long, block long, n long")
    seeds = anchors.withColumn("all", F.sum("n").over(W.partitionBy("anchor"))).where(F.col("all") > 1)
    seeds = seeds.select("block", "anchor", F.ceil(F.col("all") / PLACES).alias("parts"))
    candidates = blocks.groupBy("block").cogroup(seeds.groupBy("block")).applyInArrow(_candidates, _CANDIDATE)
    sorted_ = candidates.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "doc_id", "block", "at")
    again = sorted_.mapInArrow(_decide, _DECIDED)
    return blocks.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(_removed, _RESULT)


def digest_row(docs: DataFrame) -> DataFrame:
    """One row per document, with a digest of the kept words."""
    kept = remove_repeats(docs)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))

