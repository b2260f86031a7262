"""Byte-level BPE, with every distinct word of the corpus encoded once.

Texts are cut into pre-tokens by the vocabulary's pattern in Spark's own matcher. A block of
documents holds its pre-tokens as numbers into a list of distinct words, in order, which is their
position. The words of all blocks are shuffled by hash, packed, so that every distinct word meets
itself and is encoded once; ids go back to the blocks, and each block is put together again by
position. Decoding looks ids up in the token-byte table, which has as many rows as the vocabulary.

Null and empty texts have no tokens. Rows with equal or null ids are encoded one by one. A text is
encoded whole, however long: it may fill several blocks. Equal words have equal ids, and of two pairs that could merge
the one of the lower rank, then the first, does, so there are no ties. Empty tables give empty ones. Other
columns are left out, whatever they are called. The vocabulary file is read on the driver and sent to the
tasks; its size is fixed. The input is read three times, once for its size, and must give the same rows each time:
write it first if it doesn't.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced
from .hashing import pieces_hash, utf8

#: Pre-tokens in a block.
BLOCK = 800_000
#: Bytes of text for each bucket of words, so that a bucket's words fit a task at any size of input.
BUCKET = 8_000_000
#: Bytes of text for each shuffle partition, where that gives more than the session's setting.
SHARE = 64_000_000
#: Words longer than this, in bytes, are merged with a heap.
LONG = 64


@lru_cache(maxsize=4)
def ranks_of(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges the adjacent pair of least rank, the first of equal ones, until none is left."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > LONG:
        return _encode_long(word, ranks)
    # Places where parts begin, and the rank of each part with the next.
    at, none = list(range(len(word) + 1)), len(ranks) + 1
    known = [ranks.get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while known and (least := min(known)) < none:
        i = known.index(least)
        del at[i + 1], known[i]
        if i:
            known[i - 1] = ranks.get(word[at[i - 1] : at[i + 1]], none)
        if i < len(known):
            known[i] = ranks.get(word[at[i] : at[i + 2]], none)
    return [ranks[word[i:j]] for i, j in zip(at, at[1:])]


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap of pairs: (rank, place, end), stale when the place or the end has moved."""
    n = len(word)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (rank := ranks.get(word[i : after[j]])) is not None:
            heapq.heappush(heap, (rank, i, after[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or after[after[i]] != end:
            continue
        j = after[i]
        alive[j] = False
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [ranks[word[i : after[i]]] for i in range(n) if alive[i]]


def pre_tokens(docs: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, cut, odd): the text with a zero byte after each pre-token.

    ``odd`` is the text instead where it has zero bytes itself, or characters that Java's Unicode
    tables don't know yet and may class otherwise than the vocabulary's library.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    odd = F.rlike(text, F.lit(r"[\p{Cn}\x00]"))
    cut = F.regexp_replace(text, F.lit("(?U)" + pattern), F.lit("$0\0"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(~odd, cut).alias("cut"), F.when(odd, text).alias("odd"))


@dataclass
class _Block:
    """Documents with their pre-tokens, each ended by a zero byte."""

    number: int
    ids: np.ndarray
    present: np.ndarray
    counts: np.ndarray
    tokens: pa.Array

    def mark(self) -> int:
        """A digest of the pre-tokens in their order."""
        data, offsets = utf8(self.tokens)
        return xxhash.xxh64_intdigest(data, seed=len(offsets)) >> 1

    def words(self, buckets: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct words by bucket and then by text, the bucket of each, and the word of every pre-token."""
        coded = self.tokens.dictionary_encode()
        words = coded.dictionary
        data, offsets = utf8(words)
        bucket = (pieces_hash(data, offsets) % np.uint64(buckets)).astype(np.int64)
        order = pc.array_sort_indices(words.cast(pa.large_binary())).to_numpy().astype(np.int64)
        order = order[np.argsort(bucket[order], kind="stable")]
        place = np.empty(len(order), dtype=np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        return words.take(pa.array(order)), bucket[order], place[coded.indices.to_numpy()]


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[_Block]:
    made, part, slow = 0, TaskContext.get().partitionId(), regex.compile(pattern)
    for batch in sliced(batches, 1000):
        data, offsets = utf8(batch.column("cut"))
        ends = np.flatnonzero(data == 0) + 1
        edges = np.searchsorted(ends, offsets, side="right")
        at = np.concatenate(([0], ends)).astype(np.int64)
        tokens = pa.Array.from_buffers(pa.large_string(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(data.tobytes())])
        raw = np.array([x if x is not None else 0 for x in batch.column("doc_id").to_pylist()], dtype=np.int64)
        present = np.array(batch.column("doc_id").is_valid(), dtype=bool)
        usual = np.array(batch.column("cut").is_valid(), dtype=bool)
        counts = np.diff(edges)
        begin = 0
        while begin < len(raw):
            end = max(begin + 1, int(np.searchsorted(edges, edges[begin] + BLOCK, side="right")) - 1)
            own = np.flatnonzero(usual[begin:end]) + begin
            if len(own):
                yield _Block((part << 32) | made, raw[own], present[own], counts[own], tokens.slice(edges[begin], edges[end] - edges[begin]))
                made += 1
            begin = end
        for i in np.flatnonzero(~usual).tolist():
            found = [t + "\0" for t in slow.findall(batch.column("odd")[i].as_py())]
            yield _Block((part << 32) | made, raw[[i]], present[[i]], np.array([len(found)]), pa.array(found, pa.large_string()))
            made += 1


def _planes(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes, as high bytes are much alike."""
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _from_planes(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _words(pattern: str, buckets: int):
    """(bucket, block, mark, sizes, words): the distinct words of each block, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in _blocks(batches, pattern):
            words, bucket, _ = b.words(buckets)
            data, offsets = utf8(words)
            raw = data.tobytes()
            edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))).tolist() if len(bucket) else []
            rows = [(int(bucket[lo]), np.diff(offsets[lo : hi + 1]), raw[offsets[lo] : offsets[hi]]) for lo, hi in zip(edges, [*edges[1:], len(bucket)])]
            yield pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array([r[0] for r in rows], pa.int64()), "block": pa.array([b.number] * len(rows), pa.int64()), "mark": pa.array([b.mark()] * len(rows), pa.int64()),
                    "sizes": pa.array([_planes(r[1]) for r in rows], pa.binary()), "words": pa.array([press.compress(r[2]) for r in rows], pa.binary()),
                }
            )

    return run


def _numbers(pattern: str, buckets: int):
    """(block, mark, ids, present, counts, distinct, numbers): the documents of each block with the numbers of their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches, pattern):
            words, _, numbers = b.words(buckets)
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([b.number], pa.int64()), "mark": pa.array([b.mark()], pa.int64()), "ids": [b.ids.tobytes()], "present": [b.present.tobytes()],
                    "counts": [b.counts.astype(np.int64).tobytes()], "distinct": pa.array([len(words)], pa.int64()), "numbers": [_planes(numbers)],
                }
            )

    return run


def _encoded(raw_ranks):
    """(block, mark, bucket, sizes, ids) of rows sorted by bucket; each distinct word of a bucket is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, open_ = ranks_of(raw_ranks.value), zstandard.ZstdDecompressor()
        now, done = None, {}
        for batch in sliced(batches, 200):
            buckets = batch.column("bucket").to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1]))).tolist()
            for lo, hi in zip(edges, [*edges[1:], batch.num_rows]):
                if buckets[lo] != now:
                    now, done = buckets[lo], {}
                part = batch.slice(lo, hi - lo)
                lengths = [_from_planes(x.as_py()).astype(np.int64) for x in part.column("sizes")]
                raw = b"".join(open_.decompress(x.as_py()) for x in part.column("words"))
                at = np.concatenate(([0], np.cumsum(np.concatenate(lengths))))
                coded = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw)]).dictionary_encode()
                own: list[list[int]] = []
                for word in coded.dictionary.to_pylist():
                    found = done.get(word)
                    if found is None:
                        found = done[word] = encode_word(word[:-1], known)  # without the zero byte
                    own.append(found)
                size = np.array([len(x) for x in own], dtype=np.int64)
                flat = np.array([t for x in own for t in x], dtype=np.uint32)
                which = coded.indices.to_numpy()
                sizes, ids = size[which], _gathered(flat, size, which)
                ends = np.cumsum([len(x) for x in lengths])
                cuts = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], ends))]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("block"), part.column("mark"), part.column("bucket"),
                        pa.array([_planes(sizes[i:j]) for i, j in zip([0, *ends[:-1]], ends)], pa.binary()), pa.array([_planes(ids[i:j]) for i, j in zip(cuts, cuts[1:])], pa.binary()),
                    ],
                    names=["block", "mark", "bucket", "sizes", "ids"],
                )

    return run


def _gathered(flat: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` that ``which`` names, end to end; stretch i has ``size[i]`` entries."""
    starts, n = np.cumsum(size) - size, size[which]
    ends = np.concatenate(([0], np.cumsum(n)))
    return flat[np.repeat(starts[which] - ends[:-1], n) + np.arange(ends[-1])]


def _assemble(block: pa.Table, words: pa.Table) -> pa.Table:
    """Token ids of the documents of a block."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    order = np.argsort(words.column("bucket").to_numpy()).tolist()
    sizes = [_from_planes(words.column("sizes")[i].as_py()) for i in order]
    if block.num_rows != 1 or sum(map(len, sizes)) != block.column("distinct")[0].as_py():
        raise ValueError("the documents changed between two reads; write them first")
    ids, present, counts = (np.frombuffer(block.column(c)[0].as_py(), dtype=t) for c, t in (("ids", np.int64), ("present", bool), ("counts", np.int64)))
    at = _from_planes(block.column("numbers")[0].as_py()).astype(np.int64)
    flat = [_from_planes(words.column("ids")[i].as_py()) for i in order]
    none = np.zeros(0, dtype=np.uint32)
    size, token = np.concatenate([none, *sizes]).astype(np.int64), np.concatenate([none, *flat])
    tokens = _gathered(token, size, at)
    ends = np.concatenate(([0], np.cumsum(size[at])))
    edges = ends[np.concatenate(([0], np.cumsum(counts)))]
    return pa.table(
        {
            "doc_id": pa.array(ids, pa.int64(), mask=~present),
            "ids": pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(tokens.astype(np.int32))),
        },
        schema=schema,
    )


def _sent(spark: SparkSession, path: str):
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): token ids by the ranks in the file, without special tokens."""
    spark = docs.sparkSession
    size = docs.select(F.sum(F.octet_length(F.col("text").cast("string")).cast("long")).alias("n")).first().n or 0
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets, parts = max(usual, math.ceil(size / BUCKET)), max(usual, math.ceil(size / SHARE))
    cut = pre_tokens(docs, pattern)
    numbered = cut.mapInArrow(_numbers(pattern, buckets), "block long, mark long, ids binary, present binary, counts binary, distinct long, numbers binary")
    words = cut.mapInArrow(_words(pattern, buckets), "bucket long, block long, mark long, sizes binary, words binary")
    met = words.repartition(parts, "bucket").sortWithinPartitions("bucket")
    back = met.mapInArrow(_encoded(_sent(spark, path)), "block long, mark long, bucket long, sizes binary, ids binary")
    left, right = (x.repartition(parts, "block", "mark").groupBy("block", "mark") for x in (numbered, back))
    return left.cogroup(right).applyInArrow(_assemble, "doc_id long, ids array<int>")


def _decoder(raw: bytes):
    """Bytes of lists of ids, by the token-byte table."""
    known = ranks_of(raw)
    by_id: list[bytes] = [b""] * (max(known.values()) + 1)
    for token, rank in known.items():
        by_id[rank] = token
    table = pa.array(by_id, pa.large_binary())

    def decoded(lists: pa.Array) -> list[memoryview]:
        """The taken bytes lie end to end, so each list is one stretch of them."""
        size = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())))
        taken = table.take(lists.flatten())
        _, offsets, data = taken.buffers()
        ends = np.frombuffer(offsets, dtype=np.int64)[taken.offset :][size] if len(taken) else np.zeros(len(size), dtype=np.int64)
        view = memoryview(data) if data is not None else memoryview(b"")
        return [view[i:j] for i, j in zip(ends.tolist(), ends[1:].tolist())]

    return decoded


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded``, the bytes of the ids; null arrays of ids give no bytes."""
    ranks = _sent(encoded.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded = _decoder(ranks.value)
        for batch in sliced(batches, 1000):
            out = pa.array([bytes(x) for x in decoded(batch.column("ids"))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, "decoded"])

    schema = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes)
    return encoded.mapInArrow(run, f"{schema}, decoded binary")


def digest_row(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: its tokens, and digests of its ids and of the bytes they decode to."""
    ranks = _sent(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoded = _decoder(ranks.value)
        for batch in sliced(batches, 1000):
            lists = batch.column("ids")
            flat = lists.flatten().to_numpy().astype("<u4", copy=False)
            ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy()))).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pc.list_value_length(lists).cast(pa.int64()),
                    pa.array([hashlib.sha256(flat[i:j].tobytes()).hexdigest() for i, j in zip(ends, ends[1:])]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in decoded(lists)]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return encode(docs, path, pattern).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
