"""Near-duplicate documents by min-max hashing.

A document is its set of distinct word shingles. Each permutation gives two signature entries,
the minimum and the maximum, so half the hash evaluations of plain minimum hashing fill a
signature. Bands of entries bring candidates together; every link is then confirmed on the full
sets.

Equal sets are one node from the start. In each band, a node meets the ``PIVOTS`` least nodes of
its bucket. Where the links found leave a larger bucket unconnected, its nodes meet nodes of other
components by their rarest shingles, which loses no link, so large groups of like documents cost
a few comparisons each.

Null, empty and blank texts have an empty set and are linked with nothing. Repeated rows are
copies; rows with equal or null ids are kept apart. Very long texts are read whole. Of equally small
signatures and equally rare shingles the order is that of their bytes. An empty table gives an empty
one; other columns are left out, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Written, looked_up, sliced
from .components import components
from .hashing import Words, lowered, mix, pieces, utf8, words_of

#: Nodes of a bucket that all its nodes are compared with at first.
PIVOTS = 8
#: A bucket's nodes are dealt over so many parts to find its least ones.
SPLITS = 16
#: Nodes on a side of the blocks in which the nodes of a frequent shingle meet.
BLOCK = 1000
_PIECE = 400_000
#: Documents of a batch that are worked on together.
_ROWS = 1000


@dataclass(frozen=True)
class Params:
    """``words`` in a shingle; least Jaccard similarity as ``num / den``; bands and entries of each.

    At the least similarity of 0.85, 24 bands of 5 entries miss a pair with probability 8e-7.
    """

    words: int = 3
    num: int = 85
    den: int = 100
    bands: int = 24
    rows: int = 5


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, and where those of each text begin.

    A text with fewer words than k is one shingle; a text without words has none.
    """
    size = words.last - words.first
    n = np.where(size >= k, size - k + 1, (size > 0).astype(np.int64))
    begins = np.concatenate(([0], np.cumsum(n)))
    out = np.zeros(begins[-1], dtype=np.uint64)
    doc = np.repeat(np.arange(len(n)), n)
    at = words.first[doc] + np.arange(begins[-1]) - begins[:-1][doc]
    for length in range(1, k + 1):
        fit = (size[doc] >= k) if length == k else (size[doc] == length)
        if fit.any():
            out[fit] = words.runs(length)[at[fit]]
    return out, begins


def _sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """The sorted set of each text, by its place."""
    data, offsets = utf8(texts)
    for begin, end in pieces(offsets, _PIECE):
        part = lowered(data[offsets[begin] : offsets[end]])
        found, begins = shingles(words_of(part, offsets[begin : end + 1] - offsets[begin]), k)
        for i in range(end - begin):
            yield begin + i, np.unique(found[begins[i] : begins[i + 1]])


def _signatures(p: Params):
    count = (p.bands * p.rows + 1) // 2
    rng = np.random.default_rng(1)
    scale = rng.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, count, dtype=np.uint64)
    weight = rng.integers(1, 1 << 63, p.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    order = rng.permutation(2 * count)[: p.bands * p.rows]

    def bands(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """One row a set, one column a band."""
        signature = np.empty((len(begins), 2 * count), dtype=np.uint64)
        for j in range(count):
            moved = values * scale[j] + shift[j]
            signature[:, 2 * j] = np.minimum.reduceat(moved, begins)
            signature[:, 2 * j + 1] = np.maximum.reduceat(moved, begins)
        entries = signature[:, order].reshape(len(begins), p.bands, p.rows)
        return mix((mix(entries) * weight).sum(axis=2) + np.arange(p.bands, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, _ROWS):
            ids, held, size = batch.column("doc_id"), [], 0
            for i, values in _sets(batch.column("text"), p.words):
                held.append((i, values))
                size += len(values)
                if size > _PIECE:
                    yield rows(ids, held)
                    held, size = [], 0
            if held:
                yield rows(ids, held)

    def rows(ids: pa.Array, held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        full = [values for _, values in held if len(values)]
        sizes = np.array([len(values) for values in full], dtype=np.int64)
        found = bands(np.concatenate(full), np.cumsum(sizes) - sizes) if full else np.zeros((0, p.bands), dtype=np.uint64)
        has = np.array([len(values) > 0 for _, values in held])
        offsets = np.concatenate(([0], np.cumsum(np.where(has, p.bands, 0)))).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array([i for i, _ in held], pa.int64())),
                pa.array([len(values) for _, values in held], pa.int64()),
                pa.array([_node(values) for _, values in held], pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel().view(np.int64))),
            ],
            names=["doc_id", "n_shingles", "node", "bands"],
        )

    return run


def _node(values: np.ndarray) -> bytes | None:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


def _texts(k: int):
    """(node, text): lower-case text of each set once a batch, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in sliced(batches, _ROWS):
            seen: dict[bytes, bytes] = {}
            for i, values in _sets(batch.column("text"), k):
                if len(values) and (node := _node(values)) not in seen:
                    seen[node] = press.compress(batch.column("text")[i].as_buffer().to_pybytes().lower())
            yield pa.RecordBatch.from_pydict({"node": pa.array(seen.keys(), pa.binary()), "text": pa.array(seen.values(), pa.binary())})

    return run


def _confirm(p: Params):
    """(a, b) of the pairs (a, b, a_text, b_text) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, dtype=np.uint64))
        open_ = zstandard.ZstdDecompressor()

        def full(text: bytes) -> np.ndarray:
            data = np.frombuffer(open_.decompress(text), dtype=np.uint8)
            return np.unique(shingles(words_of(data, np.array([0, len(data)])), p.words)[0])

        for batch in sliced(batches, _ROWS):
            a, b = [], []
            for left, right, left_text, right_text in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "a_text", "b_text")), strict=True):
                if last[0] != left:
                    last = (left, full(left_text))
                x, y = last[1], full(right_text)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if p.den * both >= p.num * (len(x) + len(y) - both):
                    a.append(left)
                    b.append(right)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _pivots(members: DataFrame) -> DataFrame:
    """(band, pivot): the least nodes of each bucket, found part by part."""
    part = F.pmod(F.xxhash64("node"), F.lit(SPLITS))
    first = W.partitionBy("band", part).orderBy("node")
    own = members.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= PIVOTS)
    every = W.partitionBy("band").orderBy("node")
    return own.withColumn("_r", F.row_number().over(every)).where(F.col("_r") <= PIVOTS).select("band", F.col("node").alias("pivot"))


def links(docs: DataFrame, nodes: DataFrame, p: Params) -> DataFrame:
    """(node, component) of the nodes that have a link."""
    members = nodes.select("node", F.explode("bands").alias("band")).distinct()
    shared = members.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("band")
    members = Written(members.join(shared, "band")).df
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_texts(p.words), "node binary, text binary")
    wanted = Written(
        texts.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    ).df

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = wanted.select(F.col("node").alias("a"), F.col("text").alias("a_text"))
        right = wanted.select(F.col("node").alias("b"), F.col("text").alias("b_text"))
        return pairs.join(right, "b").join(left, "a").select("a", "b", "a_text", "b_text").mapInArrow(_confirm(p), "a binary, b binary")

    met = members.join(_pivots(members), "band").where(F.col("node") > F.col("pivot"))
    found = Written(confirmed(met.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())).df
    stars = components(found, "a", "b")
    large = members.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > PIVOTS + 1).select("band")
    named = members.join(large, "band").join(stars, "node", "left").withColumn("component", F.coalesce("component", "node"))
    apart = named.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band")
    rest = named.join(apart, "band").select("node", "component").distinct()
    more = Written(confirmed(_by_rare_shingles(rest.join(wanted, "node"), p))).df
    return components(found.unionByName(more), "a", "b")


def _all_shingles(p: Params):
    """(node, component, n, shingle): every shingle of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in sliced(batches, _ROWS):
            for i in range(batch.num_rows):
                data = np.frombuffer(open_.decompress(batch.column("text")[i].as_py()), dtype=np.uint8)
                values = np.unique(shingles(words_of(data, np.array([0, len(data)])), p.words)[0])
                row = pa.array(np.zeros(len(values), dtype=np.int32))
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [one.column("node").take(row), one.column("component").take(row), pa.array(np.full(len(values), len(values), dtype=np.int64)), pa.array(values.view(np.int64))],
                    names=["node", "component", "n", "shingle"],
                )

    return run


def _by_rare_shingles(rest: DataFrame, p: Params) -> DataFrame:
    """Pairs (a, b) of nodes of different components that may be similar enough; none that is gets lost.

    Two sets that are similar enough share one of their rarest shingles, as many of each set as may
    be missing from the other, and one more. At the first that they share, enough shingles must be
    left in both for the overlap they need. Copies with many edits of their own have nothing but
    these at first, so they meet nobody, however large their group.
    """
    every = Written(rest.mapInArrow(_all_shingles(p), "node binary, component binary, n long, shingle long")).df
    spread = Written(every.groupBy("shingle").agg(F.count("*").alias("df")).where(F.col("df") > 1)).df
    # Shingles of a 10,000th of all rows or more, of which there are 10,000 at most, are broadcast, so none fills a task.
    often = F.broadcast(spread.where(F.col("df") > max(1000, every.count() // 10_000)))
    shared = every.join(often, "shingle").unionByName(every.join(often.select("shingle"), "shingle", "left_anti").join(spread, "shingle"))
    own = W.partitionBy("node")
    alone = F.col("n") - F.count("*").over(own)  # shingles that no other node has come first
    allowed = F.col("n") - F.ceil(F.col("n") * p.num / p.den) + 1
    place = F.row_number().over(own.orderBy("df", "shingle"))
    rare = shared.withColumn("place", alone + place).withColumn("_left", allowed - F.col("place")).where(F.col("_left") >= 0)
    rare = Written(rare.select("shingle", "node", "component", "n", (F.col("n") - F.col("place") + 1).alias("onwards"))).df
    kinds = rare.groupBy("shingle", "component").agg(F.count("*").alias("c"))
    sides = F.ceil(F.sum("c") / BLOCK).cast("int").alias("sides")
    mixed = kinds.groupBy("shingle").agg(F.count("*").alias("k"), F.max_by("component", "c").alias("main"), sides).where(F.col("k") > 1).drop("k")
    met = looked_up(rare, Written(mixed).df, "shingle").where(F.col("main").isNotNull())
    # The nodes of a frequent shingle meet in a square of blocks, so that no task holds all of them.
    own = F.pmod(F.xxhash64("node"), F.col("sides")).cast("int")
    every_block = F.explode(F.sequence(F.lit(0), F.col("sides") - 1))
    left = met.where(F.col("component") != F.col("main")).select("shingle", own.alias("i"), every_block.alias("j"), F.col("node").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("onwards").alias("oa"))
    right = met.select("shingle", own.alias("j"), every_block.alias("i"), F.col("node").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("onwards").alias("ob"), (F.col("component") == F.col("main")).alias("most"))
    near = (F.col("ca") != F.col("cb")) & (F.col("most") | (F.col("a") < F.col("b")))
    near = near & (F.least("oa", "ob") * (p.den + p.num) >= (F.col("na") + F.col("nb")) * p.num)
    return left.join(right, ["shingle", "i", "j"]).where(near).select("a", "b").distinct()


def groups(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row a document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, node binary, bands array<long>"
    signed = Written(slim.mapInArrow(_signatures(p), schema)).df
    joined = links(slim, signed.where(F.col("node").isNotNull()), p)
    own = signed.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least"))
    named = own.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    final = named.join(least, "component").select("node", "component_id")
    return looked_up(signed.select("doc_id", "n_shingles", "node"), final, "node").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def digest_row(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per document: the size of its set, its component and whether it stays."""
    return groups(docs, p).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
