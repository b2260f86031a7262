"""Near-duplicate vectors by iterative quantisation.

Rotations of the principal axes are learned on a bounded sample so that the signs of the rotated
vectors make balanced binary codes that keep near vectors near. The codes are cut into disjoint
substrings, one multi-index table each. Codes that differ in fewer bits than there are tables agree
in a whole substring, so each table is probed at radius 0. A substring is about as long as the count of
vectors has bits, which keeps buckets small at any size; the tables follow from the share of
links that may be missed, and further rotations give the bits they need. How often bits differ is measured on
vectors of the sample that are moved to just the least cosine, so it holds for vectors that share a direction too.

What meets in a bucket is screened by the Hamming distance of the first codes. Only vectors with a partner
left are fetched and reranked by cosine. Buckets are compared in square blocks of ``CHUNK``
vectors, and a pair counts only in the first table where it meets, so links are counted
without listing pairs: tasks return counts and a spanning forest. Equal vectors are one node that
counts as often as it occurs.

Only vectors with equal labels are compared. Null labels link with nothing, and neither do vectors
that are null, empty or zero or hold null or non-finite components. Vectors of another length than
most get rotations of that length drawn at random. Rows with equal or null ids are kept apart; an
empty table gives an empty one; other columns are left out, whatever they are called.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, looked_up, runs
from .components import components

CHUNK = 512
#: What comparing a pair of codes costs of what a row in a table does; tables beyond which even a bit says nothing.
COMPARED, MOST_TABLES = 0.01, 4096


@dataclass(frozen=True)
class Params:
    """Least cosine; share of pairs at just that cosine that may be missed; vectors the rotations are fitted on, at most, and rounds."""

    cosine: float = 0.98
    missed: float = 3e-4
    fit_rows: int = 4096
    rounds: int = 30

    @property
    def flips(self) -> float:
        """The chance that a bit differs at the least cosine."""
        return math.acos(min(1.0, max(-1.0, self.cosine))) / math.pi


@dataclass(frozen=True)
class Flips:
    """Chances that a bit differs at the least cosine, one for each of some vectors, and that a bit of any two vectors agrees."""

    each: np.ndarray
    same: float = 0.5

    @classmethod
    def of_angle(cls, p: Params) -> Flips:
        """Under random rotations through the origin the angle alone decides."""
        return cls(np.array([p.flips]))


@dataclass(frozen=True)
class Tables:
    """So many tables, of substrings of so many bits."""

    count: int
    bits: int

    @classmethod
    def of(cls, vectors: int, p: Params, flips: Flips | None = None) -> Tables:
        """As many as leave ``missed`` of the pairs at the least cosine without a table in which they agree.

        Without measured flips substrings are as long as the count of vectors has bits. Otherwise they are as long as
        costs least: shorter ones need fewer tables, but fill buckets more.
        """
        longest = min(max(8, math.ceil(math.log2(max(2, vectors)))), 48)
        if flips is None:
            return cls(_tables(longest, Flips.of_angle(p), p), longest)
        counts = {bits: _tables(bits, flips, p) for bits in range(min(4, longest), longest + 1)}
        cost = {bits: count * (1 + COMPARED * vectors * flips.same**bits) for bits, count in counts.items()}
        bits = min(cost, key=lambda k: (cost[k], -k))
        return cls(max(counts[bits], _tables(bits, Flips.of_angle(p), p)), bits)

    def rotations(self, width: int) -> int:
        """How many codes of ``width`` bits it takes."""
        return math.ceil(self.count / max(1, width // self.bits))


def _tables(bits: int, flips: Flips, p: Params) -> int:
    """The least number of tables with which no more than ``missed`` of the pairs are missed, over all that were measured."""
    apart = 1 - (1 - flips.each) ** bits
    missed = lambda n: float((apart**n).mean())
    lo, hi = 0, 1
    while missed(hi) > p.missed and hi < MOST_TABLES:
        lo, hi = hi, 2 * hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if missed(mid) <= p.missed else (mid, hi)
    return hi


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    rotations: list[np.ndarray]


def _turned(unit: np.ndarray, mean: np.ndarray, rounds: int, seeds: range) -> Model:
    _, _, axes = np.linalg.svd(unit - mean, full_matrices=True)
    low = (unit - mean) @ axes.T
    found = []
    for seed in seeds:
        turn = np.linalg.qr(np.random.default_rng(7 + seed).standard_normal((low.shape[1],) * 2))[0]
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(low @ turn >= 0, 1.0, -1.0).T @ low)
            turn = (left @ right).T
        found.append(axes.T @ turn)
    return Model(mean, found)


def moved(unit: np.ndarray, p: Params, vectors: int = 500, draws: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Pairs at just the least cosine: vectors of the sample, and each moved that far in random directions. No linked pair need be in the sample."""
    rng = np.random.default_rng(5)
    own = np.tile(unit[rng.permutation(len(unit))[:vectors]], (draws, 1))
    aside = rng.standard_normal(own.shape)
    aside -= (aside * own).sum(axis=1, keepdims=True) * own
    size = np.linalg.norm(aside, axis=1, keepdims=True)
    aside = np.divide(aside, size, out=np.zeros_like(aside), where=size > 0)
    return own, p.cosine * own + math.sqrt(max(0.0, 1 - p.cosine**2)) * aside


def flips_of(unit: np.ndarray, model: Model, p: Params, draws: int = 8) -> Flips:
    """What the codes make of pairs at just the least cosine.

    Centring brings vectors that share a direction apart, and their partners with them, so bits differ more often there
    than the angle tells.
    """
    code = lambda x: np.concatenate([(x - model.mean) @ r >= 0 for r in model.rotations], axis=1)
    here, there = map(code, moved(unit, p, draws=draws))
    each = (here != there).mean(axis=1).reshape(draws, -1).mean(axis=0)
    here = here[: len(each)]
    return Flips(each, float((here == np.roll(here, 1, axis=0)).mean()) if len(here) > 1 else 0.5)


@dataclass(frozen=True)
class Fitted:
    """A model with its tables, how many of its codes the Hamming screen takes, and the bits that linked pairs may differ in there."""

    model: Model
    tables: Tables
    screens: int
    most: float


def fit(sample: np.ndarray, p: Params, vectors: int) -> Fitted:
    """Principal axes, rotated in turns to fit the signs and the signs to the rotation, from different beginnings; and the tables for them.

    Vectors are centred, which balances the codes, or not, whichever needs less work by what was measured. As learned
    rotations aren't independent, tables are added until pairs at the least cosine are in fact missed no more often
    than they may, and the screen's bound is what they differ in at most, two deviations and two bits more.
    """
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    width, best = unit.shape[1], None
    for mean in (unit.mean(axis=0), np.zeros(width)):
        flips = flips_of(unit, _turned(unit, mean, p.rounds, range(2)), p)
        tables = Tables.of(vectors, p, flips)
        cost = tables.count * (1 + COMPARED * vectors * flips.same**tables.bits)
        if best is None or cost < best[0]:
            best = (cost, mean, tables, flips)
    _, mean, tables, flips = best
    needed, model, (here, there) = screens(flips, width), Model(mean, []), moved(unit, p)
    while True:
        more = range(len(model.rotations), max(tables.rotations(width), needed))
        model = Model(mean, model.rotations + _turned(unit, mean, p.rounds, more).rotations)
        (mine, code), (other, theirs) = (_codes(x, model, tables, needed) for x in (here, there))
        if (mine != other).all(axis=1).mean() <= p.missed or tables.count >= MOST_TABLES:
            break
        tables = Tables(math.ceil(1.4 * tables.count), tables.bits)
    apart = _ONES[code ^ theirs].sum(axis=1)
    return Fitted(model, tables, needed, float(apart.max() + 2 * apart.std() + 2))


def _most(bits: int, rate: float) -> float:
    """Six standard deviations above the bits that differ on average."""
    return bits * rate + 6 * math.sqrt(bits * rate * (1 - rate))


def screens(flips: Flips, width: int) -> int:
    """How many codes the Hamming screen needs to tell linked pairs, the worst measured, from any two; 1 mostly, 8 at most."""
    rate = min(0.5, float(flips.each.max()))
    apart = 1 - flips.same
    for n in range(1, 9 if apart > 0.05 else 1):
        if _most(n * width, rate) < n * width * apart - 2 * math.sqrt(n * width * apart * (1 - apart)):
            return n
    return 8 if apart > 0.05 else 1


def _drawn(size: int, rotations: int) -> Model:
    rng = np.random.default_rng(size)
    return Model(np.zeros(size), [np.linalg.qr(rng.standard_normal((size, size)))[0] for _ in range(rotations)])


def _vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Doubles, or None for vectors that link with nothing."""
    out: list[np.ndarray | None] = []
    for x in column:
        v = np.array(x.values.to_numpy(zero_copy_only=False), dtype=np.float64) if x.is_valid and len(x.values) else None
        if v is not None and (x.values.null_count or not np.isfinite(v).all() or not (v * v).sum() > 0 or not np.isfinite((v * v).sum())):
            v = None
        out.append(v)
    return out


def _codes(unit: np.ndarray, model: Model, t: Tables, screens: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The substrings as numbers, one column a table, and the first codes, packed."""
    codes = [(unit - model.mean) @ r >= 0 for r in model.rotations]
    width = unit.shape[1]
    bits = min(t.bits, width)
    per = width // bits
    keys = np.empty((len(unit), t.count), dtype=np.int64)
    for i in range(t.count):
        at = (i % per) * bits
        keys[:, i] = codes[i // per][:, at : at + bits].astype(np.int64) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
    return keys, np.packbits(np.concatenate(codes[:screens], axis=1), axis=1)


def _encode(model: Model | None, t: Tables, screens: int = 1):
    """(vec_id, node, label, vector, keys, code); node is null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, Model] = {}
        for batch in batches:
            vectors, labels = _vectors(batch.column("embedding")), batch.column("label").to_pylist()
            nodes: list[bytes | None] = [None] * len(vectors)
            keys: list[list[int] | None] = [None] * len(vectors)
            codes: list[bytes | None] = [None] * len(vectors)
            sizes = {len(v) for v, label in zip(vectors, labels, strict=True) if v is not None and label is not None}
            for size in sizes:
                use = [i for i, v in enumerate(vectors) if v is not None and len(v) == size and labels[i] is not None]
                if model is not None and len(model.mean) == size:
                    m, own_screens = model, screens
                else:
                    m, own_screens = drawn.setdefault(size, _drawn(size, t.rotations(size))), 1
                full = np.stack([vectors[i] for i in use])
                found, code = _codes(full / np.linalg.norm(full, axis=1, keepdims=True), m, t, own_screens)
                for i, row, own, v in zip(use, found, code, full + 0.0, strict=True):
                    nodes[i] = hashlib.blake2b(f"{labels[i]}/".encode() + v.tobytes(), digest_size=16).digest()
                    keys[i], codes[i] = row.tolist(), own.tobytes()
            stored = [v.tobytes() if n is not None else None for v, n in zip(vectors, nodes, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(nodes, pa.binary()), batch.column("label"), pa.array(stored, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(codes, pa.binary())],
                names=["vec_id", "node", "label", "vector", "keys", "code"],
            )

    return run


def _blocks(part: pa.Table) -> Iterator[pa.Table]:
    """The blocks of two or more rows in a table sorted by block."""
    where = np.stack([part.column(c).to_numpy() for c in ("bucket", "lo", "hi")])
    begins = np.flatnonzero(np.concatenate(([True], (where[:, 1:] != where[:, :-1]).any(axis=0)))).tolist()
    for begin, end in zip(begins, [*begins[1:], part.num_rows], strict=True):
        if end - begin > 1:
            yield part.slice(begin, end - begin)


def _across(block: pa.Table) -> np.ndarray | None:
    """The pairs that a block of two chunks is there for; None for a block of one chunk, where all are."""
    if block.column("lo")[0].as_py() == block.column("hi")[0].as_py():
        return None
    chunk = block.column("chunk").to_numpy()
    return chunk[:, None] != chunk[None, :]


_ONES = np.array([i.bit_count() for i in range(256)], dtype=np.uint8)


def _screen(p: Params, fitted: int = 0, most_fitted: float = 0.0):
    """The rows of each block whose code has a partner near enough; nearly all that meet by chance go here.

    Vectors of the ``fitted`` length may differ in ``most_fitted`` bits, of others in what random rotations make likely.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, ["bucket", "lo", "hi"]):
            out = []
            for block in _blocks(part):
                codes = np.stack([np.frombuffer(c, dtype=np.uint8) for c in block.column("code").to_pylist()])
                width = block.column("width")[0].as_py()
                most = most_fitted if width == fitted else _most(width, p.flips)
                apart = np.zeros((len(codes),) * 2, dtype=np.uint16)
                for j in range(codes.shape[1]):
                    apart += _ONES[codes[:, j][:, None] ^ codes[:, j][None, :]]
                near = apart <= most
                np.fill_diagonal(near, False)
                if (across := _across(block)) is not None:
                    near &= across
                keep = near.any(axis=1)
                if keep.any():
                    out.append(block.filter(pa.array(keep)))
            if out:
                yield from pa.concat_tables(out).select(["bucket", "lo", "hi", "chunk", "table", "node"]).combine_chunks().to_batches()

    return run


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each row its least reachable row."""
    n = len(linked)
    root = np.arange(n)
    while True:
        least = np.where(linked, root[None, :], n).min(axis=1)
        new = np.minimum(root, least)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _rerank(p: Params):
    """(node, other, n): links of a node counted by weight, and an edge of the forest, from each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, ["bucket", "lo", "hi"]):
            node, other, n = [], [], []
            for block in _blocks(part):
                ids = block.column("node").to_pylist()
                vectors = np.stack([np.frombuffer(v, dtype=np.float64) for v in block.column("vector").to_pylist()])
                unit = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
                linked = unit @ unit.T >= p.cosine
                np.fill_diagonal(linked, False)
                if (across := _across(block)) is not None:
                    linked &= across
                if not linked.any():
                    continue
                keys = np.array(block.column("keys").to_pylist())
                for t in range(block.column("table")[0].as_py()):
                    linked &= keys[:, t][:, None] != keys[:, t][None, :]
                if not linked.any():
                    continue
                weight = block.column("weight").to_numpy()
                root = _forest(linked)
                for i in np.flatnonzero(linked.any(axis=1)).tolist():
                    node.append(ids[i])
                    other.append(ids[root[i]])
                    n.append(int(weight[linked[i]].sum()))
            yield pa.RecordBatch.from_pydict({"node": pa.array(node, pa.binary()), "other": pa.array(other, pa.binary()), "n": pa.array(n, pa.int64())})

    return run


def sample_of(vectors: DataFrame, p: Params) -> np.ndarray | None:
    """At most ``fit_rows`` vectors, chosen by a hash of the id, of the length that most of them have."""
    rows = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    rows = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(p.fit_rows).select("embedding").toArrow()
    good = [v for v in _vectors(rows.column("embedding").combine_chunks()) if v is not None]
    if not good:
        return None
    lengths = [len(v) for v in good]
    most = max(sorted(set(lengths)), key=lengths.count)
    return np.stack([v for v in good if len(v) == most])


def groups(vectors: DataFrame, p: Params = Params()) -> DataFrame:
    """(vec_id, n_links, component_id), one row a vector."""
    slim = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label")
    )
    sample, vectors_in_all = sample_of(slim, p), slim.count()
    if sample is not None:
        fitted = fit(sample, p, vectors_in_all)
        screen, encode = _screen(p, sample.shape[1], fitted.most), _encode(fitted.model, fitted.tables, fitted.screens)
    else:
        screen, encode = _screen(p), _encode(None, Tables.of(vectors_in_all, p))
    coded = Written(slim.mapInArrow(encode, "vec_id long, node binary, label long, vector binary, keys array<long>, code binary")).df
    live = coded.where(F.col("node").isNotNull())
    nodes = Written(
        live.groupBy("node").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"), *[F.first(c).alias(c) for c in ("label", "vector", "keys", "code")])
    ).df
    thin = nodes.select("node", "code", "label", (F.length("vector") / 8).cast("int").alias("width"), F.posexplode("keys").alias("table", "key"))
    thin = thin.select("node", "code", "width", "table", F.xxhash64("label", "width", "table", "key").alias("bucket"))
    crowd = thin.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    met = thin.join(crowd, "bucket").withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int"))
    blocks = met.withColumn("with", F.explode(F.sequence(F.lit(0), chunks - 1))).withColumns(
        {"lo": F.least("chunk", "with"), "hi": F.greatest("chunk", "with")}
    )

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")

    near = dealt(blocks.select("bucket", "lo", "hi", "chunk", "table", "node", "code", "width")).mapInArrow(
        screen, "bucket long, lo int, hi int, chunk int, table int, node binary"
    )
    found = Written(dealt(near.join(nodes.select("node", "weight", "vector", "keys"), "node")).mapInArrow(_rerank(p), "node binary, other binary, n long")).df
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    stars = components(found, "node", "other")
    named = nodes.select("node", "weight", "least").join(stars, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    final = named.join(least, "component").join(counts, "node", "left").select(
        "node", "component_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")
    )
    return looked_up(coded.select("vec_id", "node"), final, "node").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )


def digest_row(vectors: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per vector: its links, its component and whether it stays."""
    return groups(vectors, p).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
