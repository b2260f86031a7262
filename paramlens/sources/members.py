"""Files of gzip members, one or more whole lines each, read by many tasks and by offset.

Where members begin can only be told by inflating, so a file is cut into ranges of bytes, and each task looks for
a beginning in its range and follows the members from there. What it finds is (file, start, end); ``sound`` keeps
what lies end to end, as a beginning may also be met by chance or in stored bytes. A task tells how far its earlier finds
reach, and what ranges before it reach comes from one row a range, so members are neither shuffled nor sorted for that. Offsets count compressed bytes, so
a member is read again by its place alone. A member that isn't whole yet is held back, one that is broken is told.

Files are opened by the path's own filesystem, local or not.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: The most bytes that a member may inflate to; bytes of a file that a task scans; how a member begins.
LIMIT, RANGE, MAGIC = 512 << 20, 8 << 20, b"\x1f\x8b\x08"
_BLOCK = 1 << 20
#: What a range's task gives; members and bytes of text that it hands over at once.
_FOUND, _ROWS, _TEXT = "file string, start long, end long, payload string, lo long, reach long", 10_000, 4 << 20


class Bytes:
    """A file's bytes by place, through a block that is held."""

    def __init__(self, size: int, read: Callable[[int, int], bytes]):
        self.size, self._read, self._at, self._held = size, read, 0, b""

    @classmethod
    def of(cls, raw: bytes) -> Bytes:
        return cls(len(raw), lambda at, n: raw[at : at + n])

    def at(self, place: int, n: int) -> memoryview:
        n = min(n, self.size - place)
        if not self._at <= place <= place + n <= self._at + len(self._held):
            self._at, self._held = place, self._read(place, max(n, min(_BLOCK, self.size - place)))
        return memoryview(self._held)[place - self._at : place - self._at + n]

    def beginning(self, place: int) -> int | None:
        """Where the next member may begin."""
        while place + len(MAGIC) <= self.size:
            seen = bytes(self.at(place, _BLOCK // 4))
            found = seen.find(MAGIC)
            if found >= 0:
                return place + found
            place += max(1, len(seen) - len(MAGIC) + 1)
        return None


def member(raw: Bytes, start: int, limit: int = LIMIT) -> tuple[int, bytes] | None:
    """(end, payload) of the member at a place, None if it isn't whole; time and memory follow its own size."""
    inflate, parts, held, at, step = zlib.decompressobj(31), [], 0, start, 512
    while at < raw.size:
        piece = raw.at(at, step)
        parts.append(inflate.decompress(piece, limit - held + 1))
        held += len(parts[-1])
        if held > limit:
            raise ValueError(f"the member at byte {start} inflates to more than {limit} bytes")
        at += len(piece)
        if inflate.eof:
            return at - len(inflate.unused_data), b"".join(parts)
        step = min(2 * step, _BLOCK)
    return None


def in_range(raw: Bytes, lo: int, hi: int, limit: int = LIMIT) -> Iterator[tuple[int, int | None, bytes]]:
    """(start, end, payload) of what looks like members that begin in a range; without an end if one isn't whole."""
    at = raw.beginning(lo)
    while at is not None and at < hi:
        try:
            found = member(raw, at, limit)
        except zlib.error:
            at = raw.beginning(at + 1)
            continue
        if found is None:
            yield at, None, b""
            at = raw.beginning(at + 1)
        else:
            yield at, found[0], found[1]
            at = found[0] if bytes(raw.at(found[0], 3)) == MAGIC else raw.beginning(found[0])


class _Range(InputPartition):
    def __init__(self, uri: str, lo: int, hi: int):
        self.uri, self.lo, self.hi = uri, lo, hi


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.ranges = [_Range(*x) for x in json.loads(options["ranges"])]
        self.limit, self.payload = int(options.get("limit", LIMIT)), options.get("payload") == "true"

    def partitions(self) -> list[_Range]:
        return self.ranges

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(partition.uri)
        rows: list[tuple] = []
        held, reach = 0, None
        with store.open_input_file(path) as file:
            raw = Bytes(file.size(), lambda at, n: file.read_at(n, at))
            for start, end, text in in_range(raw, partition.lo, partition.hi, self.limit):
                rows.append((start, end, text.decode("utf-8", "replace") if self.payload else None, reach))
                held += len(text) if self.payload else 0
                reach = end if reach is None else max(reach, end or 0)
                if len(rows) >= _ROWS or held >= _TEXT:
                    yield _batch(partition, rows)
                    rows, held = [], 0
        if rows:
            yield _batch(partition, rows)


def _batch(at: _Range, rows: list[tuple]) -> pa.RecordBatch:
    start, end, text, reach = zip(*rows, strict=True)
    every = [([at.uri] * len(rows), pa.string()), (start, pa.int64()), (end, pa.int64()), (text, pa.string()), ([at.lo] * len(rows), pa.int64()), (reach, pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in every], names=["file", "start", "end", "payload", "lo", "reach"])


class MemberSource(DataSource):
    """``format("gzip_members")``: what begins in given ranges of files."""

    @classmethod
    def name(cls) -> str:
        return "gzip_members"

    def schema(self) -> str:
        return _FOUND

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


def _source(spark: SparkSession, ranges: list[tuple[str, int, int]], payload: bool, limit: int) -> DataFrame:
    if not ranges:
        return spark.createDataFrame([], _FOUND)
    spark.dataSource.register(MemberSource)
    return spark.read.format("gzip_members").option("ranges", json.dumps(ranges)).option("payload", str(payload).lower()).option("limit", limit).load()


def files_of(spark: SparkSession, *paths: str) -> list[tuple[str, int]]:
    """(uri, bytes) of the files that paths name, which may be folders or patterns."""
    hadoop, found = spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in paths:
        named = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        store = named.getFileSystem(hadoop)
        matched = list(store.globStatus(named) or [])
        if not matched:
            raise FileNotFoundError(path)
        for state in matched:
            inner = list(store.listStatus(state.getPath())) if state.isDirectory() else [state]
            found += [(x.getPath().toString(), x.getLen()) for x in inner if x.isFile() and x.getPath().getName()[0] not in "_."]
    return sorted((files_uri(uri), size) for uri, size in found)


def files_uri(uri: str) -> str:
    """A local uri in the form that has an empty host, which other readers ask for."""
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def scanned(spark: SparkSession, *paths: str, after: dict[str, int] | None = None, payload: bool = False, limit: int = LIMIT, width: int = RANGE) -> DataFrame:
    """(file, start, end, payload, lo, reach): candidates, from many tasks; ``after`` tells from which byte on files are new.

    ``lo`` is where the task's range begins, ``reach`` the furthest end of what it found before.
    """
    after = after or {}
    ranges = [(uri, lo, min(lo + width, size)) for uri, size in files_of(spark, *paths) for lo in range(after.get(uri, 0), size, width)]
    return _source(spark, ranges, payload, limit)


def sound(candidates: DataFrame, after: dict[str, int] | None = None, bare: DataFrame | None = None) -> DataFrame:
    """Candidates that lie end to end, with ``state``: whole, unfinished (the last of a file), or after a broken member.

    What begins inside another member is none. ``bare`` may give the same candidates without payload, as they are read twice.
    """
    ends = (candidates if bare is None else bare).groupBy("file", "lo").agg(F.max("end").alias("_end"))
    earlier = W.partitionBy("file").orderBy("lo").rowsBetween(W.unboundedPreceding, -1)
    reached = ends.select("file", "lo", F.max("_end").over(earlier).alias("_reached"))  # one row a range
    before = F.coalesce(F.greatest("reach", "_reached"), _begins(after))
    placed = candidates.join(F.broadcast(reached), ["file", "lo"]).withColumn("_before", before).where(F.col("start") >= F.col("_before"))
    state = F.when(F.col("start") > F.col("_before"), "after broken").when(F.col("end").isNull(), "unfinished").otherwise("whole")
    return placed.select("file", "start", "end", "payload", state.alias("state"))


def _begins(after: dict[str, int] | None):
    known = [x for uri, at in (after or {}).items() for x in (F.lit(uri), F.lit(at).cast("long"))]
    return F.coalesce(F.element_at(F.create_map(*known), F.col("file")), F.lit(0).cast("long")) if known else F.lit(0).cast("long")


def members(spark: SparkSession, *paths: str, after: dict[str, int] | None = None, limit: int = LIMIT, width: int = RANGE) -> DataFrame:
    """(file, start, end, payload) of whole members; a last one that isn't whole is held back, a broken one is an error."""
    scan = [scanned(spark, *paths, after=after, payload=payload, limit=limit, width=width) for payload in (True, False)]
    found = sound(scan[0], after, scan[1])
    broken = F.raise_error(F.concat(F.lit("a broken member before byte "), F.col("start").cast("string"), F.lit(" of "), F.col("file")))
    checked = F.when(F.col("state") == "after broken", broken).otherwise(F.col("payload"))
    return found.where(F.col("state") != "unfinished").select("file", "start", "end", checked.alias("payload"))


def index(spark: SparkSession, *paths: str, key: str = "round_id", after: dict[str, int] | None = None, width: int = RANGE) -> DataFrame:
    """(key, file, start, end): where each record is; of records with one key the last holds. ``after`` reads only what files have gained."""
    one = members(spark, *paths, after=after, width=width).select(F.get_json_object("payload", f"$.{key}").alias(key), "file", "start", "end")
    # Places are so alike that their shuffled bytes tell little of their memory, by which Spark would join partitions.
    one = one.where(F.col(key).isNotNull()).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)
    return one.groupBy(key).agg(F.max(F.struct("file", "start", "end")).alias("_p")).select(key, "_p.*")


def merged(old: DataFrame, new: DataFrame, key: str = "round_id") -> DataFrame:
    """An index with what was read since."""
    columns = ["file", "start", "end"]
    return old.unionByName(new).groupBy(key).agg(F.max(F.struct(*columns)).alias("_p")).select(key, "_p.*")


def read_to(spark: SparkSession, *paths: str, width: int = RANGE) -> dict[str, int]:
    """Where the whole members of each file end: what to hand on as ``after``."""
    found = sound(scanned(spark, *paths, width=width))
    return {r["file"]: r["end"] for r in found.where(F.col("state") != "unfinished").groupBy("file").agg(F.max("end").alias("end")).collect()}  # a row a file


def payload_at(spark: SparkSession, file: str, start: int, limit: int = LIMIT) -> str:
    """One member by its place: reads nothing else of the file."""
    got = _source(spark, [(file, start, start + 1)], True, limit).first()
    if got is None or got["start"] != start or got["end"] is None:
        raise ValueError(f"no member begins at byte {start} of {file}")
    return got["payload"]


def lines(spark: SparkSession, *paths: str, limit: int = LIMIT) -> DataFrame:
    """(shard, place, part, text): every line of the members, with its member's offset and its number there."""
    rows = members(spark, *paths, limit=limit).select(F.col("file").alias("shard"), F.col("start").alias("place"), F.posexplode(F.split("payload", "\r?\n")).alias("part", "text"))
    return rows.where(F.col("text") != "")
