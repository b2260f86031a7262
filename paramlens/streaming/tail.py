"""Following a file that grows, as a streaming source.

Spark's own file stream reads a file once. This source reads what was appended since the last
batch, in whole lines; a line is held back until it ends. With gzip, every member is read once it is whole.
A file that was replaced, got shorter, or begins otherwise than before starts a new generation. Offsets are in the
checkpoint with what the file began with, so a batch is read again as it was; where the file has been
replaced since, reading it again is an error, never other lines under the old offsets.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from ..sources.members import Bytes, member

#: Bytes read in one go.
CHUNK = 4 << 20
#: Bytes at the beginning that tell a file from one that took its place.
HEAD = 1024


class TailReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"generation": 0, "inode": -1, "at": 0, "head": 0, "mark": ""}

    def _whole(self, raw: bytes) -> int:
        """How many of the bytes are whole records."""
        return raw.rfind(b"\n") + 1

    def _records(self, raw: bytes) -> Iterator[tuple[int, str]]:
        """(place, text) of whole records."""
        at = 0
        for line in raw.splitlines(keepends=True):
            yield at, line.rstrip(b"\r\n").decode("utf-8", "replace")
            at += len(line)

    def _lines(self, offset: dict, end: int | None = None) -> tuple[list[tuple], int]:
        """Whole records from an offset on, and where they end."""
        with open(self.path, "rb") as file:
            file.seek(offset["at"])
            raw = file.read(CHUNK if end is None else end - offset["at"])
            while end is None and raw and not self._whole(raw) and (more := file.read(CHUNK)):
                raw += more
        whole = raw[: self._whole(raw)]
        return [(offset["generation"], offset["at"] + at, text) for at, text in self._records(whole)], offset["at"] + len(whole)

    def _begins(self, size: int) -> str:
        with open(self.path, "rb") as file:
            return hashlib.sha256(file.read(size)).hexdigest()

    def _same(self, offset: dict) -> bool:
        """Whether the file is the one that an offset was taken of."""
        state = os.stat(self.path)
        return offset["inode"] in (-1, state.st_ino) and state.st_size >= offset["at"] and (not offset["head"] or self._begins(offset["head"]) == offset["mark"])

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        try:
            same, inode = self._same(start), os.stat(self.path).st_ino
        except FileNotFoundError:
            return iter(()), start
        offset = dict(start) if same else self.initialOffset() | {"generation": start["generation"] + 1}
        lines, at = self._lines(offset)
        end = offset | {"inode": inode, "at": at}
        if end["head"] < min(at, HEAD):
            end |= {"head": min(at, HEAD), "mark": self._begins(min(at, HEAD))}
        return iter(lines), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        if not self._same(end):
            raise ValueError(f"{self.path} was replaced after a batch of it was read")
        begin = start if start["generation"] == end["generation"] else end | {"at": 0}
        return iter(self._lines(begin | {"generation": end["generation"]}, end["at"])[0])


class GzipTailReader(TailReader):
    """The same for a file of gzip members, each of one or more whole lines; a torn member is held back."""

    def _members(self, raw: bytes) -> Iterator[tuple[int, int, bytes]]:
        own, at = Bytes.of(raw), 0
        while at < len(raw):
            try:
                found = member(own, at)
            except zlib.error as problem:
                raise ValueError(f"{self.path} holds a broken member") from problem
            if found is None:
                return
            yield at, *found
            at = found[0]

    def _whole(self, raw: bytes) -> int:
        return max((end for _, end, _ in self._members(raw)), default=0)

    def _records(self, raw: bytes) -> Iterator[tuple[int, str]]:
        for at, _, text in self._members(raw):
            for line in text.decode("utf-8", "replace").splitlines():
                yield at, line


class TailSource(DataSource):
    """``spark.readStream.format("tail").option("path", ...)``: (generation, at, value)."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "generation int, at long, value string"

    def simpleStreamReader(self, schema: StructType) -> TailReader:
        return (GzipTailReader if self.options.get("compression") == "gzip" else TailReader)(self.options["path"])


def follow(spark: SparkSession, path: str, gzip: bool = False) -> DataFrame:
    spark.dataSource.register(TailSource)
    return spark.readStream.format("tail").option("path", path).option("compression", "gzip" if gzip else "none").load()


def current(lines: DataFrame, shard: str) -> DataFrame:
    """What each shard holds now: its newest generation. A shard that started over leaves the others as they are."""
    newest = lines.groupBy(shard).agg(F.max("generation").alias("generation"))
    return lines.join(newest, [shard, "generation"], "left_semi")


def archived(lines: DataFrame, shard: str) -> DataFrame:
    """What shards held before they started over."""
    newest = lines.groupBy(shard).agg(F.max("generation").alias("generation"))
    return lines.join(newest, [shard, "generation"], "left_anti")


def append_to(rows: DataFrame, path: str, checkpoint: str):
    """Starts a query that writes each batch under its own number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
