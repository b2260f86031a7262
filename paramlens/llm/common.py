"""What the operators share: table access, word patterns, and tables written between steps."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def squeezed(text: str | Column) -> Column:
    """The words of a text joined by single spaces; empty for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def n_words(squeezed_text: Column) -> Column:
    """The number of words of a squeezed text."""
    blanks = F.length(squeezed_text) - F.length(F.replace(squeezed_text, F.lit(" "), F.lit("")))
    return F.when(squeezed_text == "", F.lit(0)).otherwise(blanks + 1).cast("long")


def settled(df: DataFrame, name: str) -> DataFrame:
    """Keeps filters on later columns from being pushed below this one.

    Pushing a filter copies the expressions that it depends on, and costly ones, above all those
    that lambdas refer to, would then be computed many times over.
    """
    return df.withColumn(name, F.when(F.monotonically_increasing_id() >= 0, F.col(name)))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where no folder is set, as in work on one machine, one is made in the warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/paramlens-steps"


class Written:
    """A table written to the shared folder, so that what follows doesn't depend on lost executors.

    It is deleted by ``drop``, or else when the driver's JVM ends.
    """

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark).rstrip('/')}/paramlens-{uuid.uuid4().hex}"
        jvm = self.spark.sparkContext._jvm
        self._file = jvm.org.apache.hadoop.fs.Path(self.path)
        self._store = self._file.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        df.write.parquet(self.path)
        self._store.deleteOnExit(self._file)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Deletes the files; the table must not be read any more."""
        self._store.delete(self._file, True)


def looked_up(rows: DataFrame, known: DataFrame, key: str, least: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``known``, which has one row a key, null where there is none.

    Rows of a null key are joined with nothing. Keys of more than ``least`` rows and more than a
    10,000th of all, of which there can be 10,000 at most, are broadcast, and only the others
    are shuffled by key. ``rows`` is read several times.
    """
    has = rows.where(F.col(key).isNotNull())
    often = has.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > F.lit(max(least, has.count() // 10_000)))
    often = Written(often.select(key)).df
    one = has.join(F.broadcast(often), key, "left_semi").join(F.broadcast(known.join(F.broadcast(often), key, "left_semi")), key, "left")
    others = has.join(F.broadcast(often), key, "left_anti").join(known, key, "left")
    columns = [*rows.columns, *[c for c in known.columns if c != key]]
    return one.unionByName(others).unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True).select(*columns)


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many, which bounds what a task holds; frees memory at the end."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)
    pa.default_memory_pool().release_unused()


def runs(batches: Iterator[pa.RecordBatch], key: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, from batches that are sorted by the key.

    A table has about ``rows`` rows, or one run if that is longer.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        last = [batch.column(k)[batch.num_rows - 1] for k in key]
        whole = pa.Table.from_batches(held)
        at = _first_equal(whole, key, last)
        if at:
            yield whole.slice(0, at).combine_chunks()
            rest = whole.slice(at).combine_chunks()
            held, count = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _first_equal(sorted_table: pa.Table, key: list[str], last: list[pa.Scalar]) -> int:
    """The first row of the last run, by bisection."""
    columns = [sorted_table.column(k) for k in key]
    lo, hi = 0, sorted_table.num_rows - 1
    while lo < hi:
        mid = (lo + hi) // 2
        if all(c[mid].equals(x) for c, x in zip(columns, last, strict=True)):
            hi = mid
        else:
            lo = mid + 1
    return lo
