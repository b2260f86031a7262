"""What runs have gained since a reader last looked: a table of shards by generation, and a ledger of batches.

Every micro-batch writes its rows under (run, kind, shard, generation, batch) and then, in one file, the ledger
entry that makes them visible: how many rows each shard's generation has gained. A batch that is written again replaces its
own partitions and its own entry, so it changes nothing; one that failed before its entry is not seen. A
shard that starts over begins a new generation. Its old partitions stay as the archive, and no other
shard's rows are touched. A reader's cursor is the number of the last batch that it holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEYS = ["run", "kind", "shard", "generation"]
ROWS = "at long, value string, run string, kind string, shard string, generation int, batch long"
LEDGER = "run string, kind string, shard string, generation int, rows long, first long, last long, batch long"


def write(batch: DataFrame, number: int, path: str) -> None:
    """One micro-batch of (run, kind, shard, generation, at, value); ``kind`` is rows, rounds or log."""
    rows = batch.select(F.col("at").cast("long").alias("at"), F.col("value").cast("string").alias("value"), *[F.col(k).cast("string").alias(k) for k in KEYS[:3]], F.col("generation").cast("int").alias("generation")).withColumn("batch", F.lit(number).cast("long"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS, "batch").parquet(f"{path}/rows")
    entry = rows.groupBy(*KEYS).agg(F.count("*").alias("rows"), F.min("at").alias("first"), F.max("at").alias("last"))
    entry.coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/batch={number}")


def follow(stream: DataFrame, path: str, checkpoint: str):
    """Starts a query that writes a stream's batches."""
    return stream.writeStream.foreachBatch(lambda batch, number: write(batch, number, path)).option("checkpointLocation", checkpoint).start()


def ledger(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """(run, kind, shard, generation, rows, first, last, batch): what each batch brought, up to one of them."""
    entries = spark.read.schema(LEDGER).parquet(f"{path}/ledger")
    return entries if upto is None else entries.where(F.col("batch") <= upto)


def state(entries: DataFrame) -> DataFrame:
    """(run, kind, shard, generation, rows, batch): each shard's newest generation, its rows, and the last batch that brought any."""
    newest = F.max("generation").over(W.partitionBy("run", "kind", "shard"))
    own = entries.withColumn("_newest", newest).where(F.col("generation") == F.col("_newest"))
    return own.groupBy(*KEYS).agg(F.sum("rows").alias("rows"), F.max("batch").alias("batch"))


def _rows(spark: SparkSession, path: str, entries: DataFrame) -> DataFrame:
    """Rows of the batches and generations that entries name; partitions that none names aren't read."""
    named = entries.select(*KEYS, "batch").distinct()
    rows = spark.read.schema(ROWS).parquet(f"{path}/rows")
    return rows.join(F.broadcast(named), [*KEYS, "batch"], "left_semi")  # an entry for each batch of a shard


def current(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """What runs hold, as of now or of a batch: each shard's newest generation."""
    entries = ledger(spark, path, upto)
    return _rows(spark, path, entries.join(F.broadcast(state(entries).select(*KEYS)), KEYS, "left_semi"))


def archived(spark: SparkSession, path: str) -> DataFrame:
    """What shards held before they started over."""
    entries = ledger(spark, path)
    return _rows(spark, path, entries.join(F.broadcast(state(entries).select(*KEYS)), KEYS, "left_anti"))


def messages(entries: DataFrame, cursor: int | None) -> DataFrame:
    """(run, kind, shard, generation, message, lo, hi): what a reader at a cursor must do, one row a shard that changed.

    ``new``: it knew nothing of the shard; ``reset``: the shard started over, so its older rows go; ``rows``: it grew. In
    each case rows ``lo`` to ``hi`` of the generation are to be read. Without a cursor all shards are new.
    """
    now = state(entries)
    old = state(entries.where(F.lit(False) if cursor is None else F.col("batch") <= cursor))
    known = old.select(*KEYS[:3], F.col("generation").alias("_g"), F.col("rows").alias("_rows"))
    both = now.join(known, KEYS[:3], "left")
    message = F.when(F.col("_g").isNull(), "new").when(F.col("_g") < F.col("generation"), "reset").otherwise("rows")
    lo = F.when(F.col("_g") == F.col("generation"), F.col("_rows")).otherwise(F.lit(0).cast("long"))
    out = both.select(*KEYS, message.alias("message"), lo.alias("lo"), F.col("rows").alias("hi"))
    return out.where((F.col("message") != "rows") | (F.col("hi") > F.col("lo")))


def delta(spark: SparkSession, path: str, cursor: int | None) -> DataFrame:
    """Just the rows that a reader at a cursor lacks, of generations that still hold."""
    entries = ledger(spark, path)
    held = entries.join(F.broadcast(state(entries).select(*KEYS)), KEYS, "left_semi")
    return _rows(spark, path, held if cursor is None else held.where(F.col("batch") > cursor))


def brought_up(held: DataFrame, changes: DataFrame, rows: DataFrame) -> DataFrame:
    """A reader's rows after it has followed messages: shards that started over lose theirs, and the new rows are added."""
    gone = changes.where(F.col("message") == "reset").select("run", "kind", "shard")
    return held.join(F.broadcast(gone), ["run", "kind", "shard"], "left_anti").unionByName(rows)


def newest_batch(entries: DataFrame) -> int | None:
    """The cursor of a reader that holds everything."""
    return entries.agg(F.max("batch").alias("b")).first()["b"]


def waiting(entries: DataFrame, shards: DataFrame) -> DataFrame:
    """The shards (run, shard) of which nothing has been read yet; a run's history is joined when none is left."""
    return shards.join(entries.select("run", "shard").distinct(), ["run", "shard"], "left_anti")
