"""Mixing sources to target weights by systematic sampling.

Within a source every document is expected in ``target / source_size`` copies. The prefix sum of
expected copies, plus one random offset for the source, crosses an integer once for each copy
taken. Documents are summed in an order that keeps like sizes together, which ties the words
taken to the target. The place of a document in that order comes from counts of small bins, so
that no source is ever in one task.

A null source is a source of its own, last in order. Null and empty texts have size 0. Sources
without words have target 0. Rows with equal or null ids are sampled one by one and spread over
bins by their texts; rows of one id and text are interchangeable and lie in one bin. Very long
texts are documents like others. An empty table gives an empty one. The caller's columns stay as
they are; only ``size`` is read if there is one. Plain column expressions only; the offset and
the order come from digests, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Written, n_words, squeezed

#: Bins by digest within each class of size; the order within a source is cut at these.
SPLITS = 256
_UNIT = 1 << 20


def sized(docs: DataFrame) -> DataFrame:
    """Adds ``size``, the number of words."""
    return docs.withColumn("_flat", squeezed("text")).withColumn("size", n_words(F.col("_flat"))).drop("_flat")


def source_key(source: str | Column = "source") -> Column:
    """Sorts by code point with null last."""
    source = F.col(source) if isinstance(source, str) else source
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), cap: int = 3, share: float = 1.0) -> DataFrame:
    """Target words by source: (skey, source_size, target), from one row (skey, source_size) a source.

    Targets are in proportion to the weights, which repeat along the sources, up to ``cap`` times
    a source's size; what goes beyond is shared among the rest. That levels off where a common
    factor times the weight meets the total, which sorting by size over weight finds directly.
    """
    everything = W.partitionBy(F.lit(1))
    rows = sizes.withColumn("_n", F.row_number().over(everything.orderBy("skey")))
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in cycle]), (F.col("_n") - 1) % len(cycle) + 1))
    rows = rows.withColumn("_cap", F.col("source_size") * cap).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    before = everything.orderBy("_ratio", "skey").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "_k": F.row_number().over(everything.orderBy("_ratio", "skey")),
            "_total": F.floor(F.sum("source_size").over(everything) * share),
            "_weights": F.sum("weight").over(everything),
            "_capped": F.coalesce(F.sum("_cap").over(before), F.lit(0)),
            "_capped_weight": F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    level = (F.col("_total") - F.col("_capped")) / (F.col("_weights") - F.col("_capped_weight"))
    first = F.min(F.when(level <= F.col("_ratio"), F.struct("_k", level.alias("level")))).over(everything)
    rows = rows.withColumn("_level", first["level"])
    target = F.when(F.col("_level").isNull() | (F.col("_ratio") < F.col("_level")), F.col("_cap").cast("double"))
    return rows.select("skey", "source_size", target.otherwise(F.col("_level") * F.col("weight")).alias("target"))


def sample(docs: DataFrame, seed: str = "mix", text_digest: Column | None = None, **shares) -> DataFrame:
    """(_doc, size, source_size, target, copies): every document as a struct, also those taken 0 times.

    A column ``size`` is taken as the number of words. ``text_digest`` tells rows of one id apart, by
    default the digest of the text.
    """
    told = F.md5(F.coalesce("text", F.lit(""))) if text_digest is None else text_digest
    size = F.col("size").cast("long") if "size" in docs.columns else n_words(F.col("_flat"))
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "source", told.alias("_told"), *(["size"] if "size" in docs.columns else [squeezed("text").alias("_flat")]))
    rows = rows.withColumn("size", size).drop("_flat").withColumn("_skey", source_key())
    rows = rows.withColumn("_digest", F.md5(F.concat_ws("/", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_told"))).drop("_told")
    # Eight classes of size for each power of two.
    length = F.length(F.bin("size"))
    rows = rows.withColumn("_class", length * 16 + F.call_function("shiftright", F.col("size") * 8, length - 1).cast("int"))
    rows = rows.withColumn("_split", (F.conv(F.substring("_digest", 1, 4), 16, 10).cast("int") % SPLITS))
    rows = Written(rows).df  # texts are measured once
    bins = rows.groupBy("_skey", "_class", "_split").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    plan = targets(bins.groupBy(F.col("_skey").alias("skey")).agg(F.sum("words").alias("source_size")), **shares)
    before = W.partitionBy("_skey").orderBy("_class", "_split").rowsBetween(W.unboundedPreceding, -1)
    placed = bins.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(
        plan.withColumnRenamed("skey", "_skey"), "_skey"
    )
    within = W.partitionBy("_skey", "_class", "_split").orderBy("size", "_digest", F.col("doc_id"))
    rows = rows.withColumn("_row", F.row_number().over(within)).join(
        placed.drop("n", "words"), ["_skey", "_class", "_split"]
    )
    # The offset is a multiple of 2^-20, so that whole rates are summed without rounding.
    offset = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), "_skey")), 1, 5), 16, 10).cast("double") / _UNIT
    rate = F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0))
    rank = (F.col("_before") + F.col("_row")).cast("double")
    copies = F.floor(offset + rate * rank) - F.floor(offset + rate * (rank - 1))
    return rows.withColumn("copies", copies.cast("long")).select("_doc", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, seed: str = "mix", **shares) -> DataFrame:
    """The mixture: each document as often as it is taken."""
    taken = sample(docs, seed, **shares).where(F.col("copies") > 0)
    return taken.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_doc.*")


def digest_row(docs: DataFrame, seed: str = "mix") -> DataFrame:
    slim = sized(docs.select("doc_id", "source", "text")).select("doc_id", "source", "size", F.md5(F.coalesce("text", F.lit(""))).alias("told"))
    rows = sample(slim, seed, F.col("told"))
    return rows.select("_doc.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
