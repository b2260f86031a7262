"""Sweep results from JSON lines and CSV files, by any path Spark reads.

A JSON row may lack a key, or hold null there; ``present`` keeps the two apart. Nested objects
become dotted names, short lists of numbers one name a position, and lists of texts stay lists;
anything else is kept as canonical JSON text. Lines that can't be read are kept with the reason.
"""

from __future__ import annotations

import csv as csv_module
import json
import math
from collections import Counter
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .members import files_of

#: Levels of nesting that are flattened; longest list of numbers that is split; largest whole number a double holds.
DEPTH, NUMBERS, WHOLE = 3, 8, 2**53
_ROW = "shard string, line long, present array<string>, kinds map<string,string>, fields map<string,string>, error string, text string"


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def _kind(v: Any) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, str):
        return "str"
    if isinstance(v, (int, float)) and not (isinstance(v, int) and abs(v) > WHOLE):
        return "num"
    return "set" if isinstance(v, list) and all(isinstance(x, str) for x in v) else "json"


def leaves(value: Any, name: str = "", depth: int = 0) -> Iterator[tuple[str, Any]]:
    """The named values of a row."""
    if isinstance(value, dict) and (not name or (value and depth <= DEPTH)):
        for key, inner in value.items():
            yield from leaves(inner, f"{name}.{key}" if name else str(key), depth + 1)
    elif isinstance(value, list) and 0 < len(value) <= NUMBERS and all(_kind(x) in ("num", "json") and isinstance(x, (int, float)) for x in value):
        yield from ((f"{name}.{i}", x) for i, x in enumerate(value))
    else:
        yield name, value


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("shard", "line", "present", "kinds", "fields", "error", "text")}
        for shard, line, text in zip(*(batch.column(c).to_pylist() for c in ("shard", "line", "text")), strict=True):
            kinds, fields, error = [], [], None
            try:
                row = json.loads(text)
                if not isinstance(row, dict):
                    raise ValueError(f"a {type(row).__name__} where an object is due")
                for name, v in leaves(row):
                    kind = _kind(v)
                    kinds.append((name, kind))
                    shown = None if v is None else v if isinstance(v, str) else repr(float(v)) if kind == "num" else canonical(v)
                    fields.append((name, shown))
            except ValueError as problem:
                kinds, fields, error = [], [], str(problem)
            for key, v in zip(out, (shard, line, [k for k, _ in fields], kinds, fields, error, text if error else None), strict=True):
                out[key].append(v)
        text = pa.string()
        types = (text, pa.int64(), pa.list_(text), pa.map_(text, text), pa.map_(text, text), text, text)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))


def numbered_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(shard, line, text): every line of text files with its number in its file, from 1.

    Files are read in blocks; a first pass counts the lines of each block, of which there are few, and the second
    adds what comes before.
    """
    where = F.col("_metadata.file_path").alias("shard"), F.col("_metadata.file_block_start").alias("_block")
    lines = spark.read.text(list(paths)).select(*where, F.monotonically_increasing_id().alias("_id"), F.col("value").alias("text"))
    blocks = lines.groupBy("shard", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("shard").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select("shard", "_block", "_first", before.alias("_before"))
    return lines.join(F.broadcast(blocks), ["shard", "_block"]).select("shard", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line"), "text")


def json_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """One row a line, in the parsed form; several directories are shards of one run. Blank lines are skipped."""
    return numbered_lines(spark, *paths).where(F.trim("text") != "").mapInArrow(_parsed, _ROW)


def good(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("error").isNull())


def bad(rows: DataFrame, keep: int = 50) -> DataFrame:
    """The first lines that couldn't be read, by shard and line, with the reason and the number of all."""
    wrong = rows.where(F.col("error").isNotNull())
    return wrong.select("shard", "line", "error", "text").orderBy("shard", "line").limit(keep).crossJoin(F.broadcast(wrong.agg(F.count("*").alias("bad"))))  # one row


def fields_of(rows: DataFrame) -> DataFrame:
    """(name, kind, rows, nulls): the kind of each field; values of several kinds make it ``json``."""
    long = good(rows).select(F.explode("kinds").alias("name", "kind"))
    return long.groupBy("name").agg(
        F.when(F.count_distinct(F.when(F.col("kind") != "null", F.col("kind"))) > 1, "json").otherwise(F.coalesce(F.max(F.when(F.col("kind") != "null", F.col("kind"))), F.lit("json"))).alias("kind"),
        F.count("*").alias("rows"), F.sum((F.col("kind") == "null").cast("long")).alias("nulls"),
    )


def typed(rows: DataFrame, fields: list[tuple[str, str]] | None = None) -> DataFrame:
    """Rows with a typed column for each field, dots as underscores, ``__shard`` and ``__present``.

    A dot stays where the name with an underscore is another field's. Without ``fields`` the kinds are surveyed, which
    runs a job at once; they are as many as the names in the data.
    """
    known = fields if fields is not None else [(r["name"], r["kind"]) for r in fields_of(rows).orderBy("name").collect()]
    casts = {"num": lambda c: c.cast("double"), "bool": lambda c: c.cast("boolean"), "set": lambda c: F.from_json(c, "array<string>")}
    columns, flat = [], Counter(name.replace(".", "_") for name, _ in known)
    for name, kind in known:
        raw = F.element_at("fields", F.lit(name))
        if kind == "json":  # texts among values of other kinds are quoted, so that each reads back as it was
            raw = F.when(F.element_at("kinds", F.lit(name)) == "str", F.to_json(F.array(raw)).substr(F.lit(2), F.length(F.to_json(F.array(raw))) - 2)).otherwise(raw)
        columns.append(casts.get(kind, lambda c: c)(raw).alias(plain if flat[plain := name.replace(".", "_")] == 1 else name))
    return good(rows).select(F.col("shard").alias("__shard"), F.col("line").alias("__line"), F.col("present").alias("__present"), *columns)


def row_object(fields: dict[str, Any]) -> dict[str, Any]:
    """The nested object of flat names; runs of positions become lists again."""
    out: dict[str, Any] = {}
    for name, v in fields.items():
        at = out
        *path, last = name.split(".")
        for part in path:
            at = at.setdefault(part, {})
        at[last] = None if isinstance(v, float) and math.isnan(v) else v

    def lists(node: Any) -> Any:
        if not isinstance(node, dict):
            return node
        inner = {k: lists(v) for k, v in node.items()}
        return list(inner.values()) if inner and list(inner) == [str(i) for i in range(len(inner))] else inner

    return {k: lists(v) for k, v in out.items()}


_INT = r"^[+-]?[0-9]+$"
_FLOAT = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def csv_kind(text: Column) -> Column:
    """What a CSV field holds: null, bool, num, json or str."""
    return (
        F.when(text.isNull() | (text == ""), "null").when(text.isin("True", "False"), "bool")
        .when(F.rlike(text, F.lit(_INT)) | F.rlike(text, F.lit(_FLOAT)) | F.lower(text).isin("nan", "inf", "-inf", "infinity", "-infinity"), "num")
        .when(text.startswith("[") | text.startswith("{"), F.when(F.try_parse_json(text).isNotNull(), "json").otherwise("str")).otherwise("str")
    )


def _header(spark: SparkSession, uri: str) -> tuple[str, ...]:
    """The column names of one file: its first record, which a file with a codec is read by Spark for."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(uri)
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    if jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(hadoop).getCodec(path) is not None:
        return tuple(spark.read.csv(uri, header=True, multiLine=True, escape='"').columns)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(path.getFileSystem(hadoop).open(path), "UTF-8"))
    try:
        record = reader.readLine()
        while record is not None and record.count('"') % 2:
            record += "\n" + (reader.readLine() or '"')
    finally:
        reader.close()
    return tuple(next(csv_module.reader([record.removeprefix("\ufeff")]), ())) if record else ()


def csv(spark: SparkSession, *paths: str) -> DataFrame:
    """CSV results with typed columns; quoted fields may hold line breaks. Short and long records go to ``__bad``.

    Files may order their columns differently, or lack some: those with one header are read together, and all are
    matched by name. Empty files hold nothing.
    """
    headers: dict[tuple[str, ...], list[str]] = {}
    for uri, _ in files_of(spark, *paths):
        headers.setdefault(_header(spark, uri), []).append(uri)
    headers.pop((), None)
    if not headers:
        raise ValueError("no file has a header")
    raw = None
    for header, uris in headers.items():
        schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in header) + ", `__bad` string"
        part = spark.read.csv(uris, header=True, multiLine=True, escape='"', schema=schema, columnNameOfCorruptRecord="__bad", emptyValue="", enforceSchema=True)
        raw = part if raw is None else raw.unionByName(part, allowMissingColumns=True)
    names = [c for c in raw.columns if c != "__bad"]
    quoted = ["`" + c.replace("`", "``") + "`" for c in names]
    kinds = raw.where(F.col("__bad").isNull()).agg(*[F.collect_set(F.when(csv_kind(F.col(c)) != "null", csv_kind(F.col(c)))).alias(f"k{i}") for i, c in enumerate(quoted)]).first()
    columns = []
    for i, (name, c) in enumerate(zip(names, quoted, strict=True)):
        v = F.when(F.col(c) != "", F.col(c))
        kind = set(kinds[f"k{i}"]) if kinds else set()
        columns.append((v.cast("double") if kind == {"num"} else v == "True" if kind == {"bool"} else v).alias(name))
    return raw.select(*columns, "__bad")


def interleaved(shards: list[DataFrame], order: str) -> DataFrame:
    """Shards of one run as one table: by the order column, then by shard; a shard may lack columns."""
    out = None
    for i, shard in enumerate(shards):
        part = shard.withColumn("__shard_index", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no shards")
    return out.orderBy(F.asc_nulls_first(order), "__shard_index")


def merged_history(history: DataFrame, arrived: DataFrame, index: str, place: str, shard: str) -> DataFrame:
    """A run whose files were read at first and followed since: old rows by round index, else by place, then shard; new ones as they came.

    Adds ``__at``, the time of arrival, null for old rows, which ``arrived`` has.
    """
    old = history.withColumn("__at", F.lit(None).cast("timestamp"))
    return old.unionByName(arrived, allowMissingColumns=True).orderBy(F.asc_nulls_first("__at"), F.coalesce(index, place), shard)


def last_write(rounds: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the one written last."""
    columns = [c for c in rounds.columns if c not in keys]
    return rounds.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("_r")).select(*keys, "_r.*")
