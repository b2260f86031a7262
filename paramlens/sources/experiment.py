"""Result directories: their declaration, reports, round logs, and whether several make one run."""

from __future__ import annotations

import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import members
from .rows import last_write, numbered_lines

_SERIES = "array<double>"
ROUND = (
    f"round_id string, _round_index long, probs {_SERIES}, preds {_SERIES}, optimal_threshold double, threshold_rule string, market_ref string, "
    f"execution struct<pos:{_SERIES}, gross:{_SERIES}, net:{_SERIES}>, market struct<ret:{_SERIES}>, round_params struct<fee_bps:double, slip_bps:double>"
)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file by any path that Spark reads; None if there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def metadata(spark: SparkSession, directory: str) -> dict:
    """The declaration in ``metadata.json``: manifest, sampled parameters, run settings, objective."""
    text = read_text(spark, f"{directory}/metadata.json")
    if text is None:
        raise FileNotFoundError(f"{directory} has no metadata.json")
    raw = json.loads(text)
    own = raw.get("yaml_reference") or {}
    sfd = own.get("sfd") or {}
    return {"manifest": own, "params": sfd.get("params") or {}, "uel": own.get("uel") or {}, "objective": raw.get("objective"), "id": raw.get("manifest_id")}


def reports(spark: SparkSession, directory: str) -> dict[str, dict | None]:
    """The convergence and acceptance reports that are there."""
    found = {name: read_text(spark, f"{directory}/{name}_report.json") for name in ("convergence", "acceptance")}
    return {name: json.loads(text) if text else None for name, text in found.items()}


#: Where result directories of one run may differ.
OWN_SETTINGS = ("uel.search.seed", "uel.output_path")


def settings(manifest: dict) -> dict[str, str]:
    """A manifest as a flat table: dotted place and JSON text of every value that isn't an object."""
    table, todo = {}, [("", manifest)]
    while todo:
        place, node = todo.pop()
        if isinstance(node, dict) and node:
            todo += [(f"{place}.{key}" if place else key, inner) for key, inner in node.items()]
        else:
            table[place] = json.dumps(node, sort_keys=True)
    return table


def why_not_one_run(declared: dict[str, dict]) -> str | None:
    """What keeps result directories from being read as one run, or None: all of it, in one text.

    Every setting must have one value everywhere but for ``OWN_SETTINGS``. A grid search draws the same rounds in each
    directory, and so does a seed that two share.
    """
    tables = {label: settings(m) for label, m in declared.items()}
    places = sorted({place for t in tables.values() for place in t} - set(OWN_SETTINGS))
    unlike = [place for place in places if len({t.get(place) for t in tables.values()}) > 1]
    seeds = Counter(t["uel.search.seed"] for t in tables.values() if t.get("uel.search.seed", "null") != "null")
    grids = [label for label, t in tables.items() if t.get("uel.search.type") == '"grid"']
    problems = [
        f"settings differ: {', '.join(unlike)}" if unlike else None,
        f"a grid search draws the same rounds everywhere: {', '.join(grids)}" if grids and len(tables) > 1 else None,
        *[f"seed {seed} is shared by {n} directories" for seed, n in seeds.items() if n > 1],
    ]
    return "; ".join(p for p in problems if p) or None


# The files that hold a run's rounds, and how its metadata declares the compressed form.
PLAIN_ROUNDS = "round_data.jsonl"
PACKED_ROUNDS = "round_data.jsonl.gz"


def round_file(names: set[str], declared: str | None, packed: str) -> str:
    """The file that holds the rounds; ``declared`` is the storage that metadata names, ``packed`` the name of the compressed one.

    What is declared and what is there must fit: nothing declared means plain lines and no compressed file.
    """
    expected = {None: (PLAIN_ROUNDS, PACKED_ROUNDS), packed: (PACKED_ROUNDS, PLAIN_ROUNDS)}.get(declared)
    if expected is None:
        raise ValueError(f"unknown round storage {declared}")
    own, other = expected
    if other in names:
        raise ValueError(f"{other} doesn't fit the declared storage, which is {declared or 'plain'}")
    return own


def round_log(spark: SparkSession, *paths: str) -> DataFrame:
    """Round records from JSON lines or gzip members, by file and line; records without an index, or torn ones, are marked in ``bad``.

    Of a file's records with one index the last written holds. For gzip members, each read by many tasks, ``line`` is
    the offset of the record's member; one that the run is still writing is held back.
    """
    packed = [p for p in paths if p.endswith(".gz")]
    found = []
    if len(packed) < len(paths):
        found.append(numbered_lines(spark, *[p for p in paths if p not in packed]).select("shard", "line", F.lit(0).alias("part"), "text"))
    if packed:
        found.append(members.lines(spark, *packed).select("shard", F.col("place").alias("line"), "part", "text"))
    lines = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    parsed = lines.where(F.trim("text") != "").select("shard", "line", "part", F.from_json("text", ROUND).alias("r"), "text")
    index = F.col("r._round_index")
    rows = parsed.select("shard", "line", "part", "r.*", F.when(index.isNull() | (index < 0), F.col("text")).alias("bad"))
    spot = F.struct("line", "part")
    last = last_write(rows.where(F.col("bad").isNull()).withColumn("_spot", spot), ["shard", "_round_index"], "_spot")
    return last.select(*rows.columns).unionByName(rows.where(F.col("bad").isNotNull())).drop("part")


def _unsound() -> Column:
    """Why a round's recorded arrays can't be used, or null."""
    e, n = F.col("execution"), F.size(F.col("execution")["pos"])
    return (
        F.when(e.isNull() | (F.coalesce(n, F.lit(-1)) <= 0), "no execution was recorded")
        .when((F.size(e["gross"]) != n) | (F.size(e["net"]) != n), "execution arrays differ in length")
        .when(F.col("market").isNotNull() & (F.size(F.col("market")["ret"]) != n), "market returns differ in length")
    )


def executions(rounds: DataFrame) -> DataFrame:
    """Rounds whose recorded arrays are of one length, as ``member``, ``pos``, ``gross``, ``net`` and ``ret``; see ``left_out``."""
    e = F.col("execution")
    return rounds.where(_unsound().isNull()).select(F.col("round_id").alias("member"), e["pos"].alias("pos"), e["gross"].alias("gross"), e["net"].alias("net"), F.col("market")["ret"].alias("ret"))


def left_out(rounds: DataFrame) -> DataFrame:
    """(round_id, reason) of the rounds that ``executions`` leaves out."""
    return rounds.select("round_id", _unsound().alias("reason")).where(F.col("reason").isNotNull())


def search_space(params: dict[str, list], narrowed: dict[str, list] | None = None) -> dict:
    """How many combinations a manifest's parameters span, now and with some cut to chosen values; choices it lacks are problems."""
    narrowed = narrowed or {}
    lists = {k: v if isinstance(v, list) else [v] for k, v in params.items()}
    problems = [f"{k} is not a parameter" for k in narrowed if k not in lists]
    problems += [f"{k} has no value {v}" for k, own in narrowed.items() if k in lists for v in own if v not in lists[k]]
    cut = {k: [v for v in own if v in narrowed[k]] if k in narrowed else own for k, own in lists.items()}
    problems += [f"{k} would have no values" for k, own in cut.items() if not own and lists[k]]
    size = lambda table: math.prod(len(own) for own in table.values())
    return {"params": len(lists), "combinations": size(lists), "narrowed": cut, "left": size(cut), "problems": problems}


def hydrated(rounds: DataFrame, markets: DataFrame) -> DataFrame:
    """Rounds that refer to shared market returns get them, or ``market_problem``: why they can't.

    ``markets`` has ref and text. The text must have the digest that names it and be an object with nothing but ``ret``, a list of
    finite numbers and nulls, as long as the round's predictions, or its positions where it has none.
    """
    raw = F.from_json("text", "ret array<string>")["ret"]
    ret = F.transform(raw, lambda t: t.try_cast("double"))
    sound = F.forall(F.zip_with(raw, ret, lambda t, v: t.isNull() | (v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))), lambda ok: ok)
    broken = (
        F.when(F.sha2("text", 256) != F.col("ref"), "the digest differs").when(~F.coalesce(F.array_size(F.json_object_keys("text")) == 1, F.lit(False)) | ret.isNull(), "not an object of returns alone")
        .when(~sound, "a return is no number")
    )
    known = markets.select(F.col("ref").alias("market_ref"), F.struct(ret.alias("ret")).alias("_m"), broken.alias("_broken"), F.lit(True).alias("_there"))
    rows = rounds.join(known, "market_ref", "left")
    n = F.coalesce(F.size("preds"), F.size(F.col("execution")["pos"]))
    asked = F.col("market_ref").isNotNull()
    problem = (
        F.when(~asked, None).when(F.col("market").isNotNull(), "both a market and a reference").when(~F.rlike("market_ref", F.lit("^[0-9a-f]{64}$")), "not a reference")
        .when(F.col("_there").isNull(), "no such market").when(F.col("_broken").isNotNull(), F.col("_broken")).when(n.isNull(), "no positions to align with")
        .when(F.size(F.col("_m")["ret"]) != n, "market returns and predictions differ in length")
    )
    rows = rows.withColumn("market_problem", problem)
    return rows.withColumn("market", F.when(asked & F.col("market_problem").isNull(), F.col("_m")).otherwise(F.col("market"))).drop("_m", "_broken", "_there")


def manifest_file(names: set[str], directory: str) -> str:
    """The file that a result directory keeps its manifest in: the only YAML file there."""
    found = sorted(n for n in names if n.rpartition(".")[2] in ("yaml", "yml"))
    if len(found) != 1:
        raise ValueError(f"{directory} must hold one YAML file and holds {', '.join(found) or 'none'}")
    return found[0]


def slim(rows: DataFrame, ids: DataFrame, path: str, lines: DataFrame | None = None) -> None:
    """Writes a run of given ids only: its rows as CSV in ``results``, and in ``rounds`` the lines (text) of a round log as they were."""
    wanted = ids.select("id").distinct()
    rows.join(wanted, "id", "left_semi").write.mode("overwrite").csv(f"{path}/results", header=True)
    if lines is not None:
        named = lines.withColumn("id", F.get_json_object("text", "$.round_id"))
        named.join(wanted, "id", "left_semi").select("text").write.mode("overwrite").text(f"{path}/rounds")
