"""Logs, round files and deltas of runs on the driver's tables, each with the SQL it is checked against."""

from __future__ import annotations

import gzip
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tails
from .operators import bars, dependence, effects, interactions, provenance, rounds, runs
from .operators import members as member_sets
from .plans import dims, profiles
from .queries import _BARS, _FIT, _SETS, _SWEEP, _TEST, DIMS, PRICE, SQL, _bars, _baskets, _detected, _key, _table, _tested, query, sweep
from .sources import experiment, members
from .streaming import deltas, logs


def run_logs(spark, d) -> DataFrame:
    """A log for each user: signups start a run, views tell progress, clicks warn, errors are tracebacks or exceptions."""
    k = F.get_json_object("props", "$.k").cast("int")
    text = (
        F.when(F.col("event_type") == "signup", F.format_string("sampling %d perms...", F.col("event_id") % 500 + 1))
        .when(F.col("event_type") == "view", F.format_string("%d/500 %ds best=%d", F.col("event_id") % 97, F.col("event_id") % 89, k))
        .when(F.col("event_type") == "click", F.format_string("/x/run.py:%d: UserWarning: odd", F.col("event_id") % 5))
        .when((F.col("event_type") == "error") & (k % 2 == 0), F.lit("Traceback (most recent call last):"))
        .when(F.col("event_type") == "error", F.format_string("ValueError: %d", k))
        .when(k % 10 == 0, F.lit("-- top 5 / 500 --")).otherwise(F.format_string("spent %d", k))
    )
    return _table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("log"), F.col("event_id").alias("at"), text.alias("value"))


#: A traceback is an unbroken run of heads and exceptions from its first head on.
_LOGS = """
WITH e AS (SELECT 'u' || user_id AS log, event_id AS spot, event_type AS t, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
f AS (SELECT *, CASE WHEN t = 'signup' THEN 'start' WHEN t = 'view' THEN 'progress' WHEN t = 'click' THEN 'warning' WHEN t = 'error' AND k % 2 = 0 THEN 'head' WHEN t = 'error' THEN 'exception' WHEN k % 10 = 0 THEN 'done' ELSE 'other' END AS form FROM e),
i AS (SELECT *, count(CASE WHEN form NOT IN ('head', 'exception') THEN 1 END) OVER (PARTITION BY log ORDER BY spot) AS isle, count(CASE WHEN form = 'start' THEN 1 END) OVER (PARTITION BY log ORDER BY spot) AS starts FROM f),
h AS (SELECT *, form IN ('head', 'exception') AND count(CASE WHEN form = 'head' THEN 1 END) OVER (PARTITION BY log, isle ORDER BY spot) > 0 AS traced, count(CASE WHEN form = 'progress' AND starts = 0 THEN 1 END) OVER (PARTITION BY log ORDER BY spot) > 0 AS early FROM i),
s AS (SELECT *, starts - 1 + CASE WHEN early THEN 1 ELSE 0 END AS segment FROM h),
r AS (SELECT *, coalesce(last_value(CASE WHEN form = 'progress' THEN spot % 97 END IGNORE NULLS) OVER (PARTITION BY log, segment ORDER BY spot), 0) AS row FROM s),
crash AS (SELECT log, segment, min(spot) AS spot, max(spot) AS "end", max_by(row, spot) AS row, min_by(CAST(k AS VARCHAR), spot) FILTER (WHERE form = 'exception') AS message, count(*) FILTER (WHERE form = 'exception') AS told FROM r WHERE traced GROUP BY log, segment, isle),
fatal AS (SELECT *, segment >= 0 AND row_number() OVER (PARTITION BY log, segment ORDER BY spot) = 1 AS fatal FROM crash)"""


@query(f"""{_LOGS}, g AS (SELECT log, segment, min(spot) AS first, max(spot) AS last, coalesce(max(CASE WHEN form = 'start' THEN spot % 500 + 1 END), 500) AS total, max(CASE WHEN form = 'start' THEN 'perms' END) AS what,
  max_by(row, spot) AS rows, bool_or(form = 'done') AS done, max(segment) OVER (PARTITION BY log) AS newest FROM r WHERE segment >= 0 GROUP BY log, segment)
SELECT g.log, CAST(g.segment AS INT) AS segment, first, last, total, what, rows, CASE WHEN c.log IS NOT NULL THEN 'crashed' WHEN done THEN 'finished' WHEN g.segment = newest THEN 'open' ELSE 'ended without a closing line' END AS status
FROM g LEFT JOIN (SELECT log, segment FROM fatal WHERE fatal) c ON c.log = g.log AND c.segment = g.segment""")
def log_segments(spark, d):
    return logs.segments(logs.classified(run_logs(spark, d))).drop("stamp", "label")


@query(f"""{_LOGS} SELECT log, CAST(segment AS INT) AS segment, spot AS "at", "end", row, CASE WHEN told > 0 THEN 'ValueError' END AS exception, message, CAST(told AS INT) AS told, fatal FROM fatal""")
def log_crashes(spark, d):
    found = logs.crashes(logs.classified(run_logs(spark, d)))
    return found.select("log", "segment", "at", "end", "row", "exception", "message", F.size("exceptions").alias("told"), "fatal")


@query(f"""{_LOGS} SELECT log, CAST(spot % 5 AS INT) AS line, count(*) AS count, min(spot) AS first, max_by(row, spot) AS last_row, coalesce(array_to_string(list_sort(list(DISTINCT segment) FILTER (WHERE segment >= 0)), ' '), '') AS segments
FROM r WHERE form = 'warning' GROUP BY log, spot % 5""")
def log_warnings(spark, d):
    found = logs.warnings(logs.classified(run_logs(spark, d)))
    return found.select("log", "line", "count", F.col("first.at").alias("first"), F.col("last.row").alias("last_row"), F.array_join(F.transform("segments", lambda s: s.cast("string")), " ").alias("segments"))


def _folder(spark) -> str:
    """A new folder that driver and executors share; it goes when the driver's JVM ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/paramlens-rounds-{uuid.uuid4().hex}")
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return members.files_uri(store.makeQualified(path).toString())


def _ranges(spark, d, files: int) -> DataFrame:
    """(file, k, price) in order of file and k, by ranges that shuffles' partitions are as many as."""
    rounds = _table(spark, d, "orders").select(F.pmod("o_custkey", F.lit(files)).cast("int").alias("file"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    return rounds.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "k").sortWithinPartitions("file", "k")


def round_files(spark, d, files: int = 4) -> str:
    """Orders as rounds, one gzip member each, in order; the last member of each file is unfinished.

    Tasks write ranges of a file's rounds as parts, none of which is a whole file; then one task a file strings its parts
    together, a block at a time.
    """
    folder = _folder(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, made = None, None, []
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(f"{root}/parts", recursive=True)
        for batch in batches:
            for file, k, price in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != at:
                    if out is not None:
                        out.close()
                    name = f"{root}/parts/{uuid.uuid4().hex}"
                    at, out = file, store.open_output_stream(name, compression=None)
                    made.append((file, k, name))
                out.write(gzip.compress((json.dumps({"round_id": f"r{k}", "_round_index": k, "optimal_threshold": price}) + "\n").encode(), 1, mtime=0))
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "k", "name"), x, strict=True)) for x in made], schema=pa.schema([("file", pa.int32()), ("k", pa.int64()), ("name", pa.string())]))

    def string(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for one in batch.to_pylist():
                with store.open_output_stream(f"{root}/{one['file']}.jsonl.gz", compression=None) as out:
                    for part in one["parts"]:
                        with store.open_input_stream(part["name"], compression=None) as piece:
                            while block := piece.read(4 << 20):
                                out.write(block)
                    out.write(gzip.compress(b'{"round_id": "torn", "_round_index": 0}\n', mtime=0)[:-9])
        yield pa.RecordBatch.from_pydict({"done": pa.array([1], pa.int32())})

    parts = _ranges(spark, d, files).mapInArrow(write, "file int, k long, name string").collect()  # a row a part
    if parts:
        listed = spark.createDataFrame(parts, "file int, k long, name string").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("k", "name"))).alias("parts"))
        listed.repartition(files, "file").mapInArrow(string, "done int").write.format("noop").mode("overwrite").save()
        store, root = fs.FileSystem.from_uri(folder)
        store.delete_dir(f"{root}/parts")
    return folder


@query("""SELECT 'r' || o_orderkey AS round_id, o_orderkey AS _round_index, o_totalprice AS optimal_threshold, FALSE AS bad FROM orders""")
def round_members(spark, d):
    """Round logs of gzip members, read by many tasks, torn tails held back."""
    rounds = experiment.round_log(spark, f"{round_files(spark, d)}/*.jsonl.gz")
    return rounds.select("round_id", "_round_index", "optimal_threshold", F.col("bad").isNotNull().alias("bad"))


@query("""SELECT CAST(o_custkey % 4 AS INT) AS file, count(*) AS rounds, min(o_orderkey) AS least FROM orders GROUP BY 1""")
def round_index(spark, d):
    """Where each round is: files, how many members they hold, and which comes first in the file."""
    found = members.index(spark, f"{round_files(spark, d)}/*.jsonl.gz")
    return found.groupBy(F.regexp_extract("file", r"(\d+)\.jsonl", 1).cast("int").alias("file")).agg(F.count("*").alias("rounds"), F.min_by(F.substring("round_id", 2, 20).cast("long"), "start").alias("least"))


def delta_batches(spark, d, folder: str) -> None:
    """Events in three batches by arrival, by user in three shards; the second shard starts over in the third batch."""
    events = _table(spark, d, "events")
    n = events.agg(F.count("*").alias("n")).first()["n"]
    part = F.floor(F.col("event_id") * 3 / n).cast("int")
    shard = F.col("user_id") % 3
    rows = events.select(
        F.col("event_type").alias("run"), F.lit("rows").alias("kind"), F.concat(F.lit("s"), shard.cast("string")).alias("shard"),
        F.when((shard == 1) & (part == 2), 1).otherwise(0).alias("generation"), F.col("event_id").alias("at"), F.col("props").alias("value"), part.alias("part"),
    )
    for k in range(3):
        deltas.write(rows.where(F.col("part") == k).drop("part"), k, folder)
    deltas.write(rows.where(F.col("part") == 1).drop("part"), 1, folder)  # a batch that comes again


_PARTED = """WITH n AS (SELECT count(*) AS n FROM events), e AS (SELECT event_type AS run, 's' || user_id % 3 AS shard, CAST(floor(event_id * 3 / n) AS INT) AS part, event_id FROM events, n),
g AS (SELECT *, CASE WHEN shard = 's1' AND part = 2 THEN 1 ELSE 0 END AS generation FROM e)"""


@query(f"""{_PARTED}, now AS (SELECT run, shard, max(generation) AS generation FROM g GROUP BY ALL)
SELECT g.run, 'rows' AS kind, g.shard, CAST(g.generation AS INT) AS generation, CASE WHEN g.generation = 1 THEN 'reset' ELSE 'rows' END AS message, count(*) FILTER (WHERE part = 0) AS lo, count(*) AS hi
FROM g JOIN now ON now.run = g.run AND now.shard = g.shard AND now.generation = g.generation GROUP BY g.run, g.shard, g.generation HAVING count(*) > count(*) FILTER (WHERE part = 0)""")
def delta_messages(spark, d):
    """What a reader that holds the first of three batches must do."""
    folder = _folder(spark)
    delta_batches(spark, d, folder)
    return deltas.messages(deltas.ledger(spark, folder), 0)


@query(f"""{_PARTED} SELECT run, shard, CAST(generation AS INT) AS generation, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS at FROM g WHERE (shard <> 's1' AND part > 0) OR generation = 1 GROUP BY ALL""")
def delta_rows(spark, d):
    """Just the rows that it lacks."""
    folder = _folder(spark)
    delta_batches(spark, d, folder)
    return deltas.delta(spark, folder, 0).groupBy("run", "shard", "generation").agg(F.count("*").alias("rows"), F.sum("at").alias("at"))


_GRAPH = ["l_returnflag", "l_linestatus", "status_n"]


def _edges_sql() -> str:
    pairs = [(a, b) for a in _GRAPH for b in _GRAPH if a != b]
    cells = " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {b} AS lb, count(*) AS n, count({a}) AS on_, count(DISTINCT {a}) AS k, count(y) FILTER (WHERE {a} IS NOT NULL) AS ny, coalesce(sum(y) FILTER (WHERE {a} IS NOT NULL), 0) AS sy, (SELECT count(DISTINCT {a}) FROM sweep) AS ka FROM sweep GROUP BY {b}"
        for a, b in pairs
    )
    return f"""{_SWEEP}, c AS ({cells}),
e AS (SELECT a, b, sum(n) AS n, sum(on_) AS on_, sum(ny) AS ny, sum(sy) AS sy, count(lb) AS of_, any_value(ka) AS ka, bool_and(lb IS NULL OR (k <= 1 AND on_ IN (0, n))) AS fixed, bool_and(on_ IN (0, n)) AS cut,
  list_sort(list(lb) FILTER (WHERE lb IS NOT NULL AND on_ > 0)) AS within_, coalesce(sum(on_) FILTER (WHERE lb IS NULL), 0) AS off_ FROM c GROUP BY a, b),
f AS (SELECT * FROM e WHERE ka >= 2 AND of_ >= 2)
SELECT a AS dim, b AS other, 'determined by' AS relation, NULL AS within, round(on_ / n, 6) AS share, round(sy / ny, 4) AS mean FROM f WHERE fixed AND off_ = 0
UNION ALL SELECT a, b, 'applies within', array_to_string(within_, '|'), round(on_ / n, 6), round(sy / ny, 4) FROM f WHERE cut AND on_ < n AND off_ = 0 AND len(within_) > 0"""


@query(_edges_sql())
def scope_graph(spark, d):
    """Which dimension applies within which levels of another, or is determined by it."""
    out = dependence.dependence(sweep(spark, d), PRICE, _GRAPH)
    return out.select("dim", "other", "relation", F.array_join("within", "|").alias("within"), F.round("share", 6).alias("share"), F.round("mean", 4).alias("mean"))


def choices(spark, d) -> DataFrame:
    """A session for each user, in which events set and clear choices."""
    k = F.get_json_object("props", "$.k").cast("int")
    what = (
        F.when(F.col("event_type") == "click", "pocket").when(F.col("event_type") == "view", "first_half").when(F.col("event_type") == "purchase", "target")
        .when(F.col("event_type") == "signup", "gates").when(k % 10 == 0, "restored").otherwise("context")
    )
    value = (
        F.when(what == "pocket", F.when(k % 4 != 0, F.concat(F.lit("a="), k.cast("string")))).when(what == "first_half", F.when(k % 4 != 0, "true").otherwise("false"))
        .when(what == "target", F.when(k % 3 == 0, "auc").otherwise("pnl")).when(what == "gates", F.when(k % 3 != 0, F.when(k % 2 == 0, "g1=pnl").otherwise("g1=auc")))
    )
    return _table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("at"), what.alias("what"), value.alias("value"))


def _standing(what: str) -> str:
    return f"coalesce(last_value(CASE WHEN what = '{what}' THEN coalesce(value, '') END IGNORE NULLS) OVER (PARTITION BY session ORDER BY spot), '')"


@query(f"""WITH e AS (SELECT user_id AS session, event_id AS spot, event_type AS t, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
c AS (SELECT session, spot, CASE t WHEN 'click' THEN 'pocket' WHEN 'view' THEN 'first_half' WHEN 'purchase' THEN 'target' WHEN 'signup' THEN 'gates' ELSE CASE WHEN k % 10 = 0 THEN 'restored' ELSE 'context' END END AS what,
  CASE t WHEN 'click' THEN CASE WHEN k % 4 <> 0 THEN 'a=' || k END WHEN 'view' THEN CASE WHEN k % 4 <> 0 THEN 'true' ELSE 'false' END WHEN 'purchase' THEN CASE WHEN k % 3 = 0 THEN 'auc' ELSE 'pnl' END WHEN 'signup' THEN CASE WHEN k % 3 <> 0 THEN 'g1=' || CASE WHEN k % 2 = 0 THEN 'pnl' ELSE 'auc' END END END AS value FROM e),
v AS (SELECT session, spot, what, {_standing('pocket')} <> '' OR {_standing('gates')} <> '' OR {_standing('context')} <> '' OR what = 'restored' AS held, {_standing('first_half')} <> 'true' OR {_standing('target')} = 'auc' OR what = 'restored' AS tainted FROM c),
w AS (SELECT *, count(CASE WHEN NOT held THEN 1 END) OVER (PARTITION BY session ORDER BY spot) AS choice FROM v)
SELECT session, spot AS "at", CASE WHEN held THEN CASE WHEN max((tainted AND held)::INT) OVER (PARTITION BY session, choice ORDER BY spot) = 1 THEN 'whole' ELSE 'first' END END AS found FROM w""")
def choices_found(spark, d):
    """Whether each choice, as it stands after each change, has seen the second half."""
    return provenance.replayed(choices(spark, d), ["pnl"], {}, "pnl").select("session", "at", "found")


_EVENTS = profiles.Profile(
    "events", marks=("props", "value"), reads=(profiles.Read("k", "props", r'"k": (\d+)'), profiles.Read("even", "props", r'"k": \d*(\d)\}', "0")),
    derived=(
        profiles.Derived("top", ("good", "score"), "good = 1 and score > 1000", binary=True), profiles.Derived("good", ("k", "value"), "k >= 50 and value >= 10", binary=True),
        profiles.Derived("score", ("k", "value"), "k * value"), profiles.Derived("none", ("missing",), "1"),
    ),
    invariants=(profiles.Invariant("k below 95", ("k",), "k >= 95"), profiles.Invariant("clicks are cheap", ("event_type", "value"), "event_type = 'click' and value > 40"), profiles.Invariant("k is known", ("k",), "k is null")),
)

_PROFILED = """WITH e AS (SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
f AS (SELECT *, (k % 10 = 0)::INT::DOUBLE AS even, CASE WHEN value IS NOT NULL THEN (k >= 50 AND value >= 10)::INT::DOUBLE END AS good, k * value AS score FROM e)"""


@query(f"""{_PROFILED} SELECT event_id, k, even, good, round(score, 4) AS score, (good = 1 AND score > 1000)::INT::DOUBLE AS top, (k >= 95)::INT + (event_type = 'click' AND value > 40)::INT AS breaks FROM f""")
def profile_rows(spark, d):
    """A profile's columns: two read from a text, two levels of derived targets, and how many promises a row breaks."""
    out = profiles.profiled(_table(spark, d, "events"), _EVENTS)
    return out.select("event_id", "k", "even", "good", F.round("score", 4).alias("score"), "top", F.size("breaks").alias("breaks"))


@query("""WITH e AS (SELECT event_type, value, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
SELECT 'k below 95' AS invariant, count(*) FILTER (WHERE k >= 95) AS n FROM e UNION ALL SELECT 'clicks are cheap', count(*) FILTER (WHERE event_type = 'click' AND value > 40) FROM e UNION ALL SELECT 'k is known', count(*) FILTER (WHERE k IS NULL) FROM e""")
def profile_breaks(spark, d):
    return profiles.breaks(profiles.profiled(_table(spark, d, "events"), _EVENTS), _EVENTS)


@query(f"""{_SWEEP}, l AS (SELECT row_number() OVER (ORDER BY status_n NULLS FIRST) - 1 AS code, status_n FROM (SELECT DISTINCT status_n FROM sweep)), m AS (SELECT row_number() OVER (ORDER BY l_discount) - 1 AS code, l_discount FROM (SELECT DISTINCT l_discount FROM sweep))
SELECT CAST(l.code AS INT) AS status, CAST(m.code AS INT) AS discount, count(*) AS n FROM sweep s JOIN l ON l.status_n IS NOT DISTINCT FROM s.status_n JOIN m ON m.l_discount = s.l_discount GROUP BY 1, 2""")
def level_lookup(spark, d):
    """Rows by the codes of two dimensions' levels."""
    rows = dims.coded(dims.coded(sweep(spark, d), "status_n", "status"), "l_discount", "discount")
    return rows.groupBy("status", "discount").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT o_orderkey % 100 AS g, count(*) AS n FROM orders GROUP BY 1)
SELECT CASE WHEN g % 7 = 1 THEN 'market returns and predictions differ in length' WHEN g % 7 = 2 THEN 'the digest differs' WHEN g % 7 = 3 THEN 'no such market' WHEN g % 7 = 4 THEN 'a return is no number' WHEN g % 7 = 5 THEN 'not an object of returns alone' END AS problem,
 CAST(sum(n) AS BIGINT) AS rounds, CAST(sum(CASE WHEN g % 7 IN (0, 6) THEN 2 * n ELSE 0 END) AS BIGINT) AS returns FROM r GROUP BY 1""")
def market_references(spark, d):
    """Rounds that share market returns by digest: which fit, and why others don't."""
    orders = _table(spark, d, "orders").select((F.col("o_orderkey") % 100).alias("g"))
    way = F.col("g") % 7
    text = (
        F.when(way == 4, F.format_string('{"ret": [%d, "x"]}', "g")).when(way == 5, F.format_string('{"ret": [%d, 1], "more": 1}', "g"))
        .when(way == 1, F.format_string('{"ret": [%d]}', "g")).otherwise(F.format_string('{"ret": [%d, null]}', "g"))
    )
    named = orders.withColumn("text", text).withColumn("market_ref", F.sha2("text", 256))
    markets = named.where(way != 3).select("g", F.col("market_ref").alias("ref"), F.when(way == 2, F.concat("text", F.lit(" "))).otherwise(F.col("text")).alias("text")).distinct().drop("g")
    rounds = named.select("market_ref", F.array(F.lit(1.0), F.lit(0.0)).alias("preds"), F.lit(None).cast("struct<pos:array<double>>").alias("execution"), F.lit(None).cast("struct<ret:array<double>>").alias("market"))
    out = experiment.hydrated(rounds, markets)
    return out.groupBy(F.col("market_problem").alias("problem")).agg(F.count("*").alias("rounds"), F.sum(F.coalesce(F.size(F.col("market")["ret"]), F.lit(0)).cast("long")).alias("returns"))


@query(SQL["combos"])
def set_search(spark, d):
    """Sets of three, best first within the budget, which has room for all of them here; q over those tested."""
    rows = sweep(spark, d)
    found = interactions.search(rows, PRICE, DIMS, 3, effects.board(rows, PRICE, DIMS), interactions.interactions(rows, PRICE, DIMS), batch=4)
    return _tested(found)


_LATE = _FIT.replace("(1 - l_discount) END AS y", "(1 - l_discount) * CASE WHEN l_returnflag = 'N' AND l_linenumber > 3 THEN 1.5 ELSE 1 END END AS y")


@query(f"""{_LATE}, {tails.additive_fit(_SETS[2], _key)}, {tails.interaction_tests(2, 0)}, u AS ({_detected(tails.with_q('tests', 'd AS dims, ' + _TEST))}) SELECT dims, 'strongest' AS why FROM u WHERE detectable ORDER BY omega2 DESC, dims LIMIT 1""")
def best_pair(spark, d):
    """The pair to look at first, where late lines of one flag cost more."""
    y = F.col("y") * F.when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") > 3), 1.5).otherwise(1.0)
    found = interactions.chosen_set(interactions.interactions(sweep(spark, d).withColumn("y", y), PRICE, DIMS))
    return found.select(F.array_join("dims", "|").alias("dims"), "why")


@query("""WITH b AS (SELECT l_orderkey, list_distinct(list(l_returnflag)) AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey)
SELECT list_contains(s, 'A')::INT AS "in_A", list_contains(s, 'N')::INT AS "in_N", list_contains(s, 'R')::INT AS "in_R", CAST(len(s) AS INT) AS size, count(*) AS n FROM b GROUP BY ALL""")
def member_flags(spark, d):
    """Members and sizes of sets as dimensions."""
    rows = member_sets.member_flags(_baskets(spark, d), "set", ["A", "N", "R"])
    return rows.groupBy("in_A", "in_N", "in_R", "size").agg(F.count("*").alias("n"))


@query("""SELECT 'r' || o_custkey % 100 AS id, o_orderkey, o_orderstatus AS shard FROM orders WHERE o_custkey % 100 = 7 AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 1""")
def row_of_round(spark, d):
    """The first row of a round id in one directory."""
    rows = _table(spark, d, "orders").select(F.concat(F.lit("r"), (F.col("o_custkey") % 100).cast("string")).alias("id"), "o_orderkey", F.col("o_orderstatus").alias("shard"))
    return rounds.row_of(rows, "r7", "o_orderkey", "F")


@query(_BARS + """, p AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY at_) - 1 AS place, count(*) OVER (PARTITION BY member) AS n FROM b)
SELECT member, CASE WHEN place < n // 2 THEN 1 ELSE 2 END AS half, count(*) AS bars, round(avg(net) * 10000, 4) AS pnl FROM p GROUP BY 1, 2""")
def bar_halves(spark, d):
    """Bars of each member by the halves of its own window."""
    return bars.halves(_bars(spark, d)).groupBy("member", "half").agg(F.count("*").alias("bars"), F.round(F.avg("net") * 10000, 4).alias("pnl"))


@query("""SELECT event_type AS pattern, CAST(sum(c) AS BIGINT) AS rounds, CAST(sum(w) AS BIGINT) AS warned FROM (SELECT event_type, user_id % 3 AS shard, count(*) AS c, count(*) FILTER (WHERE value > 50) AS w FROM events GROUP BY 1, 2) GROUP BY 1""")
def convergence_sums(spark, d):
    """Convergence reports of three shards, summed."""
    events = _table(spark, d, "events")
    reports = events.groupBy(F.col("event_type").alias("pattern"), F.col("user_id") % 3).agg(F.count("*").alias("rounds"), F.count(F.when(F.col("value") > 50, 1)).alias("warned"))
    return runs.convergence(reports)
