"""What readers lack, from batches that may come again and shards that start over."""

import pytest

from paramlens.streaming import deltas

COLUMNS = "run string, kind string, shard string, generation int, at long, value string"


def rows(run, shard, generation, places, kind="rows"):
    return [(run, kind, shard, generation, at, f"{run}{shard}{generation}:{at}") for at in places]


BATCHES = [
    rows("r", "1", 0, [0, 1, 2]) + rows("r", "2", 0, [0, 1]) + rows("r", "1", 0, [0], "log"),
    rows("r", "1", 0, [3]) + rows("q", "1", 0, [0]),
    rows("r", "2", 1, [0, 1, 2]),  # started over
    rows("r", "2", 1, [3]) + rows("r", "1", 0, [4]),
]


def values(df):
    return sorted(r["value"] for r in df.collect())


@pytest.fixture
def path(spark, tmp_path):
    for number, batch in enumerate(BATCHES):
        deltas.write(spark.createDataFrame(batch, COLUMNS), number, str(tmp_path))
    return str(tmp_path)


def test_a_reader_at_any_cursor_gets_just_the_difference(spark, path):
    entries = deltas.ledger(spark, path)
    whole = values(deltas.current(spark, path))
    assert whole == sorted(r[5] for b in BATCHES for r in b if not (r[2] == "2" and r[3] == 0)) and deltas.newest_batch(entries) == 3
    assert values(deltas.archived(spark, path)) == ["r20:0", "r20:1"]
    for cursor in (0, 1, 2, 3):
        held, lacks, changes = deltas.current(spark, path, cursor), deltas.delta(spark, path, cursor), deltas.messages(entries, cursor)
        assert values(deltas.brought_up(held, changes, lacks)) == whole
        assert len(values(lacks)) == sum((r["hi"] - r["lo"]) for r in changes.collect())
    assert values(deltas.delta(spark, path, None)) == whole and deltas.delta(spark, path, 3).count() == 0
    told = {(r["run"], r["kind"], r["shard"]): (r["message"], r["generation"], r["lo"], r["hi"]) for r in deltas.messages(entries, 0).collect()}
    assert told == {("r", "rows", "1"): ("rows", 0, 3, 5), ("r", "rows", "2"): ("reset", 1, 0, 4), ("q", "rows", "1"): ("new", 0, 0, 1)}
    assert {r["message"] for r in deltas.messages(entries, None).collect()} == {"new"}


def test_a_batch_that_comes_again_changes_nothing(spark, path):
    before = values(deltas.current(spark, path)), sorted(map(tuple, deltas.ledger(spark, path).collect()))
    deltas.write(spark.createDataFrame(BATCHES[1], COLUMNS), 1, path)
    assert (values(deltas.current(spark, path)), sorted(map(tuple, deltas.ledger(spark, path).collect()))) == before


def test_rows_without_a_ledger_entry_are_not_seen(spark, path):
    before = values(deltas.current(spark, path))
    batch = spark.createDataFrame(rows("r", "1", 0, [9]), COLUMNS).selectExpr("at", "value", "run", "kind", "shard", "generation", "4L as batch")
    batch.write.mode("append").partitionBy(*deltas.KEYS, "batch").parquet(f"{path}/rows")  # a batch that failed before its entry
    assert values(deltas.current(spark, path)) == before
    deltas.write(spark.createDataFrame(rows("r", "1", 0, [9]), COLUMNS), 4, path)
    assert values(deltas.current(spark, path)) == sorted([*before, "r10:9"])


def test_waiting_for_histories(spark, path):
    shards = spark.createDataFrame([("r", "1"), ("r", "2"), ("r", "3")], "run string, shard string")
    assert [tuple(r) for r in deltas.waiting(deltas.ledger(spark, path, 0), shards).collect()] == [("r", "3")]


def test_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame(BATCHES[0], COLUMNS).write.json(str(source))
    query = deltas.follow(spark.readStream.schema(COLUMNS).json(str(source)), str(tmp_path / "out"), str(tmp_path / "check"))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert values(deltas.current(spark, str(tmp_path / "out"))) == sorted(r[5] for r in BATCHES[0])
