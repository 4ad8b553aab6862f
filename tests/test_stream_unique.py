"""Uniqueness on arrival by keyed state: first rows by order, late rows, nulls, restarts and replays."""

import os
import random

import pytest

from moraine.session import scratch_dir
from moraine.streaming import jobs

ROW = "k string, j int, at int, payload string"


def batches(seed, n=4, size=60):
    rnd = random.Random(seed)
    return [[(rnd.choice(["a", "b", "c", None, "hot", "hot", "hot"]), rnd.choice([1, 2, None]), rnd.choice([None, *range(50)]), f"p{b}-{i}")
             for i in range(size)] for b in range(n)]


def expected(rows):
    best = {}
    for k, j, at, payload in rows:
        rank = (at is None, at or 0)
        if (k, j) not in best or rank < best[k, j][0]:
            best[k, j] = (rank, {payload})
        elif rank == best[k, j][0]:
            best[k, j][1].add(payload)
    return best


def arrive(spark, folder, i, rows):
    spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(folder)


def published(spark, path):
    return {(r.k, r.j): (r.at, r.payload) for r in jobs.unique_rows(spark, path, ["k", "j"]).collect()}


def check(got, rows):
    want = expected(rows)
    assert set(got) == set(want)
    for key, (at, payload) in got.items():
        assert (at is None, at or 0) == want[key][0] and payload in want[key][1]


def run(spark, folder, sink):
    jobs.run_unique(jobs.stream_files(spark, folder, ROW, 1), ["k", "j"], f"{sink}/rows", f"{sink}/cp", ["at"])


def test_first_rows_across_batches_and_restarts(spark):
    folder, sink, seen = scratch_dir(spark, "arrive"), scratch_dir(spark, "sink"), []
    for i, rows in enumerate(batches(1)):
        arrive(spark, folder, i, rows)
        seen += rows
        run(spark, folder, sink)  # a restart for every batch
        check(published(spark, f"{sink}/rows"), seen)
    spark_rows = spark.read.parquet(f"{sink}/rows")
    before = spark_rows.count()
    run(spark, folder, sink)  # nothing new
    assert spark.read.parquet(f"{sink}/rows").count() == before


def test_a_replayed_batch_writes_the_same(spark):
    folder, sink, seen = scratch_dir(spark, "arrive"), scratch_dir(spark, "sink"), []
    for i, rows in enumerate(batches(2, 3)):
        arrive(spark, folder, i, rows)
        seen += rows
        run(spark, folder, sink)
    before = published(spark, f"{sink}/rows")
    commits = f"{sink.removeprefix('file://')}/cp/commits"
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    for name in (str(last), f".{last}.crc"):  # the last batch was written, but not committed
        if os.path.exists(f"{commits}/{name}"):
            os.remove(f"{commits}/{name}")
    run(spark, folder, sink)
    assert published(spark, f"{sink}/rows") == before
    check(before, seen)


def test_a_batch_writes_only_keys_it_changed(spark):
    folder, sink = scratch_dir(spark, "arrive"), scratch_dir(spark, "sink")
    first = [("a", 1, 5, "x"), ("b", 1, 5, "x"), ("a", 1, 7, "y")]
    later = [("a", 1, 9, "z"), ("b", 1, 2, "late"), ("c", 1, None, "new"), ("a", 1, 5, "x")]
    for i, rows in enumerate((first, later)):
        arrive(spark, folder, i, rows)
        run(spark, folder, sink)
    wrote = spark.read.parquet(f"{sink}/rows")
    latest = wrote.agg({"batch_id": "max"}).first()[0]
    assert sorted(r.k for r in wrote.filter(f"batch_id = {latest}").collect()) == ["b", "c"]
    assert published(spark, f"{sink}/rows") == {("a", 1): (5, "x"), ("b", 1): (2, "late"), ("c", 1): (None, "new")}


def test_state_is_keyed_and_nothing_published_is_read(spark):
    stream = spark.readStream.schema(ROW).parquet(os.path.dirname(__file__))
    plan = jobs.first_rows(stream, ["k", "j"], ["at"])._jdf.queryExecution().toString()
    assert "min_by" in plan and "Join" not in plan
    assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize("again,rows", [("2024-01-01 00:05:00", 1), ("2024-01-01 09:00:00", 2)])
def test_state_expires_after_a_span(spark, again, rows):
    folder, sink = scratch_dir(spark, "arrive"), scratch_dir(spark, "sink")
    schema = "k string, ts timestamp_ntz"
    for at in ("2024-01-01 00:00:00", "2024-01-01 06:00:00" if rows == 2 else "2024-01-01 00:01:00", again):
        k = "other" if "06:00" in at or "00:01" in at else "a"
        spark.sql(f"SELECT '{k}' AS k, timestamp_ntz'{at}' AS ts").coalesce(1).write.mode("append").parquet(folder)
        jobs.run_unique(jobs.stream_files(spark, folder, schema, 1), ["k"], f"{sink}/rows", f"{sink}/cp", within=("ts", "1 hour"))
    assert spark.read.parquet(f"{sink}/rows").filter("k = 'a'").count() == rows
