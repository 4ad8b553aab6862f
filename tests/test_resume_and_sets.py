"""Backfills that resume, sets published together, planned probes, curve layouts, rules carried back."""

import pytest
from pyspark.sql import functions as F
from test_fleet import inventory

from moraine.operators import checks as ck
from moraine.operators import evolve as ev
from moraine.operators import safety as sf
from moraine.plans import changes as ch
from moraine.plans import phases as ph
from moraine.plans import probing as pb
from moraine.session import drop_scratch, recorded_scratch, scratch_dir, staged
from moraine.sources.files import delete, is_dir, list_names
from moraine.sources.publish import PublishError, StaleError, Staged, current_set, publish_tables, read_set


@pytest.fixture()
def half(spark):
    """A migration half way, with nulls in the key and keys below zero."""
    return spark.range(-40, 60).selectExpr(
        "CASE WHEN id % 17 = 0 THEN NULL ELSE id END AS k", "concat('v', id) AS old",
        "CASE WHEN id % 3 = 0 THEN 'kept' END AS new").repartition(3)


def plain(df):
    return sorted(map(str, df.collect()))


def test_a_stopped_backfill_resumes(spark, half):
    path = scratch_dir(spark, "backfill")
    arguments = (half, "k", 5, "new", "old", "string", path, 6)
    assert ph.run_backfill(*arguments, stop_after=2) == 2
    with pytest.raises(ph.GateError, match="has not finished"):
        ph.read_backfill(spark, path)
    half.limit(3).write.mode("overwrite").parquet(f"{path}/batch-3")  # what a killed task has left
    second = ph.run_backfill(*arguments)
    assert second == len([n for n in list_names(spark, f"{path}/{ph.MANIFEST}") if n.startswith("batch-")]) - 2
    assert plain(ph.read_backfill(spark, path)) == plain(ph.type_change_backfill(half, "old", "new", "string"))
    assert ph.run_backfill(*arguments) == 0


def test_a_backfill_is_not_mixed_with_another(spark, half):
    path = scratch_dir(spark, "backfill")
    ph.run_backfill(half, "k", 5, "new", "old", "string", path, 6, 1)
    with pytest.raises(ph.GateError, match="another backfill"):
        ph.run_backfill(half, "k", 7, "new", "old", "string", path, 6)
    empty = half.limit(0)
    path = scratch_dir(spark, "backfill")
    ph.run_backfill(empty, "k", 5, "new", "old", "string", path)
    assert ph.read_backfill(spark, path).count() == 0


def test_ranges_of_a_backfill_reach_the_scan(spark, half):
    path, table = scratch_dir(spark, "backfill"), scratch_dir(spark, "table")
    half.write.parquet(table)
    ph.run_backfill(spark.read.parquet(table), "k", 5, "new", "old", "string", path, 4)
    assert plain(ph.read_backfill(spark, path)) == plain(ph.type_change_backfill(half, "old", "new", "string"))


def test_a_set_is_published_whole_or_not_at_all(spark):
    root = scratch_dir(spark, "set")
    parents, children = spark.range(5).toDF("id"), spark.range(10).selectExpr("id AS child", "id % 5 AS id")
    fk = ck.ForeignKey(("id",), "parents", ("id",))
    first = publish_tables(spark, root, {"parents": Staged(parents, (ck.PrimaryKey(("id",)),)), "children": Staged(children, (fk,))})
    with pytest.raises(PublishError, match="children"):
        publish_tables(spark, root, {"parents": Staged(parents.filter("id < 3")), "children": Staged(children, (fk,))})
    assert {n: df.count() for n, df in read_set(spark, root).items()} == {"parents": 5, "children": 10}
    assert {len(list_names(spark, f"{root}/{n}")) for n in ("parents", "children")} == {1}  # nothing staged is left
    second = publish_tables(spark, root, {"children": Staged(children.withColumn("note", F.lit("n")), (fk,))}, first["hash"])
    assert second["tables"]["parents"] == first["tables"]["parents"] and second["hash"] != first["hash"]
    with pytest.raises(StaleError):  # planned on definitions that have moved
        publish_tables(spark, root, {"children": Staged(children)}, first["hash"])
    third = publish_tables(spark, root, {}, second["hash"], drop=["children"])
    assert set(third["tables"]) == {"parents"} == set(current_set(spark, root)["tables"])


CURRENT = {"e": {"t": {"cols": [("k", "bigint", False, None, False), ("n", "integer", True, None, False), ("s", "text", True, None, False),
                                ("gone", "text", True, None, False)], "idx": []}}}
DESIRED = {"e": {"t": {"cols": [("k", "integer", False, None, True), ("n", "integer", False, None, False), ("s", "text", True, None, False)],
                       "idx": [("t_s", ["s"], True), ("t_ns", ["n", "s"], True), ("plain", ["s"], False)]}}}


@pytest.mark.parametrize("rows,levels,lost", [
    ([(1, 1, "a", "x"), (2, 2, "b", None)], {"alter_type": "Safe", "set_not_null": "Safe", "add_unique t_s": "Safe",
                                             "add_unique t_ns": "Safe", "add_primary_key": "Safe"}, 1),
    ([(1, None, "a", None), (1, 2, "a", None), (2**40, 2, "a", None)], {
        "alter_type": "Dangerous", "set_not_null": "Dangerous", "add_unique t_s": "Dangerous", "add_unique t_ns": "Dangerous",
        "add_primary_key": "Dangerous"}, 0),
])
def test_probes_are_planned_from_the_diff(spark, rows, levels, lost):
    cur = inventory(spark, {**CURRENT, "f": CURRENT["e"]})
    des = inventory(spark, {**DESIRED, "f": DESIRED["e"]})
    data = spark.createDataFrame([("e", *r) for r in rows], "env_id string, k long, n int, s string, gone string")
    wanted = pb.wanted_probes(cur, des)
    probes = pb.measured_probes(wanted, {"t": data, "unrelated": data})
    verdicts = sf.classify_with_data(sf.classify_diff_full(cur, des), probes).collect()
    of = {(r.env_id, r.operation, r.subject): r for r in verdicts}
    for name, level in levels.items():
        operation, _, subject = name.partition(" ")
        assert {r.data_level for k, r in of.items() if k[0] == "e" and k[1] == operation and subject in ("", k[2])} == {level}
    assert of["e", "drop_column", "gone"].impact == lost
    # the other environment holds no data and keeps its static levels
    assert all(r.data_level == r.level and r.impact is None for k, r in of.items() if k[0] == "f")


def test_a_dropped_table_tells_its_rows(spark):
    cur, des = inventory(spark, CURRENT), inventory(spark, {})
    data = spark.range(4).selectExpr("'e' AS env_id", "id AS k")
    got = sf.classify_with_data(sf.classify_diff_full(cur, des), pb.measured_probes(pb.wanted_probes(cur, des), {"t": data})).collect()
    assert [(r.operation, r.data_level, r.impact) for r in got] == [("drop_table", "Dangerous", 4)]
    (row,) = sf.safer_alternatives(sf.classify_diff_full(cur, des)).collect()
    assert len(row.alternatives) == 2


def test_probes_scan_a_table_once(spark):
    path = scratch_dir(spark, "probed")
    spark.createDataFrame([("e", 1, 1, "a", "x")], "env_id string, k long, n int, s string, gone string").write.parquet(path)
    wanted = pb.wanted_probes(inventory(spark, CURRENT), inventory(spark, DESIRED))
    plan = pb.measured_probes(wanted, {"t": spark.read.parquet(path)})._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "moraine-probed" in line]
    assert len(scans) == 1
    assert pb.measured_probes(wanted, {}).count() == 0


def test_a_curve_narrows_files_in_both_columns(spark):
    df = spark.range(4000).selectExpr("id", "CAST(pmod(xxhash64(id), 1000) AS int) AS a", "CAST(pmod(xxhash64(id, 7), 12) AS int) AS b",
                                      "CASE WHEN id % 100 = 0 THEN NULL ELSE id END AS c")
    found = {}
    for name, laid in (("plain", df.repartition(16)), ("range", ev.file_layout(df, ["a", "b"], 16)), ("curve", ev.curve_layout(df, ["a", "b"], 16))):
        path = scratch_dir(spark, name)
        laid.write.parquet(path)
        back = spark.read.parquet(path)
        assert plain(back) == plain(df)
        found[name] = {r.column_name: r.admitting / r.files for r in ev.files_admitting(back, {"a": 500, "b": 6}).collect()}
    assert found["plain"]["b"] == 1 and found["range"]["b"] == 1 and max(found["curve"].values()) <= 0.5
    assert ev.curve_layout(df.limit(0), ["a", "c"], 2).count() == 0 and ev.curve_layout(df, ["c"], 2).count() == 4000


def test_forward_and_back_keeps_the_rules(spark):
    rules = (ck.NotNull("b"), ck.Unique(("a",)), ck.Check("positive", "b > 0"), ck.OneOf("c", ("x",)))
    before = ch.Table(spark.sql("SELECT 1 AS a, 2 AS b, 'x' AS c"), rules, {"b": "2"})
    steps = [ch.DropColumn("b"), ch.RenameColumn("c", "d"), ch.AddColumn("e", "int", nullable=False, default="1")]
    after = ch.apply_changes(before, steps)
    assert ck.NotNull("b") not in after.rules and len(after.rules) == 3
    back = ch.rollback_changes(after, before, steps)
    assert back.rules == before.rules and dict(back.defaults) == dict(before.defaults) and back.df.columns == before.df.columns


def test_scratch_folders_go_once_their_reader_is_written(spark):
    with recorded_scratch() as outer:
        with recorded_scratch() as made:
            df = staged(spark.range(3), "kept").join(staged(spark.range(2), "more"), "id")
        out = staged(df, "result")
    assert len(made) == 2 and len(outer) == 3
    drop_scratch(spark, made)
    assert made == [] and [is_dir(spark, p) for p in outer] == [False, False, True] and out.count() == 2
    delete(spark, outer[-1])
