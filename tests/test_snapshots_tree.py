"""Digest trees, restores with null keys, and cascades along long chains."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from moraine.operators import referential as rf
from moraine.operators import snapshots as sn

ROW = "k long, j string, v string, w double"


def two_states(spark, seed=3, n=2000, changed=3):
    rnd = random.Random(seed)
    rows = {i: (i, f"j{i % 3}", f"v{i}", float(i)) for i in range(-50, n)}
    later = dict(rows)
    for i in rnd.sample(sorted(rows), changed):
        kind = rnd.randrange(3)
        if kind == 0:
            later.pop(i)
        elif kind == 1:
            later[i] = (i, rows[i][1], "other", None)
        else:
            later[i + 10**6] = (i + 10**6, "j", "new", 1.0)
    return spark.createDataFrame(list(rows.values()), ROW), spark.createDataFrame(list(later.values()), ROW)


@pytest.mark.parametrize("keys", [["k"], ["k", "j"]])
def test_tree_gives_the_answer_of_the_join(spark, keys):
    old, new = two_states(spark)
    want = sorted(map(tuple, sn.snapshot_diff(old, new, keys).collect()))
    assert sorted(map(tuple, sn.snapshot_diff_tree(old, new, keys, 16, 4).collect())) == want and want


def test_tree_on_other_keys_and_nulls(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    new = spark.createDataFrame([("a", 1), ("b", 5), (None, 3), ("c", 1)], "k string, v int")
    want = sorted(map(str, sn.snapshot_diff(old, new, ["k"]).collect()))
    assert sorted(map(str, sn.snapshot_diff_tree(old, new, ["k"], 16, 4).collect())) == want
    days = spark.createDataFrame([(datetime.date(1969, 12, 30 + i % 2), i) for i in range(2)], "k date, v int")
    assert sn.snapshot_diff_tree(days, days.withColumn("v", F.col("v") + 1), ["k"], 10).count() == 2
    none = spark.createDataFrame([], "k string, v int")
    assert sn.snapshot_diff_tree(none, none, ["k"]).count() == 0 and sn.snapshot_diff_tree(none, old, ["k"]).count() == 3


def test_only_differing_ranges_move(spark):
    """0.15 % changed rows: the leaves found hold few rows, and the large sides are filtered where they lie."""
    old, new = two_states(spark)
    leaves = sn.differing_leaves(sn.digest_leaves(old, ["k"], 16), sn.digest_leaves(new, ["k"], 16), 4)
    assert 0 < leaves.count() <= 3 + 1
    rows = old.withColumn("leaf", sn.leaf_of(old, ["k"], 16)).join(leaves, "leaf", "left_semi").count()
    assert rows <= 16 * 4
    plan = sn.snapshot_diff_tree(old, new, ["k"], 16, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("Exchange hashpartitioning(k") == 2
    same = sn.differing_leaves(sn.digest_leaves(old, ["k"], 16), sn.digest_leaves(old, ["k"], 16), 4)
    assert same.count() == 0


def test_a_backup_row_with_a_null_key_comes_back(spark):
    row = "a string, b int, v string"
    current = spark.createDataFrame([("x", 1, "now"), (None, 2, "now")], row)
    backup = spark.createDataFrame([("x", 1, "old"), (None, 1, "old"), (None, 2, "old"), ("y", None, "old")], row)
    got = sorted(map(str, sn.backup_merge(current, backup, ["a", "b"], "true").collect()))
    assert got == sorted(map(str, spark.createDataFrame(
        [("x", 1, "now"), (None, 2, "now"), (None, 1, "old"), ("y", None, "old")], row).collect()))


def closure(rows, deleted):
    up = dict(rows)
    out = set()
    for k in up:
        seen, at = set(), k
        while at is not None and at not in seen:
            if at in deleted and at in up:
                out.add(k)
                break
            seen.add(at)
            at = up.get(at)
    return out


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(rf, "dropped", lambda df: rounds.append(1))
    chain = [(i, i - 1 if i else None) for i in range(1000)]
    df = spark.createDataFrame(chain, "k long, up long").repartition(4)
    removed, kept = rf.fk_on_delete_cascade_self(df, ["k"], ["up"], spark.createDataFrame([(3,)], "k long"))
    assert {r.k for r in removed.collect()} == set(range(3, 1000)) and kept.count() == 3
    assert len(rounds) <= 12


def test_forests_circles_and_strays(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([None, rnd.randrange(60), 999])) for i in range(60)] + [(100, 101), (101, 102), (102, 100)]
    deleted = set(rnd.sample(range(60), 5)) | {999}
    df = spark.createDataFrame(rows, "k long, up long").withColumn("note", F.concat(F.lit("n"), "k"))
    gone = spark.createDataFrame([(d,) for d in deleted] + [(None,)], "k long")
    removed, kept = rf.fk_on_delete_cascade_self(df, ["k"], ["up"], gone)
    want = closure(rows, deleted)
    assert {r.k for r in removed.collect()} == want and {r.k for r in kept.collect()} == {k for k, _ in rows} - want
    assert removed.columns == df.columns


def test_a_self_reference_beside_another_table(spark):
    parts = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, None)], "id long, whole long")
    notes = spark.createDataFrame([(10, 3), (11, 4)], "note long, part long")
    edges = [rf.Edge("parts", ("whole",), "parts", ("id",)), rf.Edge("notes", ("part",), "parts", ("id",))]
    out = rf.fk_on_delete_cascade({"parts": parts, "notes": notes}, edges, "parts", parts.filter("id = 1"), {"parts": ["id"]})
    assert sorted(r.id for r in out["parts"][0].collect()) == [1, 2, 3]
    assert [r.note for r in out["notes"][0].collect()] == [10] and [r.note for r in out["notes"][1].collect()] == [11]
