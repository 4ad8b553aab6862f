"""Null rules, skew and brute force for the checks, measures and probes."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from moraine.operators import checks as ck
from moraine.operators import measures as ms
from moraine.operators import probes as pr
from moraine.operators import referential as rf
from moraine.operators import snapshots as sn


@pytest.fixture(scope="module")
def pairs(spark):
    rnd = random.Random(7)
    # one key holds a third of the rows
    rows = [(i, 1 if rnd.random() < 0.33 else rnd.choice([None, *range(2, 60)]), rnd.choice(["a", "b", None])) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "id long, k long, s string").repartition(5)


def test_unique_null_never_collides(pairs):
    rows, df = pairs
    counts = Counter((k, s) for _, k, s in rows if k is not None and s is not None)
    want = {key: n for key, n in counts.items() if n > 1}
    got = {(r.k, r.s): r.n for r in ck.check_unique(df, ["k", "s"]).collect()}
    assert got == want
    summary = ck.check_summary(df, [ck.Unique(("k", "s")), ck.PrimaryKey(("k", "s"))]).collect()
    nulls = sum(1 for _, k, s in rows if k is None or s is None)
    surplus = sum(n - 1 for n in want.values())
    assert [(r.violations, r.rows) for r in summary] == [(surplus, 3000), (surplus + nulls, 3000)]


def test_check_passes_on_null(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "a int")
    assert [r.a for r in ck.check_expression(df, "a > 0").collect()] == [-1]
    assert ck.check_one_of(df, "a", [1]).count() == 1
    assert ck.check_one_of(df, "a", df.filter("a = 1")).count() == 1


def test_summary_of_empty_table(spark):
    empty = spark.createDataFrame([], "a int, b int")
    rules = [ck.NotNull("a"), ck.Unique(("a",)), ck.ForeignKey(("a",), "p", ("b",))]
    got = ck.check_summary(empty, rules, {"p": empty}).collect()
    assert all((r.violations, r.rows, r.passed) == (0, 0, True) for r in got) and len(got) == 3


def test_dedupe_keeps_null_keys(pairs):
    rows, df = pairs
    first = {}
    for i, k, s in sorted(rows):
        first.setdefault((k, s) if None not in (k, s) else ("null", i), i)
    assert sorted(r.id for r in ck.dedupe_keep_first(df, ["k", "s"], ["id"]).collect()) == sorted(first.values())


def test_quarantine_keeps_every_row(pairs):
    rows, df = pairs
    good, bad = ck.quarantine_split(df, [ck.NotNull("s"), ck.Check("small", "k < 30")])
    want_bad = {i for i, k, s in rows if s is None or (k is not None and k >= 30)}
    assert {r.id for r in bad.collect()} == want_bad
    assert good.count() == len(rows) - len(want_bad)


def test_orphans(pairs, spark):
    rows, df = pairs
    parents = spark.createDataFrame([(k,) for k in (2, 3, 3, 4)], "p long")
    want = sorted(i for i, k, _ in rows if k is not None and k not in (2, 3, 4))
    assert sorted(r.id for r in rf.fk_orphans(df, ["k"], parents, ["p"]).collect()) == want
    summary = ck.check_summary(df, [ck.ForeignKey(("k",), "p", ("p",))], {"p": parents}).first()
    assert (summary.violations, summary.rows) == (len(want), 3000)


def test_content_match_sees_repeats_and_nulls(spark):
    def match(a, b):
        left = spark.createDataFrame(a, "a int, b int")
        return ms.content_match(left, spark.createDataFrame(b, "a int, b int")).first().matches

    assert match([(1, 2), (3, 4)], [(3, 4), (1, 2)])
    assert not match([(None, 1)], [(1, None)])
    assert not match([(1, 1), (1, 1), (2, 2)], [(2, 2), (2, 2), (2, 2)])
    assert not match([(1, 1), (1, 1)], [])
    assert not match([(1, 1)], [(1, 1), (1, 1)])
    assert match([], [])


def test_overflow_probe(spark):
    ids = [9223372036854775806, 1234567890123456789, 8765432109876543210, 123, 5000000000]
    df = spark.createDataFrame([(i,) for i in ids], "user_id long")
    row = pr.cast_probe(df, {"user_id": "int"}).first()
    assert (row.rows, row.non_null, row.failed, row.lowest_failed) == (5, 5, 4, "5000000000")
    assert pr.round_trip_probe(df, {"user_id": "int"}).first().changed == 4


def test_duplicate_emails(spark):
    rows = [(1, "alice"), (2, "alice"), (3, "bob"), (4, "bob"), (5, "charlie")]
    df = spark.createDataFrame(rows, "id int, email string")
    assert {(r.email, r.surplus) for r in ck.check_unique(df, ["email"]).collect()} == {("alice", 1), ("bob", 1)}


def test_smallest_fit(spark):
    df = spark.sql("SELECT * FROM VALUES (1L, 70000L, 'abc', 12.340000BD), (-5L, 1L, '', 0.100000BD) AS t(a, b, c, d)")
    got = {r.column_name: r.smallest_type for r in pr.smallest_fit(df, ["a", "b", "c", "d"]).collect()}
    assert got == {"a": "smallint", "b": "integer", "c": "varchar(3)", "d": "numeric(4,2)"}


def test_impact_of_every_type(spark):
    df = spark.sql("SELECT 1 AS i, 'äb' AS s, array(1L, 2L) AS a, CAST(NULL AS STRING) AS n, true AS b, array('x', 'yz') AS t")
    assert ms.drop_table_impact(df).first().bytes == 4 + 3 + 16 + 0 + 1 + 3
    assert {r.column_name: r.bytes for r in ms.drop_column_impact(df, df.columns).collect()}["n"] == 0


def test_enum_recode_with_table(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "v string")
    table = spark.createDataFrame([("a", "A"), ("a", "A")], "x string, y string")
    assert sorted((r.v or "", r.w) for r in pr.enum_recode(df, "v", table, "w").collect()) == [("", None), ("a", "A"), ("b", None)]


def test_cascade_through_a_cycle(spark):
    # 1 <- 2 <- 3 <- 4, 10 <- 11, and 20 <-> 21
    rows = [(1, None), (2, 1), (3, 2), (4, 3), (10, None), (11, 10), (20, 21), (21, 20)]
    df = spark.createDataFrame(rows, "id long, boss long")
    edge = rf.Edge("emp", ("boss",), "emp", ("id",))
    removed, kept = rf.fk_on_delete_cascade({"emp": df}, [edge], "emp", df.filter("id in (2, 20)"), {"emp": ["id"]})["emp"]
    assert sorted(r.id for r in removed.collect()) == [2, 3, 4, 20, 21]
    assert sorted(r.id for r in kept.collect()) == [1, 10, 11]


def test_cascade_through_two_tables_in_a_cycle(spark):
    a = spark.createDataFrame([(i, (i + 1) % 6) for i in range(6)] + [(90, 91)], "id long, b_id long")
    b = spark.createDataFrame([(i, (i + 1) % 6) for i in range(6)] + [(91, 90)], "id long, a_id long")
    edges = [rf.Edge("a", ("b_id",), "b", ("id",)), rf.Edge("b", ("a_id",), "a", ("id",))]
    out = rf.fk_on_delete_cascade({"a": a, "b": b}, edges, "a", a.filter("id = 0"), {"a": ["id"], "b": ["id"]})
    gone = {"a": {0}, "b": set()}
    while True:  # the same, row by row
        more_b = {r.id for r in b.collect() if r.a_id in gone["a"]}
        more_a = {r.id for r in a.collect() if r.b_id in gone["b"] | more_b} | gone["a"]
        if (more_a, more_b) == (gone["a"], gone["b"]):
            break
        gone = {"a": more_a, "b": more_b}
    for name in ("a", "b"):
        assert sorted(r.id for r in out[name][0].collect()) == sorted(gone[name])
    assert {r.id for r in out["a"][1].collect()} >= {90}
    for name, df in (("a", a), ("b", b)):
        assert sorted(r.id for r in out[name][1].collect()) == sorted(r.id for r in df.collect() if r.id not in gone[name])


def test_cascade_names_tables_that_lose_nothing_and_nulls_once(spark):
    a = spark.createDataFrame([(1, None, None), (2, "x", 1), (3, None, 2)], "id long, note string, up long")
    b = spark.createDataFrame([(10, 9)], "id long, a_id long")
    edges = [rf.Edge("a", ("up",), "a", ("id",)), rf.Edge("b", ("a_id",), "a", ("id",))]
    out = rf.fk_on_delete_cascade({"a": a, "b": b}, edges, "a", a.filter("id = 1"), {"a": ["id"], "b": ["id"]})
    assert sorted(r.id for r in out["a"][0].collect()) == [1, 2, 3] and out["a"][1].count() == 0
    assert out["b"][0].count() == 0 and out["b"][1].count() == 1
    removed, kept = rf.fk_on_delete_cascade({"a": a, "b": b}, edges[1:], "a", a.filter("id = 1"))["a"]
    assert [r.id for r in removed.collect()] == [1] and sorted(r.id for r in kept.collect()) == [2, 3]


NESTED = "id long, a array<int>, m map<string,int>, s struct<x:int,y:array<string>>"


def nested(spark, *changes):
    rows = [[1, [1, None], {"k": 1}, (1, ["a", None])], [2, [], {}, None], [3, None, None, (None, [])]]
    for row, at, value in changes:
        rows[row][at] = value
    return spark.createDataFrame([tuple(r) for r in rows], NESTED)


@pytest.mark.parametrize("change", [
    (0, 1, [1]), (0, 2, {"k": None}), (0, 2, {"k": 1, "l": 2}), (0, 3, (1, ["a"])), (1, 1, None), (1, 2, None), (1, 3, (None, None)),
    (2, 3, (None, None)),
])
def test_gates_see_nested_values(spark, change):
    from moraine.operators import measures as ms, snapshots as sn
    from moraine.plans import phases as ph
    from moraine.plans.rollback import rollback_check

    old, new = nested(spark), nested(spark, change)
    assert ms.content_match(old, nested(spark)).first().matches
    assert not ms.content_match(old, new).first().matches
    assert not ph.archive_verify(old, new).first().content_matches
    assert [r.id for r in sn.snapshot_diff(old, new, ["id"]).collect()] == [change[0] + 1]
    assert sn.snapshot_diff(old, nested(spark), ["id"]).count() == 0
    assert not rollback_check(old, new).first().identical and rollback_check(old, nested(spark)).first().identical


def test_gates_see_types_and_the_latest_archive(spark):
    from moraine.operators import measures as ms
    from moraine.plans import phases as ph
    from moraine.plans.rollback import rollback_check

    df = spark.createDataFrame([(1, 2)], "id int, v int")
    wide = df.select("id", F.col("v").cast("long").alias("v"))
    assert not rollback_check(df, wide).first().identical and not ms.content_match(df, wide).first().matches
    archive = spark.createDataFrame([(1, "old", 1), (1, "new", 2)], "id int, w string, archived_at int")
    assert [tuple(r) for r in ph.archive_restore(df, archive, ["id"], "w").collect()] == [(1, 2, "new")]
    keys = spark.createDataFrame([("e", "s1", "c", "t", "s2"), ("e", "s2", "d", "t", None)],
                                 "env_id string, schema_name string, table_name string, ref_table string, ref_schema string")
    assert ph.drop_table_guard(keys, "t", "s1").isEmpty() and ph.drop_table_guard(keys, "t", "s2").count() == 2
    assert ph.drop_table_guard(keys, "t", "s2", "other").isEmpty()


def test_cascade_by_two_paths_removes_a_row_once(spark):
    a = spark.createDataFrame([(1,), (2,)], "id long")
    b = spark.createDataFrame([(10, 1), (11, 2)], "id long, a_id long")
    c = spark.createDataFrame([(100, 1, 10), (101, 2, 10), (102, 2, 11)], "id long, a_id long, b_id long")
    edges = [rf.Edge("b", ("a_id",), "a", ("id",)), rf.Edge("c", ("a_id",), "a", ("id",)), rf.Edge("c", ("b_id",), "b", ("id",))]
    out = rf.fk_on_delete_cascade({"a": a, "b": b, "c": c}, edges, "a", a.filter("id = 1"), {"a": ["id"]})
    assert sorted(r.id for r in out["c"][0].collect()) == [100, 101]
    assert [r.id for r in out["c"][1].collect()] == [102]
    assert [r.id for r in out["a"][1].collect()] == [2]


def test_snapshot_diff_exact(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1)], "k int, v string, w int")
    new = spark.createDataFrame([(1, "a", None), (2, "b", 2), (4, "d", 1)], "k int, v string, w int")
    got = {r.k: (r.change, list(r.columns)) for r in sn.snapshot_diff_exact(old, new, ["k"]).collect()}
    assert got == {2: ("updated", ["w"]), 3: ("deleted", []), 4: ("inserted", [])}
    assert {r.k: r.change for r in sn.snapshot_diff(old, new, ["k"]).collect()} == {k: v[0] for k, v in got.items()}


def test_restrict_and_set_null_on_hot_key(pairs, spark):
    rows, df = pairs
    gone = spark.createDataFrame([(1,), (99,)], "p long")
    assert [r.p for r in rf.fk_on_delete_restrict(df, ["k"], gone, ["p"]).collect()] == [1]
    after = rf.fk_on_delete_set(df, ["k"], gone, ["p"])
    assert after.count() == len(rows) and after.filter("k = 1").isEmpty()
    by = defaultdict(int)
    for _, k, _ in rows:
        by[k] += 1
    assert after.filter(F.col("k").isNull()).count() == by[None] + by[1]
