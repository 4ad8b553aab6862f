"""Change plans, phases, rollback, publishing."""

import pytest
from pyspark.sql import functions as F

from moraine.operators import checks as ck
from moraine.operators import evolve as ev
from moraine.plans import changes as ch
from moraine.plans import phases as ph
from moraine.plans import rollback as rb
from moraine.sources.files import list_names
from moraine.sources.publish import (
    PublishError, StaleError, current_version, publish_table, read_published, recreate_table, unpublish_table,
)


@pytest.fixture()
def users(spark):
    return spark.createDataFrame(
        [(1, "ann", 30, None), (2, "bob", None, "x"), (3, None, 5, "y")], "id long, name string, age int, note string"
    )


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_safe_order():
    fk, unique = ck.ForeignKey(("a",), "t", ("b",)), ck.Unique(("a",))
    steps = [ch.DropColumn("x"), ch.SetRls(True), ch.DropRule(fk), ch.DropRule(unique), ch.AddRule(unique), ch.AddRule(fk),
             ch.AlterType("y", "int"), ch.AddColumn("z", "int")]
    assert ch.safe_order(steps) == steps[::-1]


def test_apply_and_roll_back_is_identity(users):
    before = ch.Table(users, (ck.NotNull("id"),), {"note": "'n'"})
    steps = [ch.AddColumn("c", "int", False, "7"), ch.AlterType("age", "bigint"), ch.RenameColumn("note", "remark"),
             ch.SetNotNull("name"), ch.SetDefault("age", "1"), ch.unique_rule("id"), ch.SetRls(True)]
    after = ch.apply_changes(before, steps)
    assert after.df.columns == ["id", "name", "age", "remark", "c"] and after.rls
    assert ck.NotNull("c") in after.rules and ck.Unique(("id",)) in after.rules
    back = ch.rollback_changes(after, before, steps)
    assert back.df.dtypes == before.df.dtypes and set(back.rules) == set(before.rules)
    assert back.defaults == before.defaults and back.rls is before.rls
    assert rb.rollback_check(before.df, back.df).first().identical


def test_dropped_column_comes_back_null_or_archived(users, spark):
    archive = ph.archive_column(users, ["id"], "note", F.current_timestamp())
    gone = ev.drop_column(users, "note")
    assert rows(rb.rollback_drop_column(gone, "note", "string", archive, ["id"]).select(users.columns)) == rows(users)
    assert rb.rollback_drop_column(gone, "note", "string").filter("note is not null").isEmpty()


def test_drop_column_takes_its_rules(users):
    table = ch.Table(users, (ck.NotNull("note"), ck.Unique(("id",))), {"note": "'n'"})
    after = ch.DropColumn("note").apply(table)
    assert after.rules == (ck.Unique(("id",)),) and after.defaults == {}


def test_rename_carries_rules_and_defaults(users):
    table = ch.Table(users, (ck.NotNull("age"), ck.Check("adult", "age > 1"), ck.Unique(("id", "age"))), {"age": "1"})
    after = ch.RenameColumn("age", "years").apply(table)
    assert after.rules == (ck.NotNull("years"), ck.Check("adult", "years > 1"), ck.Unique(("id", "years")))
    assert after.defaults == {"years": "1"}
    assert ck.check_summary(after.df, after.rules).count() == 3
    assert ch.DropColumn("years").apply(after).rules == ()


def test_rules_are_counted_while_writing(users, scratch):
    from pyspark.sql import Observation

    seen = Observation("rules")
    ck.observe_row_rules(users, [ck.NotNull("name"), ck.Check("adult", "age > 18")], seen).write.parquet(scratch)
    assert seen.get == {"rows": 3, "not_null(name)": 1, "check(adult)": 1}


def test_table_set_refuses_to_drop_a_referenced_table(users):
    child = ch.Table(users, (ck.ForeignKey(("id",), "users", ("id",)),))
    with pytest.raises(ValueError, match="referenced"):
        ch.apply_table_set({"users": ch.Table(users), "posts": child}, {}, drop=["users"])
    left = ch.apply_table_set({"users": ch.Table(users), "posts": child}, {}, drop=["users", "posts"])
    assert left == {}
    made = ch.apply_table_set({}, {"t": [ch.AddColumn("z", "int")]}, create={"t": ch.Table(users)})
    assert made["t"].df.columns[-1] == "z"


def test_bad_cast_fails_the_job(spark):
    df = spark.createDataFrame([("1",), ("x",)], "v string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        ev.alter_column_type(df, "v", "int").collect()


def test_unknown_columns_are_refused(users):
    for step in (lambda: ev.drop_column(users, "zz"), lambda: ev.rename_column(users, "zz", "a"),
                 lambda: ev.add_column(users, "id", "int"), lambda: ev.recreate_copy(users, [("zz", "int")])):
        with pytest.raises(ValueError):
            step()


def test_append_fills_only_absent_columns(users, spark):
    incoming = spark.createDataFrame([(9, None)], "id long, name string")
    got = ev.append_with_defaults(users, incoming, {"age": "1", "name": "'anon'"}).filter("id = 9").first()
    assert (got.name, got.age, got.note) == (None, 1, None)


def test_contract_waits_for_the_backfill(users):
    half = users.withColumn("label", F.when(F.col("id") == 1, F.col("name")))
    with pytest.raises(ph.GateError):
        ph.contract_column(half, "name", "label")
    full = ph.expand_backfill(half, "name", "label")
    assert ph.contract_column(full, "name", "label").columns == ["id", "age", "note", "label"]


def test_gates(users):
    with pytest.raises(ph.GateError):
        ph.not_null_migration(users, "name", "CAST(NULL AS STRING)")
    assert ph.not_null_migration(users, "name", "'x'").filter("name is null").isEmpty()


def test_type_change_keeps_place_and_filled_values(users):
    filled = ph.type_change_backfill(users.withColumn("age_new", F.when(F.col("id") == 1, F.lit(99).cast("bigint"))), "age", "age_new", "bigint")
    done = ph.type_change_finish(filled, "age", "age_new")
    assert done.dtypes[2] == ("age", "bigint") and rows(done.select("id", "age")) == [(1, 99), (2, None), (3, 5)]


def test_drop_table_needs_archive_and_no_references(users, spark):
    fks = spark.createDataFrame([("e", "posts", "f", "users")], "env_id string, table_name string, fk_name string, ref_table string")
    archive = ph.archive_table(users, F.current_timestamp())
    with pytest.raises(ph.GateError, match="reference"):
        ph.drop_table({"users": users}, "users", fks, archive)
    with pytest.raises(ph.GateError, match="archive"):
        ph.drop_table({"users": users}, "users", fks.limit(0), archive.filter("id > 1"))
    assert ph.drop_table({"users": users}, "users", fks.limit(0), archive) == {}


def test_batched_backfill_resumes(spark, scratch):
    df = spark.range(1000).select("id", F.col("id").cast("string").alias("old"), F.when(F.col("id") < 300, F.col("id")).alias("new"))
    progress = {r.bucket: (r.rows, r.pending, r.done) for r in ph.batched_backfill(df, "id", 100, "new", "old").collect()}
    assert progress[0] == (100, 0, 100) and progress[9] == (100, 100, 0)
    ph.backfill_pending_batches(df, "id", 100, "new", "old", "bigint", scratch)
    written = spark.read.parquet(scratch)
    assert written.count() == 700 and written.filter("new <> id or new is null").isEmpty()
    # a second run over one unfinished bucket rewrites that bucket only
    ph.backfill_pending_batches(df.filter("id >= 900"), "id", 100, "new", "old", "bigint", scratch)
    assert spark.read.parquet(scratch).count() == 700


def test_negative_keys_get_their_own_bucket(spark):
    df = spark.createDataFrame([(-1, "a", None), (0, "a", None), (-100, "a", None)], "id long, old string, new string")
    assert sorted(r.bucket for r in ph.batched_backfill(df, "id", 100, "new", "old").collect()) == [-1, 0]


def test_sample_keeps_extremes_and_nulls(spark):
    df = spark.createDataFrame([(i, "s", None if i == 77 else float(i), f"n{i}") for i in range(200)], "id long, st string, v double, name string")
    got = ph.sample_production(df, "id", "st", 50, ["v"], ["name"])
    ids = {r.id for r in got.collect()}
    assert {0, 199, 77} <= ids and len(ids) < 30
    assert got.filter("length(name) <> 64").isEmpty()


def test_publish_moves_only_when_checks_hold(users, spark, scratch):
    with pytest.raises(FileNotFoundError):
        read_published(spark, scratch)
    first = publish_table(users, scratch, [ck.NotNull("id")])
    assert rows(read_published(spark, scratch)) == rows(users)
    with pytest.raises(PublishError, match="not_null"):
        publish_table(users, scratch, [ck.NotNull("name")])
    assert current_version(spark, scratch) == first
    second = publish_table(users.filter("id = 1"), scratch, [ck.Unique(("id",))], expected_version=first)
    assert current_version(spark, scratch) == second and read_published(spark, scratch).count() == 1
    with pytest.raises(StaleError):
        publish_table(users, scratch, expected_version=first)
    assert "_CURRENT.new" not in list_names(spark, scratch)
    assert unpublish_table(spark, scratch) and not unpublish_table(spark, scratch)
    with pytest.raises(FileNotFoundError):
        read_published(spark, scratch)


def test_partitioned_publish_keeps_types(users, spark, scratch):
    coded = users.withColumn("code", F.lit("007"))
    publish_table(coded, scratch, [ck.OneOf("code", ("007",))], partition_by=["code"])
    assert read_published(spark, scratch, coded.schema).filter("code = '007'").count() == 3


def test_recreate_checks_the_new_rule(users, spark, scratch):
    rule = ck.ForeignKey(("id",), "p", ("k",))
    parents = {"p": spark.createDataFrame([(1,), (2,)], "k long")}
    with pytest.raises(PublishError):
        recreate_table(users, [("id", "bigint")], scratch, [rule], parents)
    recreate_table(users.filter("id < 3"), [("name", "string"), ("id", "bigint")], scratch, [rule], parents)
    assert read_published(spark, scratch).columns == ["name", "id"]


def test_rollback_check_counts_repeats(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "v int")
    b = spark.createDataFrame([(1,), (2,), (2,), (None,)], "v int")
    got = rb.rollback_check(a, b).first()
    assert (got.only_before, got.only_after, got.identical) == (1, 1, False)
