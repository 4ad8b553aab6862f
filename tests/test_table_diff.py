"""One nested row per table: exchanges, schemas in every key, renames against a plain matching."""

import random

import pytest
from test_fleet import ID, inventory

from moraine.operators import drift as dr
from moraine.operators import inventory as iv
from moraine.operators import lint as ln
from moraine.operators import referential as rf
from moraine.operators import safety as sf
from moraine.operators.table_diff import nested_diff, renames

NARROW = ["env_id", "schema_name", "table_name"]


@pytest.mark.parametrize("build", [dr.diff_tables, dr.diff_columns, dr.drift_report, sf.classify_diff, sf.classify_diff_full])
def test_diffs_move_rows_at_most_twice(spark, build):
    env = {"e": {"t": {"cols": [ID], "idx": [("i", ["id"], True)], "fks": [("f", [("id", "id")], "t", None)]}}}
    plan = build(inventory(spark, env), inventory(spark, env))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "Join" not in plan


def two_schemas(spark, tables, cols, fks):
    """Inventories from rows (schema, table), (schema, table, column) and (schema, table, key, column, target, target column)."""
    t = spark.createDataFrame([("e", s, n, False) for s, n in tables], "env_id string, " + iv.ROW_TYPES["tables"])
    c = spark.createDataFrame([("e", s, n, i, col, "integer", False, None, True) for i, (s, n, col) in enumerate(cols)],
                              "env_id string, " + iv.ROW_TYPES["cols"])
    x = spark.createDataFrame([], "env_id string, " + iv.ROW_TYPES["idx"])
    f = spark.createDataFrame([("e", s, n, k, i, col, rt, rc, None, None) for i, (s, n, k, col, rt, rc) in enumerate(fks)],
                              "env_id string, " + iv.ROW_TYPES["fks"])
    return dr.Inventory(t, c, x, f)


def test_a_key_is_judged_in_its_own_schema(spark):
    """Both schemas have a key ``fk`` of ``child``; only schema ``b`` lacks the target, and its second column."""
    want = two_schemas(
        spark, [("a", "child"), ("a", "parent"), ("b", "child")],
        [("a", "child", "p"), ("a", "child", "q"), ("a", "parent", "p"), ("a", "parent", "q"), ("b", "child", "p")],
        [("a", "child", "fk", "p", "parent", "p"), ("a", "child", "fk", "q", "parent", "q"), ("b", "child", "fk", "p", "parent", "p")])
    none = two_schemas(spark, [], [], [])
    problems = rf.fk_target_exists(want.fks, want.tables, want.cols).collect()
    assert [tuple(r) for r in problems] == [("e", "b", "child", "fk", "missing_table", "parent")]
    verdicts = sf.classify_diff(none, want).filter("operation = 'add_foreign_key'").collect()
    assert sorted((r.schema_name, r.valid, r.message) for r in verdicts) == [("a", True, ""), ("b", False, "missing_table parent")]
    issues = ln.lint_inventory(want.tables, want.cols, want.idx, want.fks).filter("code = 'invalid_fk_table'").collect()
    assert [(r.schema_name, r.subject) for r in issues] == [("b", "fk.parent")]


def test_key_problems_match_the_lookup(spark):
    """The verdict's problem is what ``fk_target_exists`` says, for composite keys too."""
    rnd = random.Random(2)
    tables = [(s, t) for s in "ab" for t in ("x", "y", "z") if rnd.random() < 0.8]
    cols = [(s, t, c) for s, t in tables for c in "klm" if rnd.random() < 0.7]
    fks = [(s, t, f"k{i % 3}", c, rnd.choice("xyz"), rnd.choice(["k", "l", "n"])) for i, (s, t, c) in enumerate(cols * 2)]
    single = {}
    fks = [f for f in fks if single.setdefault(f[:3], f[4]) == f[4]]  # a key has one target
    want = two_schemas(spark, tables, cols, fks)
    expected = {}
    for r in rf.fk_target_exists(want.fks, want.tables, want.cols).collect():
        expected.setdefault((r.schema_name, r.table_name, r.fk_name), set()).add(f"{r.problem} {r.subject}")
    got = {(r.schema_name, r.table_name, r.subject): set(r.message.split("; ")) for r in sf.classify_diff(
        two_schemas(spark, [], [], []), want).filter("operation = 'add_foreign_key' and not valid").collect()}
    assert got == expected and got


def test_same_names_in_two_schemas_stay_apart(spark):
    old = two_schemas(spark, [("a", "t"), ("b", "t")], [("a", "t", "x"), ("b", "t", "x"), ("b", "t", "y")], [])
    new = two_schemas(spark, [("a", "t"), ("b", "t")], [("a", "t", "x"), ("a", "t", "y"), ("b", "t", "x")], [])
    assert sorted((r.schema_name, r.column_name, r.status) for r in dr.diff_columns(old, new).collect()) == [
        ("a", "y", "added"), ("b", "y", "removed")]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("seed", range(3))
def test_renames_are_a_stable_matching(spark, seed):
    rnd = random.Random(seed)
    names = sorted({"".join(rnd.choice("ab_") for _ in range(rnd.randint(1, 5))) for _ in range(40)})
    old, new = [n for i, n in enumerate(names) if i % 2], [n for i, n in enumerate(names) if i % 2 == 0]
    col = lambda n: (n, rnd.choice(["text", "integer"]), True, None, False)
    left, right = {n: col(n) for n in old}, {n: col(n) for n in new}
    nested = nested_diff(inventory(spark, {"e": {"t": {"cols": list(left.values())}}}), inventory(spark, {"e": {"t": {"cols": list(right.values())}}}))
    (got,) = nested.select(renames(nested["columns"], 2)).first()
    pairs = sorted((edit_distance(o, n), new.index(n), n, o) for o in old for n in new
                   if left[o][1] == right[n][1] and edit_distance(o, n) <= 2)
    want, used = [], set()
    for d, _, n, o in pairs:
        if ("o", o) not in used and ("n", n) not in used:
            used |= {("o", o), ("n", n)}
            want.append((o, n, d))
    assert [tuple(r) for r in got] == want
    assert len({r[0] for r in got}) == len({r[1] for r in got}) == len(got)


def test_rename_rows_stand_beside_the_drop_and_the_add(spark):
    col = lambda n: (n, "text", True, None, False)
    rows = sf.classify_diff_full(inventory(spark, {"e": {"t": {"cols": [col("remarks")]}}}),
                                 inventory(spark, {"e": {"t": {"cols": [col("remark")]}}})).collect()
    assert {(r.operation, r.subject, r.level, r.reversible, r.requires_multi_phase) for r in rows} == {
        ("rename_column", "remarks -> remark", sf.MULTI_PHASE, "yes", True), ("drop_column", "remarks", sf.DANGEROUS, "no", True),
        ("add_column", "remark", sf.SAFE, "yes", False)}


def test_odd_inventories(spark):
    """Rows of unlisted tables, repeated columns and empty sides change nothing and stop nothing."""
    odd = two_schemas(spark, [("a", "t")], [("a", "t", "x"), ("a", "t", "x"), ("a", "ghost", "x")], [("a", "ghost", "f", "x", "t", "x")])
    none = two_schemas(spark, [], [], [])
    assert [tuple(r) for r in dr.diff_tables(none, odd).collect()] == [("e", "a", "t", "added")]
    assert dr.diff_tables(odd, odd).collect() == [] and dr.drift_report(none, none).collect() == []
    assert sf.classify_diff(odd, odd).collect() == [] and sf.classify_diff_full(odd, none).count() == 1
