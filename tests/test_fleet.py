"""Diffs, hashes, replay, documents, policies and streams on small fixtures."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from moraine.operators import drift as dr
from moraine.operators import inventory as iv
from moraine.operators import lint as ln
from moraine.operators import policy as po
from moraine.operators import safety as sf
from moraine.operators import checks as ck
from moraine.session import scratch_dir
from moraine.sources import schema_docs as sd
from moraine.sources.tables import read_table_set
from moraine.streaming import jobs


def inventory(spark, tables):
    """``{env: {table: {"cols": [(name, type, nullable, default, pk)], "idx": .., "fks": .., "rls": ..}}}``"""
    t, c, x, f = [], [], [], []
    for env, named in tables.items():
        for name, d in named.items():
            key = (env, "public", name)
            t.append((*key, d.get("rls", False)))
            c += [(*key, i, *col) for i, col in enumerate(d.get("cols", []), 1)]
            x += [(*key, n, i, col, u) for n, cols, u in d.get("idx", []) for i, col in enumerate(cols, 1)]
            f += [(*key, n, i, a, rt, b, od, None) for n, pairs, rt, od in d.get("fks", []) for i, (a, b) in enumerate(pairs, 1)]
    frames = [
        spark.createDataFrame(rows, "env_id string, " + iv.ROW_TYPES[kind])
        for kind, rows in (("tables", t), ("cols", c), ("idx", x), ("fks", f))
    ]
    return dr.Inventory(*frames)


ID = ("id", "integer", False, None, True)
# a network of gauges: one table changes in every way at once, two only in a key or an index, one comes, one goes
CURRENT = {"e": {
    "gauge": {"cols": [ID, ("site_code", "varchar(12)", False, None, False), ("depth_m", "smallint", True, "0", False),
                       ("owner_note", "text", True, None, False), ("last_seen", "timestamp", True, None, False)]},
    "site": {"cols": [("site_code", "varchar(12)", False, None, True), ("lat", "real", False, None, False)],
             "idx": [("site_lat", ["lat"], False)]},
    "reading": {"cols": [ID, ("gauge_id", "bigint", False, None, False)]},
    "telegram": {"cols": [ID]},
}}
DESIRED = {"e": {
    "gauge": {"cols": [ID, ("site_code", "varchar(12)", False, None, False), ("depth_m", "integer", False, "1", False),
                       ("firmware", "text", True, None, False), ("last_seen", "timestamptz", True, None, False)]},
    "site": {"cols": [("site_code", "varchar(12)", False, None, True), ("lat", "real", False, None, False)],
             "idx": [("site_lat", ["lat", "site_code"], False)]},
    "reading": {"cols": [ID, ("gauge_id", "bigint", False, None, False)],
                "fks": [("reading_gauge", [("gauge_id", "id")], "gauge", "CASCADE")]},
    "alarm": {"cols": [ID]},
}}


def test_composite_diff(spark):
    cur, des = inventory(spark, CURRENT), inventory(spark, DESIRED)
    assert {(r.table_name, r.status) for r in dr.diff_tables(cur, des).collect()} == {
        ("gauge", "modified"), ("site", "modified"), ("reading", "modified"), ("telegram", "removed"), ("alarm", "added")}
    got = {r.column_name: (r.status, list(r.changes)) for r in dr.diff_columns(cur, des).collect()}
    assert got == {"depth_m": ("modified", ["type", "nullable", "default"]), "last_seen": ("modified", ["type"]),
                   "firmware": ("added", []), "owner_note": ("removed", [])}
    assert [(r.index_name, r.status) for r in dr.diff_indexes(cur, des).collect()] == [("site_lat", "modified")]
    assert [(r.fk_name, r.status) for r in dr.diff_foreign_keys(cur, des).collect()] == [("reading_gauge", "added")]
    report = dr.drift_report(cur, des).first()
    assert (report.modified_tables, report.added_columns, report.removed_columns, report.modified_columns) == (3, 1, 1, 2)
    assert not report.in_sync and dr.drift_report(cur, cur).first().in_sync


def test_diff_with_itself_is_empty(spark):
    cur = inventory(spark, CURRENT)
    assert dr.diff_tables(cur, cur).isEmpty() and dr.diff_columns(cur, cur).isEmpty()
    assert dr.diff_indexes(cur, cur).isEmpty() and dr.diff_foreign_keys(cur, cur).isEmpty()


@pytest.mark.parametrize("old,new,changes", [
    (("c", "int4", True, None, False), ("c", "integer", True, None, False), []),
    (("c", "text", True, None, False), ("c", "text", True, "''", False), ["default"]),
    (("c", "text", True, "'a'", False), ("c", "text", True, None, False), ["default"]),
    (("c", "text", True, None, False), ("c", "bigint", False, "0", True), ["type", "nullable", "default", "is_primary_key"]),
])
def test_column_changes_in_order(spark, old, new, changes):
    cur, des = inventory(spark, {"e": {"t": {"cols": [old]}}}), inventory(spark, {"e": {"t": {"cols": [new]}}})
    assert [c for r in dr.diff_columns(cur, des).collect() for c in r.changes] == changes


def test_rls_only_difference_is_reported(spark):
    cur = inventory(spark, {"e": {"t": {"cols": [ID]}}})
    des = inventory(spark, {"e": {"t": {"cols": [ID], "rls": True}}})
    assert [r.rls_enabled for r in dr.diff_rls(cur, des).collect()] == [True]
    assert [r.status for r in dr.diff_tables(cur, des).collect()] == ["modified"]
    assert [r.operation for r in sf.classify_diff(cur, des).collect()] == ["enable_rls"]


def test_index_and_key_bodies_are_compared(spark):
    cur = inventory(spark, {"e": {"t": {"cols": [ID], "idx": [("i", ["a", "b"], False)], "fks": [("f", [("a", "x")], "p", None)]}}})
    des = inventory(spark, {"e": {"t": {"cols": [ID], "idx": [("i", ["b", "a"], False)], "fks": [("f", [("a", "x")], "p", "CASCADE")]}}})
    assert [(r.status, list(r.changes)) for r in dr.diff_indexes(cur, des).collect()] == [("modified", ["column_names"])]
    assert [(r.status, list(r.changes)) for r in dr.diff_foreign_keys(cur, des).collect()] == [("modified", ["on_delete"])]


FULL = {"users": {"cols": [("id", "INT4", False, "nextval('s')", True), ("e<&>", "text", True, None, False)],
                  "idx": [("z", ["id"], True), ("a", ["e", "id"], False)]},
        "posts": {"cols": [], "fks": [("fk", [("u", "id")], "users", "CASCADE")]}}


def canonical():
    doc = {"tables": [
        {"columns": [], "foreign_keys": [{"columns": ["u"], "name": "fk", "on_delete": "CASCADE", "referenced_columns": ["id"],
                                          "referenced_table": "users"}], "name": "posts"},
        {"columns": [{"is_primary_key": False, "name": "e<&>", "nullable": True, "type": "text"},
                     {"default": "nextval('s')", "is_primary_key": True, "name": "id", "nullable": False, "type": "integer"}],
         "indexes": [{"columns": ["e", "id"], "name": "a", "unique": False}, {"columns": ["id"], "name": "z", "unique": True}],
         "name": "users"}]}
    text = json.dumps(doc, separators=(",", ":"))
    return text.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")


def test_canonical_text_and_hash(spark):
    inv = inventory(spark, {"e": FULL})
    assert dr.canonical_schema(inv).first().document == canonical()
    assert dr.schema_hash(inv).first().schema_hash == hashlib.sha256(canonical().encode()).hexdigest()


def test_hash_ignores_row_order_and_sees_each_field(spark):
    base = inventory(spark, {"e": FULL})
    shuffled = dr.Inventory(*[df.orderBy(F.rand(3)) for df in (base.tables, base.cols, base.idx, base.fks)])
    first = dr.schema_hash(base).first().schema_hash
    assert dr.schema_hash(shuffled).first().schema_hash == first
    others = [
        dr.Inventory(base.tables, base.cols.withColumn("nullable", ~F.col("nullable")), base.idx, base.fks),
        dr.Inventory(base.tables, base.cols.withColumn("default_raw", F.lit("0")), base.idx, base.fks),
        dr.Inventory(base.tables, base.cols.withColumn("is_pk", F.lit(True)), base.idx, base.fks),
        dr.Inventory(base.tables, base.cols, base.idx.withColumn("is_unique", F.lit(True)), base.fks),
        dr.Inventory(base.tables, base.cols, base.idx, base.fks.withColumn("on_delete", F.lit("SET NULL"))),
        dr.Inventory(base.tables, base.cols),
    ]
    hashes = [dr.schema_hash(o).first().schema_hash for o in others]
    assert len({first, *hashes}) == len(hashes) + 1
    rls = dr.Inventory(base.tables.withColumn("rls_enabled", F.lit(True)), base.cols, base.idx, base.fks)
    assert dr.schema_hash(rls).first().schema_hash == first


def test_hash_of_no_tables(spark):
    inv = inventory(spark, {"e": FULL})
    envs = spark.createDataFrame([("e",), ("empty",)], "env_id string")
    got = {r.env_id: r.schema_hash for r in dr.schema_hash(inv, envs).collect()}
    assert got["empty"] == hashlib.sha256(b'{"tables":[]}').hexdigest()


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("d", [1, 2, 3])
def test_rename_candidates_against_all_pairs(spark, d):
    rnd = random.Random(d)
    names = {"".join(rnd.choice("aB_") for _ in range(rnd.randint(1, 7))) for _ in range(120)}
    old, new = [n for i, n in enumerate(sorted(names)) if i % 2], [n for i, n in enumerate(sorted(names)) if i % 2 == 0]
    col = lambda n: (n, "text", True, None, False)
    cur, des = inventory(spark, {"e": {"t": {"cols": [col(n) for n in old]}}}), inventory(spark, {"e": {"t": {"cols": [col(n) for n in new]}}})
    got = {r.old_name: (r.distance, r.new_name) for r in dr.rename_candidates(dr.diff_columns(cur, des), d).collect()}
    want = {}
    for o in old:
        best = min((edit_distance(o.lower(), n.lower()), i, n) for i, n in enumerate(new))
        if best[0] <= d:
            want[o] = (best[0], best[2])
    assert got == want


def test_replay_against_a_loop(spark):
    rnd = random.Random(5)
    actions = ["add_column", "drop_column", "alter_type", "set_not_null", "drop_not_null", "set_default", "drop_default",
               "add_primary_key", "drop_primary_key"]
    log, state, errors = [], {("t", "a"): ["int", True, None, False]}, []
    for seq in range(600):
        table, column, action = rnd.choice("tttg"), rnd.choice("abc"), rnd.choice(actions)
        row = ("e", "public", table, seq, action, column, f"ty{seq}", bool(seq % 2), f"d{seq}", False)
        log.append(row)
        key = (table, column)
        if table == "g":
            errors.append((seq, "unknown_table"))
        elif action == "add_column":
            state[key] = [row[6], row[7], row[8], row[9]]
        elif key not in state:
            errors.append((seq, "unknown_column"))
        elif action == "drop_column":
            del state[key]
        else:
            at, value = {"alter_type": (0, row[6]), "set_not_null": (1, False), "drop_not_null": (1, True), "set_default": (2, row[8]),
                         "drop_default": (2, None), "add_primary_key": (3, True), "drop_primary_key": (3, False)}[action]
            state[key][at] = value
            if action == "add_primary_key":  # a primary key implies NOT NULL
                state[key][1] = False
    inv = inventory(spark, {"e": {"t": {"cols": [("a", "int", True, None, False)]}}})
    df = spark.createDataFrame(log, "env_id string, schema_name string, table_name string, seq long, action string, column_name string, "
                                    "type_raw string, nullable boolean, default_raw string, is_pk boolean")
    for block in (7, 100_000):
        final, bad = dr.replay_change_log(inv.cols, inv.tables, df, block)
        assert {(r.table_name, r.column_name): [r.type_raw, r.nullable, r.default_raw, r.is_pk] for r in final.collect()} == state
        assert sorted((r.seq, r.error) for r in bad.collect()) == errors


def test_replay_rls(spark):
    inv = inventory(spark, {"e": {"t": {"cols": [ID]}, "u": {"cols": [ID], "rls": True}}})
    log = spark.createDataFrame([("e", "public", "t", 1, "rls_on"), ("e", "public", "t", 2, "rls_off"), ("e", "public", "t", 3, "rls_on")],
                                "env_id string, schema_name string, table_name string, seq long, action string")
    assert {r.table_name: r.rls_enabled for r in dr.replay_rls(inv.tables, log).collect()} == {"t": True, "u": True}


@pytest.mark.parametrize("column,want", [
    (("c", "text", True, None, False), ("Safe", True, True)), (("c", "text", False, "'x'", False), ("Safe", True, True)),
    (("c", "text", False, None, False), ("Dangerous", False, False)), (("c", "text", False, "", False), ("Dangerous", False, False)),
])
def test_classify_added(spark, column, want):
    cur, des = inventory(spark, {"e": {"t": {"cols": [ID]}}}), inventory(spark, {"e": {"t": {"cols": [ID, column]}}})
    r = sf.classify_add_column(dr.diff_columns(cur, des)).first()
    assert (r.level, r.valid, r.rollback_data_loss) == want and r.reversible


@pytest.mark.parametrize("old,new,want", [
    ("integer", "bigint", ("Lossy", True, False)), ("bigint", "integer", ("Dangerous", False, True)),
    ("text", "integer", ("Dangerous", False, False)), ("varchar(100)", "varchar(50)", ("Safe", True, True)),
])
def test_classify_retyped(spark, old, new, want):
    cur = inventory(spark, {"e": {"t": {"cols": [("c", old, True, None, False)]}}})
    des = inventory(spark, {"e": {"t": {"cols": [("c", new, True, None, False)]}}})
    r = sf.classify_alter_type(dr.diff_columns(cur, des)).first()
    assert (r.level, r.valid, r.reversible) == want and r.breaking_change and r.lock_contention


def test_data_can_raise_and_lower_a_level(spark):
    cur = inventory(spark, {"e": {"t": {"cols": [("a", "bigint", True, None, False), ("b", "varchar(100)", True, None, False)]}}})
    des = inventory(spark, {"e": {"t": {"cols": [("a", "integer", True, None, False), ("b", "varchar(50)", True, None, False)]}}})
    probes = spark.createDataFrame([("t", "a", 0, 0, 0, 0), ("t", "b", 3, 3, 0, 0)],
                                   "table_name string, column_name string, failed long, changed long, null_rows long, duplicates long")
    got = {r.subject: (r.level, r.data_level, r.shift) for r in sf.classify_with_data(sf.classify_diff(cur, des), probes).collect()}
    assert got == {"a": ("Dangerous", "Safe", "downgraded"), "b": ("Safe", "Dangerous", "upgraded")}


def test_rollup_of_nothing_is_valid(spark):
    cur = inventory(spark, CURRENT)
    r = sf.safety_rollup(sf.classify_diff(cur, cur), cur.tables).first()
    assert (r.operations, r.all_valid, r.all_reversible, r.has_dangerous) == (0, True, True, False)


def test_new_table_keys_are_checked(spark):
    cur = inventory(spark, {"e": {"users": {"cols": [ID]}}})
    des = inventory(spark, {"e": {"users": {"cols": [ID]}, "posts": {"cols": [ID], "fks": [
        ("ok", [("id", "id")], "users", None), ("bad", [("id", "id")], "authors", None), ("col", [("id", "zz")], "users", None)]}}})
    got = {r.subject: (r.valid, r.message) for r in sf.classify_diff(cur, des).collect()}
    assert got == {"ok": (True, ""), "bad": (False, "missing_table authors"), "col": (False, "missing_column users.zz")}


def test_lint_counts_each_repeat(spark):
    inv = inventory(spark, {"e": {"t": {"cols": [("a", "text", True, None, False)] * 3 + [("b", "", True, None, False)],
                                        "idx": [("i", ["a"], False), ("i", ["zz"], False)]}, "empty": {}}})
    got = sorted((r.code, r.severity, r.subject) for r in ln.lint_inventory(inv.tables, inv.cols, inv.idx, inv.fks).collect())
    assert got == sorted([
        ("duplicate_column", "error", "a"), ("duplicate_column", "error", "a"), ("missing_type", "error", "b"),
        ("no_primary_key", "warning", "t"), ("no_primary_key", "warning", "empty"), ("empty_table", "warning", "empty"),
        ("duplicate_index", "warning", "i"), ("invalid_index_column", "error", "i.zz")])


def test_schema_documents_from_files(spark, tmp_path):
    good = {"tables": [{"name": "users", "columns": [{"name": "id", "type": "integer", "nullable": False, "is_primary_key": True}],
                        "indexes": [{"name": "i", "columns": ["id", "x"], "unique": True}]},
                       {"name": "posts", "columns": [{"name": "id", "type": "integer", "nullable": False, "is_primary_key": True, "default": "0"}],
                        "foreign_keys": [{"name": "f", "columns": ["id"], "referenced_table": "users", "referenced_columns": ["id"], "on_delete": "CASCADE"}]}]}
    bad = {
        "extra": {**good, "version": 1}, "no_tables": {"dialect": "postgres"},
        "col_field": {"tables": [{"name": "t", "columns": [{"name": "id", "type": "integer", "nullable": False, "is_primary_key": True, "len": 3}]}]},
        "col_missing": {"tables": [{"name": "t", "columns": [{"name": "id", "nullable": False, "is_primary_key": True}]}]},
        "col_kind": {"tables": [{"name": "t", "columns": [{"name": "id", "type": "integer", "nullable": "maybe", "is_primary_key": True}]}]},
        "no_columns": {"tables": [{"name": "t", "columns": []}]},
        "action": {"tables": [{"name": "t", "columns": good["tables"][0]["columns"], "foreign_keys": [
            {"name": "f", "columns": ["id"], "referenced_table": "t", "referenced_columns": ["id"], "on_delete": "EXPLODE"}]}]},
    }
    for name, doc in {"good": good, "none": {"tables": []}, **bad}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    (tmp_path / "broken.json").write_text("{not json")
    docs = sd.read_schema_docs(spark, str(tmp_path))
    assert {r.env_id for r in docs.rejected.collect()} == {*bad, "broken"}
    assert {(r.env_id, r.table_name, r.column_name, r.default_raw) for r in docs.inventory.cols.collect()} == {
        ("good", "users", "id", None), ("good", "posts", "id", "0")}
    assert sorted((r.ordinal, r.column_name) for r in docs.inventory.idx.collect()) == [(1, "id"), (2, "x")]
    assert [(r.ref_table, r.ref_column, r.on_delete) for r in docs.inventory.fks.collect()] == [("users", "id", "CASCADE")]


def test_documents_name_every_problem(spark):
    column = '{"name":"id","type":"integer","nullable":false,"is_primary_key":true}'
    docs = {
        "ok": '{"dialect":"sqlite","tables":[{"name":"t_1","columns":[' + column + ']}]}',
        "names": '{"tables":[{"name":"Bad-Name","columns":[' + column.replace('"id"', '"2nd"') + ']}]}',
        "dialect": '{"dialect":"oracle","tables":[{"name":"t","columns":[' + column + ']}]}',
        "three": '{"tables":[{"name":"t","owner":"me","policies":[{"x":1}],"columns":[' + column.replace('"nullable":false,', "") + ']}]}',
    }
    read = sd.parse_schema_docs(spark.createDataFrame(list(docs.items()), "env_id string, document string"))
    got = {}
    for r in read.rejected.collect():
        got.setdefault(r.env_id, set()).add(r.problem)
    assert got == {
        "names": {"bad table name Bad-Name", "bad column name 2nd"}, "dialect": {"unknown dialect oracle"},
        "three": {"unknown table field owner", "unknown table field policies", "missing column field nullable"}}
    assert [r.env_id for r in read.inventory.tables.collect()] == ["ok"]


def test_written_inventory_reads_back_equal(spark, scratch):
    inv = inventory(spark, {"e": FULL, "f": {"users": FULL["users"]}})
    named = inv.cols.withColumn("default_raw", F.coalesce("default_raw", F.lit("'<&>'"))).withColumn(
        "column_name", F.regexp_replace("column_name", "[<&>]", "_"))
    plain = dr.Inventory(inv.tables.filter("table_name = 'users'"), named, inv.idx)
    sd.write_inventory(plain, scratch)
    back = sd.read_schema_docs(spark, scratch, one_per_line=True)
    assert back.rejected.isEmpty()
    want = {r.env_id: r.schema_hash for r in dr.schema_hash(plain).collect()}
    assert {r.env_id: r.schema_hash for r in dr.schema_hash(back.inventory).collect()} == want


def test_table_set_needs_tables(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_table_set(spark, str(tmp_path))
    tables = read_table_set(spark, "/root/testdata/sf0.001", register=True)
    assert list(tables) == sorted(tables) and spark.table("region").count() == 5


def test_live_catalog_becomes_inventory(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    spark.sql("CREATE TABLE shop.items (id BIGINT, label STRING) USING parquet")
    try:
        got = [(r.table_name, r.ordinal, r.column_name, r.type_raw) for r in iv.catalog_columns(spark, "shop", "e").orderBy("ordinal").collect()]
    finally:
        spark.sql("DROP DATABASE shop CASCADE")
    assert got == [("items", 1, "id", "bigint"), ("items", 2, "label", "string")]


def test_policies_combine(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, owner string")
    own = po.Policy("own", "SELECT", True, ("clerk",), "owner = 'a'")
    second = po.Policy("two", "ALL", True, ("clerk",), "id = 3", "id > 1")
    limit = po.Policy("limit", "ALL", False, (), "id < 3")
    ids = lambda d: sorted(r.id for r in d.collect())
    assert ids(po.rls_select(df, [own, second], "clerk")) == [1, 3]
    assert ids(po.rls_select(df, [own, second, limit], "clerk")) == [1]
    assert ids(po.rls_select(df, [own], "guest")) == [] and ids(po.rls_select(df, [limit], "clerk")) == []
    assert ids(po.rls_select(df, [own], "clerk", "DELETE")) == []
    assert ids(po.rls_select(df, [], "clerk", rls=False)) == [1, 2, 3]
    assert ids(po.rls_check_violations(df, [second], "clerk")) == [1]
    assert [r.locked_out for r in po.rls_coverage(df, [own], ["clerk", "guest"]).collect()] == [False, True]


# -------------------------------------------------------------------- streaming

EVENT = "event_id long, ts timestamp_ntz, kind string"


@pytest.fixture(scope="module")
def arrivals(spark):
    """Three files in time order, read one per micro-batch."""
    path = scratch_dir(spark, "arrivals")
    df = spark.range(300).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 5) AS ts",
        "CASE WHEN id % 7 = 0 THEN 'bad' ELSE cast(id AS string) END AS kind")
    for i, part in enumerate(("event_id < 100", "event_id >= 100 AND event_id < 200", "event_id >= 200")):
        df.filter(part).coalesce(1).write.mode("append").parquet(f"{path}/part{i}")
    flat = scratch_dir(spark, "arrivals-flat")
    for i in range(3):
        spark.read.parquet(f"{path}/part{i}").coalesce(1).write.mode("append").parquet(flat)
    return flat


def run(spark, df):
    path = scratch_dir(spark, "sink")
    jobs.run_to_files(df, f"{path}/rows", f"{path}/cp")
    return spark.read.parquet(f"{path}/rows")


def test_dual_write_equals_batch(spark, arrivals):
    step = lambda df: jobs.dual_write(df, "kind", "number", "bigint")
    stream = run(spark, step(jobs.stream_files(spark, arrivals, EVENT, 1)))
    batch = step(spark.read.parquet(arrivals))
    assert stream.exceptAll(batch).isEmpty() and batch.exceptAll(stream).isEmpty() and stream.count() == 300


def test_gap_monitor_equals_batch_on_closed_windows(spark, arrivals):
    def step(df):
        return jobs.gap_monitor(jobs.dual_write(df, "kind", "number", "bigint"), "ts", "kind", "number")

    stream = {tuple(r) for r in run(spark, step(jobs.stream_files(spark, arrivals, EVENT))).collect()}
    batch = step(spark.read.parquet(arrivals))
    last = spark.read.parquet(arrivals).agg((F.max("ts").cast("timestamp") - F.expr("INTERVAL 10 MINUTES")).alias("m")).first().m
    assert stream == {tuple(r) for r in batch.filter(F.col("window_end") <= F.lit(last)).collect()} and stream


def test_unique_arrivals_across_batches(spark, arrivals):
    stream = run(spark, jobs.unique_arrivals(jobs.stream_files(spark, arrivals, EVENT, 1), ["event_id"], "ts"))
    assert stream.count() == 300


def test_quarantine_replay_repeats_no_row(spark, arrivals):
    path = scratch_dir(spark, "quarantine")
    rules = [ck.Check("kind", "kind <> 'bad'")]
    for _ in range(2):  # a second run finds nothing new
        jobs.run_quarantine(jobs.stream_files(spark, arrivals, EVENT, 1), rules, f"{path}/rows", f"{path}/cp")
    out = spark.read.parquet(f"{path}/rows")
    bad = out.filter("outcome = 'quarantined'").collect()
    assert out.count() == 300 and len(bad) == len(range(0, 300, 7))
    assert all(list(r.reasons) == ["check(kind)"] for r in bad)
