"""The replay of named constraints against a loop over the log."""

import random

import pytest
from test_fleet import inventory

from moraine.operators import drift as dr

LOG = ("env_id string, schema_name string, table_name string, seq long, action string, column_name string, type_raw string, "
       "nullable boolean, default_raw string, is_pk boolean, constraint_name string, key_columns array<string>, is_unique boolean, "
       "ref_table string, ref_columns array<string>, on_delete string")


def loop(log, tables, block_key=lambda r: r):
    """tables: {(schema, table): {"pk": {column: bool}, "idx": [(name, cols, unique)], "fks": [(name, cols, target)]}}"""
    errors = []
    for r in sorted(log, key=lambda r: r["seq"]):
        t = tables.get((r["schema_name"], r["table_name"]))
        action, name = r["action"], r["constraint_name"]
        if t is None:
            errors.append((r["seq"], "unknown_table"))
        elif action in ("add_unique", "add_index", "add_foreign_key", "drop_constraint"):
            if name is None:
                errors.append((r["seq"], "missing_name"))
            elif action == "add_foreign_key":
                if r["key_columns"]:
                    t["fks"].append((name, tuple(r["key_columns"]), r["ref_table"]))
            elif action != "drop_constraint":
                if r["key_columns"]:
                    t["idx"].append((name, tuple(r["key_columns"]), action == "add_unique" or bool(r["is_unique"])))
            else:
                for kind in ("idx", "fks"):
                    at = next((i for i, x in enumerate(t[kind]) if x[0] == name), None)
                    if at is not None:
                        del t[kind][at]
                        break
                else:
                    if not any(t["pk"].values()):
                        errors.append((r["seq"], "unknown_constraint"))
                    t["pk"] = dict.fromkeys(t["pk"], False)
        elif action == "add_column":
            t["pk"][r["column_name"]] = r["is_pk"]
        elif action in ("drop_column", "add_primary_key", "drop_primary_key", "set_not_null"):
            if r["column_name"] not in t["pk"]:
                errors.append((r["seq"], "unknown_column"))
            elif action == "drop_column":
                del t["pk"][r["column_name"]]
            elif action != "set_not_null":
                t["pk"][r["column_name"]] = action == "add_primary_key"
        elif action not in ("rls_on", "rls_off"):
            errors.append((r["seq"], "unsupported_action"))
    return errors


def random_log(rnd, n, names="pqr"):
    kinds = ["add_unique", "add_index", "add_foreign_key", "drop_constraint", "drop_constraint", "add_column", "drop_column",
             "add_primary_key", "drop_primary_key", "set_not_null", "rls_on", "vacuum", None]
    out = []
    for seq in range(n):
        action = rnd.choice(kinds)
        out.append({
            "env_id": "e", "schema_name": rnd.choice("ab"), "table_name": rnd.choice("ttttg"), "seq": seq, "action": action,
            "column_name": rnd.choice("xyz"), "type_raw": "int", "nullable": True, "default_raw": None, "is_pk": rnd.random() < 0.3,
            "constraint_name": rnd.choice([*names, None] if rnd.random() < 0.2 else names),
            "key_columns": rnd.choice([["x"], ["x", "y"], []]), "is_unique": rnd.random() < 0.5, "ref_table": f"target{seq}",
            "ref_columns": ["id"], "on_delete": None})
    return out


@pytest.mark.parametrize("seed,block", [(1, 7), (2, 100_000)])
def test_constraints_against_a_loop(spark, seed, block):
    rnd = random.Random(seed)
    log = random_log(rnd, 400)
    inv = inventory(spark, {"e": {"t": {
        "cols": [("x", "int", False, None, True)], "idx": [("p", ["x"], True)], "fks": [("q", [("x", "id")], "old", None)]}}})
    inv = dr.Inventory(*[df.withColumn("schema_name", dr.F.explode(dr.F.array(dr.F.lit("a"), dr.F.lit("b")))).select(*df.columns)
                         for df in (inv.tables, inv.cols, inv.idx, inv.fks)])
    state = {(s, "t"): {"pk": {"x": True}, "idx": [("p", ("x",), True)], "fks": [("q", ("x",), "old")]} for s in "ab"}
    errors = loop(log, state)
    df = spark.createDataFrame([tuple(r.values()) for r in log], LOG)
    final, bad = dr.replay_change_log(inv.cols, inv.tables, df, block, inv.idx, inv.fks)
    assert sorted((r.seq, r.error) for r in bad.collect()) == sorted(errors)
    assert {(r.schema_name, r.column_name): r.is_pk for r in final.collect()} == {
        (s, c): v for (s, _), t in state.items() for c, v in t["pk"].items()}
    indexes, keys = dr.replay_keys(inv.idx, inv.fks, inv.tables, df, block)
    assert sorted((r.schema_name, r.index_name, tuple(r.column_names), r.is_unique) for r in indexes.collect()) == sorted(
        (s, *x) for (s, _), t in state.items() for x in t["idx"])
    assert sorted((r.schema_name, r.fk_name, tuple(r.column_names), r.ref_table) for r in keys.collect()) == sorted(
        (s, *x) for (s, _), t in state.items() for x in t["fks"])


def test_no_log_changes_nothing(spark):
    inv = inventory(spark, {"e": {"t": {"cols": [("x", "int", False, None, True)], "idx": [("p", ["x"], True)]}}})
    empty = spark.createDataFrame([], LOG)
    final, bad = dr.replay_change_log(inv.cols, inv.tables, empty, 10, inv.idx, inv.fks)
    assert bad.count() == 0 and [(r.column_name, r.is_pk) for r in final.collect()] == [("x", True)]
    indexes, keys = dr.replay_keys(inv.idx, inv.fks, inv.tables, empty)
    assert [r.index_name for r in indexes.collect()] == ["p"] and keys.count() == 0
