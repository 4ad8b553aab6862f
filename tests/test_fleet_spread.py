"""Fleets that are large in rows though small in files: nothing of them is broadcast or unfolded by one task."""

import pytest

from moraine.operators import drift
from moraine.operators.drift import Inventory
from moraine.sources.schema_docs import schema_documents
from moraine.workload import queries
from moraine.workload.data import Data

SMALL, LARGE = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "fk_target_exists", "inventory_columns", "inventory_foreign_keys", "inventory_indexes", "inventory_policies", "inventory_rls",
    "serial_columns", "lint_inventory"])
def test_no_side_of_a_fleet_is_broadcast(spark, name):
    assert "Broadcast" not in plan_of(queries()[name](spark, SMALL))


def test_documents_of_a_fleet_broadcast_nothing(spark):
    cur = Data(spark, SMALL).cur
    assert "Broadcast" not in plan_of(schema_documents(Inventory(cur.tables, cur.cols, cur.idx, cur.fks)))


def test_unknown_types_broadcast_spellings_only(spark):
    plan = plan_of(queries()["lint_unknown_type"](spark, SMALL))
    assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" in plan


def test_tenants_are_dealt_out_before_they_are_unfolded(spark):
    d = Data(spark, LARGE)
    for side in (d.cur, d.des):
        for frame in (side.tables, side.cols, side.idx, side.fks):
            assert frame.rdd.getNumPartitions() == 4  # 15,000 tenants


def test_tables_of_a_tenant_are_grouped_where_they_lie(spark):
    assert plan_of(queries()["lint_duplicate_pk"](spark, LARGE)).count("Exchange") == 1


@pytest.mark.parametrize("name", [
    "replay_change_log", "replay_change_log_errors", "replay_constraints", "replay_constraint_errors", "safety_rollup"])
def test_replay_broadcasts_staged_sets_only(spark, name):
    plan = plan_of(queries()[name](spark, SMALL))
    for part in plan.split("BroadcastExchange")[1:]:  # what is broadcast is read from the scratch folder, nothing else
        scan = part.split("FileScan", 1)[1].split("\n")[0]
        assert "customer.parquet" not in scan and "events.parquet" not in scan


def test_unlisted_tables_are_found_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(drift, "staged", lambda df, label: df)
    d = Data(spark, SMALL)
    log = d.events.selectExpr("user_id AS env_id", "'public' AS schema_name", "'runs' AS table_name")
    assert "Broadcast" not in plan_of(drift.known_log(d.des.tables, log)[1])
