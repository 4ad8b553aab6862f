"""Every registered query against its SQL form, and the shape of its plan."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry
from moraine import workload

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = workload.queries(), workload.oracles()
STARTS_JOBS = {n for n in QUERIES if n.startswith("stream_")}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, FOLDER, QUERIES[name], SQL[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STARTS_JOBS))
def test_plan_has_no_cross_join_and_no_python(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "FlatMapGroups"):
        assert node not in plan


def test_entry_is_stable(spark):
    df = entry.entry(spark)
    assert df.columns == ["rule", "violations", "rows", "passed"] and df.count() == 8


def _scan(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "FileScan" in line]


def test_probe_reads_only_its_column(spark):
    (scan,) = _scan(QUERIES["identity_high_water_mark"](spark, FOLDER))
    assert "ReadSchema: struct<o_orderkey:bigint>" in scan


def test_filters_reach_the_scan(spark):
    (scan,) = _scan(QUERIES["rls_select"](spark, FOLDER))
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in scan and "Or(" in scan
    from moraine.operators import checks as ck
    from moraine.workload.data import Data

    d = Data(spark, FOLDER)
    (scan,) = _scan(ck.check_expression(d.lineitem, "l_quantity > 0"))
    assert "LessThanOrEqual(l_quantity,0.0)" in scan
    (scan,) = _scan(ck.check_not_null(d.lineitem, "l_shipdate"))
    assert "PushedFilters: [IsNull(l_shipdate)]" in scan
    (scan,) = _scan(d.orders.filter(ck.OneOf("o_orderstatus", ("F", "O")).violation()))
    assert "Not(In(o_orderstatus" in scan


@pytest.mark.parametrize("name", ["fk_orphans", "fk_on_delete_set_null", "check_enum_membership"])
def test_rows_stay_in_place_when_few_keys_are_exceptional(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_environments_meet_in_one_exchange(spark):
    from moraine.operators.drift import schema_hash
    from moraine.workload.data import Data

    plan = schema_hash(Data(spark, FOLDER).cur)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_changes_collapse_into_one_projection(spark):
    plan = QUERIES["apply_changes"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") == 1 and plan.count("Relation") == 1


def test_row_rules_share_one_scan(spark):
    from moraine.operators import checks as ck
    from moraine.workload.checks import LINEITEM_RULES
    from moraine.workload.data import Data

    rules = [r for r in LINEITEM_RULES if isinstance(r, ck.ROW_RULES)]
    assert len(_scan(ck.check_summary(Data(spark, FOLDER).lineitem, rules))) == 1


def test_dedupe_limits_each_key_before_the_shuffle(spark):
    plan = QUERIES["dedupe_keep_first"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # partial and final
