"""Foreign keys on data, row access rules, snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from moraine.operators import policy as po
from moraine.operators import referential as rf
from moraine.operators import snapshots as sn
from moraine.session import staged
from moraine.workload.data import Data, fleet, using
from moraine.workload.registry import query


@query("fk_orphans", using("live_orders") + """
SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice FROM lineitem l
WHERE l_orderkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM live_orders o WHERE o.o_orderkey = l.l_orderkey)""")
def fk_orphans(d: Data):
    lines = d.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")
    return rf.fk_orphans(lines, ["l_orderkey"], d.live_orders, ["o_orderkey"])


@query("fk_orphans_composite", """
WITH child AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderstatus END AS st FROM orders),
parent AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderpriority <> '1-URGENT')
SELECT o_orderkey, o_custkey, st FROM child c WHERE st IS NOT NULL AND o_custkey IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM parent p WHERE p.o_custkey = c.o_custkey AND p.o_orderstatus = c.st)""")
def fk_orphans_composite(d: Data):
    status = F.expr("CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderstatus END")
    child = d.orders.select("o_orderkey", "o_custkey", status.alias("st"))
    parent = d.orders.filter("o_orderpriority <> '1-URGENT'")
    return rf.fk_orphans(child, ["o_custkey", "st"], parent, ["o_custkey", "o_orderstatus"]).select(
        "o_orderkey", "o_custkey", "st"
    )


_BROKEN_FKS = """broken AS (
  SELECT f.env_id, f.schema_name, f.table_name, f.fk_name, f.ordinal, f.column_name,
    CASE WHEN c.c_nationkey = 6 AND f.fk_name = 'runs_route_id_fkey' THEN 'services' ELSE f.ref_table END AS ref_table,
    CASE WHEN c.c_nationkey = 7 AND f.fk_name = 'runs_route_id_fkey' THEN 'rid'
         WHEN c.c_nationkey = 9 AND f.fk_name = 'calls_run_id_fkey' THEN NULL ELSE f.ref_column END AS ref_column
  FROM des_fks f JOIN customer c ON c.c_custkey = f.env_id)"""


@query("fk_target_exists", fleet("tables", "cols", "fks") + ", " + _BROKEN_FKS + """,
sizes AS (SELECT env_id, table_name, fk_name, count(column_name) AS a, count(ref_column) AS b FROM broken GROUP BY ALL),
judged AS (SELECT f.*, CASE
  WHEN NOT EXISTS (SELECT 1 FROM cur_tables t WHERE t.env_id = f.env_id AND t.table_name = f.ref_table) THEN 'missing_table'
  WHEN s.a <> s.b THEN 'column_count'
  WHEN NOT EXISTS (SELECT 1 FROM cur_cols c WHERE c.env_id = f.env_id AND c.table_name = f.ref_table AND c.column_name = f.ref_column) THEN 'missing_column'
  END AS problem FROM broken f JOIN sizes s USING (env_id, table_name, fk_name))
SELECT DISTINCT env_id, schema_name, table_name, fk_name, problem,
  CASE WHEN problem = 'missing_column' THEN concat_ws('.', ref_table, ref_column) ELSE ref_table END AS subject
FROM judged WHERE problem IS NOT NULL""")
def fk_target_exists(d: Data):
    fk, nation = F.col("fk_name"), F.col("c_nationkey")
    to_route, to_run = fk == "runs_route_id_fkey", fk == "calls_run_id_fkey"
    broken = d.des.fks.join(d.tenants.select("env_id", "c_nationkey").hint("merge"), "env_id").withColumns({
        "ref_table": F.when((nation == 6) & to_route, "services").otherwise(F.col("ref_table")),
        "ref_column": F.when((nation == 7) & to_route, "rid").when((nation == 9) & to_run, F.lit(None)).otherwise(
            F.col("ref_column")),
    })
    return rf.fk_target_exists(broken, d.cur.tables, d.cur.cols)


@query("fk_on_delete_cascade", using("gone_customers") + """,
gone_orders AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone_customers))
SELECT 'customer' AS table_name, c_custkey AS key, NULL AS part, c_acctbal AS value, c_custkey IN (SELECT c_custkey FROM gone_customers) AS removed FROM customer
UNION ALL SELECT 'orders', o_orderkey, NULL, o_totalprice, o_custkey IN (SELECT c_custkey FROM gone_customers) FROM orders
UNION ALL SELECT 'lineitem', l_orderkey, l_linenumber, l_extendedprice, l_orderkey IN (SELECT o_orderkey FROM gone_orders) FROM lineitem""")
def fk_on_delete_cascade(d: Data):
    edges = [
        rf.Edge("orders", ("o_custkey",), "customer", ("c_custkey",)),
        rf.Edge("lineitem", ("l_orderkey",), "orders", ("o_orderkey",)),
    ]
    outcome = rf.fk_on_delete_cascade(
        {"customer": d.customer, "orders": d.orders, "lineitem": d.lineitem}, edges, "customer", d.gone_customers,
        {"customer": ["c_custkey"]},
    )
    shown = {"customer": ("c_custkey", None, "c_acctbal"), "orders": ("o_orderkey", None, "o_totalprice"),
             "lineitem": ("l_orderkey", "l_linenumber", "l_extendedprice")}
    parts = []
    for name, sides in outcome.items():
        key, part, value = shown[name]
        parts += [df.select(F.lit(name).alias("table_name"), F.col(key).alias("key"),
                            (F.col(part) if part else F.lit(None).cast("int")).alias("part"), F.col(value).alias("value"),
                            F.lit(gone).alias("removed")) for df, gone in zip(sides, (True, False), strict=True)]
    return reduce(DataFrame.unionByName, parts)


@query("fk_on_delete_cascade_chain", """
WITH chained AS (SELECT event_id, user_id, event_type, lag(event_id) OVER w AS previous,
  max(CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 1 ELSE 0 END) OVER w AS gone FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, previous, gone = 1 AS removed FROM chained""")
def fk_on_delete_cascade_chain(d: Data):
    """Every event names its user's event before it."""
    chain = d.events.select("event_id", "event_type", F.lag("event_id").over(
        Window.partitionBy("user_id").orderBy("event_id")).alias("previous"))
    rows = staged(chain, "chain")
    removed, kept = rf.fk_on_delete_cascade_self(
        rows, ["event_id"], ["previous"], rows.filter("event_type = 'error' AND event_id % 3 = 0").select("event_id"))
    return removed.select("event_id", "previous", F.lit(True).alias("removed")).unionByName(
        kept.select("event_id", "previous", F.lit(False).alias("removed")))


@query("fk_on_delete_set_null", using("gone_customers") + """
SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM gone_customers) THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS o_custkey
FROM orders""")
def fk_on_delete_set_null(d: Data):
    rows = rf.fk_on_delete_set(d.orders, ["o_custkey"], d.gone_customers, ["c_custkey"])
    return rows.select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"))


@query("fk_on_delete_set_default", using("gone_customers") + """
SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM gone_customers) THEN -1 ELSE o_custkey END AS o_custkey
FROM orders""")
def fk_on_delete_set_default(d: Data):
    rows = rf.fk_on_delete_set(d.orders, ["o_custkey"], d.gone_customers, ["c_custkey"], {"o_custkey": F.lit(-1)})
    return rows.select("o_orderkey", "o_custkey")


@query("fk_on_delete_restrict", using("gone_customers") + """
SELECT c_custkey, c_name FROM gone_customers WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def fk_on_delete_restrict(d: Data):
    held = rf.fk_on_delete_restrict(d.orders, ["o_custkey"], d.gone_customers, ["c_custkey"])
    return held.select("c_custkey", "c_name")


_POLICIES = [
    po.Policy("own_region", "SELECT", True, ("clerk",), "o_custkey < 1000"),
    po.Policy("urgent", "ALL", True, ("clerk", "manager"), "o_orderpriority = '1-URGENT'", "o_totalprice < 200000"),
    po.Policy("no_closed", "ALL", False, ("clerk",), "o_orderstatus <> 'F'"),
    po.Policy("everyone_cheap", "SELECT", True, (), "o_totalprice < 5000"),
]


@query("rls_select", """
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
WHERE (o_custkey < 1000 OR o_orderpriority = '1-URGENT' OR o_totalprice < 5000) AND o_orderstatus <> 'F'""")
def rls_select(d: Data):
    return po.rls_select(d.orders, _POLICIES, "clerk").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("rls_check_violations", """
SELECT o_orderkey, o_totalprice FROM orders WHERE NOT (o_totalprice < 200000 AND o_orderstatus <> 'F')""")
def rls_check_violations(d: Data):
    return po.rls_check_violations(d.orders, _POLICIES, "clerk").select("o_orderkey", "o_totalprice")


@query("rls_coverage", """
SELECT 'clerk' AS role, count(*) AS rows, count(*) FILTER (WHERE (o_custkey < 1000 OR o_orderpriority = '1-URGENT' OR o_totalprice < 5000) AND o_orderstatus <> 'F') AS visible_rows, false AS locked_out FROM orders
UNION ALL SELECT 'manager', count(*), count(*) FILTER (WHERE o_orderpriority = '1-URGENT' OR o_totalprice < 5000), false FROM orders
UNION ALL SELECT 'guest', count(*), count(*) FILTER (WHERE o_totalprice < 5000), false FROM orders""")
def rls_coverage(d: Data):
    return po.rls_coverage(d.orders, _POLICIES, ["clerk", "manager", "guest"])


@query("snapshot_diff", using("orders_later") + """
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
  CASE WHEN a.o_orderkey IS NULL THEN 'inserted' WHEN b.o_orderkey IS NULL THEN 'deleted' ELSE 'updated' END AS change
FROM orders a FULL JOIN orders_later b ON a.o_orderkey = b.o_orderkey
WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL
   OR (a.o_custkey, a.o_orderstatus, a.o_totalprice) IS DISTINCT FROM (b.o_custkey, b.o_orderstatus, b.o_totalprice)""")
def snapshot_diff(d: Data):
    return sn.snapshot_diff(d.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"),
                            d.orders_later, ["o_orderkey"])


_LATER_SQL = """, now AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 997 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
  FROM orders WHERE o_orderkey % 1009 <> 0)
SELECT o.o_orderkey, CASE WHEN n.o_orderkey IS NULL THEN 'deleted' ELSE 'updated' END AS change
FROM orders o LEFT JOIN now n USING (o_orderkey) WHERE n.o_orderkey IS NULL OR n.o_totalprice <> o.o_totalprice"""


@query("snapshot_diff_tree", "WITH unused AS (SELECT 1)" + _LATER_SQL)
def snapshot_diff_tree(d: Data):
    """About two rows in a thousand differ."""
    old = d.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    price = F.when(F.col("o_orderkey") % 997 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return sn.snapshot_diff_tree(old, old.filter("o_orderkey % 1009 <> 0").withColumn("o_totalprice", price), ["o_orderkey"], 64)


@query("backup_merge", using("live_orders") + """
SELECT o_orderkey, o_custkey, o_orderstatus, CAST(NULL AS VARCHAR) AS channel FROM live_orders
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, NULL FROM orders
WHERE o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' AND o_orderkey NOT IN (SELECT o_orderkey FROM live_orders)""")
def backup_merge(d: Data):
    # the present table has a column the backup lacks, and lacks one the backup has
    present = d.live_orders.select("o_orderkey", "o_custkey", "o_orderstatus", F.lit(None).cast("string").alias("channel"))
    return sn.backup_merge(present, d.orders, ["o_orderkey"], "o_orderdate >= timestamp_ntz'1998-01-01 00:00:00'")
