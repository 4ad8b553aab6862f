"""Phased migrations on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from moraine.plans import phases as ph
from moraine.session import scratch_dir
from moraine.workload.data import NOW, Data, fleet, using
from moraine.workload.registry import query


@query("expand_backfill", using("cust") + """
SELECT c_custkey, c_mktsegment, coalesce(segment_new, c_mktsegment) AS segment_new FROM cust""")
def expand_backfill(d: Data):
    return ph.expand_backfill(d.cust, "c_mktsegment", "segment_new").select("c_custkey", "c_mktsegment", "segment_new")


@query("contract_column", using("cust") + """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, coalesce(segment_new, c_mktsegment) AS segment_new FROM cust""")
def contract_column(d: Data):
    return ph.contract_column(ph.expand_backfill(d.cust, "c_mktsegment", "segment_new"), "c_mktsegment", "segment_new")


@query("contract_rollback", using("cust") + """
SELECT c_custkey, segment_new, segment_new AS c_mktsegment FROM cust""")
def contract_rollback(d: Data):
    contracted = d.cust.drop("c_mktsegment")
    return ph.contract_rollback(contracted, "c_mktsegment", "segment_new").select("c_custkey", "segment_new", "c_mktsegment")


@query("type_change_backfill", using("cust") + """
SELECT c_custkey, CASE WHEN segment_new IS NULL AND c_mktsegment IS NOT NULL THEN substr(c_mktsegment, 1, 3) ELSE segment_new END AS segment_new FROM cust""")
def type_change_backfill(d: Data):
    filled = ph.type_change_backfill(d.cust, "c_mktsegment", "segment_new", "string", "substring(c_mktsegment, 1, 3)")
    return filled.select("c_custkey", "segment_new")


@query("type_change_finish", """
SELECT l_orderkey, l_partkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag FROM lineitem""")
def type_change_finish(d: Data):
    lines = d.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag")
    filled = ph.type_change_backfill(lines, "l_linenumber", "line_new", "bigint")
    return ph.type_change_finish(filled, "l_linenumber", "line_new")


@query("type_change_clear", using("cust") + "SELECT c_custkey, CAST(NULL AS VARCHAR) AS segment_new FROM cust")
def type_change_clear(d: Data):
    return ph.type_change_clear(d.cust, "segment_new").select("c_custkey", "segment_new")


@query("null_backfill", using("cust") + "SELECT c_custkey, coalesce(c_mktsegment, 'UNKNOWN') AS c_mktsegment FROM cust")
def null_backfill(d: Data):
    return ph.null_backfill(d.cust, "c_mktsegment", "'UNKNOWN'").select("c_custkey", "c_mktsegment")


@query("not_null_migration", using("cust") + """
SELECT c_custkey, c_name, coalesce(c_mktsegment, 'UNKNOWN') AS c_mktsegment FROM cust""")
def not_null_migration(d: Data):
    return ph.not_null_migration(d.cust, "c_mktsegment", "'UNKNOWN'").select("c_custkey", "c_name", "c_mktsegment")


@query("not_null_pipeline", using("cust") + """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, coalesce(c_mktsegment, 'UNKNOWN') AS c_mktsegment, segment_new FROM cust""")
def not_null_pipeline(d: Data):
    return ph.not_null_migration(d.cust, "c_mktsegment", "'UNKNOWN'")


@query("unique_pipeline", """
SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey,
  l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) = 1""")
def unique_pipeline(d: Data):
    order = [c for c in d.lineitem.columns if c not in ("l_orderkey", "l_linenumber")]
    return ph.unique_migration(d.lineitem, ["l_orderkey", "l_linenumber"], order)


@query("unique_migration", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) = 1""")
def unique_migration(d: Data):
    lines = d.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return ph.unique_migration(lines, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query("archive_column", using("cust") + f"""
SELECT c_custkey, c_mktsegment, TIMESTAMP '{NOW}' AS archived_at FROM cust WHERE c_mktsegment IS NOT NULL""")
def archive_column(d: Data):
    return ph.archive_column(d.cust, ["c_custkey"], "c_mktsegment", d.now)


@query("archive_table", f"SELECT *, TIMESTAMP '{NOW}' AS archived_at FROM orders")
def archive_table(d: Data):
    path = scratch_dir(d.spark, "archive")
    ph.archive_table(d.orders, d.now).write.partitionBy("archived_at").parquet(path)
    return d.spark.read.parquet(path).withColumn("archived_at", F.col("archived_at").cast("timestamp_ntz"))


@query("archive_verify", using("cust_archive") + """
SELECT 'orders' AS table_name, count(*) AS left_rows, count(*) AS right_rows, true AS rows_match, true AS content_matches FROM orders
UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), count(*), (SELECT count(*) FROM customer) = count(*),
  NOT EXISTS (SELECT * FROM customer EXCEPT ALL SELECT * FROM cust_archive) FROM cust_archive""")
def archive_verify(d: Data):
    full = ph.archive_verify(d.orders, ph.archive_table(d.orders, d.now))
    short = ph.archive_verify(d.customer, ph.archive_table(d.cust_archive, d.now))
    return full.withColumn("table_name", F.lit("orders")).unionByName(short.withColumn("table_name", F.lit("customer")))


@query("archive_restore", using("cust") + """
SELECT c.c_custkey, c.c_name, a.c_mktsegment FROM customer c
LEFT JOIN (SELECT c_custkey, c_mktsegment FROM cust WHERE c_mktsegment IS NOT NULL) a USING (c_custkey)""")
def archive_restore(d: Data):
    archive = ph.archive_column(d.cust, ["c_custkey"], "c_mktsegment", d.now)
    return ph.archive_restore(d.customer, archive, ["c_custkey"], "c_mktsegment").select("c_custkey", "c_name", "c_mktsegment")


@query("drop_table_guard", fleet("fks") + """
SELECT env_id, table_name, fk_name FROM cur_fks WHERE ref_table = 'runs' AND table_name <> 'runs'""")
def drop_table_guard(d: Data):
    return ph.drop_table_guard(d.cur.fks, "runs").select("env_id", "table_name", "fk_name")


@query("drop_table", """
SELECT table_name, n AS rows FROM (
SELECT 'customer' AS table_name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders)""")
def drop_table(d: Data):
    tables = {"customer": d.customer, "orders": d.orders, "events": d.events}
    left = ph.drop_table(
        tables, "events", d.cur.fks, ph.archive_table(d.events.repartition("user_id"), d.now)
    )
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in left.items()]
    return parts[0].unionByName(parts[1])


@query("batched_backfill", using("cust") + """
SELECT CAST(floor(c_custkey / 100.0) AS BIGINT) AS bucket, count(*) AS rows,
  count(*) FILTER (WHERE segment_new IS NULL AND c_mktsegment IS NOT NULL) AS pending,
  count(*) FILTER (WHERE segment_new IS NOT NULL AND c_mktsegment IS NOT NULL) AS done FROM cust GROUP BY 1""")
def batched_backfill(d: Data):
    return ph.batched_backfill(d.cust, "c_custkey", 100, "segment_new", "c_mktsegment")


@query("batched_backfill_resume", using("cust") + """
SELECT c_custkey, c_mktsegment, coalesce(segment_new, c_mktsegment) AS segment_new, c_acctbal FROM cust""")
def batched_backfill_resume(d: Data):
    """Stopped after three batches, then resumed: the whole table, filled."""
    path = scratch_dir(d.spark, "backfill")
    arguments = (d.cust, "c_custkey", 10, "segment_new", "c_mktsegment", "string", path, 8)
    ph.run_backfill(*arguments, stop_after=3)
    ph.run_backfill(*arguments)
    return ph.read_backfill(d.spark, path).select("c_custkey", "c_mktsegment", "segment_new", "c_acctbal")


@query("rollback_loss", using("evt_dual") + """
SELECT count(*) AS rows, count(*) FILTER (WHERE value_new IS NOT NULL AND ts >= TIMESTAMP '2024-01-20 00:00:00') AS lost_rows FROM evt_dual""")
def rollback_loss(d: Data):
    return ph.rollback_loss(d.evt_dual, "value_new", "ts", F.expr("timestamp_ntz'2024-01-20 00:00:00'"))


@query("sample_production", """
WITH edge AS (
  SELECT arg_min(c_custkey, (c_acctbal, c_custkey)) AS k FROM customer GROUP BY c_mktsegment
  UNION SELECT arg_min(c_custkey, (-c_acctbal, c_custkey)) FROM customer GROUP BY c_mktsegment)
SELECT c_custkey, sha256(c_name) AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
WHERE ('0x' || substr(md5(CAST(c_custkey AS VARCHAR)), 1, 8))::BIGINT % 20 = 0 OR c_custkey IN (SELECT k FROM edge)""")
def sample_production(d: Data):
    return ph.sample_production(d.customer, "c_custkey", "c_mktsegment", 20, ["c_acctbal"], ["c_name"])
