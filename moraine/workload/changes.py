"""Table evolution, change plans and their rollback."""

from __future__ import annotations

from pyspark.sql import functions as F

from moraine.operators import checks as ck
from moraine.operators import evolve as ev
from moraine.plans import changes as ch
from moraine.plans import phases as ph
from moraine.plans import rollback as rb
from moraine.session import scratch_dir
from moraine.sources.publish import (
    PublishError, Staged, publish_table, publish_tables, read_published, read_set, recreate_table,
)
from moraine.workload.data import NOW, Data, using
from moraine.workload.registry import query


@query("add_column_nullable", "SELECT *, CAST(NULL AS VARCHAR) AS nickname FROM customer")
def add_column_nullable(d: Data):
    return ev.add_column(d.customer, "nickname", "string")


@query("add_column_default", "SELECT *, 'pending' AS status FROM customer")
def add_column_default(d: Data):
    return ev.add_column(d.customer, "status", "string", "'pending'::text")


@query("default_expression", f"""
SELECT c_custkey, 100 AS n, 0.5::DOUBLE AS f, 'it''s' AS s, true AS b, TIMESTAMP '{NOW}' AS at, '2024-06-01' AS day,
  'abc' AS low, md5('x') AS dig, 7 AS casted FROM customer""")
def default_expression(d: Data):
    df = d.customer.select("c_custkey")
    for name, kind, text in (
        ("n", "int", "100"), ("f", "double", "0.5"), ("s", "string", "'it''s'"), ("b", "boolean", "TRUE"),
        ("at", "timestamp_ntz", "CURRENT_TIMESTAMP(3)"), ("day", "date", "CURRENT_DATE"),
        ("low", "string", "lower('ABC')"), ("dig", "string", "md5(lower('X'))"), ("casted", "int", "'7'::integer"),
    ):
        df = ev.add_column(df, name, kind, text, d.now)
    return df.withColumn("day", F.col("day").cast("string"))


@query("drop_column", "SELECT * EXCLUDE (l_tax) FROM lineitem")
def drop_column(d: Data):
    return ev.drop_column(d.lineitem, "l_tax")


@query("rename_column", "SELECT * RENAME (o_orderstatus AS status) FROM orders")
def rename_column(d: Data):
    return ev.rename_column(d.orders, "o_orderstatus", "status")


@query("alter_column_type", "SELECT * REPLACE (CAST(l_linenumber AS BIGINT) AS l_linenumber) FROM lineitem")
def alter_column_type(d: Data):
    return ev.alter_column_type(d.lineitem, "l_linenumber", "bigint")


@query("alter_column_type_using", """
SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS o_orderpriority FROM orders""")
def alter_column_type_using(d: Data):
    changed = ev.alter_column_type(d.orders, "o_orderpriority", "int", "substring(o_orderpriority, 1, 1)")
    return changed.select("o_orderkey", "o_orderpriority")


@query("set_not_null", using("cust") + """
SELECT 'before' AS state, 'not_null(c_mktsegment)' AS rule, count(*) FILTER (WHERE c_mktsegment IS NULL) AS violations, count(*) AS rows FROM cust
UNION ALL SELECT 'after', 'not_null(c_mktsegment)', 0, count(*) FROM cust WHERE c_mktsegment IS NOT NULL""")
def set_not_null(d: Data):
    """Declared on the table as it is, and on what a quarantine of its violations leaves."""
    before = ch.SetNotNull("c_mktsegment").apply(ch.Table(d.cust))
    good, _ = ck.quarantine_split(before.df, before.rules)
    after = ch.SetNotNull("c_mktsegment").apply(ch.Table(good))
    parts = [ck.check_summary(t.df, t.rules).select(F.lit(n).alias("state"), "rule", "violations", "rows") for n, t in (("before", before), ("after", after))]
    return parts[0].unionByName(parts[1])


@query("append_with_defaults", using("gone_customers") + """
SELECT c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_acctbal, c_mktsegment FROM customer
UNION ALL SELECT c_custkey + 1000000, c_name, NULL, 0.0, 'GENERAL' FROM gone_customers""")
def append_with_defaults(d: Data):
    # the nation is present and null, balance and segment are left out
    incoming = d.gone_customers.select(
        (F.col("c_custkey") + 1000000).alias("c_custkey"), "c_name", F.lit(None).cast("int").alias("c_nationkey")
    )
    defaults = {"c_mktsegment": "'GENERAL'", "c_nationkey": "0", "c_acctbal": "0"}
    appended = ev.append_with_defaults(d.customer, incoming, defaults)
    return appended.withColumn("c_nationkey", F.col("c_nationkey").cast("string"))


@query("recreate_copy", """
SELECT o_orderstatus, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderkey FROM orders""")
def recreate_copy(d: Data):
    rule = ck.ForeignKey(("o_custkey",), "customer", ("cust_text",))
    root = scratch_dir(d.spark, "recreate")
    parents = {"customer": d.customer.select(F.col("c_custkey").cast("string").alias("cust_text"))}
    columns = [("o_orderstatus", "string"), ("o_custkey", "string"), ("o_orderkey", "bigint")]
    recreate_table(d.orders, columns, root, [rule], parents)
    return read_published(d.spark, root)


@query("recreate_copy_without_rule", using("gone_customers") + """
SELECT 'refused' AS state, NULL AS o_orderkey, NULL AS o_custkey, count(*) > 0 AS refused FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone_customers)
UNION ALL SELECT 'rebuilt', o_orderkey, o_custkey, false FROM orders""")
def recreate_copy_without_rule(d: Data):
    """With its foreign key the copy is refused, without it the rebuilt table is published under the rules that are left."""
    fk = ck.ForeignKey(("o_custkey",), "gone_customers", ("c_custkey",))
    table, parents = ch.Table(d.orders, (ck.Unique(("o_orderkey",)), fk)), {"gone_customers": d.gone_customers}
    root, columns = scratch_dir(d.spark, "without-rule"), d.orders.dtypes
    refused = False
    try:
        recreate_table(table.df, columns, root, table.rules, parents)
    except PublishError:
        refused = True
    copy = ch.DropRule(fk).apply(table)
    recreate_table(copy.df, columns, root, copy.rules, parents)
    rows = read_published(d.spark, root).select(F.lit("rebuilt").alias("state"), "o_orderkey", "o_custkey", F.lit(False).alias("refused"))
    none = F.lit(None).cast("bigint")
    return rows.unionByName(d.spark.range(1).select(
        F.lit("refused").alias("state"), none.alias("o_orderkey"), none.alias("o_custkey"), F.lit(refused).alias("refused")))


@query("generated_column", """
SELECT p_partkey, p_brand || ' ' || p_type AS full_name FROM part""")
def generated_column(d: Data):
    made = ev.generated_column(d.part, "full_name", "concat_ws(' ', p_brand, p_type)")
    return made.select("p_partkey", "full_name")


_ORDER_CHANGES = [
    ch.DropColumn("o_orderpriority"),
    ch.AlterType("o_totalprice", "decimal(12,2)"),
    ch.AddColumn("priority_no", "int", source="CAST(substring(o_orderpriority, 1, 1) AS INT)"),
    ch.AddColumn("channel", "string", nullable=False, default="'web'"),
    ch.SetNotNull("o_custkey"),
    ch.unique_rule("o_orderkey"),
]


@query("apply_changes", """
SELECT o_orderkey, o_custkey, o_orderstatus, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS o_totalprice, o_orderdate,
  CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority_no, 'web' AS channel FROM orders""")
def apply_changes(d: Data):
    changed = ch.apply_changes(ch.Table(d.orders), _ORDER_CHANGES).df
    return changed.withColumn("o_totalprice", F.col("o_totalprice").cast("string"))  # decimals compare as text


_REVERSIBLE = [
    ch.AddColumn("channel", "string", nullable=False, default="'web'"),
    ch.AlterType("o_custkey", "string"),
    ch.RenameColumn("o_orderstatus", "status"),
    ch.SetRls(True),
]


_RULED = (ck.NotNull("o_orderstatus"), ck.Unique(("o_orderkey",)), ck.OneOf("o_orderstatus", ("F", "O")),
          ck.Check("priced", "o_totalprice > 0"))


@query("rollback_changes", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, NULL AS rule, NULL AS violations FROM orders
UNION ALL SELECT NULL, NULL, NULL, NULL, r.rule, r.violations FROM (
  SELECT 'not_null(o_orderstatus)' AS rule, 0 AS violations UNION ALL SELECT 'unique(o_orderkey)', 0
  UNION ALL SELECT 'enum(o_orderstatus)', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O'))
  UNION ALL SELECT 'check(priced)', (SELECT count(*) FROM orders WHERE NOT o_totalprice > 0)) r""")
def rollback_changes(d: Data):
    """Forward and back over a table with rules, a dropped column's among them, its values from the archive."""
    before = ch.Table(d.orders, _RULED)
    steps = [*_REVERSIBLE[:2], ch.SetRls(True), ch.DropColumn("o_orderstatus")]
    archive = ph.archive_column(d.orders, ["o_orderkey"], "o_orderstatus", d.now)
    back = ch.rollback_changes(ch.apply_changes(before, steps), before, steps)
    rows = rb.rollback_drop_column(back.df.drop("o_orderstatus"), "o_orderstatus", "string", archive, ["o_orderkey"])
    checked = ck.check_summary(rows, back.rules)
    shown = rows.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return shown.unionByName(checked.select("rule", "violations"), allowMissingColumns=True)


@query("rollback_check", """
SELECT 0::BIGINT AS only_before, 0::BIGINT AS only_after, true AS identical, 'reversible' AS plan
UNION ALL SELECT count(*), count(*), false, 'lossy' FROM events WHERE event_type = 'error'""")
def rollback_check(d: Data):
    before = ch.Table(d.orders)
    restored = ch.rollback_changes(ch.apply_changes(before, _REVERSIBLE), before, _REVERSIBLE)
    clean = rb.rollback_check(before.df, restored.df).withColumn("plan", F.lit("reversible"))
    big = ch.Table(d.evt_big.select("event_id", "big_id"))
    steps = [ch.AlterType("big_id", "int", lenient=True)]
    lossy = ch.rollback_changes(ch.apply_changes(big, steps), big, steps)
    return clean.unionByName(rb.rollback_check(big.df, lossy.df).withColumn("plan", F.lit("lossy")))


@query("rollback_drop_column", using("cust") + """
SELECT c_custkey, c_mktsegment AS restored, CAST(NULL AS VARCHAR) AS lost FROM cust""")
def rollback_drop_column(d: Data):
    archive = ph.archive_column(d.cust, ["c_custkey"], "c_mktsegment", d.now)
    dropped = ev.drop_column(d.cust, "c_mktsegment")
    restored = rb.rollback_drop_column(dropped, "c_mktsegment", "string", archive, ["c_custkey"])
    bare = rb.rollback_drop_column(restored.withColumnRenamed("c_mktsegment", "restored"), "lost", "string")
    return bare.select("c_custkey", "restored", "lost")


@query("rollback_alter_type", using("evt_big") + """
SELECT event_id, CAST(try_cast(big_id AS INTEGER) AS VARCHAR) AS big_id, big_id > 2147483647 AS big_id_unfit FROM evt_big""")
def rollback_alter_type(d: Data):
    back = rb.rollback_alter_type(d.evt_big, "big_id", "int")
    return back.select("event_id", F.col("big_id").cast("string").alias("big_id"), "big_id_unfit")


@query("add_index", """
SELECT column_name, true AS skips, (SELECT count(*) FROM lineitem) AS rows, (SELECT CAST(sum(l_quantity) AS BIGINT) FROM lineitem) AS quantity
FROM (VALUES ('l_partkey'), ('l_suppkey')) AS c(column_name)""")
def add_index(d: Data):
    """Whether a probe on either column, by the minima and maxima of the files written, skips half of them or more."""
    path = scratch_dir(d.spark, "index")
    ev.curve_layout(d.lineitem, ["l_partkey", "l_suppkey"], 16).write.parquet(path)
    laid = d.spark.read.parquet(path)
    # probes in the middle of either column's values
    probes = laid.agg(*[F.percentile_approx(c, 0.5).alias(c) for c in ("l_partkey", "l_suppkey")]).first().asDict()
    found = ev.files_admitting(laid, probes).select("column_name", (F.col("admitting") * 2 <= F.col("files")).alias("skips"))
    totals = laid.agg(F.count(F.lit(1)).alias("rows"), F.sum("l_quantity").cast("bigint").alias("quantity")).first()
    return found.withColumns({"rows": F.lit(totals["rows"]), "quantity": F.lit(totals["quantity"])})


@query("drop_index", """
SELECT 'unique(o_custkey)' AS rule, 'declared' AS state, count(*) - count(DISTINCT o_custkey) > 0 AS violated FROM orders
UNION ALL SELECT 'unique(o_orderkey)', 'declared', count(*) - count(DISTINCT o_orderkey) > 0 FROM orders
UNION ALL SELECT 'unique(o_orderkey)', 'left', count(*) - count(DISTINCT o_orderkey) > 0 FROM orders""")
def drop_index(d: Data):
    """Two unique rules, one of them violated; the drop takes that one along."""
    both = ch.Table(d.orders, (ck.Unique(("o_orderkey",)), ck.Unique(("o_custkey",))))
    left = ch.DropRule(ck.Unique(("o_custkey",))).apply(both)
    parts = [ck.check_summary(t.df, t.rules).select("rule", F.lit(n).alias("state"), (F.col("violations") > 0).alias("violated"))
             for n, t in (("declared", both), ("left", left))]
    return parts[0].unionByName(parts[1])


@query("publish_table", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag, true AS refused FROM lineitem""")
def publish_table_query(d: Data):
    """Published once; a second version that breaks a rule is refused, and readers stay on the first."""
    root = scratch_dir(d.spark, "publish")
    rules = [ck.NotNull("l_orderkey"), ck.Check("quantity", "l_quantity > 0")]
    publish_table(d.lineitem, root, rules)
    refused = False
    try:
        publish_table(d.lineitem.withColumn("l_quantity", F.lit(-1.0)), root, rules)
    except PublishError:
        refused = True
    return read_published(d.spark, root).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", F.lit(refused).alias("refused"))


@query("publish_tables", """
SELECT 'orders' AS table_name, o_orderkey AS key, o_custkey AS parent, true AS refused FROM orders
UNION ALL SELECT 'customer', c_custkey, NULL, true FROM customer""")
def publish_tables_query(d: Data):
    """A set of two: a change whose second table breaks its foreign key leaves both on their old versions."""
    root, fk = scratch_dir(d.spark, "set"), ck.ForeignKey(("o_custkey",), "customer", ("c_custkey",))
    first = publish_tables(d.spark, root, {"customer": Staged(d.customer, (ck.PrimaryKey(("c_custkey",)),)), "orders": Staged(d.orders, (fk,))})
    refused = False
    try:
        publish_tables(d.spark, root, {
            "customer": Staged(d.customer.withColumn("c_custkey", F.col("c_custkey") + 10**9)),
            "orders": Staged(d.orders, (fk,))}, first["hash"])
    except PublishError:
        refused = True
    now = read_set(d.spark, root)
    parts = [now[n].select(F.lit(n).alias("table_name"), F.col(k).alias("key"), p.alias("parent"), F.lit(refused).alias("refused"))
             for n, k, p in (("orders", "o_orderkey", F.col("o_custkey")), ("customer", "c_custkey", F.lit(None).cast("bigint")))]
    return parts[0].unionByName(parts[1])
