"""Constraint checks on data."""

from __future__ import annotations

from pyspark.sql import functions as F

from moraine.operators import checks as ck
from moraine.workload.data import Data, using
from moraine.workload.registry import query

LINEITEM_RULES = [
    ck.NotNull("l_shipdate"),
    ck.Check("l_quantity > 0", "l_quantity > 0"),
    ck.Check("l_discount < 0.1", "l_discount < 0.1"),
    ck.MaxLength("l_returnflag", 1),
    ck.OneOf("l_linestatus", ("F", "O")),
    ck.Castable("l_orderkey", "int"),
    ck.Unique(("l_orderkey", "l_linenumber")),
    ck.ForeignKey(("l_orderkey",), "live_orders", ("o_orderkey",)),
]

_SUMMARY_SQL = """
SELECT rule, CAST(violations AS BIGINT) AS violations, CAST(n AS BIGINT) AS rows, violations = 0 AS passed FROM (
  SELECT 'not_null(l_shipdate)' AS rule, count(*) FILTER (WHERE l_shipdate IS NULL) AS violations, count(*) AS n FROM lineitem
  UNION ALL SELECT 'check(l_quantity > 0)', count(*) FILTER (WHERE NOT l_quantity > 0), count(*) FROM lineitem
  UNION ALL SELECT 'check(l_discount < 0.1)', count(*) FILTER (WHERE NOT l_discount < CAST(0.1 AS DOUBLE)), count(*) FROM lineitem
  UNION ALL SELECT 'varchar(l_returnflag,1)', count(*) FILTER (WHERE length(l_returnflag) > 1), count(*) FROM lineitem
  UNION ALL SELECT 'enum(l_linestatus)', count(*) FILTER (WHERE l_linestatus NOT IN ('F', 'O')), count(*) FROM lineitem
  UNION ALL SELECT 'cast(l_orderkey,int)', count(*) FILTER (WHERE abs(l_orderkey) > 2147483647), count(*) FROM lineitem
  UNION ALL SELECT 'unique(l_orderkey,l_linenumber)',
    (SELECT coalesce(sum(c - 1), 0) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)), count(*) FROM lineitem
  UNION ALL SELECT 'foreign_key(l_orderkey->live_orders)',
    count(*) FILTER (WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')), count(*) FROM lineitem)
"""


@query("check_summary", _SUMMARY_SQL)
def check_summary(d: Data):
    return ck.check_summary(d.lineitem, LINEITEM_RULES, {"live_orders": d.live_orders})


@query("check_not_null", using("cust") + "SELECT c_custkey, c_name FROM cust WHERE c_mktsegment IS NULL")
def check_not_null(d: Data):
    return ck.check_not_null(d.cust, "c_mktsegment").select("c_custkey", "c_name")


@query("check_expression", using("cust") + """
SELECT c_custkey, c_acctbal FROM cust WHERE (c_mktsegment <> 'BUILDING' OR c_acctbal >= 1000) IS FALSE""")
def check_expression(d: Data):
    rows = ck.check_expression(d.cust, "c_mktsegment <> 'BUILDING' OR c_acctbal >= 1000")
    return rows.select("c_custkey", "c_acctbal")


@query("check_unique", """
SELECT text, count(*) AS n, count(*) - 1 AS surplus FROM documents WHERE text IS NOT NULL
GROUP BY text HAVING count(*) > 1""")
def check_unique(d: Data):
    return ck.check_unique(d.documents, ["text"])


@query("check_primary_key", """
SELECT k.l_orderkey AS l_orderkey, k.line_no AS line_no, count(*) AS n,
       CASE WHEN line_no IS NULL THEN 'null' ELSE 'duplicate' END AS problem
FROM (SELECT l_orderkey, CASE WHEN l_discount > 0.08 AND l_tax > 0.06 THEN NULL ELSE CAST(l_linenumber AS VARCHAR) END AS line_no FROM lineitem) k
GROUP BY ALL HAVING line_no IS NULL OR count(*) > 1""")
def check_primary_key(d: Data):
    lines = d.lineitem.select("l_orderkey", F.expr(
        "CASE WHEN l_discount > 0.08D AND l_tax > 0.06D THEN NULL ELSE CAST(l_linenumber AS STRING) END"
    ).alias("line_no"))
    return ck.check_primary_key(lines, ["l_orderkey", "line_no"])


@query("check_varchar_length", "SELECT p_partkey, p_name FROM part WHERE length(p_name) > 10")
def check_varchar_length(d: Data):
    return ck.check_max_length(d.part, "p_name", 10).select("p_partkey", "p_name")


@query("check_enum_membership", """
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""")
def check_enum_membership(d: Data):
    allowed = d.orders.filter("o_orderpriority <= '3-Z'").select("o_orderpriority")
    return ck.check_one_of(d.orders, "o_orderpriority", allowed).select("o_orderkey", "o_orderpriority")


_QUARANTINE = [
    ck.NotNull("c_mktsegment"),
    ck.Check("balance", "c_acctbal < 9000"),
    ck.OneOf("segment_new", ("building", "machinery", "furniture")),
]


@query("quarantine_split", using("cust") + """
SELECT c_custkey, concat_ws(';',
  CASE WHEN c_mktsegment IS NULL THEN 'not_null(c_mktsegment)' END,
  CASE WHEN c_acctbal >= 9000 THEN 'check(balance)' END,
  CASE WHEN segment_new NOT IN ('building', 'machinery', 'furniture') THEN 'enum(segment_new)' END) AS reasons
FROM cust""")
def quarantine_split(d: Data):
    good, bad = ck.quarantine_split(d.cust, _QUARANTINE)
    return bad.select("c_custkey", F.array_join("reasons", ";").alias("reasons")).unionByName(
        good.select("c_custkey", F.lit("").alias("reasons"))
    )


@query("dedupe_keep_first", """
SELECT doc_id, lang, source, n_chars FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def dedupe_keep_first(d: Data):
    return ck.dedupe_keep_first(d.documents, ["text"], ["doc_id"]).select("doc_id", "lang", "source", "n_chars")
