"""Counts, sizes and content comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from moraine.operators import measures as ms
from moraine.operators import probes as pr
from moraine.workload.data import Data, using
from moraine.workload.registry import query


@query("null_count", using("cust") + """
SELECT count(*) AS rows, count(*) FILTER (WHERE c_mktsegment IS NULL) AS null_rows FROM cust""")
def null_count(d: Data):
    return ms.null_count(d.cust, "c_mktsegment")


@query("backfill_gap_count", using("cust") + """
SELECT count(*) AS gap FROM cust WHERE segment_new IS NULL AND c_mktsegment IS NOT NULL""")
def backfill_gap_count(d: Data):
    return ms.backfill_gap_count(d.cust, "segment_new", "c_mktsegment")


@query("pending_backfill_rows", using("cust") + """
SELECT c_custkey, c_mktsegment FROM cust WHERE segment_new IS NULL AND c_mktsegment IS NOT NULL""")
def pending_backfill_rows(d: Data):
    return d.cust.filter(ms.pending("segment_new", "c_mktsegment")).select("c_custkey", "c_mktsegment")


@query("row_count_match", using("cust_archive") + """
SELECT a AS left_rows, b AS right_rows, a = b AS matches
FROM (SELECT (SELECT count(*) FROM customer) AS a, (SELECT count(*) FROM cust_archive) AS b)""")
def row_count_match(d: Data):
    return ms.row_count_match(d.customer, d.cust_archive)


_SAME = "NOT EXISTS (SELECT * FROM {a} EXCEPT ALL SELECT * FROM {b}) AND NOT EXISTS (SELECT * FROM {b} EXCEPT ALL SELECT * FROM {a})"


@query("content_match", using("cust_archive") + f"""
SELECT 'complete' AS archive, {_SAME.format(a='lineitem', b='lineitem')} AS matches
UNION ALL SELECT 'short', {_SAME.format(a='customer', b='cust_archive')}""")
def content_match(d: Data):
    # the complete copy comes in another row order
    complete = ms.content_match(d.lineitem, d.lineitem.repartition("l_partkey")).select(F.lit("complete").alias("archive"), "matches")
    short = ms.content_match(d.customer, d.cust_archive).select(F.lit("short").alias("archive"), "matches")
    return complete.unionByName(short)


@query("drop_column_impact", """
SELECT * , round(bytes / 1048576.0::DOUBLE, 2) AS mb FROM (
SELECT 'text' AS column_name, count(*) AS rows, count(text) AS non_null, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents
UNION ALL SELECT 'lang', count(*), count(lang), CAST(sum(octet_length(encode(lang))) AS BIGINT) FROM documents
UNION ALL SELECT 'n_chars', count(*), count(n_chars), 8 * count(n_chars) FROM documents)""")
def drop_column_impact(d: Data):
    return ms.drop_column_impact(d.documents, ["text", "lang", "n_chars"])


@query("drop_table_impact", """
SELECT *, round(bytes / 1048576.0::DOUBLE, 2) AS mb FROM (
SELECT count(*) AS rows, CAST(sum(8 + 8 + 8 + 8 + octet_length(encode(event_type)) + octet_length(encode(props))) AS BIGINT) AS bytes FROM events)""")
def drop_table_impact(d: Data):
    return ms.drop_table_impact(d.events)


@query("identity_high_water_mark", "SELECT coalesce(max(o_orderkey), 1) AS high_water_mark FROM orders")
def identity_high_water_mark(d: Data):
    return ms.identity_high_water_mark(d.orders, "o_orderkey")


@query("sample_compare", using("ord_text") + """
SELECT o_orderkey, cust_text AS old_value, CAST(try_cast(cust_text AS BIGINT) AS VARCHAR) AS new_value,
       CAST(try_cast(cust_text AS BIGINT) AS VARCHAR) AS back_value
FROM ord_text ORDER BY o_orderkey LIMIT 20""")
def sample_compare(d: Data):
    sample = pr.sample_compare(d.ord_text, "o_orderkey", "cust_text", "bigint", 20)
    return sample.withColumn("new_value", F.col("new_value").cast("string"))
