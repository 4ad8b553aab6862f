"""Type names, conversions and what they do to the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from moraine.functions import typenames as tn
from moraine.operators import probes as pr
from moraine.workload.data import Data, using, fleet
from moraine.workload.registry import query

# Fixture spellings, spread over the tenants' columns by the length of the column name.
_SPELLINGS = [
    "int2", "pg_catalog.int4", "INT8", "pg_catalog.varchar(255)", "bpchar(3)", "float8[]", "numeric(10, 2)",
    "timestamptz", "pg_catalog.bool", "my_schema.mood", "text[][]", "serial4",
]
_DEFAULTS = [
    "'{}'::jsonb", "now()", "nextval('routes_route_id_seq'::regclass)", "'a::b'", "(now() at time zone 'utc'::text)",
    "'x'::character varying", "0", "'it''s'::text",
]


def _pick(items: list[str], engine: str) -> str:
    """The item chosen by environment and ordinal, as SQL text of either engine."""
    quoted = ", ".join("'" + i.replace("'", "''") + "'" for i in items)
    at = f"CAST((env_id + ordinal) % {len(items)} AS INTEGER) + 1"
    return f"element_at(array({quoted}), {at})" if engine == "spark" else f"[{quoted}][{at}]"


@query("normalize_type", fleet("cols") + f"""
SELECT env_id, table_name, column_name, spelling,
  CASE lower(base) WHEN 'int2' THEN 'smallint' WHEN 'int4' THEN 'integer' WHEN 'int8' THEN 'bigint' WHEN 'bpchar' THEN 'char'
    WHEN 'float8' THEN 'double precision' WHEN 'timestamptz' THEN 'timestamp with time zone' WHEN 'bool' THEN 'boolean'
    WHEN 'serial4' THEN 'serial' WHEN 'varchar' THEN 'varchar' WHEN 'numeric' THEN 'numeric' WHEN 'text' THEN 'text' ELSE base END
  || replace(mods, ' ', '') || CASE WHEN contains(spelling, '[') THEN '[]' ELSE '' END AS standard
FROM (SELECT *, split_part(split_part(replace(spelling, 'pg_catalog.', ''), '(', 1), '[', 1) AS base,
        CASE WHEN contains(spelling, '(') THEN substr(spelling, instr(spelling, '('), instr(spelling, ')') - instr(spelling, '(') + 1) ELSE '' END AS mods
      FROM (SELECT env_id, table_name, column_name, {_pick(_SPELLINGS, 'duck')} AS spelling FROM cur_cols))""")
def normalize_type(d: Data):
    named = d.cur.cols.withColumn("spelling", F.expr(_pick(_SPELLINGS, "spark")))
    return named.select("env_id", "table_name", "column_name", "spelling",
                        tn.normalize_type(F.col("spelling")).alias("standard"))


@query("normalize_default", fleet("cols") + f"""
SELECT env_id, table_name, column_name, raw, CASE raw
  WHEN '''{{}}''::jsonb' THEN '''{{}}'''
  WHEN '''x''::character varying' THEN '''x''' WHEN '''it''''s''::text' THEN '''it''''s'''
  ELSE raw END AS default_norm
FROM (SELECT env_id, table_name, column_name, {_pick(_DEFAULTS, 'duck')} AS raw FROM cur_cols)""")
def normalize_default(d: Data):
    named = d.cur.cols.withColumn("raw", F.expr(_pick(_DEFAULTS, "spark")))
    return named.select("env_id", "table_name", "column_name", "raw",
                        tn.normalize_default(F.col("raw")).alias("default_norm"))


_FROM = ["smallint", "integer", "bigint", "real", "double precision", "varchar(100)", "char(3)", "date", "timestamp",
         "numeric(10,4)", "text"]
_TO = ["bigint", "numeric(12,2)", "text", "varchar(50)", "integer", "timestamptz", "double precision"]


@query("classify_conversion", fleet("cols") + f"""
SELECT env_id, table_name, column_name, old_type, new_type, a = b OR (a, b) IN (
  VALUES ('smallint','integer'),('smallint','bigint'),('smallint','numeric'),('smallint','decimal'),
  ('integer','bigint'),('integer','numeric'),('integer','decimal'),('bigint','numeric'),('bigint','decimal'),
  ('real','double precision'),('real','numeric'),('real','decimal'),('double precision','numeric'),('double precision','decimal'),
  ('varchar','text'),('char','varchar'),('char','text'),('date','timestamp'),('date','timestamptz'),('timestamp','timestamptz')) AS safe
FROM (SELECT *, split_part(old_type, '(', 1) AS a, split_part(new_type, '(', 1) AS b FROM (
  SELECT env_id, table_name, column_name, {_pick(_FROM, 'duck')} AS old_type, {_pick(_TO, 'duck')} AS new_type FROM cur_cols))""")
def classify_conversion(d: Data):
    typed = d.cur.cols.select(
        "env_id", "table_name", "column_name",
        F.expr(_pick(_FROM, "spark")).alias("old_type"), F.expr(_pick(_TO, "spark")).alias("new_type"),
    )
    return typed.withColumn("safe", tn.is_widening(F.col("old_type"), F.col("new_type")))


@query("cast_probe", using("evt_big", "ord_text") + """
SELECT 'big_id' AS column_name, 'int' AS target, count(*) AS rows, count(big_id) AS non_null,
  count(*) FILTER (WHERE try_cast(big_id AS INTEGER) IS NULL) AS failed,
  CAST(min(big_id) FILTER (WHERE try_cast(big_id AS INTEGER) IS NULL) AS VARCHAR) AS lowest_failed,
  CAST(max(big_id) FILTER (WHERE try_cast(big_id AS INTEGER) IS NULL) AS VARCHAR) AS highest_failed FROM evt_big
UNION ALL SELECT 'cust_text', 'int', count(*), count(cust_text), count(*) FILTER (WHERE try_cast(cust_text AS INTEGER) IS NULL),
  min(cust_text) FILTER (WHERE try_cast(cust_text AS INTEGER) IS NULL), max(cust_text) FILTER (WHERE try_cast(cust_text AS INTEGER) IS NULL) FROM ord_text""")
def cast_probe(d: Data):
    return pr.cast_probe(d.evt_big, {"big_id": "int"}).unionByName(pr.cast_probe(d.ord_text, {"cust_text": "int"}))


@query("round_trip_probe", using("evt_big") + """
SELECT 'big_id' AS column_name, 'bigint' AS old_type, 'int' AS new_type, count(*) AS rows,
  count(*) FILTER (WHERE big_id > 2147483647) AS changed FROM evt_big
UNION ALL SELECT 'ts', 'timestamp_ntz', 'date', count(*), count(*) FILTER (WHERE ts <> date_trunc('day', ts)) FROM evt_big""")
def round_trip_probe(d: Data):
    return pr.round_trip_probe(d.evt_big, {"big_id": "int", "ts": "date"})


@query("smallest_fit", using("evt_big") + """
SELECT 'big_id' AS column_name, 'bigint' AS current_type, CASE WHEN max(big_id) <= 32767 THEN 'smallint'
  WHEN max(big_id) <= 2147483647 THEN 'integer' ELSE 'bigint' END AS smallest_type FROM evt_big
UNION ALL SELECT 'user_id', 'bigint', CASE WHEN max(user_id) <= 32767 THEN 'smallint' WHEN max(user_id) <= 2147483647 THEN 'integer' ELSE 'bigint' END FROM evt_big
UNION ALL SELECT 'event_type', 'string', 'varchar(' || max(length(event_type)) || ')' FROM evt_big
UNION ALL SELECT 'price', 'decimal(20,6)', 'numeric(' || max(length(CAST(floor(l_extendedprice) AS BIGINT)::VARCHAR)) + 2 || ',2)' FROM lineitem""")
def smallest_fit(d: Data):
    priced = d.lineitem.select(F.col("l_extendedprice").cast("decimal(20,6)").alias("price"))
    return pr.smallest_fit(d.evt_big, ["big_id", "user_id", "event_type"]).unionByName(pr.smallest_fit(priced, ["price"]))


@query("timestamp_to_date", """
SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS ts, ts <> date_trunc('day', ts) AS ts_lost_time FROM events""")
def timestamp_to_date(d: Data):
    return pr.timestamp_to_date(d.events, "ts").select("event_id", F.col("ts").cast("string").alias("ts"), "ts_lost_time")


@query("decimal_rescale", """
SELECT l_orderkey, l_partkey, l_linenumber, CAST(round(exact, 1)::DECIMAL(12,1) AS VARCHAR) AS price, exact <> round(exact, 1) AS price_changed
FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(20,2)) AS exact FROM lineitem)""")
def decimal_rescale(d: Data):
    lines = d.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(20,2)").alias("price"))
    return pr.decimal_rescale(lines, "price", 12, 1).withColumn("price", F.col("price").cast("string"))


@query("text_to_int", using("ord_text") + """
SELECT CASE WHEN cust_text = 'n/a' THEN 'failed' ELSE 'converted' END AS outcome, count(*) AS rows,
  CAST(coalesce(sum(try_cast(cust_text AS BIGINT)), 0) AS BIGINT) AS total FROM ord_text GROUP BY 1""")
def text_to_int(d: Data):
    good, bad = pr.text_to_int(d.ord_text, "cust_text")
    count, total = F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("cust_text"), F.lit(0)).alias("total")
    return good.groupBy(F.lit("converted").alias("outcome")).agg(count, total).unionByName(
        bad.groupBy(F.lit("failed").alias("outcome")).agg(count, F.lit(0).cast("bigint").alias("total"))
    )


@query("text_to_array", """
SELECT p_partkey, 1::BIGINT AS items, p_name AS first_item FROM part""")
def text_to_array(d: Data):
    arrays = pr.text_to_array(d.part, "p_name")
    return arrays.select("p_partkey", F.size("p_name").cast("bigint").alias("items"), F.col("p_name")[0].alias("first_item"))


@query("array_to_text", "SELECT p_partkey, p_brand || ',' || p_type AS tags FROM part")
def array_to_text(d: Data):
    tagged = d.part.select("p_partkey", F.array("p_brand", F.lit(None).cast("string"), "p_type").alias("tags"))
    return pr.array_to_text(tagged, "tags")


@query("enum_recode", """
SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' END AS status FROM orders""")
def enum_recode(d: Data):
    return pr.enum_recode(d.orders, "o_orderstatus", {"O": "open", "F": "filled"}, "status").select(
        "o_orderkey", "o_orderstatus", "status"
    )
