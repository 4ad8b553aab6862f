"""The audit of the statement log."""

from __future__ import annotations

from pyspark.sql import functions as F

from moraine.operators import audit as au
from moraine.workload.data import Data, log_sql
from moraine.workload.registry import query

_LOCKED = log_sql() + """,
u AS (SELECT *, upper(trim(sql_text)) AS t FROM stmt_log),
lv AS (SELECT *, CASE
  WHEN t = '' THEN 0
  WHEN (t LIKE 'CREATE INDEX%' OR t LIKE 'CREATE UNIQUE INDEX%') AND contains(t, 'CONCURRENTLY') THEN 3
  WHEN t LIKE 'CREATE INDEX%' OR t LIKE 'CREATE UNIQUE INDEX%' THEN 4
  WHEN t LIKE 'ALTER TABLE%' AND contains(t, 'ADD CONSTRAINT') THEN 7
  WHEN t LIKE 'ALTER TABLE%' AND contains(t, 'VALIDATE CONSTRAINT') THEN 3
  WHEN t LIKE 'ALTER TABLE%' THEN 7
  WHEN t LIKE 'DROP TABLE%' OR t LIKE 'DROP INDEX%' OR t LIKE 'TRUNCATE%' THEN 7
  WHEN t LIKE 'CREATE TABLE%' THEN 0
  WHEN t LIKE 'INSERT%' OR t LIKE 'UPDATE%' OR t LIKE 'DELETE%' THEN 2
  WHEN t LIKE 'SELECT%' THEN 0 ELSE 7 END AS lvl FROM u),
l AS (SELECT *, CASE lvl WHEN 0 THEN 'ACCESS SHARE' WHEN 2 THEN 'ROW EXCLUSIVE' WHEN 3 THEN 'SHARE UPDATE EXCLUSIVE' WHEN 4 THEN 'SHARE' ELSE 'ACCESS EXCLUSIVE' END AS lock_mode,
  CASE WHEN lvl <= 2 THEN 0 WHEN lvl = 3 THEN 1 WHEN lvl = 4 THEN 2 ELSE 3 END AS imp,
  CASE WHEN lvl <= 2 THEN 'NONE' WHEN lvl = 3 THEN 'LOW' WHEN lvl = 4 THEN 'MEDIUM' ELSE 'HIGH' END AS impact FROM lv) """


@query("classify_statement_lock", _LOCKED + """
SELECT stmt_no, lock_mode, impact, lvl = 7 AS blocks_reads, lvl >= 4 AS blocks_writes FROM l""")
def classify_statement_lock(d: Data):
    return au.classify_statement_lock(d.stmt_log).select("stmt_no", "lock_mode", "impact", "blocks_reads", "blocks_writes")


_NAMES = """
SELECT stmt_no, sql_text,
  CASE WHEN upper(sql_text) LIKE '%ALTER TABLE %' THEN split_part(sql_text, ' ', 3) ELSE '' END AS table_name,
  CASE WHEN upper(sql_text) LIKE '%ADD CONSTRAINT CHECK %' THEN split_part(sql_text, ' ', 3) || '_check'
       WHEN upper(sql_text) LIKE '%ADD CONSTRAINT %' THEN split_part(sql_text, ' ', 6) ELSE 'constraint_name' END AS constraint_name,
  CASE WHEN upper(sql_text) LIKE '%ALTER COLUMN %' THEN split_part(sql_text, ' ', 6) ELSE '' END AS column_name
FROM stmt_log"""


@query("statement_names", log_sql() + f"SELECT stmt_no, table_name, constraint_name, column_name FROM ({_NAMES})")
def statement_names(d: Data):
    return au.statement_names(d.stmt_log).select("stmt_no", "table_name", "constraint_name", "column_name")


@query("rewrite_statement", log_sql() + f"""
SELECT stmt_no, 'concurrent_index' AS rewrite, replace(sql_text, ' INDEX ', ' INDEX CONCURRENTLY ') AS statements
  FROM stmt_log WHERE (sql_text LIKE 'CREATE INDEX%' OR sql_text LIKE 'CREATE UNIQUE INDEX%')
UNION ALL SELECT stmt_no, 'not_valid_then_validate', CASE WHEN sql_text LIKE '%;' THEN rtrim(sql_text, ';') || ' NOT VALID;' ELSE sql_text || ' NOT VALID' END
    || '|ALTER TABLE ' || table_name || ' VALIDATE CONSTRAINT ' || constraint_name
  FROM ({_NAMES}) WHERE sql_text LIKE '%ADD CONSTRAINT%' AND sql_text NOT LIKE '%NOT VALID%'
UNION ALL SELECT stmt_no, 'type_change', '' FROM stmt_log WHERE upper(sql_text) LIKE 'ALTER TABLE%ALTER COLUMN%TYPE%'""")
def rewrite_statement(d: Data):
    return au.rewrite_statement(d.stmt_log).select("stmt_no", "rewrite", F.array_join("statements", "|").alias("statements"))


@query("should_rewrite", _LOCKED + """
SELECT l.stmt_no, imp >= 2 OR e.value * 20 > 1000 OR lvl >= 4 AS should_rewrite FROM l JOIN events e ON e.event_id = l.stmt_no""")
def should_rewrite(d: Data):
    timed = d.stmt_log.join(d.events.select(F.col("event_id").alias("stmt_no"), (F.col("value") * 20).alias("duration_ms")), "stmt_no")
    return au.should_rewrite(timed).select("stmt_no", "should_rewrite")


@query("step_lock_impact", _LOCKED + """
SELECT env_id, plan_id, step_no, CASE WHEN imp = 0 THEN 'ACCESS SHARE' ELSE lock_mode END AS lock_mode, impact,
  lvl = 7 AS blocks_reads, lvl >= 4 AS blocks_writes, imp >= 2 AS rewritable
FROM (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY env_id, plan_id, step_no ORDER BY imp DESC, stmt_no) = 1)""")
def step_lock_impact(d: Data):
    return au.step_lock_impact(d.stmt_log)


@query("flag_dangerous_statements", log_sql() + """
SELECT stmt_no, code FROM (SELECT stmt_no, CASE
  WHEN sql_text LIKE 'DROP TABLE%' THEN 'dangerous_drop_table' WHEN sql_text LIKE 'TRUNCATE%' THEN 'dangerous_truncate'
  WHEN sql_text LIKE 'DELETE FROM%' AND split_part(sql_text, '--', 1) NOT LIKE '%WHERE%' THEN 'dangerous_delete_all'
  WHEN sql_text LIKE 'ALTER TABLE%DROP COLUMN%' THEN 'dangerous_drop_column' END AS code FROM stmt_log) WHERE code IS NOT NULL""")
def flag_dangerous_statements(d: Data):
    return au.flag_dangerous_statements(d.stmt_log).select("stmt_no", "code")


@query("flag_non_declarative", log_sql() + """
SELECT stmt_no, code FROM (SELECT stmt_no, CASE
  WHEN sql_text LIKE 'CREATE TABLE IF NOT EXISTS%' OR sql_text LIKE 'CREATE INDEX IF NOT EXISTS%' THEN 'non_declarative_if_not_exists'
  WHEN sql_text = 'BEGIN' THEN 'non_declarative_transaction'
  WHEN sql_text LIKE 'CREATE OR REPLACE VIEW%' THEN 'non_declarative_or_replace' END AS code FROM stmt_log) WHERE code IS NOT NULL""")
def flag_non_declarative(d: Data):
    return au.flag_non_declarative(d.stmt_log).select("stmt_no", "code")


@query("audit_rollup", _LOCKED + """
SELECT env_id, count(*) AS statements, count(*) FILTER (WHERE imp = 0) AS impact_none, count(*) FILTER (WHERE imp = 1) AS impact_low,
  count(*) FILTER (WHERE imp = 2) AS impact_medium, count(*) FILTER (WHERE imp = 3) AS impact_high,
  count(*) FILTER (WHERE lvl = 7) AS blocking_reads, count(*) FILTER (WHERE lvl >= 4) AS blocking_writes,
  count(*) FILTER (WHERE lvl = 4 OR (contains(t, 'ADD CONSTRAINT') AND NOT contains(t, 'NOT VALID')) OR t LIKE 'ALTER TABLE%ALTER COLUMN%TYPE%') AS rewritable
FROM l GROUP BY env_id""")
def audit_rollup(d: Data):
    return au.audit_rollup(d.stmt_log)
