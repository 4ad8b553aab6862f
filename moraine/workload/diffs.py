"""Diffs, hashes, drift and safety verdicts over the fleet."""

from __future__ import annotations

from pyspark.sql import functions as F

from moraine.operators import drift as dr
from moraine.operators import safety as sf
from moraine.plans import probing as pb
from moraine.workload.data import Data, fleet
from moraine.workload.registry import query

# The diff of columns, written once for the SQL forms that build on it.
_NORM = """CASE lower(type_raw) WHEN 'int8' THEN 'bigint' WHEN 'pg_catalog.int4' THEN 'integer'
  WHEN 'timestamptz' THEN 'timestamp with time zone' ELSE lower(type_raw) END"""
_COLUMN_DIFF = f"""
c AS (SELECT *, {_NORM} AS t FROM cur_cols), w AS (SELECT *, {_NORM} AS t FROM des_cols),
col_diff AS (
  SELECT * FROM (
    SELECT coalesce(c.env_id, w.env_id) AS env_id, coalesce(c.schema_name, w.schema_name) AS schema_name,
      coalesce(c.table_name, w.table_name) AS table_name, coalesce(c.column_name, w.column_name) AS column_name,
      CASE WHEN c.env_id IS NULL THEN 'added' WHEN w.env_id IS NULL THEN 'removed' ELSE 'modified' END AS status,
      CASE WHEN c.env_id IS NULL OR w.env_id IS NULL THEN '' ELSE concat_ws(',',
        CASE WHEN c.t <> w.t THEN 'type' END, CASE WHEN c.nullable <> w.nullable THEN 'nullable' END,
        CASE WHEN c.default_raw IS DISTINCT FROM w.default_raw THEN 'default' END,
        CASE WHEN c.is_pk <> w.is_pk THEN 'is_primary_key' END) END AS changes,
      c.t AS old_type, w.t AS new_type, w.nullable AS new_nullable, w.default_raw AS new_default, w.ordinal AS new_ordinal,
      w.is_pk AS new_pk
    FROM c FULL JOIN w ON c.env_id = w.env_id AND c.schema_name = w.schema_name AND c.table_name = w.table_name AND c.column_name = w.column_name)
  WHERE (status <> 'modified' OR changes <> '')
    AND (env_id, table_name) IN (SELECT (env_id, table_name) FROM cur_tables)
    AND (env_id, table_name) IN (SELECT (env_id, table_name) FROM des_tables)),
table_diff AS (
  SELECT env_id, schema_name, table_name, 'added' AS status FROM des_tables d
    WHERE (env_id, table_name) NOT IN (SELECT (env_id, table_name) FROM cur_tables)
  UNION ALL SELECT env_id, schema_name, table_name, 'removed' FROM cur_tables
    WHERE (env_id, table_name) NOT IN (SELECT (env_id, table_name) FROM des_tables)
  UNION ALL SELECT c.env_id, c.schema_name, c.table_name, 'modified' FROM cur_tables c JOIN des_tables d USING (env_id, schema_name, table_name)
    WHERE c.rls_enabled <> d.rls_enabled OR (c.env_id, c.table_name) IN (SELECT (env_id, table_name) FROM col_diff)
      OR (c.env_id, c.table_name) IN (SELECT (env_id, table_name) FROM key_diff)) """
# tables of indexes and foreign keys that are not the same on both sides
_KEY_DIFF = """
key_diff AS (
  SELECT env_id, table_name FROM (SELECT env_id, table_name, index_name, ordinal, column_name, is_unique FROM cur_idx
    EXCEPT SELECT env_id, table_name, index_name, ordinal, column_name, is_unique FROM des_idx)
  UNION SELECT env_id, table_name FROM (SELECT env_id, table_name, index_name, ordinal, column_name, is_unique FROM des_idx
    EXCEPT SELECT env_id, table_name, index_name, ordinal, column_name, is_unique FROM cur_idx)
  UNION SELECT env_id, table_name FROM (SELECT env_id, table_name, fk_name, column_name, ref_table, ref_column, on_delete FROM cur_fks
    EXCEPT SELECT env_id, table_name, fk_name, column_name, ref_table, ref_column, on_delete FROM des_fks)
  UNION SELECT env_id, table_name FROM (SELECT env_id, table_name, fk_name, column_name, ref_table, ref_column, on_delete FROM des_fks
    EXCEPT SELECT env_id, table_name, fk_name, column_name, ref_table, ref_column, on_delete FROM cur_fks)), """
_DIFF = fleet("tables", "cols", "idx", "fks") + "," + _KEY_DIFF + _COLUMN_DIFF


@query("diff_tables", _DIFF + "SELECT * FROM table_diff")
def diff_tables(d: Data):
    return dr.diff_tables(d.cur, d.des)


@query("diff_columns", _DIFF + "SELECT env_id, table_name, column_name, status, changes FROM col_diff")
def diff_columns(d: Data):
    return dr.diff_columns(d.cur, d.des).select(
        "env_id", "table_name", "column_name", "status", F.array_join("changes", ",").alias("changes")
    )


@query("diff_indexes", fleet("tables", "idx") + """,
a AS (SELECT env_id, table_name, index_name, string_agg(column_name, ',' ORDER BY ordinal) AS cols, bool_and(is_unique) AS u FROM cur_idx GROUP BY ALL),
b AS (SELECT env_id, table_name, index_name, string_agg(column_name, ',' ORDER BY ordinal) AS cols, bool_and(is_unique) AS u FROM des_idx GROUP BY ALL)
SELECT env_id, table_name, index_name,
  CASE WHEN a.u IS NULL THEN 'added' WHEN b.u IS NULL THEN 'removed' ELSE 'modified' END AS status
FROM a FULL JOIN b USING (env_id, table_name, index_name)
WHERE (a.cols, a.u) IS DISTINCT FROM (b.cols, b.u)
  AND (env_id, table_name) IN (SELECT (env_id, table_name) FROM cur_tables) AND (env_id, table_name) IN (SELECT (env_id, table_name) FROM des_tables)""")
def diff_indexes(d: Data):
    return dr.diff_indexes(d.cur, d.des).select("env_id", "table_name", "index_name", "status")


@query("diff_foreign_keys", fleet("tables", "fks") + """
SELECT env_id, table_name, fk_name,
  CASE WHEN a.ref_table IS NULL THEN 'added' WHEN b.ref_table IS NULL THEN 'removed' ELSE 'modified' END AS status
FROM cur_fks a FULL JOIN des_fks b USING (env_id, table_name, fk_name)
WHERE (a.ref_table, a.ref_column, a.column_name, a.on_delete) IS DISTINCT FROM (b.ref_table, b.ref_column, b.column_name, b.on_delete)
  AND (env_id, table_name) IN (SELECT (env_id, table_name) FROM cur_tables) AND (env_id, table_name) IN (SELECT (env_id, table_name) FROM des_tables)""")
def diff_foreign_keys(d: Data):
    return dr.diff_foreign_keys(d.cur, d.des).select("env_id", "table_name", "fk_name", "status")


@query("diff_rls", fleet("tables") + """
SELECT c.env_id, c.table_name, d.rls_enabled FROM cur_tables c JOIN des_tables d USING (env_id, schema_name, table_name)
WHERE c.rls_enabled <> d.rls_enabled""")
def diff_rls(d: Data):
    return dr.diff_rls(d.cur, d.des).select("env_id", "table_name", "rls_enabled")


@query("rename_candidates", _DIFF + """
SELECT r.env_id, r.table_name, r.column_name AS old_name,
  arg_min(a.column_name, (levenshtein(lower(r.column_name), lower(a.column_name)), a.new_ordinal)) AS new_name,
  min(levenshtein(lower(r.column_name), lower(a.column_name))) AS distance
FROM col_diff r JOIN col_diff a ON r.env_id = a.env_id AND r.table_name = a.table_name AND r.old_type = a.new_type
WHERE r.status = 'removed' AND a.status = 'added' AND levenshtein(lower(r.column_name), lower(a.column_name)) <= 2
GROUP BY r.env_id, r.table_name, r.column_name""")
def rename_candidates(d: Data):
    found = dr.rename_candidates(dr.diff_columns(d.cur, d.des), 2)
    return found.select("env_id", "table_name", "old_name", "new_name", F.col("distance").cast("bigint").alias("distance"))


@query("name_set_ops", fleet("tables") + """
SELECT env_id, table_name, CASE WHEN a AND b THEN 'both' WHEN a THEN 'only_current' ELSE 'only_desired' END AS side FROM (
  SELECT env_id, table_name, bool_or(s = 1) AS a, bool_or(s = 2) AS b FROM (
    SELECT env_id, table_name, 1 AS s FROM cur_tables UNION ALL SELECT env_id, table_name, 2 FROM des_tables) GROUP BY ALL)""")
def name_set_ops(d: Data):
    return dr.name_set_ops(d.cur.tables, d.des.tables, ["env_id", "table_name"])


_HASHES = """,
cj AS (SELECT env_id, table_name, string_agg('{' || CASE WHEN default_raw IS NULL THEN '' ELSE '"default":"' || default_raw || '",' END
    || '"is_primary_key":' || is_pk || ',"name":"' || column_name || '","nullable":' || nullable || ',"type":"' || t || '"}', ',' ORDER BY column_name) AS j
  FROM (SELECT *, """ + _NORM + """ AS t FROM cur_cols) GROUP BY ALL),
xj AS (SELECT env_id, table_name, string_agg('{"columns":[' || cols || '],"name":"' || index_name || '","unique":' || u || '}', ',' ORDER BY index_name) AS j
  FROM (SELECT env_id, table_name, index_name, string_agg('"' || column_name || '"', ',' ORDER BY ordinal) AS cols, bool_and(is_unique) AS u FROM cur_idx GROUP BY ALL) GROUP BY ALL),
fj AS (SELECT env_id, table_name, string_agg('{"columns":["' || column_name || '"],"name":"' || fk_name || '",'
    || CASE WHEN on_delete IS NULL THEN '' ELSE '"on_delete":"' || on_delete || '",' END
    || '"referenced_columns":["' || ref_column || '"],"referenced_table":"' || ref_table || '"}', ',' ORDER BY fk_name) AS j FROM cur_fks GROUP BY ALL),
hashes AS (SELECT env_id, sha256('{"tables":[' || string_agg('{"columns":[' || cj.j || ']'
    || coalesce(',"foreign_keys":[' || fj.j || ']', '') || coalesce(',"indexes":[' || xj.j || ']', '') || ',"name":"' || table_name || '"}', ',' ORDER BY table_name) || ']}') AS schema_hash
  FROM cur_tables LEFT JOIN cj USING (env_id, table_name) LEFT JOIN xj USING (env_id, table_name) LEFT JOIN fj USING (env_id, table_name) GROUP BY env_id) """
_HASH = fleet("tables", "cols", "idx", "fks") + _HASHES


@query("schema_hash", _HASH + "SELECT env_id, schema_hash FROM hashes")
def schema_hash(d: Data):
    return dr.schema_hash(d.cur, d.envs)


@query("drift_by_hash", _HASH + """
SELECT schema_hash, count(*) AS environments, min(env_id) AS first_env,
  schema_hash <> (SELECT max(schema_hash) FROM hashes WHERE env_id = (SELECT min(c_custkey) FROM customer)) AS drifted
FROM hashes GROUP BY schema_hash""")
def drift_by_hash(d: Data):
    hashes = dr.schema_hash(d.cur, d.envs)
    first = d.customer.agg(F.min("c_custkey").alias("k")).first()["k"]
    expected = dr.schema_hash(
        dr.Inventory(*[df.filter(F.col("env_id") == first) for df in (d.cur.tables, d.cur.cols, d.cur.idx, d.cur.fks)])
    ).first()["schema_hash"]
    return dr.drift_by_hash(hashes, expected)


@query("drift_report", _DIFF + """,
t AS (SELECT env_id, count(*) FILTER (WHERE status = 'added') AS ta, count(*) FILTER (WHERE status = 'removed') AS tr, count(*) FILTER (WHERE status = 'modified') AS tm FROM table_diff GROUP BY env_id),
k AS (SELECT env_id, count(*) FILTER (WHERE status = 'added') AS ca, count(*) FILTER (WHERE status = 'removed') AS cr, count(*) FILTER (WHERE status = 'modified') AS cm FROM col_diff GROUP BY env_id)
SELECT c_custkey AS env_id, coalesce(ta, 0) AS added_tables, coalesce(tr, 0) AS removed_tables, coalesce(tm, 0) AS modified_tables,
  coalesce(ca, 0) AS added_columns, coalesce(cr, 0) AS removed_columns, coalesce(cm, 0) AS modified_columns,
  coalesce(ta + tr + tm, 0) + coalesce(ca + cr + cm, 0) = 0 AS in_sync
FROM customer LEFT JOIN t ON t.env_id = c_custkey LEFT JOIN k ON k.env_id = c_custkey""")
def drift_report(d: Data):
    return dr.drift_report(d.cur, d.des)


# ------------------------------------------------------------------ change log

_LOG_SQL = """,
log AS (
  SELECT user_id AS env_id, 'public' AS schema_name, CASE WHEN event_type = 'error' AND user_id > 140 THEN 'ghosts' ELSE 'runs' END AS table_name,
    event_id AS seq,
    CASE event_type WHEN 'signup' THEN 'add_column' WHEN 'purchase' THEN 'drop_column' WHEN 'view' THEN 'alter_type'
      WHEN 'click' THEN 'set_not_null' ELSE 'set_default' END AS action,
    CASE WHEN value > 60 THEN 'vehicle' WHEN value > 30 THEN 'extra' ELSE 'flag' END AS column_name,
    CASE WHEN event_type IN ('signup', 'view') THEN CASE WHEN value > 40 THEN 'text' ELSE 'bigint' END END AS type_raw,
    CASE WHEN event_type = 'signup' THEN true END AS nullable,
    CASE WHEN event_type = 'error' THEN CAST(event_id AS STRING) END AS default_raw,
    CASE WHEN event_type = 'signup' THEN false END AS is_pk FROM events),
ev AS (
  SELECT env_id, schema_name, table_name, CAST(-1 AS BIGINT) AS seq, 'add_column' AS action, column_name, type_raw, nullable, default_raw, is_pk FROM des_cols
  UNION ALL SELECT * FROM log) """


def _log(d: Data):
    return d.events.selectExpr(
        "user_id AS env_id", "'public' AS schema_name",
        "CASE WHEN event_type = 'error' AND user_id > 140 THEN 'ghosts' ELSE 'runs' END AS table_name",
        "event_id AS seq",
        "CASE event_type WHEN 'signup' THEN 'add_column' WHEN 'purchase' THEN 'drop_column' WHEN 'view' THEN 'alter_type' "
        "WHEN 'click' THEN 'set_not_null' ELSE 'set_default' END AS action",
        "CASE WHEN value > 60 THEN 'vehicle' WHEN value > 30 THEN 'extra' ELSE 'flag' END AS column_name",
        "CASE WHEN event_type IN ('signup', 'view') THEN CASE WHEN value > 40 THEN 'text' ELSE 'bigint' END END AS type_raw",
        "CASE WHEN event_type = 'signup' THEN true END AS nullable",
        "CASE WHEN event_type = 'error' THEN CAST(event_id AS STRING) END AS default_raw",
        "CASE WHEN event_type = 'signup' THEN false END AS is_pk",
    )


@query("replay_change_log", fleet("tables", "cols") + _LOG_SQL + """,
live AS (SELECT *, max(seq) FILTER (WHERE action = 'add_column') OVER w AS added, max(seq) FILTER (WHERE action = 'drop_column') OVER w AS dropped
  FROM ev WHERE table_name <> 'ghosts' WINDOW w AS (PARTITION BY env_id, table_name, column_name))
SELECT env_id, table_name, column_name,
  arg_max(type_raw, seq) FILTER (WHERE action IN ('add_column', 'alter_type')) AS type_raw,
  NOT coalesce(bool_or(action = 'set_not_null' AND seq > added), false) AND bool_or(seq = added AND nullable) AS nullable,
  max(CASE WHEN seq = last_default THEN default_raw END) AS default_raw
FROM (SELECT *, max(seq) FILTER (WHERE action IN ('add_column', 'set_default')) OVER (PARTITION BY env_id, table_name, column_name) AS last_default FROM live)
WHERE added > coalesce(dropped, -2) GROUP BY env_id, table_name, column_name""")
def replay_change_log(d: Data):
    final, _ = dr.replay_change_log(d.des.cols, d.des.tables, _log(d), block=1000)
    return final.select("env_id", "table_name", "column_name", "type_raw", "nullable", "default_raw")


@query("replay_change_log_errors", fleet("tables", "cols") + _LOG_SQL + """
SELECT env_id, table_name, column_name, seq, action, 'unknown_table' AS error FROM log WHERE table_name = 'ghosts'
UNION ALL SELECT env_id, table_name, column_name, seq, action, 'unknown_column' FROM (
  SELECT *, last_value(CASE action WHEN 'add_column' THEN 1 WHEN 'drop_column' THEN 0 END IGNORE NULLS)
    OVER (PARTITION BY env_id, table_name, column_name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS live
  FROM ev WHERE table_name <> 'ghosts') WHERE action <> 'add_column' AND coalesce(live, 0) = 0""")
def replay_change_log_errors(d: Data):
    _, errors = dr.replay_change_log(d.des.cols, d.des.tables, _log(d), block=1000)
    return errors.select("env_id", "table_name", "column_name", "seq", "action", "error")


# named constraints: two names shared by indexes and keys, drops of any of them, a primary key, and what is no action
_ACTIONS = ("add_unique", "add_foreign_key", "drop_constraint", "drop_constraint", "add_primary_key", "vacuum", "add_index")
_NAMED_COLUMNS = {
    "env_id": "user_id", "schema_name": "'public'", "table_name": "'runs'", "seq": "event_id",
    "action": "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(_ACTIONS)) + " END",
    "column_name": "'run_id'", "type_raw": "CAST(NULL AS STRING)", "nullable": "CAST(NULL AS BOOLEAN)",
    "default_raw": "CAST(NULL AS STRING)", "is_pk": "CAST(NULL AS BOOLEAN)",
    "constraint_name": "CASE WHEN value > 40 THEN 'runs_route_left' WHEN value > 20 THEN 'runs_route_id_fkey' ELSE 'other' END",
    "ref_table": "event_type",
}
_NAMED_SQL = fleet("tables", "cols", "idx", "fks") + ", log AS (SELECT " + ", ".join(
    f"{e} AS {c}" for c, e in _NAMED_COLUMNS.items()) + """ FROM events),
ev AS (
  SELECT env_id, seq, action, constraint_name AS name, ref_table FROM log WHERE action <> 'vacuum'
  UNION ALL SELECT DISTINCT env_id, -1, 'add_index', index_name, NULL FROM des_idx WHERE table_name = 'runs'
  UNION ALL SELECT DISTINCT env_id, -1, 'add_foreign_key', fk_name, ref_table FROM des_fks WHERE table_name = 'runs'),
s1 AS (SELECT *, CASE WHEN action IN ('add_unique', 'add_index') THEN 1 WHEN action = 'drop_constraint' THEN -1 ELSE 0 END AS x FROM ev),
r1 AS (SELECT *, sum(x) OVER (PARTITION BY env_id, name ORDER BY seq) AS sx FROM s1),
t1 AS (SELECT *, action = 'drop_constraint' AND sx >= least(0, min(sx) OVER (PARTITION BY env_id, name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS hit_x FROM r1),
s2 AS (SELECT *, CASE WHEN action = 'add_foreign_key' THEN 1 WHEN action = 'drop_constraint' AND NOT coalesce(hit_x, false) THEN -1 ELSE 0 END AS f FROM t1),
r2 AS (SELECT *, sum(f) OVER (PARTITION BY env_id, name ORDER BY seq) AS sf FROM s2),
t2 AS (SELECT *, f = -1 AND sf >= least(0, min(sf) OVER (PARTITION BY env_id, name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS hit_f FROM r2),
pk AS (SELECT *, f = -1 AND NOT coalesce(hit_f, false) AS clear FROM t2),
pk_state AS (SELECT *, last_value(CASE WHEN action = 'add_primary_key' THEN 1 WHEN clear THEN 0 END IGNORE NULLS)
  OVER (PARTITION BY env_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS has_pk FROM pk)
"""


def _named_log(d: Data):
    return d.events.select(*[F.expr(e).alias(c) for c, e in _NAMED_COLUMNS.items()],
                           F.array(F.lit("route_id")).alias("key_columns"), F.array(F.lit("id")).alias("ref_columns"))


@query("replay_constraints", _NAMED_SQL + """,
adds AS (SELECT *, CASE WHEN action = 'add_foreign_key' THEN 'foreign_key' ELSE 'index' END AS kind FROM t2 WHERE action IN ('add_unique', 'add_index', 'add_foreign_key')),
numbered AS (SELECT *, row_number() OVER (PARTITION BY env_id, name, kind ORDER BY seq) AS i FROM adds),
taken AS (SELECT env_id, name, CASE WHEN hit_x THEN 'index' ELSE 'foreign_key' END AS kind, count(*) AS n FROM t2 WHERE hit_x OR hit_f GROUP BY ALL)
SELECT a.env_id, a.kind, a.name, CASE WHEN a.kind = 'index' THEN a.action = 'add_unique' END AS is_unique,
  CASE WHEN a.kind = 'foreign_key' THEN a.ref_table END AS ref_table
FROM numbered a LEFT JOIN taken t USING (env_id, name, kind) WHERE a.i > coalesce(t.n, 0) AND env_id IN (SELECT c_custkey FROM customer)
UNION ALL SELECT env_id, 'primary_key', 'run_id', NULL, NULL FROM (
  SELECT c_custkey AS env_id, coalesce(arg_max(CASE WHEN action = 'add_primary_key' THEN 1 WHEN clear THEN 0 END, seq)
    FILTER (WHERE action = 'add_primary_key' OR clear), 1) AS has FROM customer LEFT JOIN pk ON env_id = c_custkey GROUP BY c_custkey) WHERE has = 1""")
def replay_constraints(d: Data):
    """Indexes, foreign keys and the primary key of ``runs`` after the log."""
    runs = [df.filter("table_name = 'runs'") for df in (d.des.tables, d.des.cols, d.des.idx, d.des.fks)]
    log = _named_log(d).join(d.envs.hint("merge"), "env_id", "left_semi")
    final, _ = dr.replay_change_log(runs[1], runs[0], log, 1000, runs[2], runs[3])
    indexes, keys = dr.replay_keys(runs[2], runs[3], runs[0], log, 1000)
    none = F.lit(None)
    return indexes.select("env_id", F.lit("index").alias("kind"), F.col("index_name").alias("name"), "is_unique", none.cast("string").alias("ref_table")) \
        .unionByName(keys.select("env_id", F.lit("foreign_key").alias("kind"), F.col("fk_name").alias("name"), none.cast("boolean").alias("is_unique"), "ref_table")) \
        .unionByName(final.filter("is_pk").select("env_id", F.lit("primary_key").alias("kind"), F.col("column_name").alias("name"),
                                                  none.cast("boolean").alias("is_unique"), none.cast("string").alias("ref_table")))


@query("replay_constraint_errors", _NAMED_SQL + """
SELECT env_id, seq, 'unknown_constraint' AS error FROM pk_state WHERE clear AND coalesce(has_pk, 1) = 0 AND env_id IN (SELECT c_custkey FROM customer)
UNION ALL SELECT env_id, seq, 'unsupported_action' FROM log WHERE action = 'vacuum' AND env_id IN (SELECT c_custkey FROM customer)
UNION ALL SELECT env_id, seq, 'unknown_table' FROM log WHERE env_id NOT IN (SELECT c_custkey FROM customer)""")
def replay_constraint_errors(d: Data):
    _, errors = dr.replay_change_log(d.des.cols, d.des.tables, _named_log(d), 1000, d.des.idx, d.des.fks)
    return errors.select("env_id", "seq", "error")


# --------------------------------------------------------------------- verdicts

_SAFE_PAIRS = ("(('integer', 'bigint'), ('bigint', 'numeric'), ('varchar', 'text'), "
               "('timestamp without time zone', 'timestamp with time zone'), ('date', 'timestamp without time zone'), "
               "('real', 'double precision'), ('smallint', 'integer'))")
_JUDGED = _DIFF + f""",
fb AS (SELECT *, split_part(old_type, '(', 1) = split_part(new_type, '(', 1) OR (split_part(old_type, '(', 1), split_part(new_type, '(', 1)) IN {_SAFE_PAIRS} AS fwd,
  split_part(old_type, '(', 1) = split_part(new_type, '(', 1) OR (split_part(new_type, '(', 1), split_part(old_type, '(', 1)) IN {_SAFE_PAIRS} AS bwd,
  status = 'added' AND NOT new_nullable AND coalesce(new_default, '') = '' AS bare FROM col_diff),
col_verdict AS (
  SELECT env_id, table_name, 'add_column' AS operation, column_name AS subject, NOT bare AS valid, true AS reversible,
    CASE WHEN bare THEN 'Dangerous' ELSE 'Safe' END AS level, bare AS breaking_change, false AS data_loss, NOT bare AS rollback_data_loss,
    bare AS requires_multi_phase, false AS lock_contention FROM fb WHERE status = 'added'
  UNION ALL SELECT env_id, table_name, 'drop_column', column_name, true, false, 'Dangerous', true, true, false, true, true FROM fb WHERE status = 'removed'
  UNION ALL SELECT env_id, table_name, 'alter_type', column_name, fwd, bwd, CASE WHEN NOT fwd THEN 'Dangerous' WHEN NOT bwd THEN 'Lossy' ELSE 'Safe' END,
    true, NOT fwd, NOT bwd, NOT fwd, true FROM fb WHERE status = 'modified' AND contains(changes, 'type')),
verdict AS (
  SELECT * FROM col_verdict
  UNION ALL SELECT env_id, table_name, 'drop_table', table_name, true, false, 'Dangerous', true, true, false, true, true FROM table_diff WHERE status = 'removed'
  UNION ALL SELECT c.env_id, c.table_name, CASE WHEN d.rls_enabled THEN 'enable_rls' ELSE 'disable_rls' END, c.table_name, true, true, 'Safe', false, false, false, false, false
    FROM cur_tables c JOIN des_tables d USING (env_id, schema_name, table_name) WHERE c.rls_enabled <> d.rls_enabled) """
_FLAGS = ["env_id", "table_name", "operation", "subject", "valid", "reversible", "level", "breaking_change", "data_loss",
          "rollback_data_loss", "requires_multi_phase", "lock_contention"]


@query("classify_add_column", _JUDGED + "SELECT * FROM verdict WHERE operation = 'add_column'")
def classify_add_column(d: Data):
    return sf.classify_add_column(dr.diff_columns(d.cur, d.des)).select(_FLAGS)


@query("classify_drop_column", _JUDGED + "SELECT * FROM verdict WHERE operation = 'drop_column'")
def classify_drop_column(d: Data):
    return sf.classify_drop_column(dr.diff_columns(d.cur, d.des)).select(_FLAGS)


@query("classify_alter_type", _JUDGED + "SELECT * FROM verdict WHERE operation = 'alter_type'")
def classify_alter_type(d: Data):
    return sf.classify_alter_type(dr.diff_columns(d.cur, d.des)).select(_FLAGS)


@query("classify_drop_table", _JUDGED + "SELECT * FROM verdict WHERE operation = 'drop_table'")
def classify_drop_table(d: Data):
    return sf.classify_drop_table(dr.diff_tables(d.cur, d.des)).select(_FLAGS)


@query("classify_rls", _JUDGED + "SELECT * FROM verdict WHERE operation LIKE '%_rls'")
def classify_rls(d: Data):
    return sf.classify_rls(dr.diff_rls(d.cur, d.des)).select(_FLAGS)


@query("classify_diff", _JUDGED + """
SELECT env_id, table_name, operation, subject, valid, reversible, coalesce(level, '') AS level FROM verdict
UNION ALL SELECT env_id, table_name, 'add_foreign_key', fk_name, true, true, '' FROM des_fks f
WHERE (env_id, table_name, fk_name) NOT IN (SELECT (env_id, table_name, fk_name) FROM cur_fks)""")
def classify_diff(d: Data):
    return sf.classify_diff(d.cur, d.des).select(
        "env_id", "table_name", "operation", "subject", "valid", "reversible", F.coalesce("level", F.lit("")).alias("level")
    )


@query("safety_rollup", _JUDGED + """
SELECT c_custkey AS env_id, count(v.env_id) AS operations, count(*) FILTER (WHERE level = 'Safe') AS safe, 0::BIGINT AS review,
  count(*) FILTER (WHERE level = 'Lossy') AS lossy, count(*) FILTER (WHERE level = 'Dangerous') AS dangerous, 0::BIGINT AS multi_phase,
  coalesce(bool_and(valid), true) AS all_valid, coalesce(bool_and(reversible), true) AS all_reversible,
  coalesce(bool_or(level = 'Dangerous'), false) AS has_dangerous,
  coalesce(string_agg(operation || ' ' || table_name || '.' || subject, ';' ORDER BY operation || ' ' || table_name || '.' || subject)
    FILTER (WHERE level = 'Dangerous'), '') AS dangerous_operations
FROM customer LEFT JOIN (SELECT env_id, level, valid, reversible, operation, table_name, subject FROM verdict
  UNION ALL SELECT env_id, NULL, true, true, 'add_foreign_key', table_name, fk_name FROM des_fks
  WHERE (env_id, table_name, fk_name) NOT IN (SELECT (env_id, table_name, fk_name) FROM cur_fks)) v ON v.env_id = c_custkey GROUP BY c_custkey""")
def safety_rollup(d: Data):
    rolled = sf.safety_rollup(sf.classify_diff(d.cur, d.des), d.envs)
    return rolled.withColumn("dangerous_operations", F.array_join("dangerous_operations", ";"))


_FULL = _JUDGED + """,
ia AS (SELECT env_id, table_name, index_name, string_agg(column_name, ',' ORDER BY ordinal) AS k, bool_and(is_unique) AS u FROM cur_idx GROUP BY ALL),
ib AS (SELECT env_id, table_name, index_name, string_agg(column_name, ',' ORDER BY ordinal) AS k, bool_and(is_unique) AS u FROM des_idx GROUP BY ALL),
both_tables AS (SELECT env_id, table_name FROM cur_tables INTERSECT SELECT env_id, table_name FROM des_tables),
ij AS (SELECT env_id, table_name, index_name, ia.k AS ka, ib.k AS kb, ia.u AS ua, ib.u AS ub FROM ia FULL JOIN ib USING (env_id, table_name, index_name)
  WHERE (ia.k, ia.u) IS DISTINCT FROM (ib.k, ib.u) AND (env_id, table_name) IN (SELECT (env_id, table_name) FROM both_tables)),
fj AS (SELECT env_id, table_name, fk_name, a.ref_table AS ra, b.ref_table AS rb FROM cur_fks a FULL JOIN des_fks b USING (env_id, table_name, fk_name)
  WHERE (a.ref_table, a.ref_column, a.column_name, a.on_delete) IS DISTINCT FROM (b.ref_table, b.ref_column, b.column_name, b.on_delete)
  AND (env_id, table_name) IN (SELECT (env_id, table_name) FROM both_tables)),
full_verdict AS (SELECT env_id, table_name, operation, subject, level, CASE WHEN reversible THEN 'yes' ELSE 'no' END AS reversible, requires_multi_phase FROM verdict
UNION ALL SELECT env_id, table_name, CASE WHEN new_nullable THEN 'drop_not_null' ELSE 'set_not_null' END, column_name,
  CASE WHEN new_nullable THEN 'Requires Review' ELSE 'Lossy' END, 'yes', NOT new_nullable FROM col_diff WHERE contains(changes, 'nullable')
UNION ALL SELECT env_id, table_name, CASE WHEN new_default IS NULL THEN 'drop_default' ELSE 'set_default' END, column_name, 'Requires Review', 'yes', false
  FROM col_diff WHERE contains(changes, 'default')
UNION ALL SELECT env_id, table_name, CASE WHEN new_pk THEN 'add_primary_key' ELSE 'drop_primary_key' END, column_name,
  CASE WHEN new_pk THEN 'Multi-Phase Required' ELSE 'Dangerous' END, CASE WHEN new_pk THEN 'depends' ELSE 'no' END, true FROM col_diff WHERE contains(changes, 'is_primary_key')
UNION ALL SELECT env_id, table_name, 'create_table', table_name, 'Safe', 'yes', false FROM table_diff WHERE status = 'added'
UNION ALL SELECT env_id, table_name, CASE WHEN ua THEN 'drop_unique' ELSE 'drop_index' END, index_name, 'Requires Review', 'yes', false FROM ij WHERE ka IS NOT NULL
UNION ALL SELECT env_id, table_name, CASE WHEN ub THEN 'add_unique' ELSE 'create_index' END, index_name, CASE WHEN ub THEN 'Lossy' ELSE 'Requires Review' END,
  CASE WHEN ub THEN 'depends' ELSE 'yes' END, ub FROM ij WHERE kb IS NOT NULL
UNION ALL SELECT env_id, table_name, 'drop_foreign_key', fk_name, 'Requires Review', 'yes', false FROM fj WHERE ra IS NOT NULL
UNION ALL SELECT env_id, table_name, 'add_foreign_key', fk_name, 'Requires Review', 'yes', false FROM fj WHERE rb IS NOT NULL
UNION ALL SELECT env_id, table_name, 'rename_column', old_name || ' -> ' || new_name, 'Multi-Phase Required', 'yes', true FROM (
  SELECT r.env_id, r.table_name, r.column_name AS old_name, a.column_name AS new_name,
    row_number() OVER (PARTITION BY r.env_id, r.table_name, r.column_name ORDER BY levenshtein(lower(r.column_name), lower(a.column_name)), a.new_ordinal) AS i,
    row_number() OVER (PARTITION BY r.env_id, r.table_name, a.column_name ORDER BY levenshtein(lower(r.column_name), lower(a.column_name)), r.column_name) AS j
  FROM col_diff r JOIN col_diff a ON r.env_id = a.env_id AND r.table_name = a.table_name AND r.old_type = a.new_type
  WHERE r.status = 'removed' AND a.status = 'added' AND levenshtein(lower(r.column_name), lower(a.column_name)) <= 2) WHERE i = 1 AND j = 1) """


@query("classify_diff_full", _FULL + "SELECT * FROM full_verdict")
def classify_diff_full(d: Data):
    return sf.classify_diff_full(d.cur, d.des).select(
        "env_id", "table_name", "operation", "subject", "level", "reversible", "requires_multi_phase"
    )


_WAYS = "CASE " + " ".join(f"WHEN operation = '{op}' AND level = '{level}' THEN '{'; '.join(ways)}'"
                           for (op, level), ways in sf.ALTERNATIVES.items()) + " ELSE '' END"


@query("safer_alternatives", _FULL + f"SELECT env_id, table_name, operation, subject, {_WAYS} AS alternatives FROM full_verdict")
def safer_alternatives(d: Data):
    return sf.safer_alternatives(sf.classify_diff_full(d.cur, d.des)).select(
        "env_id", "table_name", "operation", "subject", F.array_join("alternatives", "; ").alias("alternatives"))


# data of the tables the diff changes, by environment; both forms read the same definitions
_PROBED = {
    "routes": ("orders", {
        "env_id": "o_custkey", "route_id": "o_orderkey",
        "code": "CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END",
        "fare_zone": "CAST(floor(o_totalprice / 10) AS INTEGER)", "opened_at": "o_orderdate",
        "operator": "CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END"}),
    "runs": ("events", {
        "env_id": "user_id", "vehicle": "CASE WHEN event_type <> 'error' THEN event_type END", "left_at": "ts",
        "remarks": "CASE WHEN event_type = 'view' THEN props END"}),
    "calls": ("events", {
        "env_id": "user_id", "run_id": "CAST(event_id % 500 AS INTEGER)",
        "stop_id": "CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS INTEGER) END"}),
    "incidents": ("events", {"env_id": "user_id", "details": "props"}),
}
_PROBED_SQL = ", ".join(
    f"p_{t} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in cols.items())} FROM {base})" for t, (base, cols) in _PROBED.items())


@query("classify_with_data", _FULL + ", " + _PROBED_SQL + """,
measured AS (
  SELECT env_id, 'routes' AS table_name, 'alter_type' AS operation, 'route_id' AS subject, count(*) FILTER (WHERE route_id > 2147483647) AS failed,
    count(*) FILTER (WHERE route_id > 2147483647) AS changed, NULL AS null_rows, NULL AS duplicates, NULL AS lost FROM p_routes GROUP BY env_id
  UNION ALL SELECT env_id, 'routes', 'alter_type', 'fare_zone', count(*) FILTER (WHERE fare_zone > 32767), count(*) FILTER (WHERE fare_zone > 32767), NULL, NULL, NULL FROM p_routes GROUP BY env_id
  UNION ALL SELECT env_id, 'routes', 'alter_type', 'opened_at', 0, 0, NULL, NULL, NULL FROM p_routes GROUP BY env_id
  UNION ALL SELECT env_id, 'routes', 'set_not_null', 'code', NULL, NULL, count(*) FILTER (WHERE code IS NULL), NULL, NULL FROM p_routes GROUP BY env_id
  UNION ALL SELECT env_id, 'routes', 'add_unique', 'routes_code_key', NULL, NULL, NULL, count(code) - count(DISTINCT code), NULL FROM p_routes GROUP BY env_id
  UNION ALL SELECT env_id, 'routes', 'drop_column', 'operator', NULL, NULL, NULL, NULL, count(operator) FROM p_routes GROUP BY env_id
  UNION ALL SELECT env_id, 'runs', 'alter_type', 'vehicle', 0, 0, NULL, NULL, NULL FROM p_runs GROUP BY env_id
  UNION ALL SELECT env_id, 'runs', 'alter_type', 'left_at', 0, 0, NULL, NULL, NULL FROM p_runs GROUP BY env_id
  UNION ALL SELECT env_id, 'runs', 'drop_column', 'remarks', NULL, NULL, NULL, NULL, count(remarks) FROM p_runs GROUP BY env_id
  UNION ALL SELECT env_id, 'incidents', 'drop_table', 'incidents', NULL, NULL, NULL, NULL, count(*) FROM p_incidents GROUP BY env_id
  UNION ALL SELECT env_id, 'calls', 'add_primary_key', unnest(['run_id', 'stop_id']), NULL, NULL, count(*) FILTER (WHERE stop_id IS NULL),
    count(*) FILTER (WHERE stop_id IS NOT NULL) - count(DISTINCT (run_id, stop_id)) FILTER (WHERE stop_id IS NOT NULL), NULL FROM p_calls GROUP BY env_id),
judged AS (
  SELECT v.env_id, table_name, operation, subject, level, lost AS impact,
    CASE WHEN operation = 'alter_type' AND failed IS NOT NULL THEN CASE WHEN failed > 0 THEN 'Dangerous' WHEN changed > 0 THEN 'Lossy' ELSE 'Safe' END
      WHEN operation IN ('set_not_null', 'add_unique', 'add_primary_key') AND m.env_id IS NOT NULL
        THEN CASE WHEN coalesce(null_rows, 0) + coalesce(duplicates, 0) > 0 THEN 'Dangerous' ELSE 'Safe' END ELSE level END AS data_level
  FROM full_verdict v LEFT JOIN measured m USING (env_id, table_name, operation, subject))
SELECT env_id, table_name, operation, subject, level, data_level, impact,
  CASE sign(list_position(['Safe', 'Requires Review', 'Lossy', 'Multi-Phase Required', 'Dangerous'], data_level)
    - list_position(['Safe', 'Requires Review', 'Lossy', 'Multi-Phase Required', 'Dangerous'], level))
    WHEN 1 THEN 'upgraded' WHEN -1 THEN 'downgraded' ELSE 'unchanged' END AS shift
FROM judged""")
def classify_with_data(d: Data):
    data = {t: getattr(d, base).select(*[F.expr(e).alias(c) for c, e in cols.items()]) for t, (base, cols) in _PROBED.items()}
    probes = pb.measured_probes(pb.wanted_probes(d.cur, d.des), data)
    return sf.classify_with_data(sf.classify_diff_full(d.cur, d.des), probes).select(
        "env_id", "table_name", "operation", "subject", "level", "data_level", "impact", "shift"
    )
