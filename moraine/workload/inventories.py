"""Sources, catalogs and lint of the fleet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from moraine.operators import drift as dr
from moraine.operators import inventory as iv
from moraine.operators import lint as ln
from moraine.session import scratch_dir
from moraine.sources import schema_docs as sd
from moraine.workload.data import SCHEMAS, Data, fleet
from moraine.workload.registry import query

_TABLE_COUNTS = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, '{c.split()[0]}' AS column_name, count(*) AS rows, count(DISTINCT {c.split()[0]}) AS distinct_values FROM {n}"
    for n, s in SCHEMAS.items() for c in s.split(", "))


@query("read_table_set", _TABLE_COUNTS)
def read_table_set(d: Data):
    """Rows and distinct values of every column of every table, so that each value is read.

    A value travels as its hash: 64 bits take a number or a time one to one, a
    text or an array has 128.
    """
    parts = []
    for name, df in d.table_set().items():
        values = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("at"), *_hashes(c, kind)) for i, (c, kind) in enumerate(df.dtypes)])))
        counted = values.groupBy("at").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("a", "b").alias("distinct_values"))
        # one row per column of the table, which may be empty
        by_column = counted.agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct("rows", "distinct_values")))).alias("m"))
        parts.append(by_column.select(F.lit(name).alias("table_name"), F.inline(F.array(*[F.struct(
            F.lit(c).alias("column_name"),
            *[F.coalesce(F.col("m")[i][n], F.lit(0)).alias(n) for n in ("rows", "distinct_values")],
        ) for i, c in enumerate(df.columns)]))))
    return reduce(DataFrame.unionByName, parts)


def _hashes(column: str, kind: str) -> list[Column]:
    """``a`` and ``b`` of a value, ``a`` null where it is null."""
    value = F.to_json(F.struct(column)) if kind.startswith("array") else F.col(column)
    wide = kind == "string" or kind.startswith("array")
    return [F.when(F.col(column).isNotNull(), F.xxhash64(value)).alias("a"),
            (F.xxhash64(F.lit("b"), value) if wide else F.lit(0).cast("bigint")).alias("b")]


@query("inventory_tables", fleet("tables") + """
SELECT env_id, schema_name, table_name, rls_enabled FROM cur_tables""")
def inventory_tables(d: Data):
    raw = d.cur.tables.withColumn("table_type", F.lit("BASE TABLE"))
    views = d.tenants.select(
        "env_id", F.lit("public").alias("schema_name"), F.lit("late_runs").alias("table_name"),
        F.lit(False).alias("rls_enabled"), F.lit("VIEW").alias("table_type"),
    )
    system = views.withColumns({"schema_name": F.lit("pg_catalog"), "table_type": F.lit("BASE TABLE")})
    return iv.inventory_tables(raw.unionByName(views).unionByName(system), ["public"])


@query("inventory_columns", fleet("cols") + """
SELECT env_id, table_name, ordinal, column_name, type_raw, nullable, default_raw, is_pk FROM cur_cols""")
def inventory_columns(d: Data):
    cols = d.cur.cols
    raw = cols.select(
        *iv.TABLE_KEY, "ordinal", "column_name", F.col("type_raw").alias("data_type"),
        F.when(F.col("nullable"), "YES").otherwise("NO").alias("is_nullable"), F.col("default_raw").alias("column_default"),
    )
    return iv.inventory_columns(raw, cols.filter("is_pk")).drop("schema_name")


@query("inventory_order", fleet("cols") + """
SELECT env_id, table_name, ordinal, column_name FROM cur_cols ORDER BY env_id, schema_name, table_name, ordinal""")
def inventory_order(d: Data):
    return iv.inventory_order(d.cur.cols).select("env_id", "table_name", "ordinal", "column_name")


@query("inventory_indexes", fleet("idx") + """
SELECT env_id, table_name, index_name, ordinal, column_name, is_unique FROM cur_idx WHERE index_name <> 'stops_label_key'""")
def inventory_indexes(d: Data):
    # catalogs also list the indexes behind primary keys and unique constraints
    primary = d.cur.cols.filter("is_pk").select(
        *iv.TABLE_KEY, F.concat("table_name", F.lit("_pkey")).alias("index_name"), "ordinal", "column_name",
        F.lit(True).alias("is_unique"),
    )
    constraints = primary.select("env_id", "schema_name", F.col("index_name").alias("constraint_name"),
                                 F.lit("PRIMARY KEY").alias("constraint_type")).distinct().unionByName(
        d.cur.idx.filter("index_name = 'stops_label_key'").select(
            "env_id", "schema_name", F.col("index_name").alias("constraint_name"), F.lit("UNIQUE").alias("constraint_type"))
    )
    return iv.inventory_indexes(d.cur.idx.unionByName(primary), constraints).drop("schema_name")


@query("inventory_foreign_keys", fleet("fks") + """
SELECT env_id, table_name, fk_name, column_name AS columns, ref_table, ref_column AS ref_columns, coalesce(on_delete, '') AS on_delete, coalesce(on_update, '') AS on_update FROM cur_fks
UNION ALL SELECT c_custkey, 'runs', 'runs_pair_fkey', 'route_id,vehicle', 'routes', 'route_id,code', '', 'RESTRICT' FROM customer""")
def inventory_foreign_keys(d: Data):
    key = ["env_id", "schema_name", "constraint_name"]
    single = d.cur.fks.select(
        "env_id", "schema_name", F.col("fk_name").alias("constraint_name"), "table_name", "ordinal", "column_name", "ref_table",
        "ref_column", F.coalesce("on_delete", F.lit("NO ACTION")).alias("delete_rule"), F.lit("NO ACTION").alias("update_rule"),
    )
    pair = d.tenants.select(
        "env_id", F.lit("public").alias("schema_name"), F.lit("runs_pair_fkey").alias("constraint_name"),
        F.lit("runs").alias("table_name"),
        F.inline(F.array(*[
            F.struct(F.lit(i).alias("ordinal"), F.lit(a).alias("column_name"), F.lit("routes").alias("ref_table"), F.lit(b).alias("ref_column"))
            for i, a, b in ((2, "vehicle", "code"), (1, "route_id", "route_id"))
        ])),
    ).withColumns({"delete_rule": F.lit("NO ACTION"), "update_rule": F.lit("RESTRICT")})
    everything = single.unionByName(pair)
    primary = d.cur.cols.filter("is_pk").select(
        "env_id", "schema_name", F.concat("table_name", F.lit("_pkey")).alias("constraint_name"), "table_name",
        F.lit("PRIMARY KEY").alias("constraint_type"),
    ).distinct()
    constraints = everything.select(*key, "table_name").distinct().withColumn("constraint_type", F.lit("FOREIGN KEY")).unionByName(primary)
    found = iv.inventory_foreign_keys(
        constraints, everything.select(*key, "ordinal", "column_name"),
        everything.select(*key, "ordinal", "ref_table", "ref_column"),
        everything.select(*key, "delete_rule", "update_rule").distinct(),
    )
    return iv.group_foreign_keys(found).select(
        "env_id", "table_name", "fk_name", F.array_join("column_names", ",").alias("columns"), "ref_table",
        F.array_join("ref_columns", ",").alias("ref_columns"), F.coalesce("on_delete", F.lit("")).alias("on_delete"),
        F.coalesce("on_update", F.lit("")).alias("on_update"),
    )


@query("inventory_policies", """
SELECT c_custkey AS env_id, 'runs' AS table_name, p AS policy_name, command,
  CASE WHEN p = 'everyone' THEN '' WHEN c_mktsegment = 'BUILDING' THEN 'auditor,clerk' ELSE 'clerk' END AS roles, p <> 'limit_own' AS permissive,
  coalesce(u, '') AS using_expr
FROM customer, (VALUES ('read_own', 'SELECT', 'route_id = 1'), ('everyone', 'ALL', 'true'), ('limit_own', 'UPDATE', NULL)) AS t(p, command, u)""")
def inventory_policies(d: Data):
    env = F.col("env_id")
    building = F.col("c_mktsegment") == "BUILDING"
    roles = F.when(building, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    entries = [
        F.struct(F.lit(n).alias("policy_name"), F.lit(c).alias("command_code"), F.lit(p).alias("permissive"),
                 (F.array().cast("array<int>") if n == "everyone" else roles).alias("role_ids"),
                 F.lit(u).cast("string").alias("using_expr"), F.lit(None).cast("string").alias("check_expr"))
        for n, c, p, u in (("read_own", "r", True, "route_id = 1"), ("everyone", "*", True, "true"), ("limit_own", "w", False, None))
    ]
    policies = d.tenants.select(env, F.lit("public").alias("schema_name"), F.lit("runs").alias("table_name"), F.inline(F.array(*entries)))
    role_names = d.tenants.select(env, F.inline(F.array(
        F.struct(F.lit(1).alias("role_id"), F.lit("clerk").alias("role_name")),
        F.struct(F.lit(2).alias("role_id"), F.lit("auditor").alias("role_name")),
    )))
    return iv.inventory_policies(policies, role_names).select(
        "env_id", "table_name", "policy_name", "command", F.array_join("roles", ",").alias("roles"), "permissive",
        F.coalesce("using_expr", F.lit("")).alias("using_expr"),
    )


@query("inventory_rls", fleet("tables") + """
SELECT d.env_id, d.table_name, coalesce(c.rls_enabled, false) AS rls_enabled, c.env_id IS NOT NULL AS found
FROM des_tables d LEFT JOIN cur_tables c USING (env_id, schema_name, table_name)""")
def inventory_rls(d: Data):
    return iv.inventory_rls(d.des.tables, d.cur.tables).drop("schema_name")


@query("serial_columns", fleet("cols") + """
SELECT env_id, table_name, column_name,
  CASE WHEN s THEN 'serial' ELSE type_raw END AS type_raw, CASE WHEN s THEN '' ELSE coalesce(default_raw, '') END AS default_raw, s AS is_serial
FROM (SELECT *, (table_name, column_name) IN (('routes', 'route_id'), ('runs', 'run_id'), ('stops', 'stop_id')) AND type_raw = 'integer'
        AND NOT (table_name = 'runs' AND env_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 15)) AS s FROM cur_cols)""")
def serial_columns(d: Data):
    # the owned sequences; tenants of nation 15 have lost the one of runs
    owners = d.tenants.select(
        "env_id", "c_nationkey", F.lit("public").alias("schema_name"),
        F.inline(F.array(*[F.struct(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"))
                           for t, c in (("routes", "route_id"), ("runs", "run_id"), ("stops", "stop_id"))])),
    ).filter("NOT (table_name = 'runs' AND c_nationkey = 15)").select(
        *iv.TABLE_KEY, "column_name", F.concat_ws("_", "table_name", "column_name", F.lit("seq")).alias("sequence_name")
    )
    return iv.serial_columns(d.cur.cols, owners).select(
        "env_id", "table_name", "column_name", "type_raw", F.coalesce("default_raw", F.lit("")).alias("default_raw"), "is_serial"
    )


@query("write_inventory", fleet("tables", "cols", "idx", "fks") + """
SELECT 'table' AS kind, env_id, schema_name, table_name, '' AS name, 0 AS place, CAST(rls_enabled AS VARCHAR) AS detail FROM cur_tables
UNION ALL SELECT 'column', env_id, schema_name, table_name, column_name, row_number() OVER (PARTITION BY env_id, table_name ORDER BY ordinal),
  concat_ws('|', type_raw, nullable, coalesce(default_raw, ''), is_pk) FROM cur_cols
UNION ALL SELECT 'index', env_id, schema_name, table_name, index_name, ordinal, concat_ws('|', column_name, is_unique) FROM cur_idx
UNION ALL SELECT 'foreign_key', env_id, schema_name, table_name, fk_name, ordinal,
  concat_ws('|', column_name, ref_table, ref_column, coalesce(on_delete, '')) FROM cur_fks""")
def write_inventory(d: Data):
    path = scratch_dir(d.spark, "inventory")
    sd.write_inventory(dr.Inventory(d.cur.tables, d.cur.cols, d.cur.idx, d.cur.fks), path)
    back = sd.read_schema_docs(d.spark, path, one_per_line=True).inventory

    def rows(df, kind, name, place, *detail):
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in detail])
        return df.select(F.lit(kind).alias("kind"), F.col("env_id").cast("bigint").alias("env_id"), "schema_name", "table_name",
                         name.alias("name"), place.cast("bigint").alias("place"), text.alias("detail"))

    at = F.col("ordinal")
    return rows(back.tables, "table", F.lit(""), F.lit(0), "rls_enabled") \
        .unionByName(rows(back.cols, "column", F.col("column_name"), at, "type_raw", "nullable", "default_raw", "is_pk")) \
        .unionByName(rows(back.idx, "index", F.col("index_name"), at, "column_name", "is_unique")) \
        .unionByName(rows(back.fks, "foreign_key", F.col("fk_name"), at, "column_name", "ref_table", "ref_column", "on_delete"))


@query("read_schema_docs", fleet("tables", "cols") + """
SELECT env_id, table_name, row_number() OVER (PARTITION BY env_id, table_name ORDER BY column_name) AS ordinal, column_name,
  CASE type_raw WHEN 'int8' THEN 'bigint' WHEN 'pg_catalog.int4' THEN 'integer' WHEN 'timestamptz' THEN 'timestamp with time zone' ELSE type_raw END AS type_raw,
  nullable, coalesce(default_raw, '') AS default_raw, is_pk, '' AS problem, '' AS named
FROM cur_cols WHERE env_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (17, 18))
UNION ALL SELECT c_custkey, '', 0, '', '', false, '', false,
  CASE c_nationkey WHEN 17 THEN 'unknown table field owner' ELSE 'missing column field nullable' END,
  CASE c_nationkey WHEN 17 THEN 'runs' ELSE n END
FROM customer LEFT JOIN (VALUES (18, 'routes.code'), (18, 'routes.mode')) AS v(k, n) ON k = c_nationkey WHERE c_nationkey IN (17, 18)""")
def read_schema_docs(d: Data):
    docs = dr.canonical_schema(d.cur).join(d.tenants.select("env_id", "c_nationkey").hint("merge"), "env_id")
    spoiled = F.when(F.col("c_nationkey") == 17, F.replace("document", F.lit('"name":"runs"}'), F.lit('"name":"runs","owner":"me"}'))).when(
        F.col("c_nationkey") == 18, F.regexp_replace("document", '"name":"(code|mode)","nullable":(true|false),', '"name":"$1",')
    ).otherwise(F.col("document"))
    path = scratch_dir(d.spark, "docs")
    docs.select(F.to_json(F.struct(F.col("env_id").cast("string").alias("env_id"), spoiled.alias("document")))).write.text(path)
    read = sd.read_schema_docs(d.spark, path, one_per_line=True)
    env = F.col("env_id").cast("bigint").alias("env_id")
    cols = read.inventory.cols.select(
        env, "table_name", F.col("ordinal").cast("bigint").alias("ordinal"), "column_name", "type_raw", "nullable",
        F.coalesce("default_raw", F.lit("")).alias("default_raw"), "is_pk", F.lit("").alias("problem"), F.lit("").alias("named"),
    )
    no = F.lit(False)
    bad = read.rejected.select(
        env, F.lit("").alias("table_name"), F.lit(0).cast("bigint").alias("ordinal"), F.lit("").alias("column_name"),
        F.lit("").alias("type_raw"), no.alias("nullable"), F.lit("").alias("default_raw"), no.alias("is_pk"), "problem", "named",
    )
    return cols.unionByName(bad)


# ------------------------------------------------------------------------- lint

_LINT_SQL = fleet("tables", "cols", "idx", "fks") + """,
lt AS (SELECT env_id, table_name FROM cur_tables UNION ALL SELECT c_custkey, 'staging' FROM customer WHERE c_nationkey = 1),
lc AS (SELECT env_id, table_name, column_name, CASE WHEN column_name = 'vehicle' AND c_acctbal < 0 THEN '' ELSE type_raw END AS type_raw, is_pk FROM cur_cols JOIN customer ON c_custkey = env_id
  UNION ALL SELECT c_custkey, 'routes', 'operator', 'text', false FROM customer, (VALUES (1), (2)) WHERE c_mktsegment = 'BUILDING'),
lx AS (SELECT env_id, table_name, index_name, ordinal, column_name FROM cur_idx
  UNION ALL SELECT env_id, table_name, index_name, ordinal, column_name FROM cur_idx JOIN customer ON c_custkey = env_id WHERE index_name = 'runs_route_left' AND c_mktsegment = 'HOUSEHOLD'),
lf AS (SELECT env_id, table_name, fk_name, column_name, ref_table FROM des_fks) """


@query("lint_inventory", _LINT_SQL + """
SELECT env_id, table_name, 'empty_table' AS code, 'warning' AS severity, table_name AS subject FROM lt WHERE (env_id, table_name) NOT IN (SELECT (env_id, table_name) FROM lc)
UNION ALL SELECT env_id, table_name, 'no_primary_key', 'warning', table_name FROM lt WHERE (env_id, table_name) NOT IN (SELECT (env_id, table_name) FROM lc WHERE is_pk)
UNION ALL SELECT env_id, table_name, 'duplicate_column', 'error', column_name FROM (SELECT *, row_number() OVER (PARTITION BY env_id, table_name, column_name) AS r FROM lc) WHERE r > 1
UNION ALL SELECT env_id, table_name, 'missing_type', 'error', column_name FROM lc WHERE type_raw = ''
UNION ALL SELECT env_id, table_name, 'invalid_fk_table', 'error', fk_name || '.' || ref_table FROM lf WHERE (env_id, ref_table) NOT IN (SELECT (env_id, table_name) FROM lt)
UNION ALL SELECT env_id, table_name, 'invalid_fk_column', 'error', fk_name || '.' || column_name FROM lf WHERE (env_id, table_name, column_name) NOT IN (SELECT (env_id, table_name, column_name) FROM lc)
UNION ALL SELECT env_id, table_name, 'duplicate_index', 'warning', index_name FROM (SELECT *, row_number() OVER (PARTITION BY env_id, table_name, index_name, ordinal) AS r FROM lx WHERE ordinal = 1) WHERE r > 1
UNION ALL SELECT env_id, table_name, 'invalid_index_column', 'error', index_name || '.' || column_name FROM lx WHERE (env_id, table_name, column_name) NOT IN (SELECT (env_id, table_name, column_name) FROM lc)""")
def lint_inventory(d: Data):
    who = d.tenants
    public = F.lit("public").alias("schema_name")
    tables = d.cur.tables.drop("rls_enabled").unionByName(
        who.filter("c_nationkey = 1").select("env_id", public, F.lit("staging").alias("table_name"))
    )
    names = [*iv.TABLE_KEY, "column_name", "type_raw", "is_pk"]
    cols = d.cur.cols.join(who.hint("merge"), "env_id").withColumn(
        "type_raw", F.when((F.col("column_name") == "vehicle") & (F.col("c_acctbal") < 0), "").otherwise(F.col("type_raw"))
    ).select(names).unionByName(
        who.filter("c_mktsegment = 'BUILDING'").select(
            "env_id", public, F.lit("routes").alias("table_name"),
            F.explode(F.array(F.lit("operator"), F.lit("operator"))).alias("column_name"),
            F.lit("text").alias("type_raw"), F.lit(False).alias("is_pk"),
        )
    )
    again = d.cur.idx.join(who.filter("c_mktsegment = 'HOUSEHOLD'").select("env_id").hint("merge"), "env_id").filter("index_name = 'runs_route_left'")
    return ln.lint_inventory(tables, cols, d.cur.idx.unionByName(again), d.des.fks).drop("schema_name")


@query("lint_duplicate_pk", fleet("cols") + """
SELECT env_id, table_name, count(*) AS declarations FROM cur_cols WHERE is_pk GROUP BY ALL HAVING count(*) > 1""")
def lint_duplicate_pk(d: Data):
    # every flagged column counts as its own PRIMARY KEY clause
    return ln.lint_duplicate_pk(d.cur.cols.filter("is_pk")).drop("schema_name")


@query("lint_unknown_type", fleet("cols") + """
SELECT env_id, table_name, column_name, CASE WHEN column_name = 'code' THEN 'txet' ELSE 'TIMESTAMPZ' END AS type_raw,
  CASE WHEN column_name = 'code' THEN 'text' ELSE 'timestamp' END AS nearest_type, CASE WHEN column_name = 'code' THEN 2::BIGINT ELSE 1::BIGINT END AS distance
FROM cur_cols JOIN customer ON c_custkey = env_id WHERE (column_name = 'code' AND c_acctbal < 0) OR (column_name = 'opened_at' AND c_mktsegment = 'MACHINERY')""")
def lint_unknown_type(d: Data):
    who = d.tenants.select("env_id", "c_acctbal", "c_mktsegment")
    typo = F.when((F.col("column_name") == "code") & (F.col("c_acctbal") < 0), "txet").when(
        (F.col("column_name") == "opened_at") & (F.col("c_mktsegment") == "MACHINERY"), "TIMESTAMPZ"
    ).otherwise(F.col("type_raw"))
    found = ln.lint_unknown_type(d.cur.cols.join(who.hint("merge"), "env_id").withColumn("type_raw", typo))
    return found.select("env_id", "table_name", "column_name", "type_raw", "nearest_type", F.col("distance").cast("bigint").alias("distance"))
