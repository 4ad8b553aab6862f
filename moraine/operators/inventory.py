"""The inventory of many environments, built from their raw catalogs.

Inputs are the catalog tables of all environments with an ``env_id`` column;
outputs are the canonical inventory frames.  One environment contributes a few
hundred rows, so every key below is spread evenly.  Both sides of a join grow
with the fleet, but catalogs compress so well (and unfolded literals count so
little) that the planner would broadcast one: they are merged by hint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from moraine.functions.typenames import normalize_default

TABLE_KEY = ["env_id", "schema_name", "table_name"]

# Columns of the inventory frames, without the leading ``env_id``.
ROW_TYPES = {
    "tables": "schema_name string, table_name string, rls_enabled boolean",
    "cols": "schema_name string, table_name string, ordinal int, column_name string, type_raw string, "
            "nullable boolean, default_raw string, is_pk boolean",
    "idx": "schema_name string, table_name string, index_name string, ordinal int, column_name string, "
           "is_unique boolean",
    "fks": "schema_name string, table_name string, fk_name string, ordinal int, column_name string, "
           "ref_table string, ref_column string, on_delete string, on_update string",
}

# Policy command codes of the catalog.
POLICY_COMMANDS = {"r": "SELECT", "a": "INSERT", "w": "UPDATE", "d": "DELETE", "*": "ALL"}

# Integer types a serial column may have, and their serial names.
SERIAL_NAMES = {"smallint": "smallserial", "integer": "serial", "bigint": "bigserial"}


def inventory_tables(raw: DataFrame, schemas: Sequence[str]) -> DataFrame:
    """Base tables of the given schemas."""
    return raw.filter((F.col("table_type") == "BASE TABLE") & F.col("schema_name").isin(*schemas)).drop("table_type")


def inventory_columns(raw: DataFrame, pk_columns: DataFrame) -> DataFrame:
    """Columns with nullable flag, default and primary-key flag (false when not listed)."""
    keys = [*TABLE_KEY, "column_name"]
    flagged = pk_columns.select(*keys).distinct().withColumn("is_pk", F.lit(True))
    return raw.join(flagged.hint("merge"), keys, "left").select(
        *TABLE_KEY,
        "ordinal",
        "column_name",
        F.col("data_type").alias("type_raw"),
        (F.col("is_nullable") == "YES").alias("nullable"),
        normalize_default(F.col("column_default")).alias("default_raw"),
        F.coalesce("is_pk", F.lit(False)).alias("is_pk"),
    )


def inventory_indexes(index_columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """Indexes that do not back a primary key or unique constraint, one row per key column."""
    backing = constraints.filter(F.col("constraint_type").isin("PRIMARY KEY", "UNIQUE")).select(
        "env_id", "schema_name", F.col("constraint_name").alias("index_name")
    )
    return index_columns.join(backing.hint("merge"), ["env_id", "schema_name", "index_name"], "left_anti").select(
        *TABLE_KEY, "index_name", "ordinal", "column_name", "is_unique"
    )


def inventory_foreign_keys(
    constraints: DataFrame, key_usage: DataFrame, ref_usage: DataFrame, actions: DataFrame
) -> DataFrame:
    """Foreign keys, one row per key column; ``NO ACTION`` becomes null.

    A name is unique within its table only, so the table is part of the key
    wherever a frame has it.
    """
    key = ["env_id", "schema_name", "constraint_name"]

    def of(df: DataFrame, *values: str) -> tuple[DataFrame, list[str]]:
        on = [*key, "table_name"] if "table_name" in df.columns else key
        return df.select(*on, *values), on

    found = constraints.filter("constraint_type = 'FOREIGN KEY'").select(*key, "table_name")
    used, on_used = of(key_usage, "ordinal", "column_name")
    refs, on_refs = of(ref_usage, "ordinal", "ref_table", "ref_column")
    rules, on_rules = of(actions, "delete_rule", "update_rule")
    return (
        found.join(used.hint("merge"), on_used).join(refs.hint("merge"), [*on_refs, "ordinal"]).join(rules.hint("merge"), on_rules)
        .select(
            *TABLE_KEY,
            F.col("constraint_name").alias("fk_name"),
            "ordinal",
            "column_name",
            "ref_table",
            "ref_column",
            F.nullif("delete_rule", F.lit("NO ACTION")).alias("on_delete"),
            F.nullif("update_rule", F.lit("NO ACTION")).alias("on_update"),
        )
    )


def group_foreign_keys(fks: DataFrame) -> DataFrame:
    """One row per foreign key, its key columns as arrays in ordinal order."""
    return grouped_keys(fks, "fk_name", ["column_name", "ref_column"], ["ref_table", "on_delete", "on_update"])


def group_indexes(idx: DataFrame) -> DataFrame:
    """One row per index, its key columns as an array in ordinal order."""
    return grouped_keys(idx, "index_name", ["column_name"], ["is_unique"])


def grouped_keys(df: DataFrame, name: str, lists: Sequence[str], singles: Sequence[str]) -> DataFrame:
    # a key has at most a few dozen columns, so the collected list is bounded
    table_key = [c for c in TABLE_KEY if c in df.columns]
    parts = F.array_sort(F.collect_list(F.struct("ordinal", *lists)))
    return df.groupBy(*table_key, name).agg(
        parts.alias("_p"), *[F.first(c).alias(c) for c in singles]
    ).select(
        *table_key, name,
        *[F.col(f"_p.{c}").alias(f"{c}s") for c in lists],
        *singles,
    )


def inventory_policies(policies: DataFrame, roles: DataFrame) -> DataFrame:
    """Policies with decoded command and role names; no roles means everyone."""
    key = [*TABLE_KEY, "policy_name"]
    command = F.create_map(*[F.lit(x) for kv in POLICY_COMMANDS.items() for x in kv])[F.col("command_code")]
    named = (
        policies.select(*key, F.explode("role_ids").alias("role_id"))
        .join(roles.hint("merge"), ["env_id", "role_id"])
        .groupBy(*key).agg(F.array_sort(F.collect_set("role_name")).alias("roles"))
    )
    return policies.join(named.hint("merge"), key, "left").select(
        *key,
        command.alias("command"),
        "permissive",
        F.coalesce("roles", F.array().cast("array<string>")).alias("roles"),
        "using_expr",
        "check_expr",
    )


def inventory_rls(wanted: DataFrame, tables: DataFrame) -> DataFrame:
    """Row-security flag of each wanted table; ``found`` is false where there is no such table."""
    known = tables.select(*TABLE_KEY, "rls_enabled", F.lit(True).alias("found"))
    return wanted.select(*TABLE_KEY).join(known.hint("merge"), TABLE_KEY, "left").select(
        *TABLE_KEY,
        F.coalesce("rls_enabled", F.lit(False)).alias("rls_enabled"),
        F.coalesce("found", F.lit(False)).alias("found"),
    )


def sequence_name(default: Column) -> Column:
    """Bare sequence name of ``nextval('"s"."name"'::regclass)``, empty if it is none."""
    full = F.regexp_extract(default, r"nextval\('([^']+)'::regclass\)", 1)
    return F.regexp_replace(F.element_at(F.split(full, r"\."), -1), '^"+|"+$', "")


def serial_columns(cols: DataFrame, sequence_owners: DataFrame) -> DataFrame:
    """Columns with serial ones recognised: type becomes serial, default null.

    A column is serial when it is NOT NULL, integer, defaults to a sequence and
    owns that sequence.
    """
    owners = sequence_owners.select(
        *TABLE_KEY, F.col("sequence_name").alias("_seq"), "column_name"
    ).distinct().withColumn("_own", F.lit(True))
    marked = cols.withColumn("_seq", sequence_name(F.coalesce("default_raw", F.lit("")))).join(
        owners.hint("merge"), [*TABLE_KEY, "column_name", "_seq"], "left"
    )
    serial = ~F.col("nullable") & F.col("type_raw").isin(*SERIAL_NAMES) & F.col("_own").isNotNull()
    names = F.create_map(*[F.lit(x) for kv in SERIAL_NAMES.items() for x in kv])
    return marked.select(*[
        F.when(serial, names[F.col("type_raw")]).otherwise(F.col(c)).alias(c) if c == "type_raw"
        else F.when(~serial, F.col(c)).alias(c) if c == "default_raw"
        else F.col(c)
        for c in cols.columns
    ], serial.alias("is_serial"))


def inventory_order(cols: DataFrame) -> DataFrame:
    """By environment and table name, then ordinal; a range sort, no single task."""
    return cols.orderBy(*TABLE_KEY, "ordinal")


def catalog_columns(spark, database: str, env_id: str) -> DataFrame:
    """Inventory rows of the base tables of a live Spark database, one environment; catalog calls only."""
    rows = []
    listed = [t for t in spark.catalog.listTables(database) if not t.isTemporary and t.tableType != "VIEW"]
    for table in sorted(listed, key=lambda t: t.name):
        for i, c in enumerate(spark.catalog.listColumns(f"{database}.{table.name}"), start=1):
            rows.append((env_id, database, table.name, i, c.name, c.dataType, c.nullable, None, False))
    return spark.createDataFrame(
        rows,
        "env_id string, schema_name string, table_name string, ordinal int, column_name string, "
        "type_raw string, nullable boolean, default_raw string, is_pk boolean",
    )
