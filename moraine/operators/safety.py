"""How risky is each difference?  ``when`` chains over diff rows.

A diff is judged in a single pass: added, removed and retyped columns are told
apart by expressions, not by scanning the diff once per kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from moraine.functions.typenames import is_widening
from moraine.operators.drift import Inventory
from moraine.operators.inventory import TABLE_KEY
from moraine.operators.table_diff import nested_diff, renames
from moraine.session import staged

# Names of the safety levels.
SAFE, REVIEW, LOSSY, DANGEROUS, MULTI_PHASE = (
    "Safe", "Requires Review", "Lossy", "Dangerous", "Multi-Phase Required",
)

VERDICT = [
    "operation", "subject", "valid", "reversible", "level", "breaking_change", "data_loss",
    "rollback_data_loss", "requires_multi_phase", "lock_contention", "message",
]


def _verdict(df: DataFrame, **values) -> DataFrame:
    as_columns = {k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()}
    return df.select(*TABLE_KEY, *[as_columns[name].alias(name) for name in VERDICT])


def verdict_columns() -> dict[str, Column]:
    """The verdict on a row of a column diff, as Columns by name."""
    added, removed = F.col("status") == "added", F.col("status") == "removed"
    bare = added & ~F.col("new_nullable") & (F.coalesce("new_default", F.lit("")) == "")
    forward = is_widening(F.col("old_type"), F.col("new_type"))
    backward = is_widening(F.col("new_type"), F.col("old_type"))
    name = F.col("column_name")
    arrow = F.concat(F.col("old_type"), F.lit(" -> "), F.col("new_type"))
    return {
        "operation": F.when(added, "add_column").when(removed, "drop_column").otherwise("alter_type"),
        "subject": name,
        "valid": F.when(added, ~bare).when(removed, True).otherwise(forward),
        "reversible": F.when(added, True).when(removed, False).otherwise(backward),
        "level": F.when(added, F.when(bare, DANGEROUS).otherwise(SAFE))
        .when(removed, DANGEROUS)
        .otherwise(F.when(~forward, DANGEROUS).when(~backward, LOSSY).otherwise(SAFE)),
        "breaking_change": F.when(added, bare).otherwise(True),
        "data_loss": F.when(added, False).when(removed, True).otherwise(~forward),
        "rollback_data_loss": F.when(added, ~bare).when(removed, False).otherwise(~backward),
        "requires_multi_phase": F.when(added, bare).when(removed, True).otherwise(~forward),
        "lock_contention": ~added,
        "message": F.when(bare, F.concat(F.lit("existing rows have no value for NOT NULL "), name))
        .when(added, F.concat(F.lit("rollback drops "), name))
        .when(removed, F.concat(F.lit("values of "), name, F.lit(" cannot be brought back")))
        .when(~forward, F.concat(F.lit("values may not fit: "), arrow))
        .when(~backward, F.concat(F.lit("values may not fit on rollback: "), arrow))
        .otherwise(arrow),
    }


def classify_columns(diff: DataFrame) -> DataFrame:
    """Verdict of every added, removed or retyped column; other changes carry none."""
    judged = diff.filter((F.col("status") != "modified") | F.array_contains("changes", "type"))
    return _verdict(judged, **verdict_columns())


def classify_add_column(diff: DataFrame) -> DataFrame:
    return classify_columns(diff.filter("status = 'added'"))


def classify_drop_column(diff: DataFrame) -> DataFrame:
    return classify_columns(diff.filter("status = 'removed'"))


def classify_alter_type(diff: DataFrame) -> DataFrame:
    return classify_columns(diff.filter("status = 'modified'"))


def classify_drop_table(tables: DataFrame) -> DataFrame:
    """Verdict of removed tables of a table diff."""
    return _verdict(
        tables.filter("status = 'removed'"),
        operation="drop_table", subject=F.col("table_name"), valid=True, reversible=False, level=DANGEROUS,
        breaking_change=True, data_loss=True, rollback_data_loss=False, requires_multi_phase=True,
        lock_contention=True,
        message=F.concat(F.lit("rows of "), F.col("table_name"), F.lit(" cannot be brought back")),
    )


def classify_rls(changes: DataFrame) -> DataFrame:
    action = F.when(F.col("rls_enabled"), "enable").otherwise("disable")
    return _verdict(
        changes,
        operation=F.concat(action, F.lit("_rls")), subject=F.col("table_name"), valid=True, reversible=True,
        level=SAFE, breaking_change=False, data_loss=False, rollback_data_loss=False,
        requires_multi_phase=False, lock_contention=False,
        message=F.concat(action, F.lit(" row security on "), F.col("table_name")),
    )


def _key_problem(schema: Column, key: Column, known: Column) -> Column:
    """What is wrong with the target of a foreign key, or null; ``known``: column names by (schema, table) of its environment."""
    body = key["value"]
    columns = F.element_at(known, F.struct(
        F.coalesce(body["ref_schema"], schema).alias("schema_name"), body["ref_table"].alias("table_name")))
    have = lambda c: F.size(F.array_compact(c))
    strays = F.array_distinct(F.array_sort(F.transform(
        F.filter(body["ref_columns"], lambda c: ~F.coalesce(F.array_contains(columns, c), F.lit(False))),
        lambda c: F.concat(F.lit("missing_column "), F.concat_ws(".", body["ref_table"], c)))))
    return F.when(columns.isNull(), F.concat_ws(" ", F.lit("missing_table"), body["ref_table"])).when(
        have(body["column_names"]) != have(body["ref_columns"]), F.concat_ws(" ", F.lit("column_count"), body["ref_table"])
    ).when(F.size(strays) > 0, F.array_join(strays, "; "))


def judged_tables(current: Inventory, desired: Inventory) -> DataFrame:
    """The nested diff with ``keys``: name and problem of every foreign key that appears.

    Everything of an environment lies in one partition, so the targets of its
    keys are looked up in a map of its desired tables without another exchange;
    an environment's schema is a document in any case.
    """
    nested = nested_diff(current, desired, by=["env_id"])
    if "desired_keys" not in nested.columns:
        return nested.withColumn("keys", F.array().cast("array<struct<name:string,problem:string>>"))
    here = F.struct(F.struct("schema_name", "table_name").alias("k"), F.col("desired_columns").alias("v"))
    tables = nested.groupBy("env_id").agg(
        F.collect_list(F.struct(*[c for c in nested.columns if c != "env_id"])).alias("_tables"),
        F.map_from_entries(F.collect_list(F.when(F.col("status") != "removed", here))).alias("_known"))
    fields = [c for c in nested.columns if c not in ("env_id", "desired_keys", "desired_columns", "desired_primary_key")]
    checked = F.transform("_tables", lambda t: F.struct(*[t[c].alias(c) for c in fields], F.transform(
        t["desired_keys"], lambda k: F.struct(k["key"].alias("name"), _key_problem(t["schema_name"], k, F.col("_known")).alias("problem"))
    ).alias("keys")))
    return tables.select("env_id", F.inline(checked))


# What a verdict is read from; a row of any kind leaves the others' fields null.
_JUDGED = ("kind", "column_name", "status", "changes", "old_type", "new_type", "new_nullable", "new_default", "problem")
_JUDGED_TYPE = ("array<struct<kind:string,column_name:string,status:string,changes:array<string>,old_type:string,new_type:string,"
                "new_nullable:boolean,new_default:string,problem:string>>")


def _judged(kind: str | Column, **values: Column) -> Column:
    given = {"kind": F.lit(kind) if isinstance(kind, str) else kind, **values}
    return F.struct(*[given.get(f, F.lit(None)).alias(f) for f in _JUDGED])


def _table_kind() -> Column:
    """Operation on the table itself, or null."""
    rls = ~F.col("old_rls_enabled").eqNullSafe(F.col("new_rls_enabled"))
    return (
        F.when(F.col("status") == "added", "create_table").when(F.col("status") == "removed", "drop_table")
        .when(rls, F.when(F.col("new_rls_enabled"), "enable_rls").otherwise("disable_rls"))
    )


def _columns_judged(test) -> Column:
    return F.transform(F.filter("columns", test), lambda c: _judged("column", **{f: c[f] for f in _JUDGED if f not in ("kind", "problem")}))


def classify_diff(current: Inventory, desired: Inventory) -> DataFrame:
    """The static verdict on a whole diff, from one row per table.

    Judged are dropped tables, added, dropped and retyped columns, row security
    and added foreign keys; nullability, default, key and index changes are not.
    Foreign keys have validity but no safety level.
    """
    tables = judged_tables(current, desired)
    own = _table_kind()
    rows = tables.select(*TABLE_KEY, F.inline(F.concat(
        F.when(own.isNotNull() & (own != "create_table"), F.array(_judged(own))).otherwise(F.array()).cast(_JUDGED_TYPE),
        _columns_judged(lambda c: (c["status"] != "modified") | F.array_contains(c["changes"], "type")).cast(_JUDGED_TYPE),
        F.transform("keys", lambda k: _judged("add_foreign_key", column_name=k["name"], problem=k["problem"])).cast(_JUDGED_TYPE),
    )))
    kind, gone = F.col("kind"), F.col("kind") == "drop_table"
    fk, none = kind == "add_foreign_key", F.lit(None).cast("boolean")
    action = F.when(kind == "enable_rls", "enable").otherwise("disable")
    on_table = {
        "operation": kind, "subject": F.when(fk, F.col("column_name")).otherwise(F.col("table_name")),
        "valid": ~fk | F.col("problem").isNull(), "reversible": ~gone,
        "level": F.when(gone, DANGEROUS).when(~fk, SAFE),
        **{f: F.when(fk, none).otherwise(gone) for f in ("breaking_change", "data_loss", "requires_multi_phase", "lock_contention")},
        "rollback_data_loss": F.when(fk, none).otherwise(F.lit(False)),
        "message": F.when(fk, F.coalesce("problem", F.lit("")))
        .when(gone, F.concat(F.lit("rows of "), F.col("table_name"), F.lit(" cannot be brought back")))
        .otherwise(F.concat(action, F.lit(" row security on "), F.col("table_name"))),
    }
    of_column = verdict_columns()
    return _verdict(rows, **{f: F.when(kind == "column", of_column[f]).otherwise(on_table[f]) for f in VERDICT})


# Level, reversible and multi-phase flag of the operations whose
# verdict does not depend on the column's definition.
CATALOG = {
    "create_table": (SAFE, "yes", False),
    "drop_table": (DANGEROUS, "no", True),
    "rename_table": (MULTI_PHASE, "yes", True),
    "rename_column": (MULTI_PHASE, "yes", True),
    "enable_rls": (SAFE, "yes", False),
    "disable_rls": (SAFE, "yes", False),
    "set_not_null": (LOSSY, "yes", True),
    "drop_not_null": (REVIEW, "yes", False),
    "set_default": (REVIEW, "yes", False),
    "drop_default": (REVIEW, "yes", False),
    "add_primary_key": (MULTI_PHASE, "depends", True),
    "drop_primary_key": (DANGEROUS, "no", True),
    "add_foreign_key": (REVIEW, "yes", False),
    "drop_foreign_key": (REVIEW, "yes", False),
    "add_unique": (LOSSY, "depends", True),
    "drop_unique": (REVIEW, "yes", False),
    "add_check": (LOSSY, "depends", True),
    "drop_check": (REVIEW, "yes", False),
    "create_index": (REVIEW, "yes", False),
    "create_index_concurrently": (SAFE, "yes", False),
    "drop_index": (REVIEW, "yes", False),
    "rename_index": (SAFE, "yes", False),
}


def _catalog_entry(operation: Column) -> Column:
    entries = [
        x for op, (level, reversible, multi) in CATALOG.items()
        for x in (F.lit(op), F.struct(F.lit(level).alias("l"), F.lit(reversible).alias("r"), F.lit(multi).alias("m")))
    ]
    return F.create_map(*entries)[operation]


def classify_diff_full(current: Inventory, desired: Inventory, max_distance: int = 2) -> DataFrame:
    """The static verdict plus the catalogued level of every other change, renames that the diff suggests included.

    Everything is read from one row per table, which unfolds into the operations
    it stands for.  ``rename_column`` rows stand beside the drop and the add they
    could replace, ``old -> new`` as subject; a column is in at most one of them.
    """
    nested = nested_diff(current, desired)
    kind = "array<struct<op:string,column_name:string,status:string,old_type:string,new_type:string,new_nullable:boolean,new_default:string>>"

    def entry(op: Column, name: Column, **of: Column) -> Column:
        names = ("status", "old_type", "new_type", "new_nullable", "new_default")
        return F.struct(op.alias("op"), name.alias("column_name"), *[of.get(n, F.lit(None)).alias(n) for n in names])

    def of_column(c: Column) -> Column:
        change = lambda x: (
            F.when(x == "nullable", F.when(c["new_nullable"], "drop_not_null").otherwise("set_not_null"))
            .when(x == "default", F.when(c["new_default"].isNull(), "drop_default").otherwise("set_default"))
            .when(x == "is_primary_key", F.when(c["new_is_primary_key"], "add_primary_key").otherwise("drop_primary_key"))
        )
        # the verdict on a column's own definition is computed for "static" rows
        ops = F.when(c["status"] == "modified", F.transform(c["changes"], lambda x: F.coalesce(change(x), F.lit("static")))) \
            .otherwise(F.array(F.lit("static")))
        body = {n: c[n] for n in ("status", "old_type", "new_type", "new_nullable", "new_default")}
        return F.transform(ops, lambda op: entry(op, c["column_name"], **body))

    def steps(rows: str, name: str, made, gone) -> Column:
        """A changed body is a drop and an add."""
        return F.flatten(F.transform(rows, lambda r: F.array_compact(F.array(
            F.when(r["status"] != "added", entry(gone(r), r[name])), F.when(r["status"] != "removed", entry(made(r), r[name]))))))

    own = _table_kind()
    ops = [
        F.when(own.isNotNull(), F.array(entry(own, F.col("table_name")))).otherwise(F.array()).cast(kind),
        F.flatten(F.transform("columns", of_column)).cast(kind),
        F.transform(renames(F.col("columns"), max_distance), lambda r: entry(
            F.lit("rename_column"), F.concat_ws(" -> ", r["old_name"], r["new_name"]))).cast(kind),
    ]
    if "indexes" in nested.columns:
        ops.append(steps("indexes", "index_name",
                         lambda r: F.when(F.coalesce(r["new_is_unique"], F.lit(False)), "add_unique").otherwise("create_index"),
                         lambda r: F.when(F.coalesce(r["old_is_unique"], F.lit(False)), "drop_unique").otherwise("drop_index")).cast(kind))
    if "foreign_keys" in nested.columns:
        ops.append(steps("foreign_keys", "fk_name", lambda _: F.lit("add_foreign_key"), lambda _: F.lit("drop_foreign_key")).cast(kind))
    rows = nested.select(*TABLE_KEY, F.inline(F.concat(*ops)))
    judged, static = verdict_columns(), F.col("op") == "static"
    listed = _catalog_entry(F.col("op"))
    return rows.select(
        *TABLE_KEY, F.when(static, judged["operation"]).otherwise(F.col("op")).alias("operation"),
        F.col("column_name").alias("subject"),
        F.when(static, judged["level"]).otherwise(listed["l"]).alias("level"),
        F.when(static, F.when(judged["reversible"], "yes").otherwise("no")).otherwise(listed["r"]).alias("reversible"),
        F.when(static, judged["requires_multi_phase"]).otherwise(listed["m"]).alias("requires_multi_phase"),
    )


def classify_with_data(verdicts: DataFrame, probes: DataFrame) -> DataFrame:
    """The static level beside the level the data supports, and the values a drop would take along.

    ``probes``: ``table_name``, ``subject`` (or ``column_name``) and any of
    ``failed, changed, null_rows, duplicates, lost`` measured on the table
    itself; with ``env_id``, ``schema_name`` or ``operation`` each measurement
    judges only what it was taken for.  A change whose measure is missing keeps
    its static level.
    """
    if "subject" not in probes.columns:
        probes = probes.withColumnRenamed("column_name", "subject")
    key = [c for c in ("env_id", "schema_name", "table_name", "operation", "subject") if c in probes.columns]
    missing = {m: F.lit(None).cast("bigint") for m in ("failed", "changed", "null_rows", "duplicates", "lost") if m not in probes.columns}
    probed = verdicts.join(staged(probes.withColumns(missing), "probes").hint("merge"), key, "left")

    def by(*measures: str) -> Column:
        """Dangerous where any measure found a row, safe where all were taken and found none."""
        found = [F.coalesce(F.col(m) > 0, F.lit(False)) for m in measures]
        taken = [F.col(m).isNotNull() for m in measures]
        any_found, all_taken = found[0], taken[0]
        for f, t in zip(found[1:], taken[1:], strict=True):
            any_found, all_taken = any_found | f, all_taken & t
        return F.when(any_found, DANGEROUS).when(all_taken, SAFE).otherwise(F.col("level"))

    operation = F.col("operation")
    level = (
        F.when((operation == "alter_type") & F.col("failed").isNotNull(),
               F.when(F.col("failed") > 0, DANGEROUS).when(F.col("changed") > 0, LOSSY).otherwise(SAFE))
        .when(operation == "set_not_null", by("null_rows"))
        .when(operation == "add_primary_key", by("null_rows", "duplicates"))
        .when(operation == "add_unique", by("duplicates"))
        .otherwise(F.col("level"))
    )
    rank = F.create_map(*[x for i, l in enumerate((SAFE, REVIEW, LOSSY, MULTI_PHASE, DANGEROUS)) for x in (F.lit(l), F.lit(i))])
    shift = F.when(rank[level] > rank[F.col("level")], "upgraded").when(rank[level] < rank[F.col("level")], "downgraded").otherwise("unchanged")
    return probed.select(*verdicts.columns, level.alias("data_level"), shift.alias("shift"), F.col("lost").alias("impact"))


# By operation and level, the ways of this library that spare the risk.
ALTERNATIVES = {
    ("add_column", DANGEROUS): (
        "add it nullable, fill it with expand_backfill, then not_null_pipeline", "give it a default"),
    ("drop_column", DANGEROUS): (
        "archive_column first, and archive_verify before the drop", "contract_column once no reader is left, in a change of its own"),
    ("drop_table", DANGEROUS): (
        "archive_table and drop_table_guard before the drop", "rename it and watch for readers first"),
    ("alter_type", DANGEROUS): (
        "type_change_backfill into a new column, stream_dual_write, then type_change_finish",
        "cast_probe on the data", "alter_column_type_using with an expression"),
    ("alter_type", LOSSY): ("round_trip_probe on the data",),
    ("set_not_null", LOSSY): ("null_backfill, then not_null_pipeline",),
    ("add_unique", LOSSY): ("unique_pipeline with dedupe_keep_first",),
    ("add_primary_key", MULTI_PHASE): ("check_primary_key, then unique_pipeline and not_null_pipeline",),
    ("add_check", LOSSY): ("check_expression on the data, then quarantine_split",),
    ("rename_column", MULTI_PHASE): ("expand_backfill under the new name, stream_dual_write, then contract_column",),
    ("create_index", REVIEW): ("rewrite_statement to build it concurrently",),
    ("enable_rls", SAFE): ("rls_coverage of every role before it is enabled",),
}


def safer_alternatives(verdicts: DataFrame) -> DataFrame:
    """The verdicts with ``alternatives``: ways to the same end with less risk, none where there are none."""
    entries = [x for (op, level), ways in ALTERNATIVES.items() for x in (F.lit(f"{op} {level}"), F.array(*map(F.lit, ways)))]
    found = F.element_at(F.create_map(*entries), F.concat_ws(" ", "operation", "level"))
    return verdicts.withColumn("alternatives", F.coalesce(found, F.array().cast("array<string>")))


def safety_rollup(verdicts: DataFrame, envs: DataFrame) -> DataFrame:
    """Per environment: operations per level, the overall flags and the dangerous operations by name.

    Nothing to do counts as valid.
    """
    named = F.concat_ws(" ", "operation", F.concat_ws(".", "table_name", "subject"))
    levels = {"safe": SAFE, "review": REVIEW, "lossy": LOSSY, "dangerous": DANGEROUS, "multi_phase": MULTI_PHASE}
    per_env = verdicts.groupBy("env_id").agg(
        F.count(F.lit(1)).alias("operations"),
        *[F.count_if(F.col("level") == v).alias(k) for k, v in levels.items()],
        F.bool_and("valid").alias("all_valid"),
        F.bool_and("reversible").alias("all_reversible"),
        # the operations of one environment's change
        F.array_sort(F.collect_list(F.when(F.col("level") == DANGEROUS, named))).alias("dangerous_operations"),
    )
    zero = F.lit(0).cast("bigint")
    return envs.select("env_id").distinct().join(per_env.hint("merge"), "env_id", "left").select(
        "env_id",
        *[F.coalesce(c, zero).alias(c) for c in ("operations", *levels)],
        F.coalesce("all_valid", F.lit(True)).alias("all_valid"),
        F.coalesce("all_reversible", F.lit(True)).alias("all_reversible"),
        (F.coalesce("dangerous", zero) > 0).alias("has_dangerous"),
        F.coalesce("dangerous_operations", F.array().cast("array<string>")).alias("dangerous_operations"),
    )
