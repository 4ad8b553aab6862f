"""Which measurements the changes of a diff need, and one pass per table that takes them all.

The plan is a table of its own, one row per environment, table, operation and
subject.  What distinguishes the measurements of a table (its operations,
columns and target types) is no larger than its schema, however many
environments there are; that much is brought to the driver, and becomes the
aggregates of a single scan grouped by environment.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from moraine.functions.typenames import spark_type
from moraine.operators.drift import Inventory
from moraine.operators.inventory import TABLE_KEY
from moraine.operators.probes import changes_on_round_trip, does_not_convert
from moraine.operators.table_diff import nested_diff
from moraine.session import staged

_WANTED = "array<struct<operation:string,subject:string,columns:array<string>,target:string>>"
MEASURES = ("failed", "changed", "null_rows", "duplicates", "lost")
SUBJECT = [*TABLE_KEY, "operation", "subject"]


def wanted_probes(current: Inventory, desired: Inventory) -> DataFrame:
    """env_id, schema_name, table_name, operation, subject, columns, target: what to measure before a change.

    A new type needs failed and changed conversions; NOT NULL the nulls; a
    primary key nulls and repeated keys over all its desired columns; a unique
    index its repeated keys; a dropped column or table the values or rows it
    takes along.
    """
    nested = nested_diff(current, desired).filter("status <> 'added'")

    def want(operation: str, subject: Column, columns: Column, target: Column | None = None) -> Column:
        return F.struct(F.lit(operation).alias("operation"), subject.alias("subject"), columns.alias("columns"),
                        (F.lit(None).cast("string") if target is None else target).alias("target"))

    def changed(name: str, more=lambda c: F.lit(True)) -> Column:
        return F.filter("columns", lambda c: F.array_contains(c["changes"], name) & more(c))

    own = lambda c: F.array(c["column_name"])
    parts = [
        F.transform(changed("type"), lambda c: want("alter_type", c["column_name"], own(c), c["new_type"])),
        F.transform(changed("nullable", lambda c: ~c["new_nullable"]), lambda c: want("set_not_null", c["column_name"], own(c))),
        F.transform(changed("is_primary_key", lambda c: c["new_is_primary_key"]),
                    lambda c: want("add_primary_key", c["column_name"], F.col("desired_primary_key"))),
        F.transform(F.filter("columns", lambda c: c["status"] == "removed"),
                    lambda c: want("drop_column", c["column_name"], own(c))),
    ]
    whole = want("drop_table", F.col("table_name"), F.array().cast("array<string>"))
    parts.append(F.when(F.col("status") == "removed", F.array(whole)).otherwise(F.array()))
    if "indexes" in nested.columns:
        fresh = F.filter("indexes", lambda x: (x["status"] != "removed") & F.coalesce(x["new_is_unique"], F.lit(False)))
        parts.append(F.transform(fresh, lambda x: want("add_unique", x["index_name"], x["new_column_names"])))
    return nested.select(*TABLE_KEY, F.inline(F.concat(*[p.cast(_WANTED) for p in parts])))


def _measure(df: DataFrame, spec) -> dict[str, Column] | None:
    """Aggregates of one measurement by name; None where the table lacks a column or Spark the type."""
    types = dict(df.dtypes)
    if spec.operation == "drop_table":
        return {"lost": F.count(F.lit(1))}
    if not spec.columns or any(c not in types for c in spec.columns):
        return None
    first = F.col(spec.columns[0])
    if spec.operation == "alter_type":
        try:
            target = spark_type(spec.target)
        except ValueError:
            return None
        return {"failed": F.count_if(does_not_convert(first, target)),
                "changed": F.count_if(changes_on_round_trip(first, types[spec.columns[0]], target))}
    some_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in spec.columns])
    whole = F.when(~some_null, F.struct(*spec.columns))
    return {
        "set_not_null": {"null_rows": F.count_if(some_null)},
        "drop_column": {"lost": F.count(first)},
        "add_unique": {"duplicates": F.count(whole) - F.count_distinct(whole)},
        "add_primary_key": {"null_rows": F.count_if(some_null), "duplicates": F.count(whole) - F.count_distinct(whole)},
    }[spec.operation]


def measured_probes(wanted: DataFrame, tables: Mapping[str | tuple[str, str], DataFrame]) -> DataFrame:
    """The measurements ``failed, changed, null_rows, duplicates, lost`` of each wanted row whose table holds data.

    ``tables``: frames with an ``env_id`` by table name, or by (schema, table)
    where schemas differ.  Each is scanned once, grouped by environment.  A
    table, a column or an environment without data gives no row; a measure that
    an operation does not need is null.
    """
    wanted = staged(wanted, "wanted")
    specs = wanted.select("schema_name", "table_name", "operation", "subject", "columns", "target").distinct().collect()
    parts = []
    for name, df in tables.items():
        schema, table = name if isinstance(name, tuple) else (None, name)
        aggs: list[Column] = []
        entries = []
        for spec in specs:
            if spec.table_name != table or schema not in (None, spec.schema_name):
                continue
            found = _measure(df, spec)
            if found is None:
                continue
            at = {m: f"_m{len(aggs) + i}" for i, m in enumerate(found)}
            aggs += [c.alias(at[m]) for m, c in found.items()]
            entries.append(F.struct(
                *[F.lit(spec[c]).alias(c) for c in ("schema_name", "table_name", "operation", "subject", "target")],
                F.array(*map(F.lit, spec.columns)).cast("array<string>").alias("columns"),
                *[(F.col(at[m]) if m in at else F.lit(None)).cast("bigint").alias(m) for m in MEASURES]))
        if entries:
            parts.append(df.groupBy("env_id").agg(*aggs).select("env_id", F.inline(F.array(*entries))))
    if not parts:
        return wanted.select(*SUBJECT, *[F.lit(None).cast("bigint").alias(m) for m in MEASURES]).limit(0)
    found = reduce(DataFrame.unionByName, parts).withColumnsRenamed({c: f"_{c}" for c in (*SUBJECT, "columns", "target")})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*SUBJECT, "columns", "target")])
    return wanted.join(found.hint("merge"), same).select(*SUBJECT, *MEASURES)
