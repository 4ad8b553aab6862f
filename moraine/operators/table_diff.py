"""Both sides of a table in one row, and what differs between them.

Tables, columns, indexes and foreign keys of the current and the desired side
are tagged, brought together by table in a single exchange, and compared inside
the row: two maps by name are zipped, so nothing is joined.  Reports, hashes of
differences and verdicts all read this row.  What it holds is the columns and
keys of one table.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from moraine.functions.typenames import logical_type
from moraine.operators.inventory import TABLE_KEY

COLUMN_FIELDS = ["type", "nullable", "default", "is_primary_key"]
INDEX_FIELDS = ["column_names", "is_unique"]
FK_FIELDS = ["column_names", "ref_table", "ref_columns", "on_delete", "on_update"]
KINDS = ("columns", "indexes", "foreign_keys")


def nested_diff(current, desired, kinds: Sequence[str] = KINDS, by: Sequence[str] = TABLE_KEY) -> DataFrame:
    """One row per table of either inventory.

    ``status`` is added, removed or both; ``old_rls_enabled``, ``new_rls_enabled``;
    and for each of ``kinds`` that both sides have, an array of what was added,
    removed or modified, with ``old_*``, ``new_*``, ``status`` and ``changes``
    (empty unless the table is on both sides).  ``desired_columns``,
    ``desired_primary_key`` and ``desired_keys`` hold the names of all desired
    columns, those of the primary key, and the foreign keys that have no namesake on the current side, new tables included.  The only
    exchange is by ``by``, a part of the table's key.
    """
    have = {"columns": True, "indexes": current.idx is not None and desired.idx is not None,
            "foreign_keys": current.fks is not None and desired.fks is not None}
    kinds = [k for k in kinds if have[k]]
    parts, aggs = [], []
    for side, inv in (("old", current), ("new", desired)):
        rows = {"tables": inv.tables.select(*TABLE_KEY, F.struct("rls_enabled").alias(f"_tables_{side}"))}
        if "columns" in kinds:
            rows["columns"] = inv.cols.filter("column_name is not null").select(*TABLE_KEY, F.struct(
                F.col("column_name").alias("name"), "ordinal", logical_type(F.col("type_raw")).alias("type"), "nullable",
                F.col("default_raw").alias("default"), F.col("is_pk").alias("is_primary_key")).alias(f"_columns_{side}"))
        if "indexes" in kinds:
            rows["indexes"] = inv.idx.filter("index_name is not null").select(*TABLE_KEY, F.struct(
                F.col("index_name").alias("name"), "ordinal", "column_name", "is_unique").alias(f"_indexes_{side}"))
        if "foreign_keys" in kinds:
            schema = F.col("ref_schema") if "ref_schema" in inv.fks.columns else F.lit(None).cast("string")
            rows["foreign_keys"] = inv.fks.filter("fk_name is not null").select(*TABLE_KEY, F.struct(
                F.col("fk_name").alias("name"), "ordinal", "column_name", "ref_column", "ref_table", "on_delete", "on_update",
                schema.alias("ref_schema")).alias(f"_foreign_keys_{side}"))
        parts += rows.values()
        aggs += [F.first(f"_{k}_{side}", ignorenulls=True).alias(f"_{k}_{side}") if k == "tables" else
                 F.array_sort(F.collect_list(f"_{k}_{side}")).alias(f"_{k}_{side}") for k in rows]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if list(by) != TABLE_KEY:
        together = together.repartition(*by)
    # rows of a table that neither side lists belong to nothing
    grouped = together.groupBy(*TABLE_KEY).agg(*aggs).filter("_tables_old is not null or _tables_new is not null")
    added, removed = F.col("_tables_old").isNull(), F.col("_tables_new").isNull()
    status = F.when(added, "added").when(removed, "removed").otherwise("both")
    out = grouped.withColumn("status", status)
    both = F.col("status") == "both"
    build = {"columns": (_columns_of, "column_name", [*COLUMN_FIELDS, "ordinal"], COLUMN_FIELDS),
             "indexes": (_indexes_of, "index_name", INDEX_FIELDS, INDEX_FIELDS),
             "foreign_keys": (_foreign_keys_of, "fk_name", FK_FIELDS, FK_FIELDS)}
    shown = []
    for kind in kinds:
        make, name, fields, compared = build[kind]
        out = out.withColumns({f"_{kind}_{s}": make(F.col(f"_{kind}_{s}")) for s in ("old", "new")})
        merged = _merged(F.col(f"_{kind}_old"), F.col(f"_{kind}_new"), name, fields, compared)
        shown.append(F.when(both, merged).otherwise(F.array().cast(_diff_type(out, kind, name, fields))).alias(kind))
    if "columns" in kinds:
        shown.append(F.map_keys("_columns_new").alias("desired_columns"))
        keys = F.map_filter("_columns_new", lambda _, c: F.coalesce(c["is_primary_key"], F.lit(False)))
        shown.append(F.map_keys(keys).alias("desired_primary_key"))
    if "foreign_keys" in kinds:
        fresh = F.map_filter("_foreign_keys_new", lambda k, _: ~F.map_contains_key(F.col("_foreign_keys_old"), k))
        shown.append(F.map_entries(fresh).alias("desired_keys"))
    return out.select(*TABLE_KEY, "status", F.col("_tables_old.rls_enabled").alias("old_rls_enabled"),
                      F.col("_tables_new.rls_enabled").alias("new_rls_enabled"), *shown)


def _columns_of(rows: Column) -> Column:
    """Columns by name; of a name listed twice the first by position counts."""
    first = F.filter(rows, lambda r, i: (i == 0) | ~r["name"].eqNullSafe(F.get(rows, i - 1)["name"]))
    return F.map_from_entries(F.transform(first, lambda r: F.struct(r["name"], r)))


def _named(rows: Column, build) -> Column:
    """A map by name of bodies built from the rows of each name, in order."""
    names = F.array_distinct(F.transform(rows, lambda r: r["name"]))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, build(F.filter(rows, lambda r: r["name"] == n)))))


def _indexes_of(rows: Column) -> Column:
    return _named(rows, lambda own: F.struct(
        F.transform(own, lambda r: r["column_name"]).alias("column_names"), own[0]["is_unique"].alias("is_unique")))


def _foreign_keys_of(rows: Column) -> Column:
    return _named(rows, lambda own: F.struct(
        F.transform(own, lambda r: r["column_name"]).alias("column_names"), own[0]["ref_table"].alias("ref_table"),
        F.transform(own, lambda r: r["ref_column"]).alias("ref_columns"), own[0]["on_delete"].alias("on_delete"),
        own[0]["on_update"].alias("on_update"), own[0]["ref_schema"].alias("ref_schema")))


def _merged(old: Column, new: Column, name: str, fields: Sequence[str], compared: Sequence[str]) -> Column:
    """The entries of two maps that are on one side only or not the same on both."""
    zipped = F.map_entries(F.map_zip_with(old, new, lambda _, o, n: F.struct(o.alias("o"), n.alias("n"))))

    def entry(e: Column) -> Column:
        o, n = e["value"]["o"], e["value"]["n"]
        status = F.when(o.isNull(), "added").when(n.isNull(), "removed").otherwise("modified")
        differ = F.array_compact(F.array(*[F.when(~o[f].eqNullSafe(n[f]), F.lit(f)) for f in compared]))
        changes = F.when(o.isNull() | n.isNull(), F.array().cast("array<string>")).otherwise(differ)
        return F.struct(e["key"].alias(name), *[o[f].alias(f"old_{f}") for f in fields],
                        *[n[f].alias(f"new_{f}") for f in fields], status.alias("status"), changes.alias("changes"))

    return F.filter(F.transform(zipped, entry), lambda d: (d["status"] != "modified") | (F.size(d["changes"]) > 0))


def _diff_type(df: DataFrame, kind: str, name: str, fields: Sequence[str]) -> str:
    body = df.schema[f"_{kind}_new"].dataType.valueType
    typed = [f"old_{f}:{body[f].dataType.simpleString()}" for f in fields] + [f"new_{f}:{body[f].dataType.simpleString()}" for f in fields]
    return f"array<struct<{name}:string,{','.join(typed)},status:string,changes:array<string>>>"


def unfolded(nested: DataFrame, kind: str) -> DataFrame:
    """The differing columns, indexes or foreign keys as rows."""
    return nested.select(*TABLE_KEY, F.inline(kind))


def touched(nested: DataFrame) -> Column:
    """Whether columns, keys or row security of a table on both sides differ."""
    rls = ~F.col("old_rls_enabled").eqNullSafe(F.col("new_rls_enabled"))
    return (F.col("status") == "both") & reduce(lambda a, b: a | b, [rls, *[F.size(k) > 0 for k in KINDS if k in nested.columns]])


def renames(columns: Column, max_distance: int = 2) -> Column:
    """Pairs (old_name, new_name, distance) of removed and added columns of one type, each in at most one pair.

    Nearest pairs are taken first, then those whose added column comes first,
    then by name.  All pairs of a column prefer the nearer partner, so this is
    the stable matching: no two columns left apart would both rather have each
    other.  The pairs tried are those of one type within one table.
    """
    gone = F.filter(columns, lambda c: c["status"] == "removed")
    made = F.filter(columns, lambda c: c["status"] == "added")

    def pair(g: Column, m: Column) -> Column:
        return F.struct(
            F.levenshtein(F.lower(g["column_name"]), F.lower(m["column_name"])).alias("distance"),
            m["new_ordinal"].alias("place"), m["column_name"].alias("new_name"), g["column_name"].alias("old_name"))

    near = F.array_sort(F.flatten(F.transform(gone, lambda g: F.filter(F.transform(
        F.filter(made, lambda m: m["new_type"].eqNullSafe(g["old_type"])), lambda m: pair(g, m)),
        lambda p: p["distance"] <= max_distance))))
    kind = "array<struct<old_name:string,new_name:string,distance:int>>"

    def take(done: Column, p: Column) -> Column:
        free = ~F.exists(done, lambda d: (d["old_name"] == p["old_name"]) | (d["new_name"] == p["new_name"]))
        one = F.struct(p["old_name"].alias("old_name"), p["new_name"].alias("new_name"), p["distance"].alias("distance"))
        return F.when(free, F.concat(done, F.array(one))).otherwise(done)

    return F.aggregate(near, F.array().cast(kind), take)
