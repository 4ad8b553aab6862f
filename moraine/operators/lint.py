"""Lint of an inventory: structural mistakes, one row per issue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from moraine.functions.typenames import KNOWN_TYPES, base_type
from moraine.operators.inventory import TABLE_KEY
from moraine.session import staged

# Issue codes that only warn; all others are errors.
WARNINGS = ("empty_table", "no_primary_key", "duplicate_index")


def _issues(code: str, subjects: Column) -> Column:
    severity = "warning" if code in WARNINGS else "error"
    return F.transform(subjects, lambda s: F.struct(
        F.lit(code).alias("code"), F.lit(severity).alias("severity"), s.alias("subject")
    ))


def _repeats(names: Column) -> Column:
    """Every occurrence of a name after its first."""
    return F.array_compact(F.transform(names, lambda n, i: F.when(F.array_contains(F.slice(names, 1, i), n), n)))


def lint_inventory(tables: DataFrame, cols: DataFrame, idx: DataFrame, fks: DataFrame) -> DataFrame:
    """Issues of every table: ``code, severity, subject``.

    All parts of a table meet in one exchange; its own issues are then found
    inside its row, from lists as long as the table is wide.  Only the target of
    a foreign key lies outside the table and is joined: a table of the same
    schema, or of the key's ``ref_schema`` where there is one.
    """
    parts = [
        tables.select(*TABLE_KEY, F.lit(True).alias("_t")),
        cols.select(*TABLE_KEY, F.struct("column_name", "type_raw", "is_pk").alias("_c")),
        idx.select(*TABLE_KEY, F.struct("index_name", "ordinal", "column_name").alias("_x")),
        fks.select(*TABLE_KEY, F.struct("fk_name", "column_name").alias("_f")),
    ]
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    whole = together.groupBy(*TABLE_KEY).agg(
        F.bool_or("_t").alias("_t"), *[F.collect_list(c).alias(c) for c in ("_c", "_x", "_f")]
    ).withColumn("_names", F.transform("_c", lambda c: c["column_name"]))
    none = F.array().cast("array<string>")
    known = F.col("_t").isNotNull()

    def on_table(test: Column) -> Column:
        return F.when(known & test, F.array("table_name")).otherwise(none)

    def unknown(column: str, label: str) -> Column:
        strays = F.filter(column, lambda r: ~F.array_contains("_names", r["column_name"]))
        return F.transform(strays, lambda r: F.concat_ws(".", r[label], r["column_name"]))

    # an index is one entry per key column; its first column stands for the index
    index_names = F.transform(F.filter("_x", lambda x: x["ordinal"] == 1), lambda x: x["index_name"])
    found = F.concat(
        _issues("empty_table", on_table(F.size("_c") == 0)),
        _issues("no_primary_key", on_table(~F.exists("_c", lambda c: F.coalesce(c["is_pk"], F.lit(False))))),
        _issues("duplicate_column", _repeats(F.col("_names"))),
        _issues("missing_type", F.transform(F.filter("_c", lambda c: c["type_raw"] == ""), lambda c: c["column_name"])),
        _issues("invalid_fk_column", unknown("_f", "fk_name")),
        _issues("duplicate_index", _repeats(index_names)),
        _issues("invalid_index_column", unknown("_x", "index_name")),
    )
    own = whole.select(*TABLE_KEY, F.inline(found))
    schema = F.coalesce("ref_schema", "schema_name") if "ref_schema" in fks.columns else F.col("schema_name")
    there = tables.select("env_id", F.col("schema_name").alias("_s"), F.col("table_name").alias("ref_table")).distinct()
    targets = fks.select(*TABLE_KEY, "fk_name", "ref_table", schema.alias("_s")).distinct().join(
        there.hint("merge"), ["env_id", "_s", "ref_table"], "left_anti"
    )
    missing = targets.select(
        *TABLE_KEY, F.lit("invalid_fk_table").alias("code"), F.lit("error").alias("severity"),
        F.concat_ws(".", "fk_name", "ref_table").alias("subject"),
    )
    return own.unionByName(missing)


def lint_duplicate_pk(declarations: DataFrame) -> DataFrame:
    """Tables with more than one primary-key declaration.

    ``declarations``: one row per declaration, a table constraint or a single
    column's own clause.
    """
    return declarations.groupBy(*TABLE_KEY).agg(F.count(F.lit(1)).alias("declarations")).filter("declarations > 1")


def lint_unknown_type(cols: DataFrame, known: tuple[str, ...] = KNOWN_TYPES) -> DataFrame:
    """Columns whose type is not a known name, with the nearest known one.

    Spellings are few however many columns there are: the distances to all known
    names are computed once per distinct unknown spelling, and the columns then
    look theirs up.
    """
    named = cols.withColumn("_base", F.lower(base_type(F.col("type_raw")))).filter(
        (F.col("_base") != "") & ~F.col("_base").isin(*known)
    )
    near = F.array_min(F.array(*[F.struct(F.levenshtein("_base", F.lit(k)).alias("distance"), F.lit(k).alias("name")) for k in known]))
    spellings = staged(named.select("_base").distinct().select("_base", near.alias("_near")), "spellings")
    return named.select(*TABLE_KEY, "column_name", "type_raw", "_base").join(spellings, "_base").select(
        *TABLE_KEY, "column_name", "type_raw",
        F.col("_near.name").alias("nearest_type"), F.col("_near.distance").alias("distance"),
    )
