"""Phased migrations: expand/contract, type change, validation, deprecation.

Each phase is lazy.  A gate between phases is a one-row aggregate, and a phase
that must not run raises.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from moraine.operators.checks import (
    NotNull, RowRule, check_unique, dedupe_keep_first, observe_row_rules,
)
from moraine.operators.measures import backfill_gap_count, content_compare, pending
from moraine.session import staged
from moraine.sources.files import list_names, read_text, replace_text

MANIFEST = "_finished"


class GateError(RuntimeError):
    """A check between two phases did not hold."""


# ------------------------------------------------------------ expand / contract


def expand_backfill(df: DataFrame, old: str, new: str, data_type: str | None = None) -> DataFrame:
    """Add ``new`` if absent and fill it from ``old`` where it is null."""
    target = data_type or dict(df.dtypes)[old]
    source = F.col(old).cast(target)
    return df.withColumn(new, F.coalesce(F.col(new), source) if new in df.columns else source)


def contract_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """Drop ``old``; refused while any row still lacks ``new``."""
    gap = backfill_gap_count(df, new, old).first()["gap"]
    if gap:
        raise GateError(f"{gap} rows have {old} but no {new}")
    return df.drop(old)


def contract_rollback(df: DataFrame, old: str, new: str, data_type: str | None = None) -> DataFrame:
    """Bring ``old`` back, filled from ``new``."""
    value = F.col(new)
    return df.withColumn(old, value.cast(data_type) if data_type else value)


# ------------------------------------------------------------------ type change


def type_change_backfill(
    df: DataFrame, old: str, new: str, data_type: str, conversion: str | None = None
) -> DataFrame:
    """Convert ``old`` into ``new`` on the rows still pending; others keep what they have."""
    converted = (F.col(old) if conversion is None else F.expr(conversion)).cast(data_type)
    if new not in df.columns:
        df = df.withColumn(new, F.lit(None).cast(data_type))
    return df.withColumn(new, F.when(pending(new, old), converted).otherwise(F.col(new)))


def type_change_finish(df: DataFrame, old: str, new: str) -> DataFrame:
    """Drop ``old`` and give its name and its place to ``new``."""
    return df.select(*[F.col(new).alias(old) if c == old else F.col(c) for c in df.columns if c != new])


def type_change_clear(df: DataFrame, new: str) -> DataFrame:
    """Rollback of a backfill: ``new`` is null again on all rows."""
    return df.withColumn(new, F.lit(None).cast(dict(df.dtypes)[new]))


def rollback_loss(df: DataFrame, new: str, written_at: str, cut_over: Column) -> DataFrame:
    """Rows written to ``new`` since the cut-over, which a rollback would lose."""
    lost = F.col(new).isNotNull() & (F.col(written_at) >= cut_over)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(lost).alias("lost_rows"))


# ------------------------------------------------------------------- validation


def null_backfill(df: DataFrame, column: str, value: str) -> DataFrame:
    """Fill nulls with a typed expression of the caller's."""
    return df.withColumn(column, F.coalesce(F.col(column), F.expr(value).cast(dict(df.dtypes)[column])))


def not_null_migration(df: DataFrame, column: str, value: str, rules: Sequence[RowRule] = ()) -> DataFrame:
    """Backfill and validate NOT NULL and any further rules in one pass; the staged outcome may be published."""
    seen = Observation(f"not_null_{uuid.uuid4().hex}")
    filled = staged(observe_row_rules(null_backfill(df, column, value), [NotNull(column), *rules], seen), "not-null")
    broken = [rule for rule, n in seen.get.items() if rule != "rows" and n]
    if broken:
        raise GateError(f"rules fail after the backfill: {broken}")
    return filled


def unique_migration(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row of each key and validate UNIQUE on the staged outcome, by the hashes of its keys."""
    kept = staged(dedupe_keep_first(df, keys, order), "unique")
    broken = check_unique(kept, keys).limit(1).count()
    if broken:
        raise GateError("keys repeat after the dedupe")
    return kept


def _bucket(key: str, size: int) -> Column:
    # whole-number arithmetic: exact for any long key
    return F.expr(f"(`{key}` - pmod(`{key}`, {size}L)) div {size}L")


def batched_backfill(df: DataFrame, key: str, size: int, new: str, old: str) -> DataFrame:
    """Progress by key range: ``bucket, rows, pending, done``; work is left where pending > 0."""
    todo = pending(new, old)
    return df.groupBy(_bucket(key, size).alias("bucket")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(todo).alias("pending"),
        F.count_if(F.col(new).isNotNull() & F.col(old).isNotNull()).alias("done"),
    )


def backfill_pending_batches(
    df: DataFrame, key: str, size: int, new: str, old: str, data_type: str, path: str
) -> None:
    """Fill and write only the buckets that still have pending rows, one folder per bucket.

    ``path`` uses dynamic partition overwrite, so a rerun after a failure
    rewrites the unfinished buckets and leaves the finished ones alone.
    """
    todo = staged(batched_backfill(df, key, size, new, old).filter("pending > 0").select("bucket"), "pending")
    bucketed = df.withColumn("bucket", _bucket(key, size))
    filled = type_change_backfill(bucketed.join(todo, "bucket", "left_semi"), old, new, data_type)
    # key ranges spread a large bucket over several tasks and files
    (
        filled.repartitionByRange("bucket", key)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    )


def run_backfill(
    df: DataFrame, key: str, size: int, new: str, old: str, data_type: str, path: str, batches: int = 16, stop_after: int | None = None
) -> int:
    """Backfill the whole table in batches of key ranges, each written once; returns how many batches this run wrote.

    A batch covers a run of buckets of ``size`` keys, and its range reaches the
    scan as a filter.  It is written to a folder of its own and then entered in
    the manifest beside it; a run that was stopped or killed goes on with the
    batches that are not entered, overwriting what a lost one has left.  The
    manifest holds the split, so a later run keeps it even if the table grew: new
    keys below or above fall into the first or the last range, and rows with a
    null key are a batch of their own.  ``stop_after`` ends the run early.
    """
    spark, root = df.sparkSession, path.rstrip("/")
    noted = read_text(spark, f"{root}/{MANIFEST}/split")
    if noted is None:
        low, high = df.agg(F.min(key), F.max(key)).first()
        first, last = (0, 0) if low is None else (low // size, high // size)
        step = max(1, -(-(last - first + 1) // batches))
        split = {"key": key, "size": size, "new": new, "old": old, "type": data_type,
                 "edges": [b * size for b in range(first + step, last + 1, step)]}
        replace_text(spark, f"{root}/{MANIFEST}/split", json.dumps(split))
    else:
        split = json.loads(noted)
        asked = {"key": key, "size": size, "new": new, "old": old, "type": data_type}
        if any(split[k] != v for k, v in asked.items()):
            raise GateError(f"{root} holds another backfill: {noted}")
    edges = split["edges"]
    ranges = {"null": F.col(key).isNull()}
    for i in range(len(edges) + 1):
        above = F.lit(True) if i == 0 else F.col(key) >= edges[i - 1]
        ranges[str(i)] = above & (F.lit(True) if i == len(edges) else F.col(key) < edges[i]) & F.col(key).isNotNull()
    wrote = 0
    finished = set(list_names(spark, f"{root}/{MANIFEST}"))
    for name, wanted in ranges.items():
        if f"batch-{name}" in finished:
            continue
        if stop_after is not None and wrote >= stop_after:
            break
        part = df.filter(wanted)
        seen = Observation()
        filled = type_change_backfill(part, old, new, data_type).observe(seen, F.count(F.lit(1)).alias("rows"))
        filled.write.mode("overwrite").parquet(f"{root}/batch-{name}")
        replace_text(spark, f"{root}/{MANIFEST}/batch-{name}", json.dumps({"rows": seen.get["rows"]}))
        wrote += 1
    return wrote


def read_backfill(spark, path: str) -> DataFrame:
    """The rows of all finished batches; refused while any is missing."""
    root = path.rstrip("/")
    split = read_text(spark, f"{root}/{MANIFEST}/split")
    done = [n for n in list_names(spark, f"{root}/{MANIFEST}") if n.startswith("batch-")] if split else []
    missing = {"batch-null", *(f"batch-{i}" for i in range(len(json.loads(split)["edges"]) + 1))} - set(done) if split else {"all"}
    if missing:
        raise GateError(f"backfill at {root} has not finished: {sorted(missing)}")
    return spark.read.parquet(*[f"{root}/{n}" for n in done])


# ------------------------------------------------------- archive and deprecation


def archive_column(df: DataFrame, keys: Sequence[str], column: str, archived_at: Column) -> DataFrame:
    """Key, value and archive time of every row that holds a value."""
    return df.filter(F.col(column).isNotNull()).select(*keys, column, archived_at.alias("archived_at"))


def archive_table(df: DataFrame, archived_at: Column) -> DataFrame:
    return df.withColumn("archived_at", archived_at)


def archive_verify(source: DataFrame, archive: DataFrame) -> DataFrame:
    """Counts and contents compared, one row: ``left_rows, right_rows, rows_match, content_matches``."""
    return content_compare(source, archive, source.columns).select(
        "left_rows", "right_rows", (F.col("left_rows") == F.col("right_rows")).alias("rows_match"),
        F.col("matches").alias("content_matches"))


def archive_restore(df: DataFrame, archive: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Put the archived values back by key; rows without an archived value get null.

    Of several archived values of a key the one archived last counts.
    """
    time = F.col("archived_at") if "archived_at" in archive.columns else F.lit(0)
    latest = archive.groupBy(*keys).agg(F.max_by(column, F.struct(time, F.col(column))).alias(column))
    return df.drop(column).join(latest, list(keys), "left")


def drop_table_guard(
    foreign_keys: DataFrame, table: str, schema: str | None = None, env: str | None = None
) -> DataFrame:
    """Foreign keys of other tables that still reference the table; empty when it may go.

    With a schema or an environment only keys to the table of that one count.  A
    key without ``ref_schema`` references its own schema.
    """
    target = F.col("schema_name")
    if "ref_schema" in foreign_keys.columns:
        target = F.coalesce("ref_schema", "schema_name")
    to_it, itself = F.col("ref_table") == table, F.col("table_name") == table
    if schema is not None:
        to_it, itself = to_it & (target == schema), itself & (F.col("schema_name") == schema)
    elif "schema_name" in foreign_keys.columns:
        itself = itself & (F.col("schema_name") == target)
    if env is not None:
        to_it = to_it & (F.col("env_id") == env)
    return foreign_keys.filter(to_it & ~itself)


def drop_table(
    tables: Mapping[str, DataFrame], name: str, foreign_keys: DataFrame, archive: DataFrame,
    schema: str | None = None, env: str | None = None,
) -> dict:
    """Remove a table once nothing references it and its archive is complete."""
    if not drop_table_guard(foreign_keys, name, schema, env).isEmpty():
        raise GateError(f"other tables still reference {name}")
    verdict = archive_verify(tables[name], archive).first()
    if not (verdict.rows_match and verdict.content_matches):
        raise GateError(f"the archive of {name} is not complete")
    return {n: df for n, df in tables.items() if n != name}


# ---------------------------------------------------------------------- sampling


def sample_production(
    df: DataFrame, key: str, stratum: str, modulus: int, extremes: Sequence[str], mask: Sequence[str] = ()
) -> DataFrame:
    """An anonymised sample that keeps, per stratum, the rows at the extremes and a row with a null.

    A row is drawn by a hash of its key, so the same rows are drawn on every
    run.  Per stratum and listed column the lowest key among the rows at its
    minimum, at its maximum, and at null is added.  ``mask`` columns are
    replaced by their SHA-256.
    """
    lows = [F.min(c).alias(f"_lo{i}") for i, c in enumerate(extremes)]
    highs = [F.max(c).alias(f"_hi{i}") for i, c in enumerate(extremes)]
    bounds = staged(df.groupBy(stratum).agg(*lows, *highs), "bounds").withColumnRenamed(stratum, "_stratum")
    at = []
    for i, c in enumerate(extremes):
        at += [F.col(c) == F.col(f"_lo{i}"), F.col(c) == F.col(f"_hi{i}"), F.col(c).isNull()]
    # plain minima of numbers: hash aggregation, nothing is sorted
    beside = df.join(bounds, F.col(stratum).eqNullSafe(F.col("_stratum")))
    picks = beside.groupBy(stratum).agg(*[F.min(F.when(test, F.col(key))).alias(f"_k{i}") for i, test in enumerate(at)])
    edges = staged(
        picks.select(F.explode(F.array(*[f"_k{i}" for i in range(len(at))])).alias(key))
        .filter(F.col(key).isNotNull()).distinct(), "edges",
    ).withColumn("_edge", F.lit(True))
    digest = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint")
    drawn = df.join(edges, key, "left").filter((digest % modulus == 0) | F.col("_edge").isNotNull()).drop("_edge")
    return drawn.select(*[
        F.sha2(F.col(c).cast("string"), 256).alias(c) if c in mask else F.col(c) for c in df.columns
    ])
