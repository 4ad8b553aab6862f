"""Publishing a changed table all-or-nothing: write, check, then switch a pointer.

A published table is a folder of immutable versions and one small pointer file
naming the current version.  Data is staged under a new version name, the rules
run on what was actually written, and only then the pointer moves.  A failed
check or a lost job leaves the pointer, and so every reader, on the old version.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from moraine.operators.checks import KeyRule, RowRule, check_summary
from moraine.operators.evolve import recreate_copy
from moraine.sources.files import delete, read_text, replace_text

POINTER = "_CURRENT"


class PublishError(RuntimeError):
    """A check failed on the staged data; the published version is unchanged."""


class StaleError(RuntimeError):
    """The table moved on since the change was computed."""


def current_version(spark: SparkSession, root: str) -> str | None:
    return read_text(spark, f"{root.rstrip('/')}/{POINTER}")


def read_published(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """The current version; a table partitioned into folders is best read with its schema."""
    version = current_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"nothing is published at {root}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{root.rstrip('/')}/{version}")


def publish_table(
    df: DataFrame,
    root: str,
    rules: Sequence[RowRule | KeyRule] = (),
    parents: Mapping[str, DataFrame] | None = None,
    expected_version: str | None = None,
    partition_by: Sequence[str] = (),
) -> str:
    """Stage, check and publish; returns the new version.

    With ``expected_version`` the switch is refused when another version has
    been published in the meantime.  The test and the switch are two steps, so
    a table has one publisher at a time; readers need no such care.
    """
    spark, root = df.sparkSession, root.rstrip("/")
    version = f"v-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{root}/{version}")
    if rules:
        staged = spark.read.schema(df.schema).parquet(f"{root}/{version}")
        # one row per declared rule
        broken = [
            f"{r.rule}: {r.violations} of {r.rows} rows"
            for r in check_summary(staged, rules, parents).filter(~F.col("passed")).collect()
        ]
        if broken:
            delete(spark, f"{root}/{version}")
            raise PublishError(f"not published: {'; '.join(broken)}")
    if expected_version is not None and current_version(spark, root) != expected_version:
        delete(spark, f"{root}/{version}")
        raise StaleError(f"{root} is no longer at {expected_version}")
    replace_text(spark, f"{root}/{POINTER}", version)
    return version


@dataclass(frozen=True)
class Staged:
    """A table of a set that is published together."""

    df: DataFrame
    rules: tuple[RowRule | KeyRule, ...] = ()
    partition_by: tuple[str, ...] = ()


def definition_hash(schemas: Mapping[str, T.StructType]) -> str:
    """SHA-256 of the names, columns and types of a set of tables, in name order."""
    text = json.dumps({n: [(f.name, f.dataType.simpleString()) for f in s.fields] for n, s in sorted(schemas.items())}, sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()


def current_set(spark: SparkSession, root: str) -> dict:
    """The manifest of a published set: ``{"tables": {name: folder}, "hash": ..}``, empty before the first."""
    text = read_text(spark, f"{root.rstrip('/')}/{POINTER}")
    return json.loads(text) if text else {"tables": {}, "hash": None}


def read_set(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All tables of the published set, of one and the same version."""
    return {n: spark.read.parquet(f"{root.rstrip('/')}/{folder}") for n, folder in current_set(spark, root)["tables"].items()}


def publish_tables(
    spark: SparkSession, root: str, tables: Mapping[str, Staged], expected_hash: str | None = None, drop: Sequence[str] = ()
) -> dict:
    """Publish a change of several tables together: all of them or none; returns the new manifest.

    Every table is staged and checked against its rules, foreign keys against
    the staged tables of the set first and the published ones else; one manifest
    then names all folders, and moving it is the only visible step.  Tables that
    are not part of the change stay where they are.  With ``expected_hash`` (of
    the set the change was planned on) nothing is written when the published
    definitions have moved since, and nothing is switched when they move
    meanwhile; a set has one publisher at a time.
    """
    root = root.rstrip("/")
    before = current_set(spark, root)

    def unmoved(now: dict) -> None:
        if expected_hash is not None and now["hash"] != expected_hash:
            raise StaleError(f"{root} is no longer at {expected_hash}")

    unmoved(before)
    version, schemas, made = uuid.uuid4().hex, {}, {}
    try:
        for name, table in tables.items():
            made[name] = f"{name}/v-{version}"
            table.df.write.mode("errorifexists").partitionBy(*table.partition_by).parquet(f"{root}/{made[name]}")
        kept = {n: f for n, f in before["tables"].items() if n not in made and n not in drop}
        everything = {n: spark.read.parquet(f"{root}/{f}") for n, f in kept.items()}
        everything |= {n: spark.read.schema(t.df.schema).parquet(f"{root}/{made[n]}") for n, t in tables.items()}
        schemas = {n: df.schema for n, df in everything.items()}
        broken = [
            f"{name}: {r.rule}: {r.violations} of {r.rows} rows" for name, table in tables.items() if table.rules
            for r in check_summary(everything[name], table.rules, everything).filter(~F.col("passed")).collect()
        ]
        if broken:
            raise PublishError(f"not published: {'; '.join(broken)}")
        now = current_set(spark, root)
        unmoved(now)
        if now != before:
            raise StaleError(f"{root} was published meanwhile")
    except BaseException:
        for folder in made.values():
            delete(spark, f"{root}/{folder}")
        raise
    manifest = {"tables": kept | made, "hash": definition_hash(schemas)}
    replace_text(spark, f"{root}/{POINTER}", json.dumps(manifest))
    return manifest


def recreate_table(
    df: DataFrame,
    columns: Sequence[tuple[str, str]],
    root: str,
    rules: Sequence[RowRule | KeyRule] = (),
    parents: Mapping[str, DataFrame] | None = None,
) -> str:
    """Rebuild a table under a new definition and its rules, as one published step."""
    return publish_table(recreate_copy(df, columns), root, rules, parents)


def unpublish_table(spark: SparkSession, root: str) -> bool:
    """Drop a published table: first the pointer, so no reader finds half of it, then the versions.

    Call it once ``plans.phases.drop_table`` has found no references to the table
    and its archive complete.
    """
    known = delete(spark, f"{root.rstrip('/')}/{POINTER}")
    delete(spark, root)
    return known
