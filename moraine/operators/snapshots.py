"""Comparing and merging two states of the same table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from moraine.operators.measures import fingerprint, row_hash
from moraine.session import staged

NO_KEY = -(1 << 63)  # leaf of rows whose first key is null


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of inserted, updated and deleted rows; the keys are unique in each snapshot.

    Only the key and a 128-bit digest per row take part in the join, so the
    width of the table does not matter to the shuffle.  ``snapshot_diff_exact``
    compares the values themselves and names the changed columns.
    """
    columns = [c for c in old.columns if c not in keys]

    def digest(df: DataFrame) -> Column:
        return F.struct(row_hash(df, columns), row_hash(df, columns, "second"))

    a = old.select(*keys, digest(old).alias("_a"))
    b = new.select(*keys, digest(new).alias("_b"))
    change = F.when(F.col("_a").isNull(), "inserted").when(F.col("_b").isNull(), "deleted").when(
        F.col("_a") != F.col("_b"), "updated"
    )
    joined = a.join(b, list(keys), "full_outer")
    return joined.select(*keys, change.alias("change")).filter("change is not null")


def leaf_of(df: DataFrame, keys: Sequence[str], width: int, leaves: int = 1 << 16) -> Column:
    """Number of the range of keys a row belongs to.

    Whole numbers, dates and timestamps (by seconds) fall into ranges of
    ``width`` of the first key, other keys into ``leaves`` ranges of a hash.
    """
    first, kind = F.col(keys[0]), df.schema[keys[0]].dataType
    if isinstance(kind, T.IntegralType):
        number = first.cast("bigint")
    elif isinstance(kind, T.DateType):
        number = F.unix_date(first).cast("bigint")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        number = F.unix_seconds(first.cast("timestamp"))
    else:
        return F.when(first.isNull(), F.lit(NO_KEY)).otherwise(F.pmod(F.xxhash64(*keys), F.lit(leaves)).cast("bigint"))
    return F.coalesce((number - F.pmod(number, F.lit(width))) / F.lit(width), F.lit(NO_KEY)).cast("bigint")


def digest_leaves(df: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """``leaf`` with count and digests of its rows: one aggregate, combined before the shuffle, one row per range of keys.

    It may be kept beside a snapshot; comparing two snapshots then starts from
    two such tables and reads no rows where nothing differs.
    """
    return df.groupBy(leaf_of(df, keys, width).alias("leaf")).agg(*fingerprint(df, df.columns))


def differing_leaves(old: DataFrame, new: DataFrame, fanout: int = 64) -> DataFrame:
    """Leaves whose digests differ, found from the root down.

    The digests of a node are the sums of its children's, so each level is an
    aggregate of the leaves below the nodes that differ, and equal snapshots end
    at the root.  ``old`` and ``new`` are tables of ``digest_leaves``, whose
    size is that of the keys' range, not of the rows.
    """
    sides = old.withColumn("_s", F.lit(1)).unionByName(new.withColumn("_s", F.lit(-1)))
    span = sides.filter(F.col("leaf") != NO_KEY).agg(F.min("leaf"), F.max("leaf")).first()
    depth = 0
    if span[0] is not None:
        while span[1] // fanout**depth - span[0] // fanout**depth >= fanout:
            depth += 1
    below = sides
    for level in range(depth, -1, -1):
        step = fanout**level
        node = F.when(F.col("leaf") == NO_KEY, F.col("leaf")).otherwise((F.col("leaf") - F.pmod("leaf", F.lit(step))) / step).cast("bigint")
        signed = [F.sum(F.col(c) * F.col("_s")).alias(c) for c in ("n", "low", "high")]
        # null keys never match, so their rows always differ
        differs = (F.col("n") != 0) | (F.col("x") != 0) | (F.col("low") != 0) | (F.col("high") != 0) | (F.col("_node") == NO_KEY)
        nodes = staged(below.groupBy(node.alias("_node")).agg(F.expr("bit_xor(x)").alias("x"), *signed)
                       .filter(differs).select("_node"), "digest-nodes")
        if nodes.isEmpty():
            return sides.select("leaf").limit(0)
        below = below.withColumn("_node", node).join(nodes, "_node", "left_semi").drop("_node")
    return below.select("leaf").distinct()


def snapshot_diff_tree(old: DataFrame, new: DataFrame, keys: Sequence[str], width: int = 4096, fanout: int = 64,
                       old_leaves: DataFrame | None = None, new_leaves: DataFrame | None = None) -> DataFrame:
    """The same answer as ``snapshot_diff``, moving only rows of key ranges that differ.

    Each side is read once for its digests, unless they were kept, and once more
    for the rows of the differing ranges; if none differ nothing is joined.
    """
    columns = old.columns
    new = new.select(*columns)
    if old_leaves is None:
        old_leaves = staged(digest_leaves(old, keys, width), "digests")
    if new_leaves is None:
        new_leaves = staged(digest_leaves(new, keys, width), "digests")
    leaves = staged(differing_leaves(old_leaves, new_leaves, fanout), "leaves")

    def touched(df: DataFrame) -> DataFrame:
        return df.withColumn("_leaf", leaf_of(df, keys, width)).join(
            leaves.withColumnRenamed("leaf", "_leaf"), "_leaf", "left_semi").select(*columns)

    return snapshot_diff(touched(old), touched(new), keys)


def snapshot_diff_exact(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As ``snapshot_diff``, comparing every value, and naming the changed columns."""
    columns = [c for c in old.columns if c not in keys]
    a = old.select(*keys, F.struct(*columns).alias("_a"), F.lit(True).alias("_in_a"))
    b = new.select(*keys, F.struct(*columns).alias("_b"), F.lit(True).alias("_in_b"))
    both = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    changed = F.array_compact(F.array(*[
        F.when(both & ~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in columns
    ]))
    change = F.when(F.col("_in_a").isNull(), "inserted").when(F.col("_in_b").isNull(), "deleted").when(
        F.size(changed) > 0, "updated"
    )
    return a.join(b, list(keys), "full_outer").select(
        *keys, change.alias("change"), changed.alias("columns")
    ).filter("change is not null")


def backup_merge(current: DataFrame, backup: DataFrame, keys: Sequence[str], predicate: str) -> DataFrame:
    """The current table plus the backup's rows it lacks, restricted by the predicate.

    Keys are compared as values: a null equals a null, so a backup row with a
    null key comes back unless the current table has that key.  Restored rows
    take the present columns: what the backup lacks is null, what the present
    table no longer has is left out.
    """
    wanted = backup.filter(predicate)

    def by_key() -> Column:
        return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])

    def only_keys(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])

    # keys meet keys; only the rows that are missing follow
    lost = staged(only_keys(wanted.select(*keys).join(only_keys(current), by_key(), "left_anti").distinct()), "missing")
    missing = wanted.join(lost, by_key(), "left_semi")
    kept = missing.select(*[c for c in missing.columns if c in current.columns])
    return current.unionByName(kept, allowMissingColumns=True)
