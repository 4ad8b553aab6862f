"""Foreign keys on data: orphans and the effect of deleting parents.

A child table may hold a third of its rows under one key.  Every operator here
therefore first reduces a side to its distinct keys, with a map-side combine,
decides on those, and only then goes back to the rows.  The key set that goes
back is the exceptional one (orphans, deleted keys).  It is staged as a file, so
that its real size decides whether it is broadcast, which leaves the child rows
where they are, or shuffled, where Spark splits the hot partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from moraine.operators.checks import any_null, key_counts
from moraine.session import dropped, staged


def parent_keys(parent: DataFrame, parent_cols: Sequence[str], child_cols: Sequence[str]) -> DataFrame:
    return parent.select(*[F.col(p).alias(c) for c, p in zip(child_cols, parent_cols)]).distinct()


def orphan_keys(
    child: DataFrame, child_cols: Sequence[str], parent: DataFrame, parent_cols: Sequence[str]
) -> DataFrame:
    """Distinct child keys without a parent, with their row count ``n``; a key with a null passes."""
    keyed = key_counts(child.filter(~any_null(child_cols)), child_cols)
    return keyed.join(parent_keys(parent, parent_cols, child_cols), list(child_cols), "left_anti")


def fk_orphans(
    child: DataFrame, child_cols: Sequence[str], parent: DataFrame, parent_cols: Sequence[str]
) -> DataFrame:
    """Child rows whose key has no parent.

    Keys meet keys to find the orphaned ones, now; the rows follow in a
    semi-join with that set when the result is used.
    """
    if len(child_cols) != len(parent_cols):
        raise ValueError("key column counts differ")
    missing = staged(orphan_keys(child, child_cols, parent, parent_cols).drop("n"), "orphans")
    return child.join(missing, list(child_cols), "left_semi")


def _flag(child: DataFrame, child_cols: Sequence[str], deleted: DataFrame, parent_cols: Sequence[str], name: str):
    keys = staged(parent_keys(deleted, parent_cols, child_cols), "deleted").withColumn(name, F.lit(True))
    return child.join(keys, list(child_cols), "left")


def fk_on_delete_set(
    child: DataFrame,
    child_cols: Sequence[str],
    deleted: DataFrame,
    parent_cols: Sequence[str],
    defaults: Mapping[str, Column] | None = None,
) -> DataFrame:
    """SET NULL, or SET DEFAULT with ``defaults``: keys of deleted parents are replaced."""
    flagged = _flag(child, child_cols, deleted, parent_cols, "_gone")
    types = dict(child.dtypes)
    values = {c: (defaults or {}).get(c, F.lit(None)).cast(types[c]) for c in child_cols}
    return flagged.select(*[
        F.when(F.col("_gone"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
        for c in child.columns
    ])


def fk_on_delete_restrict(
    child: DataFrame, child_cols: Sequence[str], deleted: DataFrame, parent_cols: Sequence[str]
) -> DataFrame:
    """Parents that cannot go because a child row still holds their key.

    The deleted keys are staged first: the child table meets them where it lies
    if they are few, and only its rows with such a key are reduced to keys.
    """
    keys = staged(deleted.select(*[F.col(p).alias(c) for c, p in zip(child_cols, parent_cols)]).distinct(), "deleted")
    held = child.select(*child_cols).join(keys, list(child_cols), "left_semi").distinct()
    return deleted.join(held.select(*[F.col(c).alias(p) for c, p in zip(child_cols, parent_cols)]), list(parent_cols), "left_semi")


@dataclass(frozen=True)
class Edge:
    """``child`` rows are deleted with the ``parent`` rows their key points to."""

    child: str
    columns: tuple[str, ...]
    parent: str
    ref_columns: tuple[str, ...]


def _topological(edges: Sequence[Edge], start: str) -> list[str] | None:
    """Tables reached from ``start``, parents before children; None when there is a cycle."""
    reached, frontier = {start}, [start]
    while frontier:
        frontier = [e.child for e in edges if e.parent in frontier and e.child not in reached]
        reached |= set(frontier)
    order, waiting = [], set(reached)
    while waiting:
        free = [t for t in sorted(waiting) if not any(
            e.child == t and e.parent in waiting for e in edges if e.parent in reached
        )]
        if not free:
            return None
        order += free
        waiting -= set(free)
    return order


def fk_on_delete_cascade(
    tables: Mapping[str, DataFrame],
    edges: Sequence[Edge],
    start: str,
    deleted: DataFrame,
    keys: Mapping[str, Sequence[str]] | None = None,
) -> dict[str, tuple[DataFrame, DataFrame]]:
    """``{table: (removed rows, kept rows)}`` when the ``deleted`` rows of ``start`` go.

    Every table that the edges reach from ``start`` is in the result.  An acyclic
    graph is walked in topological order; only the deleted keys of each level are
    staged, the rows stay lazy.  A first table that references itself by its key
    is resolved by path doubling, in logarithmic rounds.  Any other cycle is
    iterated on keys alone until nothing more is removed; ``keys`` then names
    each table's primary key, and the rows are fetched in the end.
    """
    own = [e for e in edges if e.child == e.parent == start]
    if len(own) == 1 and tuple((keys or {}).get(start, ())) == own[0].ref_columns and _topological(
            [e for e in edges if e is not own[0]], start):
        # the only cycle is the first table's reference to itself: that one by doubling, the others in order
        edge = own[0]
        removed, kept = fk_on_delete_cascade_self(tables[start], edge.ref_columns, edge.columns, deleted)
        rest = fk_on_delete_cascade(tables, [e for e in edges if e is not edge], start, removed, keys)
        return rest | {start: (removed, kept)}
    order = _topological(edges, start)
    if order is None:
        return _cascade_cyclic(tables, edges, start, deleted, keys or {})
    result: dict[str, tuple[DataFrame, DataFrame]] = {}
    for name in order:
        df = tables[name]
        if name == start:
            gone, same = deleted.select(*df.columns), list((keys or {}).get(name, df.columns))
            result[name] = (gone, _without(df, staged(gone.select(*same).distinct(), "deleted"), same))
            continue
        incoming = [e for e in edges if e.child == name and e.parent in result]
        flagged = df
        for i, e in enumerate(incoming):
            flagged = _flag(flagged, e.columns, result[e.parent][0], e.ref_columns, f"_gone{i}")
        hit = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"_gone{i}"), F.lit(False)) for i in range(len(incoming))])
        result[name] = (flagged.filter(hit).select(*df.columns), flagged.filter(~hit).select(*df.columns))
    return result


def fk_on_delete_cascade_self(
    df: DataFrame, key: Sequence[str], parent: Sequence[str], deleted: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(removed rows, kept rows) of a table whose rows name a parent row of the same table, by path doubling.

    ``deleted`` holds the keys that go; with them goes every row that has one of
    them above it.  Each row carries its farthest known ancestor and whether a
    deleted row lies between; a round looks the ancestor's own ancestor up and so
    doubles the reach: a chain of n rows takes log2(n) rounds where a walk by
    levels takes n.  Only narrow (key, ancestor) rows move.  Rows without a
    parent, or with one that does not exist, end a path; paths that run in a
    circle end when their reach exceeds the table.
    """
    def one(columns: Sequence[str]) -> Column:
        whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
        return F.when(whole, F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(columns)]))

    gone = staged(deleted.select(one(key).alias("k"), F.lit(True).alias("_gone")).filter("k is not null").distinct(), "deleted")
    start = df.select(one(key).alias("k"), one(parent).alias("up")).filter("k is not null").join(gone, "k", "left")
    state = staged(start.select("k", F.when(F.col("_gone"), None).otherwise(F.col("up")).alias("up"),
                                F.coalesce("_gone", F.lit(False)).alias("hit")), "ancestors")
    reach, rows = 1, state.count()
    while reach <= rows and not state.filter("up is not null").isEmpty():
        above = state.select(F.col("k").alias("up"), F.col("up").alias("_next"), F.col("hit").alias("_hit"), F.lit(True).alias("_there"))
        moved = state.filter("up is not null").join(above, "up", "left")
        hit = F.coalesce("_hit", F.lit(False))
        moved = moved.select("k", F.when(hit, None).otherwise(F.col("_next")).alias("up"), hit.alias("hit"))
        before, state = state, staged(state.filter("up is null").unionByName(moved), "ancestors")
        dropped(before)
        reach *= 2
    removed = staged(state.filter("hit").select("k"), "removed")
    flagged = df.withColumn("_k", one(key)).join(removed.select(F.col("k").alias("_k"), F.lit(True).alias("_hit")), "_k", "left")
    return (flagged.filter("_hit").select(*df.columns), flagged.filter("_hit is null").select(*df.columns))


def _without(df: DataFrame, gone: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of ``df`` that are not in ``gone`` by these columns; a null equals a null."""
    other = gone.select(*[F.col(c).alias(f"_gone_{c}") for c in columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_gone_{c}")) for c in columns])
    return df.join(other, same, "left_anti")


def _reached(edges: Sequence[Edge], start: str) -> list[str]:
    found = [start]
    for name in found:
        found += [e.child for e in edges if e.parent == name and e.child not in found]
    return list(dict.fromkeys(found))


def _cascade_cyclic(tables, edges, start, deleted, keys):
    # each table once, narrow: its primary key and what edges compare
    used: dict[str, dict[str, None]] = {n: dict.fromkeys(keys.get(n, tables[n].columns)) for n in _reached(edges, start)}
    for e in edges:
        if e.parent in used:
            used[e.child] |= dict.fromkeys(e.columns)
            used[e.parent] |= dict.fromkeys(e.ref_columns)
    slim = {n: staged(tables[n].select(*columns), "cascade") for n, columns in used.items() if n != start or any(
        e.child == start for e in edges)}
    levels = {start: [staged(deleted.select(*used[start]).distinct(), "level")]}
    frontier = {start: levels[start][0]}
    while frontier:  # a level holds rows that no level held before, so the levels end
        found: dict[str, list[DataFrame]] = {}
        for e in edges:
            if e.parent in frontier:
                gone = staged(parent_keys(frontier[e.parent], e.ref_columns, e.columns), "deleted")
                hit = slim[e.child].join(gone, list(e.columns), "left_semi").select(*used[e.child])
                found.setdefault(e.child, []).append(hit)
        frontier = {}
        for name, hits in found.items():
            fresh = reduce(DataFrame.unionByName, hits).distinct()
            if name in levels:
                pk = list(keys.get(name, tables[name].columns))
                fresh = _without(fresh, reduce(DataFrame.unionByName, levels[name]).select(*pk), pk)
            fresh = staged(fresh, "level")
            if not fresh.isEmpty():
                frontier[name] = fresh
        for name, df in frontier.items():
            levels.setdefault(name, []).append(df)
    result = {}
    for name in used:
        df, pk = tables[name], list(keys.get(name, tables[name].columns))
        if name not in levels:
            result[name] = (df.limit(0), df)
            continue
        gone = staged(reduce(DataFrame.unionByName, levels[name]).select(*pk).distinct(), "removed")
        other = gone.select(*[F.col(c).alias(f"_gone_{c}") for c in pk])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_gone_{c}")) for c in pk])
        result[name] = (df.join(other, same, "left_semi"), _without(df, gone, pk))
    return result


def fk_target_exists(fks: DataFrame, tables: DataFrame, cols: DataFrame) -> DataFrame:
    """Problem of each foreign key of the inventory: missing table, count, or column.

    One row per problem, keyed by ``env_id, schema_name, table_name, fk_name``; a key with a
    missing table or with unequal column counts is not looked into further.  A
    key references its own schema unless it has a ``ref_schema``.  All frames
    grow with the fleet, however small they look to the planner: they are merged.
    """
    own = F.col("schema_name")
    fks = fks.withColumn("_s", F.coalesce("ref_schema", own) if "ref_schema" in fks.columns else own)
    there = ["env_id", own.alias("_s"), F.col("table_name").alias("ref_table")]
    known = tables.select(*there).distinct().withColumn("_t", F.lit(True))
    columns = cols.select(*there, F.col("column_name").alias("ref_column")).distinct().withColumn("_c", F.lit(True))
    per_fk = fks.groupBy("env_id", "schema_name", "table_name", "fk_name").agg(
        F.count("column_name").alias("_n"), F.count("ref_column").alias("_m")
    )
    rows = (
        fks.join(per_fk.hint("merge"), ["env_id", "schema_name", "table_name", "fk_name"])
        .join(known.hint("merge"), ["env_id", "_s", "ref_table"], "left")
        .join(columns.hint("merge"), ["env_id", "_s", "ref_table", "ref_column"], "left")
    )
    problem = (
        F.when(F.col("_t").isNull(), "missing_table")
        .when(F.col("_n") != F.col("_m"), "column_count")
        .when(F.col("_c").isNull(), "missing_column")
    )
    subject = F.when(problem == "missing_column", F.concat_ws(".", "ref_table", "ref_column")).otherwise(
        F.col("ref_table")
    )
    return (
        rows.select("env_id", "schema_name", "table_name", "fk_name", problem.alias("problem"), subject.alias("subject"))
        .filter("problem is not null").distinct()
    )
