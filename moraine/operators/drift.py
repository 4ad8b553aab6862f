"""Differences between two inventories, schema hashes and drift of a fleet.

``current`` and ``desired`` hold the same environments; a desired state shared
by all of them is spread with ``desired_for``.  The join keys (environment,
schema, table, name) are unique on each side, so the full outer joins have no
hot keys however uneven the fleet is.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from moraine.functions.typenames import logical_type
from moraine.operators.inventory import ROW_TYPES, TABLE_KEY, group_foreign_keys, group_indexes
from moraine.operators.table_diff import nested_diff, touched, unfolded
from moraine.session import staged

COLUMN_KEY = [*TABLE_KEY, "column_name"]


@dataclass(frozen=True)
class Inventory:
    tables: DataFrame
    cols: DataFrame
    idx: DataFrame | None = None
    fks: DataFrame | None = None


def desired_for(envs: DataFrame, kind: str, rows: Sequence[dict]) -> DataFrame:
    """One declared schema, given as inventory rows without ``env_id``, for every environment.

    A declared schema is a document of some hundred rows; it travels in the plan
    as one literal and is unfolded per environment, so nothing is joined.
    """
    return envs.select("env_id", F.inline(literal_rows(rows, ROW_TYPES[kind])))


def literal_rows(rows: Sequence[dict], row_type: str) -> Column:
    """An array of rows as a single literal, folded once while planning."""
    return F.from_json(F.lit(json.dumps(list(rows))), f"array<struct<{_json_type(row_type)}>>")


def _json_type(row_type: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (field.split() for field in row_type.split(",")))


def _sides(current: DataFrame, desired: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Full outer join with ``old_*``, ``new_*`` and ``status`` of added, removed or both."""
    old = current.select(*key, *[F.col(f).alias(f"old_{f}") for f in fields], F.lit(True).alias("_o"))
    new = desired.select(*key, *[F.col(f).alias(f"new_{f}") for f in fields], F.lit(True).alias("_n"))
    status = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").otherwise("both")
    return old.join(new, list(key), "full_outer").withColumn("status", status).drop("_o", "_n")


def diff_columns(current: Inventory, desired: Inventory) -> DataFrame:
    """Added, removed and modified columns of the tables both sides have.

    ``changes`` lists type, nullable, default, is_primary_key in that order.
    """
    return unfolded(nested_diff(current, desired, ["columns"]), "columns")


def diff_indexes(current: Inventory, desired: Inventory) -> DataFrame:
    """Added, removed and modified indexes by name; a changed body under the same name counts as modified."""
    return unfolded(nested_diff(current, desired, ["indexes"]), "indexes")


def diff_foreign_keys(current: Inventory, desired: Inventory) -> DataFrame:
    """Added, removed and modified foreign keys by name."""
    return unfolded(nested_diff(current, desired, ["foreign_keys"]), "foreign_keys")


def table_sides(current: Inventory, desired: Inventory) -> DataFrame:
    """Every table with ``status`` of added, removed or both, and both row-security flags."""
    return _sides(current.tables, desired.tables, TABLE_KEY, ["rls_enabled"])


def diff_rls(current: Inventory, desired: Inventory) -> DataFrame:
    """Tables whose row-security flag changes, and the new value; a difference of its own, never dropped."""
    return table_sides(current, desired).filter("status = 'both' and not (old_rls_enabled <=> new_rls_enabled)").select(
        *TABLE_KEY, F.col("new_rls_enabled").alias("rls_enabled")
    )


def diff_tables(current: Inventory, desired: Inventory) -> DataFrame:
    """Added, removed and modified tables; modified means columns, indexes, foreign keys or row security differ."""
    nested = nested_diff(current, desired)
    status = F.when(F.col("status") != "both", F.col("status")).when(touched(nested), "modified")
    return nested.select(*TABLE_KEY, status.alias("status")).filter("status is not null")


def name_set_ops(current: DataFrame, desired: DataFrame, key: Sequence[str]) -> DataFrame:
    """Names only on one side or on both; each name once.

    One tagged aggregation instead of three set operations, so each side is read
    once.
    """
    tagged = current.select(*key, F.lit(1).alias("_s")).unionByName(desired.select(*key, F.lit(2).alias("_s")))
    side = F.when(F.col("_m") == 3, "both").when(F.col("_m") == 1, "only_current").otherwise("only_desired")
    return tagged.groupBy(*key).agg(F.bit_or("_s").alias("_m")).select(*key, side.alias("side"))


# ----------------------------------------------------------------- renames


def rename_candidates(diff: DataFrame, max_distance: int = 2) -> DataFrame:
    """Removed columns with the nearest added column of their table and type, by edit distance.

    Two names within distance d differ in length by at most d, and of d + 1
    pieces of the one at least one occurs in the other, shifted by at most d.
    Names that share such a piece meet; the distance itself then decides.  No
    pair in reach is missed, and removed and added columns of a table are not
    paired wholesale.  The diff is read once: both kinds of row are keyed by
    piece and meet in one grouping, whose groups are bounded by the number of
    columns a table can have.
    """
    d, pieces = max_distance, max_distance + 1
    one = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(0).alias("_dl"), F.lit(0).alias("_sh")) for i in range(pieces)])
    moves = F.array(*[
        F.struct(F.lit(i).alias("_i"), F.lit(dl).alias("_dl"), F.lit(s).alias("_sh"))
        for i in range(pieces) for dl in range(-d, d + 1) for s in range(-d, d + 1)
    ])
    added = F.col("status") == "added"
    names = diff.filter(F.col("status").isin("added", "removed")).select(
        *TABLE_KEY, F.when(added, F.col("new_type")).otherwise(F.col("old_type")).alias("type"),
        F.col("column_name").alias("_name"), F.lower("column_name").alias("_low"),
        F.col("new_ordinal").alias("_ord"), added.alias("_added"),
        F.when(added, one).otherwise(moves).alias("_moves"),
    )
    keyed = names.select("*", F.inline("_moves")).drop("_moves").withColumn("_n", F.char_length("_low") + F.col("_dl"))
    n, i = F.col("_n"), F.col("_i")
    # pieces of nearly equal width; the last n % pieces of them are one longer
    base, extra = F.expr(f"_n div {pieces}"), n % pieces
    at = i * base + F.greatest(F.lit(0), i - (pieces - extra)) + F.col("_sh")
    width = base + F.when(i >= pieces - extra, 1).otherwise(0)
    placed = keyed.filter(n >= 0).withColumn("_at", at.cast("int")).withColumn("_w", width.cast("int"))
    cut = placed.filter((F.col("_at") >= 0) & (F.col("_at") + F.col("_w") <= F.char_length("_low")))
    piece = F.substring(F.col("_low"), F.col("_at") + 1, F.col("_w"))
    meeting = cut.withColumn("_piece", piece).groupBy(*TABLE_KEY, "type", "_n", "_i", "_piece").agg(
        F.collect_set(F.when(F.col("_added"), F.struct("_ord", "_name"))).alias("_news"),
        F.collect_set(F.when(~F.col("_added"), F.col("_name"))).alias("_olds"),
    )
    pairs = meeting.select(*TABLE_KEY, "type", F.explode("_olds").alias("old_name"), "_news").select(
        *TABLE_KEY, "type", "old_name", F.inline("_news")
    )
    distance = F.levenshtein(F.lower("old_name"), F.lower("_name"))
    near = pairs.withColumn("distance", distance).filter(F.col("distance") <= d)
    best = F.min(F.struct("distance", "_ord", "_name")).alias("_best")
    return near.groupBy(*TABLE_KEY, "type", "old_name").agg(best).select(
        *TABLE_KEY, "type", "old_name", F.col("_best._name").alias("new_name"),
        F.col("_best.distance").alias("distance"),
    )


# ------------------------------------------------------------------- hashes


def escape_html(text: Column) -> Column:
    """The escapes a canonical JSON text uses beyond the usual ones."""
    for char, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"),
                       (chr(0x2028), "\\u2028"), (chr(0x2029), "\\u2029")):
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def canonical_schema(inv: Inventory) -> DataFrame:
    """``env_id, document``: the canonical JSON text of each environment.

    Lists are sorted by name, object keys are alphabetical, absent parts are
    left out.  Row security, policies and schema names are not part of it.
    Tables, columns, indexes and foreign keys are brought together by
    environment in one exchange; tables and then the document are assembled
    where they lie.  An environment's document is hashed as a whole, so it is
    one row in the end; the lists are columns of a table, tables of a schema.
    """
    column = F.struct(
        F.col("column_name").alias("k"),
        F.struct(
            F.col("default_raw").alias("default"),
            F.col("is_pk").alias("is_primary_key"),
            F.col("column_name").alias("name"),
            F.col("nullable").alias("nullable"),
            logical_type(F.col("type_raw")).alias("type"),
        ).alias("v"),
    )
    parts = [inv.tables.select(*TABLE_KEY, F.lit(True).alias("_t")), inv.cols.select(*TABLE_KEY, column.alias("_c"))]
    lists = {"_c": F.array_sort(F.collect_list("_c"))}
    body = {"columns": F.transform("_c", lambda c: c["v"])}
    if inv.fks is not None:
        parts.append(inv.fks.select(*TABLE_KEY, F.struct(
            F.col("fk_name").alias("k"), "ordinal", "column_name", "ref_table", "ref_column", "on_delete", "on_update"
        ).alias("_f")))
        lists["_f"] = F.array_sort(F.collect_list("_f"))
        body["foreign_keys"] = _by_name("_f", lambda name, rows: F.struct(
            F.transform(rows, lambda r: r["column_name"]).alias("columns"), name.alias("name"),
            rows[0]["on_delete"].alias("on_delete"), rows[0]["on_update"].alias("on_update"),
            F.transform(rows, lambda r: r["ref_column"]).alias("referenced_columns"),
            rows[0]["ref_table"].alias("referenced_table"),
        ))
    if inv.idx is not None:
        parts.append(inv.idx.select(*TABLE_KEY, F.struct(
            F.col("index_name").alias("k"), "ordinal", "column_name", "is_unique"
        ).alias("_x")))
        lists["_x"] = F.array_sort(F.collect_list("_x"))
        body["indexes"] = _by_name("_x", lambda name, rows: F.struct(
            F.transform(rows, lambda r: r["column_name"]).alias("columns"), name.alias("name"),
            rows[0]["is_unique"].alias("unique"),
        ))
    body["name"] = F.col("table_name")
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).repartition("env_id")
    tables = together.groupBy(*TABLE_KEY).agg(
        F.bool_or("_t").alias("_t"), *[c.alias(name) for name, c in lists.items()]
    ).filter("_t")
    text = F.to_json(F.struct(*[c.alias(name) for name, c in body.items()]))
    docs = tables.select("env_id", F.struct(F.col("table_name").alias("k"), text.alias("v")).alias("_t")).groupBy(
        "env_id"
    ).agg(F.array_sort(F.collect_list("_t")).alias("_t"))
    document = F.concat(F.lit('{"tables":['), F.array_join(F.transform("_t", lambda t: t["v"]), ","), F.lit("]}"))
    return docs.select("env_id", escape_html(document).alias("document"))


def _by_name(column: str, build) -> Column:
    """One object per name of a sorted list of key columns; null for an empty list."""
    names = F.array_distinct(F.transform(column, lambda r: r["k"]))
    objects = F.transform(names, lambda n: build(n, F.filter(column, lambda r: r["k"] == n)))
    return F.when(F.size(column) > 0, objects)


EMPTY_DOCUMENT = '{"tables":[]}'


def schema_hash(inv: Inventory, envs: DataFrame | None = None) -> DataFrame:
    """SHA-256 of each environment's canonical document; listed environments without tables included."""
    docs = canonical_schema(inv)
    if envs is not None:
        docs = envs.select("env_id").distinct().join(docs.hint("merge"), "env_id", "left").select(
            "env_id", F.coalesce("document", F.lit(EMPTY_DOCUMENT)).alias("document")
        )
    return docs.select("env_id", F.sha2("document", 256).alias("schema_hash"))


def drift_by_hash(hashes: DataFrame, expected: str) -> DataFrame:
    """Environments grouped by hash; a group off the expected hash has drifted."""
    return hashes.groupBy("schema_hash").agg(
        F.count(F.lit(1)).alias("environments"), F.min("env_id").alias("first_env")
    ).withColumn("drifted", F.col("schema_hash") != expected)


# ------------------------------------------------------------------- reports


def drift_report(current: Inventory, desired: Inventory, subtotals: bool = False) -> DataFrame:
    """Counts of differing tables and columns per environment, in-sync ones included.

    With ``subtotals`` the rows are per environment and table, with a total per
    environment and one for the fleet (null names).
    """
    nested = nested_diff(current, desired)
    of_status = lambda s: F.size(F.filter("columns", lambda c: c["status"] == s))
    # an index or a key that differs makes its table modified, as a column does
    per_table = nested.select(
        *TABLE_KEY, F.when(F.col("status") != "both", F.col("status")).when(touched(nested), "modified").alias("t"),
        *[of_status(s).cast("bigint").alias(f"{s}_columns") for s in ("added", "removed", "modified")])
    sums = [
        *[F.count_if(F.col("t") == s).alias(f"{s}_tables") for s in ("added", "removed", "modified")],
        *[F.sum(f"{s}_columns").alias(f"{s}_columns") for s in ("added", "removed", "modified")],
    ]
    grouped = per_table.rollup("env_id", "table_name") if subtotals else per_table.groupBy("env_id")
    report = grouped.agg(*sums)
    total = reduce(lambda a, b: a + b, [F.col(f"{s}_{k}") for s in ("added", "removed", "modified") for k in ("tables", "columns")])
    return report.withColumn("in_sync", total == 0)


# ---------------------------------------------------------------- change log

ADD, DROP = "add_column", "drop_column"
_ATTRIBUTES = {
    # attribute: the actions that set it, besides adding the column
    "type_raw": ("alter_type",),
    "nullable": ("set_not_null", "drop_not_null", "add_primary_key"),  # a primary key implies NOT NULL
    "default_raw": ("set_default", "drop_default"),
    "is_pk": ("add_primary_key", "drop_primary_key"),
}
ON_COLUMNS = (ADD, DROP, *{a: None for actions in _ATTRIBUTES.values() for a in actions})
ON_TABLES = ("rls_on", "rls_off")
NEW_INDEX, NEW_KEY, DROP_NAMED = ("add_unique", "add_index"), "add_foreign_key", "drop_constraint"
ON_NAMES = (*NEW_INDEX, NEW_KEY, DROP_NAMED)
_KEY_BODY = "key_columns array<string>, is_unique boolean, ref_table string, ref_columns array<string>, on_delete string, on_update string"


def composed(events: DataFrame, key: Sequence[str], steps: dict[str, Column], block: int) -> DataFrame:
    """Running sums of ``steps`` over each key's events in order of ``seq``, however long its history is.

    Adds ``<name>_before``, the sum of the earlier events, and ``<name>_low``,
    the least that sum has been so far (0 at the start).  Both are computed
    within blocks of sequence numbers; a block's total and lowest point then
    compose over the blocks, of which there are few, so one key's history is
    spread over many tasks.
    """
    blocks = events.withColumns({"_b": F.floor(F.col("seq") / block), **{f"_{n}": c.cast("bigint") for n, c in steps.items()}})
    inside = Window.partitionBy(*key, "_b").orderBy("seq")
    upto, until = (inside.rowsBetween(Window.unboundedPreceding, end) for end in (0, -1))
    before = Window.partitionBy(*key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({f"_{n}_sum": F.sum(f"_{n}").over(upto) for n in steps})
    totals = blocks.groupBy(*key, "_b").agg(*[c for n in steps for c in (
        F.sum(f"_{n}").alias(f"_{n}_all"), F.min(f"_{n}_sum").alias(f"_{n}_least"))])
    totals = totals.withColumns({f"_{n}_carried": F.coalesce(F.sum(f"_{n}_all").over(before), F.lit(0)) for n in steps})
    totals = totals.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(key)], F.col("_b").alias("_block"), *[c for n in steps for c in (
        F.col(f"_{n}_carried"), F.least(F.lit(0), F.min(F.col(f"_{n}_carried") + F.col(f"_{n}_least")).over(before)).alias(f"_{n}_depth"))])
    blocks = blocks.withColumns({f"_{n}_lowest": F.min(f"_{n}_sum").over(until) for n in steps})
    here = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(key)], F.col("_b") == F.col("_block"))
    joined = blocks.join(totals.hint("merge"), here)
    out = {}
    for n in steps:
        out[f"{n}_before"] = F.col(f"_{n}_carried") + F.col(f"_{n}_sum") - F.col(f"_{n}")
        out[f"{n}_low"] = F.least(F.col(f"_{n}_depth"), F.col(f"_{n}_carried") + F.col(f"_{n}_lowest"))
    return joined.select(*events.columns, *[c.alias(name) for name, c in out.items()])


def known_log(tables: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the log on listed tables, keys of the unlisted tables it names)."""
    # both grow with the fleet, however small an inventory looks to the planner: they are merged, here and below
    missing = staged(
        log.select(*TABLE_KEY).distinct().join(tables.select(*TABLE_KEY).distinct().hint("merge"), TABLE_KEY, "left_anti"), "unknown"
    )
    return log.join(missing, TABLE_KEY, "left_anti"), missing


def _named_events(idx: DataFrame | None, fks: DataFrame | None, log: DataFrame, block: int) -> DataFrame:
    """Everything that happens to named constraints, in order, and what each drop removes.

    A drop takes the earliest index of its name, else the earliest foreign key
    of its name, else the table's primary key, whatever that is called:
    ``target`` is index, foreign_key or primary_key.  How many indexes of a name
    there are before a drop is a running sum that never falls below zero.
    """
    body = [f.split()[0] for f in _KEY_BODY.split(", ")]
    typed = [F.col(n).cast(t) if n in log.columns else F.lit(None).cast(t).alias(n) for n, t in (f.split() for f in _KEY_BODY.split(", "))]
    parts = [log.filter(F.col("action").isin(*ON_NAMES) & F.col("constraint_name").isNotNull()).select(
        *TABLE_KEY, F.col("constraint_name").alias("name"), "seq", "action", *typed)]
    if idx is not None:
        parts.append(group_indexes(idx).select(
            *TABLE_KEY, F.col("index_name").alias("name"), F.lit(-1).cast("bigint").alias("seq"), F.lit("add_index").alias("action"),
            F.col("column_names").alias("key_columns"), "is_unique"))
    if fks is not None:
        parts.append(group_foreign_keys(fks).select(
            *TABLE_KEY, F.col("fk_name").alias("name"), F.lit(-1).cast("bigint").alias("seq"), F.lit(NEW_KEY).alias("action"),
            F.col("column_names").alias("key_columns"), "ref_table", "ref_columns", "on_delete", "on_update"))
    events = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    # a constraint on no column is none
    events = events.filter((F.col("action") == DROP_NAMED) | (F.coalesce(F.size("key_columns"), F.lit(0)) > 0))
    action, drop, key = F.col("action"), F.col("action") == DROP_NAMED, [*TABLE_KEY, "name"]
    one = composed(events, key, {"x": F.when(action.isin(*NEW_INDEX), 1).when(drop, -1).otherwise(0)}, block)
    one = one.withColumn("_x", F.col("x_before") - F.col("x_low") > 0)
    two = composed(one, key, {"f": F.when(action == NEW_KEY, 1).when(drop & ~F.col("_x"), -1).otherwise(0)}, block)
    target = F.when(drop, F.when(F.col("_x"), "index").when(F.col("f_before") - F.col("f_low") > 0, "foreign_key").otherwise("primary_key"))
    return two.select(*key, "seq", "action", *body, target.alias("target"))


def replay_keys(idx: DataFrame, fks: DataFrame, tables: DataFrame, log: DataFrame, block: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Final indexes (unique rules among them) and foreign keys after an ordered log of changes.

    The log's ``constraint_name`` says what ``add_unique``, ``add_index``,
    ``add_foreign_key`` and ``drop_constraint`` are about; ``key_columns``,
    ``is_unique``, ``ref_table``, ``ref_columns``, ``on_delete`` and
    ``on_update`` are their bodies.  A name may be given again, and drops take
    the earliest of it first.
    """
    log, _ = known_log(tables, log)
    events = staged(_named_events(idx, fks, log, block), "named")

    def left(added: Column, target: str) -> DataFrame:
        key = [*TABLE_KEY, "name"]
        own = events.filter(added | (F.col("target") == target))
        taken = own.filter(F.col("target") == target).groupBy(*key).agg(F.count("*").alias("_taken"))
        counted = composed(own.filter(added), key, {"i": F.lit(1)}, block)
        return counted.join(taken.hint("merge"), key, "left").filter(F.col("i_before") >= F.coalesce("_taken", F.lit(0)))

    indexes = left(F.col("action").isin(*NEW_INDEX), "index").select(
        *TABLE_KEY, F.col("name").alias("index_name"), F.col("key_columns").alias("column_names"),
        ((F.col("action") == "add_unique") | F.coalesce("is_unique", F.lit(False))).alias("is_unique"))
    keys = left(F.col("action") == NEW_KEY, "foreign_key").select(
        *TABLE_KEY, F.col("name").alias("fk_name"), F.col("key_columns").alias("column_names"), "ref_table", "ref_columns",
        "on_delete", "on_update")
    return indexes, keys


def replay_change_log(cols: DataFrame, tables: DataFrame, log: DataFrame, block: int = 100_000, idx: DataFrame | None = None,
                      fks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Final columns after an ordered log of changes, and the log rows that could not apply.

    ``log``: ``env_id, schema_name, table_name, seq, action, column_name,
    type_raw, nullable, default_raw, is_pk``, and ``constraint_name`` with the
    bodies of ``replay_keys`` where constraints come and go.  Each attribute is
    the value of the last event that set it, a map-side combined aggregate.
    Whether a column existed when an event arrived needs the order; that scan
    runs per block of sequence numbers with the state carried between blocks, so
    a single column with a huge history is spread over many tasks.  A dropped
    constraint that is no index and no foreign key clears the primary key.

    Errors: ``unknown_table``, ``unknown_column``, ``unknown_constraint`` (nothing
    of that name and no primary key), ``missing_name`` (a constraint without
    one) and ``unsupported_action``.  A row in error changes nothing.
    """
    whole, (log, missing) = log, known_log(tables, log)
    base = cols.select(
        *COLUMN_KEY, F.lit(-1).cast("bigint").alias("seq"), F.lit(ADD).alias("action"),
        "type_raw", "nullable", "default_raw", "is_pk",
    )
    events = base.unionByName(log.filter(F.col("action").isin(*ON_COLUMNS)).select(*base.columns))

    blocks = events.withColumn("_b", F.floor(F.col("seq") / block))
    lives = F.when(F.col("action") == ADD, True).when(F.col("action") == DROP, False)
    by_block = blocks.groupBy(*COLUMN_KEY, "_b").agg(F.max_by(lives, F.when(lives.isNotNull(), F.col("seq"))).alias("_l"))
    before = Window.partitionBy(*COLUMN_KEY).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = by_block.select(*COLUMN_KEY, "_b", F.last("_l", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy(*COLUMN_KEY, "_b").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    state = F.coalesce(F.last(lives, ignorenulls=True).over(inside), F.col("_carried"), F.lit(False))
    stray = (
        blocks.join(carried.hint("merge"), [*COLUMN_KEY, "_b"]).withColumn("_state", state)
        .filter((F.col("action") != ADD) & ~F.col("_state"))
        .select(*COLUMN_KEY, "seq", "action", F.lit("unknown_column").alias("error"))
    )
    odd = log.filter(~F.coalesce(F.col("action").isin(*ON_COLUMNS, *ON_TABLES, *ON_NAMES), F.lit(False)))
    errors = [stray, _error(odd, "unsupported_action")]
    final = _final_columns(events, None)
    if "constraint_name" in log.columns:
        nameless = log.filter(F.col("action").isin(*ON_NAMES) & F.col("constraint_name").isNull())
        errors.append(_error(nameless, "missing_name"))
        clears = staged(_named_events(idx, fks, log, block).filter("target = 'primary_key'").select(*TABLE_KEY, "seq", "action"), "clears")
        final, unmet = _with_clears(events, stray, clears, block)
        errors.append(unmet)
    errors.append(_error(whole.join(missing, TABLE_KEY, "left_semi"), "unknown_table"))
    return final.join(missing, TABLE_KEY, "left_anti"), reduce(DataFrame.unionByName, errors)


def _error(rows: DataFrame, name: str) -> DataFrame:
    return rows.select(*COLUMN_KEY, "seq", "action", F.lit(name).alias("error"))


def _final_columns(events: DataFrame, cleared: Column | None) -> DataFrame:
    """Live columns with the last value of each attribute; ``cleared``: condition under which a primary key no longer holds."""
    aggs = [F.max_by(F.col("action") == ADD, F.when(F.col("action").isin(ADD, DROP), F.col("seq"))).alias("_live")]
    for name, actions in _ATTRIBUTES.items():
        at = F.when(F.col("action").isin(ADD, *actions), F.col("seq"))
        value = _value_after(name)
        if name == "is_pk" and cleared is not None:
            value = value & ~cleared
        aggs.append(F.max_by(F.struct(value.alias("v")), at).alias(f"_{name}"))
    return events.groupBy(*COLUMN_KEY).agg(*aggs).filter("_live").select(
        *COLUMN_KEY, *[F.col(f"_{name}.v").alias(name) for name in _ATTRIBUTES]
    )


def _with_clears(events: DataFrame, stray: DataFrame, clears: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Final columns and failed drops where drops of constraints clear primary keys.

    The clears of a table cut its history into segments, numbered by a running
    count.  In each segment a table has a primary key if the last event of any
    column that touches one leaves it set; a clear at the end of a segment
    without one has found nothing to drop.
    """
    marks = clears.select(*TABLE_KEY, F.lit(None).cast("string").alias("column_name"), "seq", "action", F.lit(1).alias("_clear"))
    cut = composed(events.withColumn("_clear", F.lit(0)).unionByName(marks, allowMissingColumns=True), TABLE_KEY,
                   {"c": F.col("_clear")}, block).withColumnRenamed("c_before", "_segment")
    total = clears.groupBy(*TABLE_KEY).agg(F.count("*").alias("_clears"))
    placed = cut.filter("_clear = 0").join(total.hint("merge"), TABLE_KEY, "left")
    final = _final_columns(placed, F.col("_segment") < F.coalesce("_clears", F.lit(0)))
    touching = F.col("action").isin(ADD, DROP, *_ATTRIBUTES["is_pk"])
    value = F.when(F.col("action") == DROP, False).otherwise(_value_after("is_pk"))
    keyed = placed.filter(touching).join(stray.select(*COLUMN_KEY, "seq").hint("merge"), [*COLUMN_KEY, "seq"], "left_anti") \
        .groupBy(*COLUMN_KEY, "_segment").agg(F.max_by(value, "seq").alias("_pk")).filter("_pk")
    unmet = cut.filter("_clear = 1").join(keyed.select(*TABLE_KEY, "_segment").distinct().hint("merge"), [*TABLE_KEY, "_segment"], "left_anti")
    return final, _error(unmet, "unknown_constraint")


def _value_after(name: str) -> Column:
    """The attribute's value once the event in hand has been applied."""
    action, stated = F.col("action"), F.col(name)
    if name == "nullable":
        return F.when(action.isin("set_not_null", "add_primary_key"), False).when(action == "drop_not_null", True).otherwise(stated)
    if name == "default_raw":
        return F.when(action != "drop_default", stated)
    if name == "is_pk":
        return F.when(action == "add_primary_key", True).when(action == "drop_primary_key", False).otherwise(stated)
    return stated


def replay_rls(tables: DataFrame, log: DataFrame) -> DataFrame:
    """Row-security flag of each table after the log."""
    last = log.filter(F.col("action").isin("rls_on", "rls_off")).groupBy(*TABLE_KEY).agg(
        F.max_by(F.col("action") == "rls_on", "seq").alias("_rls")
    )
    return tables.join(last.hint("merge"), TABLE_KEY, "left").select(*TABLE_KEY, F.coalesce("_rls", "rls_enabled").alias("rls_enabled"))
