"""Constraint checks that run on the data.

Three different null rules apply and are kept apart: a CHECK passes on null, a
UNIQUE key with a null never collides, and a foreign key with any null column
is not looked up.

Row rules of a table are fused into one aggregate, so any number of them costs
one scan.  A row rule's ``violation`` is true on a broken row and false or null
on a good one; it is not wrapped, so that as a filter it reaches the scan.  Key
rules (unique, primary key, foreign key) first collapse equal
keys with a map-side partial aggregate; a key held by a third of all rows is
therefore a single record per task by the time it is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from moraine.session import dropped, staged

MANY_REPEATED = 1_000_000  # repeated keys, 8 MB of hashes, above which they are not broadcast


@dataclass(frozen=True)
class NotNull:
    column: str

    @property
    def name(self) -> str:
        return f"not_null({self.column})"

    def violation(self) -> Column:
        return F.col(self.column).isNull()


@dataclass(frozen=True)
class Check:
    label: str
    predicate: str

    @property
    def name(self) -> str:
        return f"check({self.label})"

    def violation(self) -> Column:
        return ~F.expr(self.predicate)


@dataclass(frozen=True)
class MaxLength:
    column: str
    length: int

    @property
    def name(self) -> str:
        return f"varchar({self.column},{self.length})"

    def violation(self) -> Column:
        return F.char_length(self.column) > self.length


@dataclass(frozen=True)
class OneOf:
    column: str
    values: tuple

    @property
    def name(self) -> str:
        return f"enum({self.column})"

    def violation(self) -> Column:
        return ~F.col(self.column).isin(*self.values)


@dataclass(frozen=True)
class Castable:
    column: str
    target: str

    @property
    def name(self) -> str:
        return f"cast({self.column},{self.target})"

    def violation(self) -> Column:
        column = F.col(self.column)
        return column.isNotNull() & column.try_cast(self.target).isNull()


@dataclass(frozen=True)
class Unique:
    columns: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"unique({','.join(self.columns)})"


@dataclass(frozen=True)
class PrimaryKey:
    columns: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"primary_key({','.join(self.columns)})"


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    ref_table: str
    ref_columns: tuple[str, ...]
    on_delete: str | None = None
    label: str | None = None

    @property
    def name(self) -> str:
        return self.label or f"foreign_key({','.join(self.columns)}->{self.ref_table})"


RowRule = NotNull | Check | MaxLength | OneOf | Castable
KeyRule = Unique | PrimaryKey | ForeignKey
ROW_RULES = (NotNull, Check, MaxLength, OneOf, Castable)


def any_null(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def key_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per distinct key with its row count ``n``."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- single rules


def check_not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(NotNull(column).violation())


def check_expression(df: DataFrame, predicate: str) -> DataFrame:
    """Rows on which the predicate is false; null passes."""
    return df.filter(Check("", predicate).violation())


def check_max_length(df: DataFrame, column: str, length: int) -> DataFrame:
    return df.filter(MaxLength(column, length).violation())


def check_one_of(df: DataFrame, column: str, values: Sequence | DataFrame) -> DataFrame:
    """Rows whose value is outside the list; a DataFrame is a one-column value table.

    With a table, distinct values meet the allowed ones, and the rows follow the
    values found wanting, so a frequent good value is never shuffled row by row.
    """
    if isinstance(values, DataFrame):
        present = df.filter(F.col(column).isNotNull()).select(column).distinct()
        wrong = staged(present.join(values.toDF(column).distinct(), column, "left_anti"))
        return df.join(wrong, column, "left_semi").select(*df.columns)
    return df.filter(OneOf(column, tuple(values)).violation())


def repeated_digests(df: DataFrame, columns: Sequence[str], name: str = "_digest") -> DataFrame:
    """Hashes of keys that occur more than once, staged; wide keys and rows stay where they are."""
    digest = F.xxhash64(*columns).alias(name)
    return staged(df.select(digest).groupBy(name).agg(F.count("*").alias("n")).filter("n > 1").select(name), "repeated")


def check_unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Colliding keys: the key, its row count ``n`` and the ``surplus`` of n - 1 rows.

    Keys are counted by their hash first; only rows whose hash repeats are
    grouped by the key itself.
    """
    keyed = df.filter(~any_null(columns)).select(*columns).withColumn("_digest", F.xxhash64(*columns))
    again = keyed.join(repeated_digests(keyed, columns), "_digest", "left_semi")
    return key_counts(again, columns).filter("n > 1").withColumn("surplus", F.col("n") - 1)


def check_primary_key(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys that break a primary key, with ``problem`` of ``null`` or ``duplicate``."""
    problem = F.when(any_null(columns), "null").when(F.col("n") > 1, "duplicate")
    return key_counts(df, columns).withColumn("problem", problem).filter("problem is not null")


# -------------------------------------------------------------------- summary


def row_rule_summary(df: DataFrame, rules: Sequence[RowRule]) -> DataFrame:
    counts = [F.count_if(r.violation()).alias(f"v{i}") for i, r in enumerate(rules)]
    totals = df.agg(F.count(F.lit(1)).alias("rows"), *counts)
    rows = [
        F.struct(F.lit(r.name).alias("rule"), F.col(f"v{i}").alias("violations"), F.col("rows").alias("rows"))
        for i, r in enumerate(rules)
    ]
    return totals.select(F.inline(F.array(*rows)))


def unique_summary(df: DataFrame, rule: Unique | PrimaryKey) -> DataFrame:
    n, has_null = F.col("n"), any_null(rule.columns)
    broken = F.when(has_null, n if isinstance(rule, PrimaryKey) else F.lit(0)).otherwise(n - 1)
    return key_counts(df, rule.columns).agg(F.sum(broken).alias("v"), F.sum("n").alias("r")).select(
        F.lit(rule.name).alias("rule"),
        F.coalesce("v", F.lit(0)).alias("violations"),
        F.coalesce("r", F.lit(0)).alias("rows"),
    )


def foreign_key_summary(df: DataFrame, rule: ForeignKey, parent: DataFrame) -> DataFrame:
    """Children and parents meet as distinct keys, both already partitioned by the key."""
    parents = parent.select(*[F.col(p).alias(c) for c, p in zip(rule.columns, rule.ref_columns)])
    found = parents.distinct().withColumn("found", F.lit(True))
    joined = key_counts(df, rule.columns).join(found, list(rule.columns), "left")
    broken = F.when(~any_null(rule.columns) & F.col("found").isNull(), F.col("n")).otherwise(F.lit(0))
    return joined.agg(F.sum(broken).alias("v"), F.sum("n").alias("r")).select(
        F.lit(rule.name).alias("rule"),
        F.coalesce("v", F.lit(0)).alias("violations"),
        F.coalesce("r", F.lit(0)).alias("rows"),
    )


def check_summary(
    df: DataFrame, rules: Sequence[RowRule | KeyRule], parents: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """One row per rule: ``rule, violations, rows, passed``."""
    row_rules = [r for r in rules if isinstance(r, ROW_RULES)]
    parts = [row_rule_summary(df, row_rules)] if row_rules else []
    for rule in rules:
        if isinstance(rule, (Unique, PrimaryKey)):
            parts.append(unique_summary(df, rule))
        elif isinstance(rule, ForeignKey):
            parts.append(foreign_key_summary(df, rule, (parents or {})[rule.ref_table]))
    if not parts:
        raise ValueError("no rules given")
    return reduce(DataFrame.unionByName, parts).withColumn("passed", F.col("violations") == 0)


def observe_row_rules(df: DataFrame, rules: Sequence[RowRule], observation: Observation) -> DataFrame:
    """The same rows, counting violations on the way to wherever they are written.

    After the write ``observation.get`` holds ``rows`` and one count per rule
    name, so checking a table costs no scan of its own.
    """
    counts = [F.count_if(r.violation()).alias(r.name) for r in rules]
    return df.observe(observation, F.count(F.lit(1)).alias("rows"), *counts)


def failures(summary: DataFrame) -> list[str]:
    """Names of failed rules; a summary has one row per declared rule."""
    return [r.rule for r in summary.filter("not passed").collect()]


# --------------------------------------------------------- quarantine, dedupe


def flag_reasons(df: DataFrame, rules: Sequence[RowRule], column: str = "reasons") -> DataFrame:
    """Adds the names of the broken row rules as an array, empty for a good row."""
    broken = F.array(*[F.when(r.violation(), F.lit(r.name)) for r in rules])
    return df.withColumn(column, F.array_compact(broken))


def quarantine_split(df: DataFrame, rules: Sequence[RowRule]) -> tuple[DataFrame, DataFrame]:
    """Good rows as they came, and bad rows with their reasons.

    To write both from a single scan, write ``flag_reasons`` partitioned by
    ``size(reasons) > 0`` instead.
    """
    flagged = flag_reasons(df, rules)
    return flagged.filter(F.size("reasons") == 0).drop("reasons"), flagged.filter(F.size("reasons") > 0)


def dedupe_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keeps the lowest row by ``order`` of each key; rows with a null key all stay.

    Keys meet first, as hashes: rows whose key occurs once stay in place, only
    the others are ranked.  Where too many keys repeat to be handed to every
    task, finding their rows would move all rows before those are moved again;
    then all are ranked, and move once.  The literal ``rank = 1`` filter lets
    Spark cut each task's rows to one per key before the shuffle, so a hot key
    does not land in one task whole.
    """
    digest = F.xxhash64(*keys)
    again = repeated_digests(df.filter(~any_null(keys)), keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    if again.count() > MANY_REPEATED:
        dropped(again)
        kept = df.filter(~any_null(keys)).withColumn("_rank", rank).filter("_rank = 1").select(*df.columns)
        return kept.unionByName(df.filter(any_null(keys)))
    marked = df.withColumn("_digest", F.when(~any_null(keys), digest))
    ranked = marked.join(again, "_digest", "left_semi").withColumn("_rank", rank)
    kept = ranked.filter("_rank = 1").select(*df.columns)
    return kept.unionByName(marked.join(again, "_digest", "left_anti").select(*df.columns))
