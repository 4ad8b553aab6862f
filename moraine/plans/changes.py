"""Changes as values: apply them in a safe order, and invert them.

A ``Table`` is a DataFrame with its declared rules, defaults and row-security
flag.  ``apply_changes`` sorts the changes of a table into a safe order and
folds them over it.  No action runs: the outcome is one lazy plan.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from moraine.operators import evolve
from moraine.operators.checks import Check, ForeignKey, KeyRule, NotNull, RowRule, Unique


@dataclass(frozen=True)
class Table:
    df: DataFrame
    rules: tuple = ()
    defaults: Mapping[str, str] = field(default_factory=dict)
    rls: bool = False

    def data_type(self, column: str) -> str:
        return dict(self.df.dtypes)[column]


@dataclass(frozen=True)
class AddColumn:
    name: str
    data_type: str
    nullable: bool = True
    default: str | None = None
    source: str | None = None  # expression that fills the column instead of the default
    rules: tuple = ()  # rules that come with the column
    order = 0

    def apply(self, t: Table, now: Column | None = None) -> Table:
        if self.source is None:
            df = evolve.add_column(t.df, self.name, self.data_type, self.default, now)
        else:
            df = evolve.generated_column(t.df, self.name, self.source, self.data_type)
        rules = t.rules if self.nullable else t.rules + (NotNull(self.name),)
        rules += tuple(r for r in self.rules if r not in rules)
        defaults = {**t.defaults, self.name: self.default} if self.default is not None else t.defaults
        return replace(t, df=df, rules=rules, defaults=defaults)

    def inverse(self, before: Table) -> "DropColumn":
        return DropColumn(self.name)


@dataclass(frozen=True)
class AlterType:
    name: str
    data_type: str
    using: str | None = None
    lenient: bool = False  # values that do not fit become null instead of failing
    order = 1

    def apply(self, t: Table, now: Column | None = None) -> Table:
        if self.lenient:
            return replace(t, df=t.df.withColumn(self.name, F.col(self.name).try_cast(self.data_type)))
        return replace(t, df=evolve.alter_column_type(t.df, self.name, self.data_type, self.using))

    def inverse(self, before: Table) -> "AlterType":
        return AlterType(self.name, before.data_type(self.name), lenient=True)


@dataclass(frozen=True)
class RenameColumn:
    old: str
    new: str
    order = 1

    def apply(self, t: Table, now: Column | None = None) -> Table:
        rules = tuple(_renamed(r, self.old, self.new) for r in t.rules)
        defaults = {self.new if k == self.old else k: v for k, v in t.defaults.items()}
        return replace(t, df=evolve.rename_column(t.df, self.old, self.new), rules=rules, defaults=defaults)

    def inverse(self, before: Table) -> "RenameColumn":
        return RenameColumn(self.new, self.old)


@dataclass(frozen=True)
class SetNotNull:
    name: str
    order = 1

    def apply(self, t: Table, now: Column | None = None) -> Table:
        rule = NotNull(self.name)
        return t if rule in t.rules else replace(t, rules=t.rules + (rule,))

    def inverse(self, before: Table) -> "SetNotNull | DropNotNull":
        return SetNotNull(self.name) if NotNull(self.name) in before.rules else DropNotNull(self.name)


@dataclass(frozen=True)
class DropNotNull:
    name: str
    order = 1

    def apply(self, t: Table, now: Column | None = None) -> Table:
        return replace(t, rules=tuple(r for r in t.rules if r != NotNull(self.name)))

    def inverse(self, before: Table) -> "SetNotNull | DropNotNull":
        return SetNotNull(self.name) if NotNull(self.name) in before.rules else DropNotNull(self.name)


@dataclass(frozen=True)
class SetDefault:
    name: str
    default: str | None
    order = 1

    def apply(self, t: Table, now: Column | None = None) -> Table:
        kept = {k: v for k, v in t.defaults.items() if k != self.name}
        return replace(t, defaults=kept if self.default is None else {**kept, self.name: self.default})

    def inverse(self, before: Table) -> "SetDefault":
        return SetDefault(self.name, before.defaults.get(self.name))


@dataclass(frozen=True)
class AddRule:
    rule: RowRule | KeyRule

    @property
    def order(self) -> int:
        return 2 if isinstance(self.rule, ForeignKey) else 3

    def apply(self, t: Table, now: Column | None = None) -> Table:
        return t if self.rule in t.rules else replace(t, rules=t.rules + (self.rule,))

    def inverse(self, before: Table) -> "DropRule":
        return DropRule(self.rule)


@dataclass(frozen=True)
class DropRule:
    rule: RowRule | KeyRule

    @property
    def order(self) -> int:
        return 5 if isinstance(self.rule, ForeignKey) else 4

    def apply(self, t: Table, now: Column | None = None) -> Table:
        if self.rule not in t.rules:
            raise ValueError(f"rule {self.rule.name} is not declared")
        return replace(t, rules=tuple(r for r in t.rules if r != self.rule))

    def inverse(self, before: Table) -> AddRule:
        return AddRule(self.rule)


@dataclass(frozen=True)
class SetRls:
    enabled: bool
    order = 6

    def apply(self, t: Table, now: Column | None = None) -> Table:
        return replace(t, rls=self.enabled)

    def inverse(self, before: Table) -> "SetRls":
        return SetRls(before.rls)


@dataclass(frozen=True)
class DropColumn:
    name: str
    order = 7

    def apply(self, t: Table, now: Column | None = None) -> Table:
        # a rule or default of the column goes with it
        rules = tuple(r for r in t.rules if not _mentions(r, self.name))
        defaults = {k: v for k, v in t.defaults.items() if k != self.name}
        return replace(t, df=evolve.drop_column(t.df, self.name), rules=rules, defaults=defaults)

    def inverse(self, before: Table) -> AddColumn:
        # Old values cannot come back from the definition alone, only the column
        # and its rules can; until ``rollback_drop_column`` has filled it, a
        # NOT NULL rule reports every row without a default.
        rules = tuple(r for r in before.rules if _mentions(r, self.name))
        return AddColumn(self.name, before.data_type(self.name), default=before.defaults.get(self.name), rules=rules)


Change = (
    AddColumn | AlterType | RenameColumn | SetNotNull | DropNotNull | SetDefault | AddRule | DropRule | SetRls
    | DropColumn
)


def _mentions(rule: RowRule | KeyRule, column: str) -> bool:
    if isinstance(rule, Check):
        return re.search(rf"\b{re.escape(column)}\b", rule.predicate) is not None
    return column in getattr(rule, "columns", ()) or column == getattr(rule, "column", None)


def _renamed(rule: RowRule | KeyRule, old: str, new: str) -> RowRule | KeyRule:
    """The rule under the column's new name."""
    if not _mentions(rule, old):
        return rule
    if isinstance(rule, Check):
        return replace(rule, predicate=re.sub(rf"\b{re.escape(old)}\b", new, rule.predicate))
    if hasattr(rule, "columns"):
        return replace(rule, columns=tuple(new if c == old else c for c in rule.columns))
    return replace(rule, column=new)


def safe_order(changes: Sequence[Change]) -> list[Change]:
    """Add columns, modify, add foreign keys, add unique and checks, drop rules, row security, drop columns."""
    return sorted(changes, key=lambda c: c.order)  # stable: equal kinds keep their order


def apply_changes(table: Table, changes: Sequence[Change], now: Column | None = None) -> Table:
    return reduce(lambda t, c: c.apply(t, now), safe_order(changes), table)


def apply_table_set(
    tables: Mapping[str, Table],
    changes: Mapping[str, Sequence[Change]],
    create: Mapping[str, Table] | None = None,
    drop: Sequence[str] = (),
    now: Column | None = None,
) -> dict[str, Table]:
    """New tables first, then the changes of each table, dropped tables last."""
    create = dict(create or {})
    clash = set(create) & set(tables)
    if clash:
        raise ValueError(f"tables exist already: {sorted(clash)}")
    result = {**tables, **create}
    for name, steps in changes.items():
        result[name] = apply_changes(result[name], steps, now)
    for name in drop:
        holders = [
            other for other, t in result.items()
            if other != name and other not in drop
            and any(isinstance(r, ForeignKey) and r.ref_table == name for r in t.rules)
        ]
        if holders:
            raise ValueError(f"cannot drop {name}: referenced by {sorted(holders)}")
        del result[name]
    return result


def inverse_changes(before: Table, changes: Sequence[Change]) -> list[Change]:
    """The inverse of each change, last one first, against the state each one met."""
    inverses, state = [], before
    for change in safe_order(changes):
        inverses.append(change.inverse(state))
        state = change.apply(state)
    return inverses[::-1]


def rollback_changes(after: Table, before: Table, changes: Sequence[Change], now: Column | None = None) -> Table:
    """Undo the changes; columns and rules end in the order they had before."""
    undone = reduce(lambda t, c: c.apply(t, now), inverse_changes(before, changes), after)
    place = {r: i for i, r in enumerate(before.rules)}
    rules = tuple(sorted(undone.rules, key=lambda r: place.get(r, len(place))))
    return replace(undone, df=undone.df.select(*before.df.columns), rules=rules)


def unique_rule(*columns: str) -> AddRule:
    return AddRule(Unique(tuple(columns)))
