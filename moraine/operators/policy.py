"""Row-level access rules as filters.

A table's policies are a short declared list; they turn into one boolean Column.
Permissive clauses are OR-ed, restrictive ones AND-ed; without any permissive
clause nothing is visible, and a clause that yields null hides the row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Policy:
    name: str
    command: str = "ALL"
    permissive: bool = True
    roles: tuple[str, ...] = ()
    using: str | None = None
    check: str | None = None

    def covers(self, role: str, command: str) -> bool:
        for_role = not self.roles or role in self.roles or "public" in self.roles
        return for_role and self.command in ("ALL", command)


def _combine(policies: Sequence[Policy], clause) -> Column:
    # AND and OR alone: the whole is true exactly when it is true with null read
    # as false, so no clause needs wrapping and the filter reaches the scan
    def holds(p: Policy) -> Column:
        text = clause(p)
        return F.lit(True) if text is None else F.expr(text)

    permissive = [holds(p) for p in policies if p.permissive]
    restrictive = [holds(p) for p in policies if not p.permissive]
    if not permissive:
        return F.lit(False)
    return reduce(lambda a, b: a & b, restrictive, reduce(lambda a, b: a | b, permissive))


def visible(policies: Sequence[Policy], role: str, command: str = "SELECT", rls: bool = True) -> Column:
    """True on rows the role may read, update or delete; false or null on hidden ones."""
    if not rls:
        return F.lit(True)
    return _combine([p for p in policies if p.covers(role, command)], lambda p: p.using)


def writable(policies: Sequence[Policy], role: str, command: str = "INSERT", rls: bool = True) -> Column:
    """True on rows the role may write; a policy without a check falls back to its filter.

    False or null means rejected.
    """
    if not rls:
        return F.lit(True)
    return _combine(
        [p for p in policies if p.covers(role, command)], lambda p: p.check if p.check is not None else p.using
    )


def rls_select(
    df: DataFrame, policies: Sequence[Policy], role: str, command: str = "SELECT", rls: bool = True
) -> DataFrame:
    return df.filter(visible(policies, role, command, rls))


def rls_check_violations(
    df: DataFrame, policies: Sequence[Policy], role: str, command: str = "INSERT", rls: bool = True
) -> DataFrame:
    """Incoming rows the role may not write."""
    return df.filter(~F.coalesce(writable(policies, role, command, rls), F.lit(False)))


def rls_coverage(df: DataFrame, policies: Sequence[Policy], roles: Sequence[str]) -> DataFrame:
    """Per role: rows, visible rows and whether the role would be locked out; one scan for all roles."""
    aggs = [F.count_if(visible(policies, r)).alias(f"v{i}") for i, r in enumerate(roles)]
    entries = [
        F.struct(
            F.lit(r).alias("role"), F.col("rows").alias("rows"), F.col(f"v{i}").alias("visible_rows"),
            (F.col(f"v{i}") == 0).alias("locked_out"),
        )
        for i, r in enumerate(roles)
    ]
    return df.agg(F.count(F.lit(1)).alias("rows"), *aggs).select(F.inline(F.array(*entries)))
