"""What a DDL or DML statement does, read off its text as Column expressions.

The matchers look at prefixes and substrings of the upper-cased, trimmed text.
``blank_literals`` hides comments and single-quoted text first where a keyword
inside them would mislead; it does not know dollar quoting or nested comments.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Lock modes from weakest to strongest.
LOCK_MODES = (
    "ACCESS SHARE",
    "ROW SHARE",
    "ROW EXCLUSIVE",
    "SHARE UPDATE EXCLUSIVE",
    "SHARE",
    "SHARE ROW EXCLUSIVE",
    "EXCLUSIVE",
    "ACCESS EXCLUSIVE",
)
# Impact of each lock mode, same order, and the impact names.
IMPACT_OF_MODE = (0, 0, 0, 1, 2, 3, 3, 3)
IMPACT_NAMES = ("NONE", "LOW", "MEDIUM", "HIGH")

_IDENT = "([a-zA-Z_][a-zA-Z0-9_]*)"
# the word COLUMN is optional; DROP NOT NULL and the like drop no column
_DROP = r"(?is)\bDROP\s+(?:COLUMN\b|(?!CONSTRAINT\b|NOT\b|DEFAULT\b|IDENTITY\b|EXPRESSION\b)\w)"
_DROPS_COLUMN = r"(?is)^\s*ALTER\s+TABLE\b.*" + _DROP.removeprefix("(?is)")


_SPACE = " \t\n\r\x0b\x0c"


def normalized(sql: Column) -> Column:
    """Trimmed, upper-cased text.  The lock and impact tests take this form.

    Callers put it in a column of its own first, so it is computed once a row
    and not once per test.
    """
    return F.upper(F.trim(sql, F.lit(_SPACE)))


def _starts(text: Column, *prefixes: str) -> Column:
    return reduce(lambda a, b: a | b, [text.startswith(p) for p in prefixes])


def _mode(name: str) -> Column:
    return F.lit(LOCK_MODES.index(name))


def lock_level(text: Column) -> Column:
    """Strength 0..7 of the lock a normalized statement takes; unknown text counts as strongest."""
    index = F.when(text.contains("CONCURRENTLY"), _mode("SHARE UPDATE EXCLUSIVE")).otherwise(_mode("SHARE"))
    alter = F.when(
        text.contains("VALIDATE CONSTRAINT") & ~text.contains("ADD CONSTRAINT"), _mode("SHARE UPDATE EXCLUSIVE")
    ).otherwise(_mode("ACCESS EXCLUSIVE"))
    return (
        F.when(text == "", _mode("ACCESS SHARE"))
        .when(_starts(text, "CREATE INDEX", "CREATE UNIQUE INDEX"), index)
        .when(_starts(text, "ALTER TABLE"), alter)
        .when(_starts(text, "CREATE TABLE", "SELECT"), _mode("ACCESS SHARE"))
        .when(_starts(text, "INSERT", "UPDATE", "DELETE"), _mode("ROW EXCLUSIVE"))
        .otherwise(_mode("ACCESS EXCLUSIVE"))
    )


def lock_name(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in LOCK_MODES]), level + 1)


def impact_level(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(i) for i in IMPACT_OF_MODE]), level + 1)


def impact_name(impact: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in IMPACT_NAMES]), impact + 1)


def blocks_reads(level: Column) -> Column:
    return level == _mode("ACCESS EXCLUSIVE")


def blocks_writes(level: Column) -> Column:
    return level >= _mode("SHARE")


def table_name(sql: Column) -> Column:
    """Table of an ALTER TABLE; empty when there is none."""
    return F.regexp_extract(sql, r"(?i)ALTER\s+TABLE\s+" + _IDENT, 1)


def column_name(sql: Column) -> Column:
    return F.regexp_extract(sql, r"(?i)ALTER\s+COLUMN\s+" + _IDENT, 1)


def constraint_name(sql: Column) -> Column:
    """Named constraint, else ``{table}_check|_unique|_fkey``, else a fixed word."""
    named = F.regexp_extract(sql, r"(?i)ADD\s+CONSTRAINT\s+" + _IDENT + r"\s+", 1)
    named = F.when(F.upper(named).isin("", "CHECK", "UNIQUE", "FOREIGN", "PRIMARY"), F.lit(None)).otherwise(named)
    text, table = F.upper(sql), table_name(sql)
    suffix = (
        F.when(text.contains("CHECK"), "_check")
        .when(text.contains("UNIQUE"), "_unique")
        .when(text.contains("FOREIGN KEY"), "_fkey")
    )
    derived = F.when(table != "", F.concat(table, suffix))
    return F.coalesce(named, derived, F.lit("constraint_name"))


def rewrite_kind(sql: Column, text: Column) -> Column:
    """``concurrent_index``, ``not_valid_then_validate``, ``type_change`` or null.

    ``text`` is the normalized form of ``sql``.
    """
    index = _starts(text, "CREATE INDEX", "CREATE UNIQUE INDEX") & ~text.contains("CONCURRENTLY")
    add = (
        text.contains("ALTER TABLE") & text.contains("ADD CONSTRAINT")
        & ~text.contains("NOT VALID") & ~text.contains("VALIDATE CONSTRAINT") & (table_name(sql) != "")
    )
    retype = (
        text.contains("ALTER TABLE") & text.contains("ALTER COLUMN") & text.contains("TYPE")
        & (table_name(sql) != "") & (column_name(sql) != "")
    )
    return F.when(index, "concurrent_index").when(add, "not_valid_then_validate").when(retype, "type_change")


def rewritten(sql: Column, kind: Column) -> Column:
    """The safer statements of a rewrite kind as an array; empty for ``type_change``, null for none."""
    body = F.trim(sql, F.lit(_SPACE))
    index = F.regexp_replace(body, r"(?i)^(CREATE\s+(?:UNIQUE\s+)?INDEX)", "$1 CONCURRENTLY")
    not_valid = F.when(body.endswith(";"), F.concat(F.regexp_replace(body, ";$", ""), F.lit(" NOT VALID;"))).otherwise(
        F.concat(body, F.lit(" NOT VALID"))
    )
    validate = F.concat(
        F.lit("ALTER TABLE "), table_name(sql), F.lit(" VALIDATE CONSTRAINT "), constraint_name(sql)
    )
    return (
        F.when(kind == "concurrent_index", F.array(index))
        .when(kind == "not_valid_then_validate", F.array(not_valid, validate))
        .when(kind == "type_change", F.array().cast("array<string>"))
    )


def should_rewrite(level: Column, duration_ms: Column | None = None) -> Column:
    """Impact MEDIUM or more; a measured duration adds > 1000 ms and blocked writes."""
    by_impact = impact_level(level) >= 2
    if duration_ms is None:
        return by_impact
    return by_impact | F.coalesce(duration_ms > 1000, F.lit(False)) | blocks_writes(level)


def blank_literals(sql: Column) -> Column:
    """Trimmed text with comments and quoted strings blanked, for keyword tests.

    One pass decides what each mark opens, so an apostrophe in a comment opens no
    string and two dashes in a string no comment.
    """
    text = F.regexp_replace(sql, r"('[^']*(?:''[^']*)*')|--[^\n]*|/\*[\s\S]*?\*/", "$1 ")
    return F.trim(F.regexp_replace(text, r"'[^']*(?:''[^']*)*'", "''"), F.lit(_SPACE))


def _once(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also after a filter on it moved down the plan."""
    return F.transform(F.array(value), body)[0]


def dangerous_code(sql: Column) -> Column:
    """Code of the data-losing statement, or null."""
    return _once(blank_literals(sql), lambda text: (
        F.when(text.rlike(r"(?is)^\s*DROP\s+TABLE\b"), "dangerous_drop_table")
        .when(text.rlike(r"(?is)^\s*TRUNCATE\b"), "dangerous_truncate")
        .when(
            text.rlike(r"(?is)^\s*DELETE\s+FROM\b") & ~text.rlike(r"(?is)\bWHERE\b"), "dangerous_delete_all"
        )
        .when(text.rlike(_DROPS_COLUMN), "dangerous_drop_column")
    ))


def dangerous_codes(sql: Column) -> Column:
    """All codes of a statement: one for each column that an ALTER TABLE drops, else the one there is."""
    code = dangerous_code(sql)
    drops = F.regexp_count(blank_literals(sql), F.lit(_DROP))
    times = F.when(code == "dangerous_drop_column", F.greatest(drops, F.lit(1))).otherwise(F.lit(1))
    return F.when(code.isNotNull(), F.array_repeat(code, times))


def non_declarative_code(sql: Column) -> Column:
    """Code of a statement that does not belong in a declared schema, or null."""
    return _once(blank_literals(sql), lambda text: (
        F.when(
            text.rlike(r"(?is)^\s*CREATE\s+(?:TEMP\s+|UNLOGGED\s+)?TABLE\s+IF\s+NOT\s+EXISTS\b")
            | text.rlike(r"(?is)^\s*CREATE\s+(?:UNIQUE\s+)?INDEX\s+(?:CONCURRENTLY\s+)?IF\s+NOT\s+EXISTS\b"),
            "non_declarative_if_not_exists",
        )
        .when(
            text.rlike(r"(?is)^\s*(?:BEGIN|COMMIT|END|ROLLBACK|START\s+TRANSACTION|SAVEPOINT|RELEASE|ABORT)\b"),
            "non_declarative_transaction",
        )
        .when(text.rlike(r"(?is)^\s*CREATE\s+OR\s+REPLACE\s+(?:TEMP\s+|RECURSIVE\s+)?VIEW\b"),
              "non_declarative_or_replace")
    ))
