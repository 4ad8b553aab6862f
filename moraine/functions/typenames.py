"""Type names, defaults and conversions as Column expressions.

All of it stays inside whole-stage codegen: the lookup tables are literals of a
few dozen entries, so no join and no Python worker is involved.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Internal type name -> standard type name.
STANDARD_NAMES = {
    "int2": "smallint",
    "int4": "integer",
    "int8": "bigint",
    "serial2": "smallserial",
    "serial4": "serial",
    "serial8": "bigserial",
    "bool": "boolean",
    "bpchar": "char",
    "float4": "real",
    "float8": "double precision",
    "timestamp": "timestamp without time zone",
    "timestamptz": "timestamp with time zone",
    "time": "time without time zone",
    "timetz": "time with time zone",
}

# Names the standard table leaves as they are (lower-cased).
PLAIN_NAMES = ("serial", "varchar", "text", "numeric", "decimal")

# Conversions that always keep the value.
WIDENING = {
    "SMALLINT": ("INTEGER", "BIGINT", "NUMERIC", "DECIMAL"),
    "INTEGER": ("BIGINT", "NUMERIC", "DECIMAL"),
    "BIGINT": ("NUMERIC", "DECIMAL"),
    "REAL": ("DOUBLE PRECISION", "NUMERIC", "DECIMAL"),
    "DOUBLE PRECISION": ("NUMERIC", "DECIMAL"),
    "VARCHAR": ("TEXT",),
    "CHAR": ("VARCHAR", "TEXT"),
    "DATE": ("TIMESTAMP", "TIMESTAMPTZ"),
    "TIMESTAMP": ("TIMESTAMPTZ",),
}

# Names that diffs use, as the widening table spells them.
SHORT_NAMES = {
    "TIMESTAMP WITHOUT TIME ZONE": "TIMESTAMP",
    "TIMESTAMP WITH TIME ZONE": "TIMESTAMPTZ",
    "CHARACTER VARYING": "VARCHAR",
    "CHARACTER": "CHAR",
}

# The type names the lint accepts (standard names, their internal
# spellings, and the remaining types of the supported matrix).
KNOWN_TYPES = tuple(
    sorted(
        set(STANDARD_NAMES)
        | set(STANDARD_NAMES.values())
        | set(PLAIN_NAMES)
        | {"int", "double", "float", "character varying", "character", "date", "uuid", "json",
           "jsonb", "bytea", "blob"}
    )
)

# Standard type name -> Spark type.
SPARK_TYPES = {
    "smallint": "smallint",
    "smallserial": "smallint",
    "integer": "int",
    "int": "int",
    "serial": "int",
    "bigint": "bigint",
    "bigserial": "bigint",
    "real": "float",
    "double precision": "double",
    "double": "double",
    "float": "double",
    "numeric": "decimal(38,18)",
    "decimal": "decimal(38,18)",
    "text": "string",
    "string": "string",
    "varchar": "string",
    "character varying": "string",
    "char": "string",
    "boolean": "boolean",
    "date": "date",
    "timestamp without time zone": "timestamp_ntz",
    "timestamp_ntz": "timestamp_ntz",
    "timestamp with time zone": "timestamp",
    "time without time zone": "string",
    "time with time zone": "string",
    "uuid": "string",
    "json": "string",
    "jsonb": "string",
    "bytea": "binary",
    "blob": "binary",
    "binary": "binary",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.create_map(*pairs)[key]


def base_type(raw: Column) -> Column:
    """The name part of ``pg_catalog.varchar(20)[]``."""
    return F.trim(F.regexp_extract(raw, r"^(?:pg_catalog\.)?([^(\[]*)", 1))


def normalize_type(raw: Column) -> Column:
    """Standard type name; ``(p,s)`` is kept, any array prints as one ``[]``."""
    known = {**STANDARD_NAMES, **{n: n for n in PLAIN_NAMES}}
    # most names are one bare word: those need a lookup and no pattern
    bare = ~raw.contains("(") & ~raw.contains("[") & ~raw.startswith("pg_catalog.")
    base = base_type(raw)
    name = F.coalesce(_lookup(known, F.lower(base)), base)
    mods = F.regexp_replace(F.regexp_extract(raw, r"(\([0-9, ]*\))", 1), " ", "")
    dims = F.when(raw.contains("["), F.lit("[]")).otherwise(F.lit(""))
    return F.when(bare, F.coalesce(_lookup(known, F.lower(raw)), F.trim(raw))).otherwise(F.concat(name, mods, dims))


def logical_type(raw: Column) -> Column:
    """The one spelling that diff and hash both compare."""
    return F.lower(normalize_type(raw))


def normalize_default(raw: Column) -> Column:
    """Cut the last ``::type`` when it stands outside quotes and parentheses."""
    head = F.regexp_extract(raw, r"(?s)^(.+)::", 1)

    def number(text: Column, mark: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))

    bare = F.regexp_replace(head, r"'[^']*(?:''[^']*)*'", "")
    closed = (number(head, "'") % 2 == 0) & (number(bare, "(") == number(bare, ")"))
    return F.when((head != "") & closed, head).otherwise(raw)


def conversion_name(raw: Column) -> Column:
    """Type name as the widening table spells it: no size, upper case, letters only, the short of two names."""
    name = F.trim(F.upper(F.regexp_replace(F.regexp_extract(raw, r"^([^(]*)", 1), r"[^A-Za-z _]", "")))
    return F.coalesce(_lookup(SHORT_NAMES, name), name)


def is_widening(old: Column, new: Column) -> Column:
    """True when every value of ``old`` fits ``new`` by the static table."""
    pairs = [f"{a}>{b}" for a, targets in WIDENING.items() for b in targets]
    a, b = conversion_name(old), conversion_name(new)
    return (a == b) | F.concat(a, F.lit(">"), b).isin(pairs)


def spark_type(name: str) -> str:
    """Spark type for a standard or internal type name."""
    match = re.fullmatch(r"\s*(?:pg_catalog\.)?([^(\[]+?)\s*(\([0-9, ]*\))?\s*(\[.*\])?\s*", name)
    if not match:
        raise ValueError(f"not a type name: {name!r}")
    base, mods, dims = match.group(1).lower(), match.group(2), match.group(3)
    base = STANDARD_NAMES.get(base, base)
    if base not in SPARK_TYPES:
        raise ValueError(f"no Spark type for {name!r}")
    spark = SPARK_TYPES[base]
    if base in ("numeric", "decimal") and mods:
        spark = "decimal" + mods.replace(" ", "")
    return f"array<{spark}>" if dims else spark


_CURRENT = {
    "current_date": lambda now: F.to_date(now),
    "current_time": lambda now: F.date_format(now, "HH:mm:ss"),
    "current_timestamp": lambda now: now,
    "now": lambda now: now,
    "localtime": lambda now: F.date_format(now, "HH:mm:ss"),
    "localtimestamp": lambda now: now,
}
_IDENTITY = {"current_user", "user", "session_user", "current_role"}
_FUNCTIONS = {"lower": F.lower, "upper": F.upper, "trim": F.trim, "md5": F.md5, "concat": F.concat}


def default_column(text: str, now: Column | None = None) -> Column:
    """Value of a declared default.

    Accepts the forms a definition may hold: number, quoted string, boolean,
    NULL, a cast (dropped), a current-time or current-user keyword, and calls of
    the listed functions on such values.  Everything else raises, so that no
    placeholder can reach the data.  ``now`` fixes the clock for a whole job.
    """
    text = text.strip()
    clock = F.current_timestamp() if now is None else now
    cast = re.fullmatch(r"(?s)(.+)::\s*[\w ]+(?:\([0-9, ]*\))?(?:\[\])?", text)
    if cast and cast.group(1).count("'") % 2 == 0 and cast.group(1).count("(") == cast.group(1).count(")"):
        return default_column(cast.group(1), now)
    if re.fullmatch(r"[+-]?\d+", text):
        return F.lit(int(text))
    if re.fullmatch(r"[+-]?\d*\.\d+(?:[eE][+-]?\d+)?", text):
        return F.lit(float(text))
    if re.fullmatch(r"(?s)'(?:[^']|'')*'", text):
        return F.lit(text[1:-1].replace("''", "'"))
    word = text.lower()
    if word in ("true", "false"):
        return F.lit(word == "true")
    if word == "null":
        return F.lit(None)
    if word in _IDENTITY:
        return F.current_user()
    timed = re.fullmatch(r"([a-z_]+)\s*(?:\(\s*\d*\s*\))?", word)
    if timed and timed.group(1) in _CURRENT:
        return _CURRENT[timed.group(1)](clock)
    call = re.fullmatch(r"(?s)(\w+)\((.+)\)", text)
    if call and call.group(1).lower() in _FUNCTIONS:
        # commas inside quotes or brackets do not separate arguments
        args = re.findall(r"(?:'(?:[^']|'')*'|\([^()]*\)|[^,'()])+", call.group(2))
        return _FUNCTIONS[call.group(1).lower()](*[default_column(a, now) for a in args])
    raise ValueError(f"default is not in the list of supported expressions: {text!r}")
