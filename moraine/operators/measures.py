"""Counts, sizes and content comparison: one aggregate pass each."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Bytes of a stored value of each fixed-width type.
FIXED_WIDTH = {
    "boolean": 1,
    "tinyint": 1,
    "smallint": 2,
    "int": 4,
    "bigint": 8,
    "float": 4,
    "double": 8,
    "date": 4,
    "timestamp": 8,
    "timestamp_ntz": 8,
}


def value_bytes(column: Column, data_type: T.DataType) -> Column:
    """Bytes a value holds, null for null."""
    name = data_type.simpleString()
    if isinstance(data_type, (T.StringType, T.BinaryType)):
        return F.octet_length(column).cast("bigint")
    if isinstance(data_type, T.DecimalType):
        width = 8 if data_type.precision <= 18 else 16
    elif isinstance(data_type, T.ArrayType):
        item = data_type.elementType
        if item.simpleString() in FIXED_WIDTH:
            return F.size(column).cast("bigint") * FIXED_WIDTH[item.simpleString()]
        sizes = F.transform(column, lambda x: F.coalesce(value_bytes(x, item), F.lit(0).cast("bigint")))
        return F.aggregate(sizes, F.lit(0).cast("bigint"), lambda a, b: a + b)
    elif name in FIXED_WIDTH:
        width = FIXED_WIDTH[name]
    else:  # maps, structs, variants: size of the text form
        return F.octet_length(F.to_json(column)).cast("bigint")
    return F.when(column.isNotNull(), F.lit(width).cast("bigint"))


def null_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(column).isNull()).alias("null_rows")
    )


def pending(new: str, old: str) -> Column:
    """True on rows a backfill still has to fill."""
    return F.col(new).isNull() & F.col(old).isNotNull()


def backfill_gap_count(df: DataFrame, new: str, old: str) -> DataFrame:
    return df.agg(F.count_if(pending(new, old)).alias("gap"))


def row_count_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left_rows, right_rows, matches``; both counts come from file metadata where possible."""
    l = left.agg(F.count(F.lit(1)).alias("left_rows"), F.lit(0).cast("bigint").alias("right_rows"))
    r = right.agg(F.lit(0).cast("bigint").alias("left_rows"), F.count(F.lit(1)).alias("right_rows"))
    return (
        l.union(r)
        .agg(F.sum("left_rows").alias("left_rows"), F.sum("right_rows").alias("right_rows"))
        .withColumn("matches", F.col("left_rows") == F.col("right_rows"))
    )


def marked(column: Column, data_type: T.DataType) -> Column:
    """A value in a form that hashes fully: nulls marked and lengths given at every depth, maps as sorted entries."""
    null = column.isNull().alias("null")
    if isinstance(data_type, T.ArrayType):
        items = F.transform(column, lambda x: marked(x, data_type.elementType))
        return F.struct(null, F.size(column).alias("n"), items.alias("v"))
    if isinstance(data_type, T.MapType):
        entries = F.transform(F.map_entries(column), lambda e: F.struct(
            marked(e["key"], data_type.keyType).alias("k"), marked(e["value"], data_type.valueType).alias("v")))
        return F.struct(null, F.size(column).alias("n"), F.array_sort(entries).alias("v"))
    if isinstance(data_type, T.StructType):
        return F.struct(null, *[marked(column[f.name], f.dataType).alias(f"f{i}") for i, f in enumerate(data_type.fields)])
    if data_type.simpleString() == "variant":
        return F.struct(null, F.to_json(column).alias("v"))
    return F.struct(null, column.alias("v"))


def row_hash(df: DataFrame, columns: Sequence[str], seed: str | None = None) -> Column:
    """64-bit hash of a row's values; another seed gives a hash of its own of the same values."""
    values = [marked(df[c], df.schema[c].dataType) for c in columns]
    return F.xxhash64(*([F.lit(seed)] if seed else []), *values)


def same_types(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> bool:
    """Whether the columns have the same types on both sides, nullability aside."""
    return all(left.schema[c].dataType.simpleString() == right.schema[c].dataType.simpleString() for c in columns)


def fingerprint(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Aggregates ``n, x, low, high`` that are the same for the same rows in any order."""
    # XOR alone cancels pairs of equal rows; the count and the sums over a second,
    # differently seeded hash do not.  Two 20-bit slices keep the sums inside a
    # long for 10^12 rows and more.
    first, second = row_hash(df, columns), row_hash(df, columns, "second")
    return [
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(first).alias("x"),
        F.sum(second.bitwiseAND(F.lit(0xFFFFF))).alias("low"),
        F.sum(F.shiftrightunsigned(second, 44)).alias("high"),
    ]


def content_compare(left: DataFrame, right: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row, ``left_rows, right_rows, matches``: the same rows of the same types, in any order, with repeats.

    Fingerprints are sums over rows, so each side is one scan and one tiny
    exchange, whatever its size.
    """
    columns = list(columns or left.columns)
    sides = [df.agg(*fingerprint(df, columns)).withColumn("side", F.lit(i)) for i, df in enumerate((left, right))]
    both = reduce(DataFrame.unionByName, sides)
    same = [F.min(F.coalesce(F.col(c).cast("string"), F.lit(""))) == F.max(F.coalesce(F.col(c).cast("string"), F.lit("")))
            for c in ("n", "x", "low", "high")]
    typed = F.lit(same_types(left, right, columns))
    rows = [F.max(F.when(F.col("side") == i, F.col("n"))).alias(n) for i, n in enumerate(("left_rows", "right_rows"))]
    return both.agg(*rows, reduce(lambda a, b: a & b, same, typed).alias("matches"))


def content_match(left: DataFrame, right: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row, ``matches``: the outcome of ``content_compare`` alone."""
    return content_compare(left, right, columns).select("matches")


def drop_column_impact(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: rows, non-null values, bytes and MB a drop would lose."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        size = F.coalesce(F.sum(value_bytes(F.col(c), fields[c])), F.lit(0))
        aggs += [F.count(c).alias(f"n{i}"), size.alias(f"b{i}")]
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col("rows").alias("rows"),
            F.col(f"n{i}").alias("non_null"),
            F.col(f"b{i}").alias("bytes"),
            F.round(F.col(f"b{i}") / F.lit(1048576.0), 2).alias("mb"),
        )
        for i, c in enumerate(columns)
    ]
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def drop_table_impact(df: DataFrame) -> DataFrame:
    """Rows, bytes and MB a drop of the whole table would lose."""
    zero = F.lit(0).cast("bigint")
    per_row = reduce(
        lambda a, b: a + b, [F.coalesce(value_bytes(F.col(f.name), f.dataType), zero) for f in df.schema.fields]
    )
    total = F.coalesce(F.sum(per_row), zero)
    return df.agg(F.count(F.lit(1)).alias("rows"), total.alias("bytes")).withColumn(
        "mb", F.round(F.col("bytes") / F.lit(1048576.0), 2)
    )


def identity_high_water_mark(df: DataFrame, column: str) -> DataFrame:
    """Value to seed a sequence with: the largest id, 1 when there is none."""
    return df.agg(F.coalesce(F.max(column), F.lit(1).cast("bigint")).alias("high_water_mark"))
