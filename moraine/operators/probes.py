"""Will a type change keep the values?  Answered on the data, one pass per table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T


def does_not_convert(column: Column, target: str) -> Column:
    return column.isNotNull() & column.try_cast(target).isNull()


def cast_probe(df: DataFrame, targets: Mapping[str, str]) -> DataFrame:
    """Per column: rows, non-null values, failed conversions, lowest and highest failing value."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, (name, target) in enumerate(targets.items()):
        bad = does_not_convert(F.col(name), target)
        aggs += [
            F.count(name).alias(f"n{i}"),
            F.count_if(bad).alias(f"f{i}"),
            F.min(F.when(bad, F.col(name))).cast("string").alias(f"lo{i}"),
            F.max(F.when(bad, F.col(name))).cast("string").alias(f"hi{i}"),
        ]
    entries = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.lit(target).alias("target"),
            F.col("rows").alias("rows"),
            F.col(f"n{i}").alias("non_null"),
            F.col(f"f{i}").alias("failed"),
            F.col(f"lo{i}").alias("lowest_failed"),
            F.col(f"hi{i}").alias("highest_failed"),
        )
        for i, (name, target) in enumerate(targets.items())
    ]
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def changes_on_round_trip(column: Column, old: str, new: str) -> Column:
    return ~column.eqNullSafe(column.try_cast(new).try_cast(old))


def round_trip_probe(df: DataFrame, targets: Mapping[str, str]) -> DataFrame:
    """Per column: rows whose value an old -> new -> old conversion would not restore."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, (name, target) in enumerate(targets.items()):
        aggs.append(F.count_if(changes_on_round_trip(F.col(name), types[name], target)).alias(f"c{i}"))
    entries = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.lit(types[name]).alias("old_type"),
            F.lit(target).alias("new_type"),
            F.col("rows").alias("rows"),
            F.col(f"c{i}").alias("changed"),
        )
        for i, (name, target) in enumerate(targets.items())
    ]
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def smallest_fit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Narrowest integer, ``varchar(n)`` or ``numeric(p,s)`` that holds every value."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    aggs, entries = [], []
    for i, name in enumerate(columns):
        kind, column = fields[name], F.col(name)
        if isinstance(kind, T.StringType):
            aggs.append(F.max(F.char_length(column)).alias(f"len{i}"))
            fit = F.concat(F.lit("varchar("), F.greatest(F.col(f"len{i}"), F.lit(1)).cast("string"), F.lit(")"))
        elif isinstance(kind, T.IntegralType):
            aggs += [F.min(column).alias(f"lo{i}"), F.max(column).alias(f"hi{i}")]
            lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
            fit = (
                F.when((lo >= -(2**15)) & (hi < 2**15), "smallint")
                .when((lo >= -(2**31)) & (hi < 2**31), "integer")
                .when(lo.isNotNull(), "bigint")
            )
        elif isinstance(kind, T.DecimalType):
            # digits before the point, and digits after it once trailing zeros go
            text = F.regexp_replace(F.abs(column).cast("string"), r"(\.\d*?)0+$", "$1")
            aggs += [
                F.max(F.char_length(F.regexp_extract(text, r"^0*(\d*)", 1))).alias(f"p{i}"),
                F.max(F.char_length(F.regexp_extract(text, r"\.(\d*)", 1))).alias(f"s{i}"),
            ]
            p, s = F.col(f"p{i}"), F.col(f"s{i}")
            fit = F.concat(F.lit("numeric("), F.greatest(p + s, F.lit(1)).cast("string"), F.lit(","),
                           s.cast("string"), F.lit(")"))
        else:
            raise ValueError(f"no narrower form for {name} of {kind.simpleString()}")
        entries.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.lit(kind.simpleString()).alias("current_type"),
                F.coalesce(fit, F.lit("empty")).alias("smallest_type"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


# ------------------------------------------------- conversions with their loss


def timestamp_to_date(df: DataFrame, column: str) -> DataFrame:
    """The column as a date; ``{column}_lost_time`` marks rows that had a time part."""
    c = F.col(column)
    lost = F.coalesce(c != F.date_trunc("day", c), F.lit(False))
    return df.withColumn(f"{column}_lost_time", lost).withColumn(column, c.cast("date"))


def decimal_rescale(df: DataFrame, column: str, precision: int, scale: int) -> DataFrame:
    """The column rounded to the scale; ``{column}_changed`` marks rows whose value moved."""
    target = f"decimal({precision},{scale})"
    # in the column's own type: any fixed one would be too narrow for some values
    own = df.schema[column].dataType
    exact = own.simpleString() if isinstance(own, T.NumericType) else "double"
    value = F.col(column).cast(exact)
    moved = F.round(value, scale)
    rounded = moved.cast(target)
    changed = F.coalesce(moved.try_cast(exact) != value, value.isNotNull())
    return df.withColumn(f"{column}_changed", changed).withColumn(column, rounded)


def text_to_int(df: DataFrame, column: str, target: str = "int") -> tuple[DataFrame, DataFrame]:
    """Rows that convert, converted, and the rows that do not, as they were."""
    bad = does_not_convert(F.col(column), target)
    return df.filter(~bad).withColumn(column, F.col(column).try_cast(target)), df.filter(bad)


def text_to_array(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.array(F.col(column)))


def array_to_text(df: DataFrame, column: str, separator: str = ",") -> DataFrame:
    """Elements joined by the separator, null elements left out, null for a null array."""
    return df.withColumn(column, F.array_join(F.col(column), separator))


def enum_recode(df: DataFrame, column: str, mapping: Mapping[str, str] | DataFrame, into: str) -> DataFrame:
    """New code of each value in ``into``; null where the mapping has no entry.

    A mapping given as a dict is a literal; given as a two-column DataFrame it is
    joined after repeats are removed, and Spark decides at run time, from its
    measured size, whether to broadcast it.
    """
    old = F.col(column).cast("string")
    if isinstance(mapping, DataFrame):
        table = mapping.toDF("_from", into).dropDuplicates(["_from"])
        return df.join(table, old == F.col("_from"), "left").drop("_from")
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(into, table[old])


def sample_compare(df: DataFrame, key: str, column: str, target: str, n: int) -> DataFrame:
    """First ``n`` rows by key: old value, converted value and the way back."""
    old_type = dict(df.dtypes)[column]
    c = F.col(column)
    return df.select(
        key, c.alias("old_value"), c.try_cast(target).alias("new_value"),
        c.try_cast(target).try_cast(old_type).alias("back_value"),
    ).orderBy(key).limit(n)

