"""Table evolution as projections.

Each change is a narrow DataFrame -> DataFrame step, so a whole list of them
collapses into one projection over one scan.  The old file-based table cannot
be altered in place; it is rewritten through the projection and then published.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from moraine.functions.typenames import default_column


def add_column(
    df: DataFrame, name: str, data_type: str, default: str | None = None, now: Column | None = None
) -> DataFrame:
    """A new last column: null, or the declared default, on every existing row."""
    if name in df.columns:
        raise ValueError(f"column {name} exists already")
    value = F.lit(None) if default is None else default_column(default, now)
    return df.withColumn(name, value.cast(data_type))


def drop_column(df: DataFrame, name: str) -> DataFrame:
    _require(df, name)
    return df.drop(name)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    _require(df, old)
    return df.withColumnRenamed(old, new)


def alter_column_type(df: DataFrame, name: str, data_type: str, using: str | None = None) -> DataFrame:
    """Change a type in place; a value that does not fit fails the job.

    ``using`` is the conversion expression, by default a plain cast.
    """
    _require(df, name)
    value = F.col(name) if using is None else F.expr(using)
    return df.withColumn(name, value.cast(data_type))


def generated_column(df: DataFrame, name: str, expression: str, data_type: str = "string") -> DataFrame:
    return df.withColumn(name, F.expr(expression).cast(data_type))


def append_with_defaults(
    df: DataFrame, incoming: DataFrame, defaults: dict[str, str], now: Column | None = None
) -> DataFrame:
    """Append rows that may omit columns: an omitted one takes its default, else null.

    A column that is present keeps its nulls.
    """
    types = dict(df.dtypes)
    for name, text in defaults.items():
        if name not in incoming.columns:
            incoming = incoming.withColumn(name, default_column(text, now).cast(types[name]))
    return df.unionByName(incoming.select("*"), allowMissingColumns=True)


def recreate_copy(df: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Copy into a new definition: the listed columns, in that order, with those types."""
    for name, _ in columns:
        _require(df, name)
    return df.select(*[F.col(n).cast(t).alias(n) for n, t in columns])


def file_layout(df: DataFrame, columns: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted by the columns, what a plain index is for a reader.

    Range bounds come from a sample, so a frequent key prefix gets more files;
    rows of one key value that fills several files stay together.
    """
    cols = [F.col(c) for c in columns]
    spread = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    return spread.sortWithinPartitions(*cols)


def curve_layout(df: DataFrame, columns: Sequence[str], partitions: int | None = None, bits: int = 5) -> DataFrame:
    """Rows laid out along a Z-order curve over several numeric or date columns, so files are narrow in each of them.

    A range layout narrows only its first column; here a probe on any of the
    columns skips files by their minima and maxima.  Each column is cut into up
    to 2^``bits`` ranges of about equal rows, found by one aggregate of
    approximate percentiles, and the bits of a row's ranks are interleaved, the
    first column's first.  Nulls come before all ranges.
    """
    cuts = [i / 2**bits for i in range(1, 2**bits)]
    found = df.agg(*[F.percentile_approx(c, cuts, 1000).alias(f"b{i}") for i, c in enumerate(columns)]).first()
    bounds = [sorted(set(found[f"b{i}"] or [])) for i in range(len(columns))]
    # few values give few ranges; their numbers are spread over all bits
    ranks = {f"_rank{i}": reduce(lambda a, b: a + b, [
        F.when(F.col(c) >= F.lit(b), 1).otherwise(0) for b in bounds[i]], F.lit(0)) for i, c in enumerate(columns)}
    ranks = {n: F.floor(r * 2**bits / (len(bounds[i]) + 1)).cast("int") for i, (n, r) in enumerate(ranks.items())}
    place = F.lit(0).cast("bigint")
    for bit in range(bits - 1, -1, -1):
        for name in ranks:
            place = F.shiftleft(place, 1) + F.shiftright(name, bit).bitwiseAND(F.lit(1))
    keyed = df.withColumns(ranks).withColumn("_curve", place)
    spread = keyed.repartitionByRange(partitions, "_curve") if partitions else keyed.repartitionByRange("_curve")
    return spread.sortWithinPartitions("_curve", *columns).select(*df.columns)


def files_admitting(df: DataFrame, probes: Mapping[str, object]) -> DataFrame:
    """Per probed column: ``files`` of a table read from files, and those whose minimum and maximum admit the value."""
    spans = df.groupBy(F.col("_metadata.file_path").alias("file")).agg(*[
        a.alias(n) for i, c in enumerate(probes) for a, n in ((F.min(c), f"lo{i}"), (F.max(c), f"hi{i}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(v).between(F.col(f"lo{i}"), F.col(f"hi{i}")).alias("admits"))
                     for i, (c, v) in enumerate(probes.items())])
    return spans.select(F.inline(rows)).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("files"), F.count_if("admits").alias("admitting"))


def _require(df: DataFrame, name: str) -> None:
    if name not in df.columns:
        raise ValueError(f"no column {name} in {df.columns}")
