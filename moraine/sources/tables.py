"""Reading a set of tables from one folder."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from moraine.sources.files import list_names


def read_table_set(
    spark: SparkSession,
    folder: str,
    schemas: Mapping[str, T.StructType | str] | None = None,
    suffix: str = ".parquet",
    register: bool = False,
) -> dict[str, DataFrame]:
    """Every table directly below the folder, by name, in name order.

    A declared schema is used as it is; otherwise the Parquet footer states it.
    Nothing is inferred from rows.  A folder without tables is an error.
    """
    names = [n[: -len(suffix)] for n in list_names(spark, folder) if n.endswith(suffix)]
    if not names:
        raise FileNotFoundError(f"no {suffix} tables in {folder}")
    tables = {}
    for name in names:
        reader = spark.read
        if schemas and name in schemas:
            reader = reader.schema(schemas[name])
        tables[name] = reader.parquet(f"{folder.rstrip('/')}/{name}{suffix}")
        if register:
            tables[name].createOrReplaceTempView(name)
    return tables


def table_set_summary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table_name, columns, rows`` of each table; the counts read file footers only."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table_name"), F.lit(len(df.columns)).cast("bigint").alias("columns"), "rows"
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)
