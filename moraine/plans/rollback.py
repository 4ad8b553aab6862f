"""Rolling a change back, and knowing beforehand what that would cost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from moraine.operators.measures import row_hash, same_types
from moraine.operators.probes import changes_on_round_trip
from moraine.plans.phases import archive_restore


def rollback_drop_column(
    df: DataFrame, column: str, data_type: str, archive: DataFrame | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Re-add a dropped column: from its archive when there is one, else null."""
    if archive is None:
        return df.withColumn(column, F.lit(None).cast(data_type))
    return archive_restore(df, archive, keys, column)


def rollback_alter_type(df: DataFrame, column: str, old_type: str) -> DataFrame:
    """Cast back; ``{column}_unfit`` marks rows whose value the old type cannot hold."""
    back = F.col(column).try_cast(old_type)
    unfit = changes_on_round_trip(F.col(column), dict(df.dtypes)[column], old_type)
    return df.withColumn(f"{column}_unfit", unfit).withColumn(column, back)


def rollback_check(before: DataFrame, restored: DataFrame) -> DataFrame:
    """Rows only before and rows only after, counting repeats; identical if both are 0 and the types are the same.

    Each distinct row is collapsed to one signed count under its 128-bit digest,
    so both differences come from one narrow shuffle and equal rows meet before it.
    """
    columns = before.columns

    def signed(df: DataFrame, sign: int) -> DataFrame:
        return df.select(row_hash(df, columns).alias("_x"), row_hash(df, columns, "second").alias("_y"), F.lit(sign).alias("_d"))

    per_row = signed(before, 1).unionByName(signed(restored, -1)).groupBy("_x", "_y").agg(F.sum("_d").alias("_d"))
    return per_row.agg(
        F.coalesce(F.sum(F.greatest(F.col("_d"), F.lit(0))), F.lit(0)).alias("only_before"),
        F.coalesce(F.sum(F.greatest(-F.col("_d"), F.lit(0))), F.lit(0)).alias("only_after"),
    ).withColumn("identical", (F.col("only_before") == 0) & (F.col("only_after") == 0)
                 & F.lit(set(columns) == set(restored.columns) and same_types(before, restored, columns)))
