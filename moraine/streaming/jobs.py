"""Dual writes, monitors, quarantine and uniqueness on arriving rows.

Each transformation is a plain DataFrame function, so the batch twin of a
stream is the same function on a batch DataFrame.  ``run_to_files`` runs one to
the end of what has arrived; its sink and checkpoint belong on a shared folder.

Late rows: the dual write is stateless and drops none; the windowed monitors
drop rows older than the watermark, as Spark does by default.  Monitors report
in update mode, so a window that is still open is seen as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from moraine.operators.checks import RowRule, flag_reasons
from moraine.sources.files import is_dir


def stream_files(
    spark: SparkSession, path: str, schema: T.StructType | str, max_files: int | None = None
) -> DataFrame:
    """A file stream over a table that is a folder of files or one single file."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if is_dir(spark, path):
        return reader.parquet(path)
    folder, name = path.rstrip("/").rsplit("/", 1)
    return reader.option("pathGlobFilter", name).parquet(folder)


def dual_write(df: DataFrame, old: str, new: str, data_type: str, conversion: str | None = None) -> DataFrame:
    """Each row with its old column and the converted new one; a value that does not convert gives null."""
    source = F.col(old) if conversion is None else F.expr(conversion)
    return df.withColumn(new, source.try_cast(data_type))


def _windowed(df: DataFrame, time: str, delay: str, width: str, aggs: dict[str, Column]) -> DataFrame:
    # a watermark needs an instant; times without a zone are read in the session zone
    timed = df.withColumn(time, F.col(time).cast("timestamp"))
    if df.isStreaming:
        timed = timed.withWatermark(time, delay)
    return timed.groupBy(F.window(time, width)).agg(*[c.alias(n) for n, c in aggs.items()]).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        *aggs,
    )


def gap_monitor(
    df: DataFrame, time: str, old: str, new: str, delay: str = "10 minutes", width: str = "1 hour"
) -> DataFrame:
    """Per window: rows, rows without the new value, and of those the failed conversions."""
    return _windowed(df, time, delay, width, {
        "rows": F.count(F.lit(1)),
        "missing_new": F.count_if(F.col(new).isNull()),
        "failed": F.count_if(F.col(new).isNull() & F.col(old).isNotNull()),
    })


def write_monitor(
    df: DataFrame, time: str, cut_over: Column, delay: str = "10 minutes", width: str = "1 hour"
) -> DataFrame:
    """Per window after the cut-over: rows still arriving; any row is an alert."""
    late = df.filter(F.col(time) >= cut_over)
    return _windowed(late, time, delay, width, {"rows": F.count(F.lit(1))})


def unique_arrivals(df: DataFrame, keys: Sequence[str], time: str, delay: str = "10 minutes") -> DataFrame:
    """The first arrival of each key within the watermark's span; ``run_unique`` keeps the first by order, without limit."""
    timed = df.withColumn(time, F.col(time).cast("timestamp"))
    if not df.isStreaming:
        return timed.dropDuplicates(list(keys))
    return timed.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def run_to_files(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything that has arrived, append to Parquet files, stop."""
    query = (
        df.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def _batch_files(query, path: str, checkpoint: str, write) -> None:
    """Run a stream to the end of what has arrived; each micro-batch overwrites a folder of its own."""
    query.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_monitor(df: DataFrame, path: str, checkpoint: str) -> None:
    """Write the windows that a batch has changed, open ones included, with their counts so far."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    _batch_files(df.writeStream.outputMode("update"), path, checkpoint, write)


def monitored(spark: SparkSession, path: str) -> DataFrame:
    """The latest counts of every window of a monitor."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in ("window_start", "window_end", "batch_id")]
    latest = F.max_by(F.struct(*values), "batch_id").alias("v")
    return rows.groupBy("window_start", "window_end").agg(latest).select("window_start", "window_end", "v.*")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of each key the row that comes first by ``order``, kept as keyed state; a batch yields the keys whose first row it changed.

    One state row per key, however often the key arrives: a micro-batch loads
    and stores the keys it holds and no others.  Nulls of ``order`` come last,
    null keys are equal, and rows that are equal by ``order`` are told apart by
    a hash of the whole row, then by arrival.  Equal keys of a batch are combined
    before the shuffle.
    """
    # the instant of arrival is the same for all of a micro-batch, replays included
    whole = df.select(F.struct(*df.columns).alias("_row"), F.current_timestamp().alias("_arrived"))
    row = F.col("_row")
    rank = F.struct(*[c for o in order for c in (row[o].isNull(), row[o])], F.xxhash64("_row"), F.col("_arrived"))
    best = whole.groupBy(*[row[k].alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        F.min_by(F.struct("_row", "_arrived"), rank).alias("_best"))
    return best.filter(F.col("_best._arrived") == F.current_timestamp()).select("_best._row.*")


def run_unique(df: DataFrame, keys: Sequence[str], path: str, checkpoint: str, order: Sequence[str] = (),
               within: tuple[str, str] | None = None) -> None:
    """Publish one row of each key, the first by ``order`` (by arrival if none is given), however far apart its rows are.

    Each batch writes the keys whose first row it found or, when an earlier row
    came late, replaced; ``unique_rows`` reads the latest of each.  Nothing that
    was published is read again.  State holds one row per key for good; with
    ``within`` (time column, span) it expires: a key that comes back after the
    span counts as new, and rows later than the span are dropped.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    if within:
        time, span = within
        timed = df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, span)
        _batch_files(timed.dropDuplicatesWithinWatermark(list(keys)).writeStream, path, checkpoint, write)
    else:
        _batch_files(first_rows(df, keys, order).writeStream.outputMode("update"), path, checkpoint, write)


def unique_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The published row of every key: what the latest batch wrote of it."""
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c != "batch_id"]
    latest = F.max_by(F.struct(*columns), "batch_id").alias("_row")
    return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(latest).select(
        *[F.col("_row")[c].alias(c) for c in columns])


def run_quarantine(df: DataFrame, rules: Sequence[RowRule], path: str, checkpoint: str) -> None:
    """Split arriving rows into good and quarantined ones while they are written.

    Each micro-batch is one write, partitioned by ``outcome`` (good or
    quarantined), into a folder named after the batch.  A replayed batch overwrites its own folder,
    so a retry after a failure repeats no row.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        outcome = F.when(F.size("reasons") > 0, "quarantined").otherwise("good")
        flagged = flag_reasons(batch, rules).withColumn("outcome", outcome)
        flagged.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("outcome").parquet(
            f"{path}/batch_id={batch_id}"
        )

    query = (
        df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
