"""What the text operators share: reading, words, row numbers, learning folds, runs of equal keys."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from moraine.session import scratch_dir

#: White space of the contracts: blank and the control characters from tab to carriage return.
GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(key: Column) -> Column:
    """crc32 of the key as text, mod 5; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def numbered(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """The rows written to the shared folder with ``row``, a number of their own.

    Row numbers are fixed by the write, so a task that is run again, or a later
    plan that reads fewer columns, sees the same ones.
    """
    path = scratch_dir(df.sparkSession, label)
    rows = df.withColumn("row", F.monotonically_increasing_id())
    rows.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


BATCH_BYTES = 4 << 20  # of rows with texts that reach a Python worker at once


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Jobs started inside hand rows to Python in batches of about ``size`` bytes, not 10,000 rows.

    A batch is held by the JVM and by the worker, for every core of an executor.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(size))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tokens(text: bytes | None) -> list[bytes]:
    """Words between white space, A-Z lower-cased; bytes split and lower by ASCII rules only."""
    return text.lower().split() if text else []


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin in sorted columns, and the length at the end."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.append(np.flatnonzero(new), n)


def batches(columns: dict[str, list | np.ndarray | pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array)
                            else columns[f.name] for f in schema], schema=schema)


def whole_runs(source: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches of a sorted partition cut so that rows of one key stay together."""
    held: list[pa.RecordBatch] = []
    for batch in source:
        if not batch.num_rows:
            continue
        column = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(column, column[-1], "left")) if column[0] != column[-1] else 0
        if last == 0 and held and held[-1].column(key)[-1].as_py() != column[0]:
            yield pa.Table.from_batches(held)
            held = []
        elif last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def packed(numbers: np.ndarray) -> bytes:
    """Numbers as one compressed value: all first bytes together, all second bytes together, and so on."""
    return pa.compress(numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes(), "zstd", asbytes=True)


def unpacked(raw: bytes, n: int, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = pa.decompress(raw, size * n, "zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(size, -1).T.copy().view(dtype).ravel()


def executor_slots(spark: SparkSession) -> int:
    """Shuffle partitions of the session, at least one."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
