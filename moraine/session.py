"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from moraine.sources.files import delete, delete_at_exit

# Only settings whose Spark defaults do not fit large skewed tables.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join even where that costs one more exchange downstream
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # keyed state of streams on disk: a batch touches the keys it holds, and state may outgrow memory
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "moraine", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach, from ``spark.checkpoint.dir``.

    A machine-local folder is only ever chosen when the setting is absent and
    Spark itself runs in local mode.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", root)
    spark.sparkContext.setCheckpointDir(root)
    return root


_RECORDS: list[list[str]] = []  # of each open ``recorded_scratch``, the folders made so far


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new, not yet existing path below the shared root, which goes with the driver at the latest.

    What is in it may be read until then.  ``recorded_scratch`` and ``dropped``
    let it go as soon as it is known that nothing reads it any more.
    """
    path = f"{shared_root(spark).rstrip('/')}/moraine-{label}-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    for record in _RECORDS:
        record.append(path)
    return path


@contextmanager
def recorded_scratch() -> Iterator[list[str]]:
    """Lists the scratch folders made inside, for ``drop_scratch`` once what was computed from them is written."""
    record: list[str] = []
    _RECORDS.append(record)
    try:
        yield record
    finally:
        _RECORDS[:] = [r for r in _RECORDS if r is not record]


def drop_scratch(spark: SparkSession, record: list[str]) -> None:
    """Remove the listed folders; the list is empty afterwards."""
    while record:
        delete(spark, record.pop())


def dropped(df: DataFrame | None) -> None:
    """Remove the files behind a ``staged`` frame that nothing reads any more."""
    path = getattr(df, "_staged_at", None)
    if path:
        delete(df.sparkSession, path)


def staged(df: DataFrame, label: str = "keys") -> DataFrame:
    """The rows, written to the shared folder now and read back.

    Used for sets of exceptional keys before they meet a large table.  Adaptive
    execution would start shuffling the large side while the set is still being
    computed; once it is a file, its real size decides the plan beforehand: a
    small set is broadcast and the large side stays where it is, a large one is
    joined by a shuffle with skew splitting.  The file also cuts the lineage, so
    a lost executor does not recompute the set.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out
