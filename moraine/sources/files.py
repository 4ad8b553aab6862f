"""Small file-system helpers that work on any Hadoop file system."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names directly below the folder, sorted."""
    p, fs = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def is_dir(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def read_text(spark: SparkSession, path: str) -> str | None:
    """Content of one small file, None if there is none."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, content: str) -> None:
    """Write a small file beside the target and rename it over the target.

    On HDFS and on a local file system the rename replaces in one step.  Other
    file systems may remove the target first, so a reader that finds no pointer
    there has to look again.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    temporary, fs = _path(spark, path + ".new")
    target, _ = _path(spark, path)
    stream = fs.create(temporary, True)
    try:
        stream.write(bytearray(content.encode("utf-8")))
    finally:
        stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(temporary, target, options)


def delete(spark: SparkSession, path: str) -> bool:
    """Remove a file or a folder with all it holds; false when there is none."""
    p, fs = _path(spark, path)
    return fs.delete(p, True)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have a folder that is yet to be made removed when the driver's file system closes."""
    p, fs = _path(spark, path)
    fs.mkdirs(p)  # only what is there can be marked
    fs.deleteOnExit(p)
    fs.delete(p, True)
