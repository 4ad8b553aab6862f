"""The streaming jobs, run to the end of the table and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from moraine.operators import checks as ck
from moraine.session import scratch_dir
from moraine.streaming import jobs
from moraine.workload.data import SCHEMAS, Data, using
from moraine.workload.registry import query


def _stream(d: Data):
    return jobs.stream_files(d.spark, d.path("events"), SCHEMAS["events"])


def _read_back(d: Data, df, label: str):
    path = scratch_dir(d.spark, label)
    jobs.run_to_files(df, f"{path}/rows", f"{path}/checkpoint")
    return d.spark.read.parquet(f"{path}/rows")


def _old_text(df):
    """The old column of the migration: text, with values that do not convert."""
    return df.withColumn("value_text", F.expr("CASE WHEN event_type = 'error' THEN 'bad' ELSE CAST(event_id AS STRING) END"))


@query("stream_dual_write", using("evt_dual") + """
SELECT event_id, value_text, CAST(try_cast(value_text AS BIGINT) AS VARCHAR) AS value_new FROM evt_dual""")
def stream_dual_write(d: Data):
    written = _read_back(d, jobs.dual_write(_old_text(_stream(d)), "value_text", "value_new", "bigint"), "dual-write")
    return written.select("event_id", "value_text", F.col("value_new").cast("string").alias("value_new"))


def _monitored(d: Data, df, label: str):
    path = scratch_dir(d.spark, label)
    jobs.run_monitor(df, f"{path}/rows", f"{path}/checkpoint")
    return jobs.monitored(d.spark, f"{path}/rows")


def _in_pieces(d: Data, label: str):
    """The table as eight files that arrive one after another."""
    path = scratch_dir(d.spark, label)
    d.events.repartitionByRange(8, "ts").write.parquet(path)
    return jobs.stream_files(d.spark, path, SCHEMAS["events"], max_files=1)


@query("stream_gap_monitor", f"""
SELECT date_trunc('hour', ts) AS window_start, count(*) AS rows, count(*) FILTER (WHERE event_type = 'error') AS missing_new,
  count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY 1""")
def stream_gap_monitor(d: Data):
    rows = jobs.dual_write(_old_text(_stream(d)), "value_text", "value_new", "bigint")
    seen = _monitored(d, jobs.gap_monitor(rows, "ts", "value_text", "value_new"), "gap-monitor")
    return seen.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "rows", "missing_new", "failed")


@query("stream_write_monitor", f"""
SELECT date_trunc('hour', ts) AS window_start, count(*) AS rows FROM events
WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1""")
def stream_write_monitor(d: Data):
    monitor = jobs.write_monitor(_stream(d), "ts", F.expr("timestamp_ntz'2024-01-20 00:00:00'"))
    seen = _monitored(d, monitor, "write-monitor")
    return seen.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "rows")


@query("stream_quarantine", """
SELECT event_id, concat_ws(';', CASE WHEN value >= 60 THEN 'check(value)' END,
  CASE WHEN event_type NOT IN ('view', 'click', 'signup', 'purchase') THEN 'enum(event_type)' END) AS reasons,
  CASE WHEN value >= 60 OR event_type NOT IN ('view', 'click', 'signup', 'purchase') THEN 'quarantined' ELSE 'good' END AS outcome FROM events""")
def stream_quarantine(d: Data):
    path = scratch_dir(d.spark, "quarantine")
    rules = [ck.Check("value", "value < 60"), ck.OneOf("event_type", ("view", "click", "signup", "purchase"))]
    jobs.run_quarantine(_stream(d), rules, f"{path}/rows", f"{path}/checkpoint")
    return d.spark.read.parquet(f"{path}/rows").select("event_id", F.array_join("reasons", ";").alias("reasons"), "outcome")


@query("stream_dedupe", """
SELECT user_id, event_type, event_id, ts, value, props FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value, event_id) = 1""")
def stream_dedupe(d: Data):
    path, keys = scratch_dir(d.spark, "dedupe"), ["user_id", "event_type"]
    jobs.run_unique(_in_pieces(d, "arrivals"), keys, f"{path}/rows", f"{path}/checkpoint", ["value", "event_id"])
    return jobs.unique_rows(d.spark, f"{path}/rows", keys).select("user_id", "event_type", "event_id", "ts", "value", "props")
