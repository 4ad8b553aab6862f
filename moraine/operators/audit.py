"""Audit of a log of statements: locks, impact, safer forms, dangerous ones.

``stmt_log``: ``env_id, plan_id, step_no, stmt_no, sql_text``.  All matching is
row-local; only the rollups shuffle, after map-side combination.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from moraine.functions import statements as st

STEP_KEY = ["env_id", "plan_id", "step_no"]


def _prepared(log: DataFrame) -> DataFrame:
    """The normalized text and the lock level as columns, so each is computed once per row."""
    text = log.withColumn("_text", st.normalized(F.col("sql_text")))
    return text.withColumn("lock_level", st.lock_level(F.col("_text")))


def classify_statement_lock(log: DataFrame) -> DataFrame:
    level = F.col("lock_level")
    return _prepared(log).withColumns({
        "lock_mode": st.lock_name(level),
        "blocks_reads": st.blocks_reads(level),
        "blocks_writes": st.blocks_writes(level),
        "impact": st.impact_name(st.impact_level(level)),
    }).drop("_text")


def statement_names(log: DataFrame) -> DataFrame:
    sql = F.col("sql_text")
    return log.withColumns({
        "table_name": st.table_name(sql),
        "constraint_name": st.constraint_name(sql),
        "column_name": st.column_name(sql),
    })


def rewrite_statement(log: DataFrame) -> DataFrame:
    """Statements that have a safer form, with its kind and its statements."""
    sql = F.col("sql_text")
    kinds = log.withColumn("_text", st.normalized(sql)).withColumn("rewrite", st.rewrite_kind(sql, F.col("_text")))
    return kinds.drop("_text").filter("rewrite is not null").withColumn(
        "statements", st.rewritten(sql, F.col("rewrite"))
    )


def should_rewrite(log: DataFrame) -> DataFrame:
    """Adds the flag; a ``duration_ms`` column, where present, counts as a measured duration."""
    measured = F.col("duration_ms") if "duration_ms" in log.columns else None
    flagged = _prepared(log).withColumn("should_rewrite", st.should_rewrite(F.col("lock_level"), measured))
    return flagged.drop("_text", "lock_level")


def step_lock_impact(log: DataFrame) -> DataFrame:
    """The highest impact among the statements of each step.

    Impact grows with the strength of the lock, and statements of equal impact
    take the same lock, so the strongest lock decides: one integer maximum per
    step.  A step without any statement above NONE reports ACCESS SHARE.
    """
    level = F.col("lock_level")
    worst = _prepared(log).groupBy(*STEP_KEY).agg(F.max(level).alias("_l"))
    kept = worst.select(*STEP_KEY, F.when(st.impact_level(F.col("_l")) == 0, 0).otherwise(F.col("_l")).alias("lock_level"))
    return kept.select(
        *STEP_KEY,
        st.lock_name(level).alias("lock_mode"),
        st.impact_name(st.impact_level(level)).alias("impact"),
        st.blocks_reads(level).alias("blocks_reads"),
        st.blocks_writes(level).alias("blocks_writes"),
        (st.impact_level(level) >= 2).alias("rewritable"),
    )


def flag_dangerous_statements(log: DataFrame) -> DataFrame:
    """One row per finding: a statement that drops two columns has two."""
    return log.select("*", F.explode(st.dangerous_codes(F.col("sql_text"))).alias("code"))


def flag_non_declarative(log: DataFrame) -> DataFrame:
    return log.withColumn("code", st.non_declarative_code(F.col("sql_text"))).filter("code is not null")


def audit_rollup(log: DataFrame) -> DataFrame:
    """Per environment: statements by impact, how many block reads or writes, how many have a safer form."""
    level, sql = F.col("lock_level"), F.col("sql_text")
    locked = _prepared(log).withColumn("_kind", st.rewrite_kind(sql, F.col("_text")))
    return locked.groupBy("env_id").agg(
        F.count(F.lit(1)).alias("statements"),
        *[F.count_if(st.impact_level(level) == i).alias(f"impact_{n.lower()}") for i, n in enumerate(st.IMPACT_NAMES)],
        F.count_if(st.blocks_reads(level)).alias("blocking_reads"),
        F.count_if(st.blocks_writes(level)).alias("blocking_writes"),
        F.count("_kind").alias("rewritable"),
    )
