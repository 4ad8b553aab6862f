"""Exact duplicates by distributed MSD radix partitioning.

Documents are split by successive bytes until every group is a single document
or its texts have ended.  The length is the first digit, the leading bytes the
next, then ever wider pieces of the text.  A split is an aggregate over (group,
digit) with map-side combine, so a group of copies that holds a third of all
rows reaches the shuffle as one record a task; groups of one leave at once, and
only rows of groups that are still open carry their text into the next round.
Bytes are compared as they are; no digest decides equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from moraine.llm.common import GAP, numbered
from moraine.session import staged


def normal_text(text: Column) -> Column:
    """White space runs as one blank; null as empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), GAP, " ")


def _split(open_rows: DataFrame, start: int, width: int) -> DataFrame:
    """Groups with more than one row after reading ``width`` bytes from ``start``: grp, digit, n, head."""
    return open_rows.groupBy("grp", "digit").agg(
        F.count("*").alias("n"),
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("head"),
        F.first("size").alias("size"),
    ).filter("n > 1").withColumn("ended", F.col("size") <= start + width)


def _digit(body: Column, start: int, width: int) -> Column:
    return F.substring(body, start + 1, width)


def copy_groups(rows: DataFrame, first: int = 64, growth: int = 64) -> DataFrame:
    """row, keep_row, keep_id, group_size for every row that has a copy.

    ``rows`` holds row, id and body (binary) in files, so that it can be read
    again.  ``first`` bytes are read in the first round, ``growth`` times as many
    in each further one; the rounds end by themselves when no group is open.
    """
    size = F.octet_length("body").cast("long")
    start, width = 0, first
    active = rows.select("row", "id", size.alias("grp"), size.alias("size"), "body")
    found = []
    while True:
        digits = active.select("row", "id", "grp", "size", _digit(F.col("body"), start, width).alias("digit"))
        split = staged(_split(digits, start, width), "radix-split")
        found.append(staged(
            digits.join(split.filter("ended").select("grp", "digit", "n", "head"), ["grp", "digit"]).select(
                "row", F.col("head.row").alias("keep_row"), F.col("head.id").alias("keep_id"),
                F.col("n").alias("group_size")),
            "radix-ended"))
        longer = split.filter(~F.col("ended")).select("grp", "digit", F.col("head.row").alias("next"))
        if start == 0:  # only the numbers meet first; most texts then stay where they are
            still = staged(digits.join(longer, ["grp", "digit"]).select("row", F.col("next").alias("grp")), "radix-open")
            # texts move once, by the same plan at every size
            active = rows.join(still.hint("merge"), "row").select("row", "id", "grp", size.alias("size"), "body")
        else:
            active = active.withColumn("digit", _digit(F.col("body"), start, width)) \
                .join(longer, ["grp", "digit"]).select("row", "id", F.col("next").alias("grp"), "size", "body")
        start, width = start + width, width * growth
        if longer.isEmpty():
            break
        active = staged(active, "radix-open")
    out = found[0]
    for part in found[1:]:
        out = out.unionAll(part)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256, and the columns ``keep``.

    Texts are equal when identical after white space runs become one blank; null
    counts as empty.  Of equal texts the row with the smallest id stays, null ids
    last; rows repeated with the same id count as rows of the group, of which
    exactly one stays.  The digest is output only.  Other columns may have any
    name: they are read only if asked for.
    """
    cols = [F.col(id_col).alias("id"), F.col(text_col).alias("text"),
            F.struct(*[F.col(c) for c in keep] or [F.lit(0).alias("none")]).alias("kept_columns")]
    rows = numbered(docs.select(*cols), "radix-docs")
    body = normal_text(F.col("text"))
    groups = copy_groups(rows.select("row", "id", body.cast("binary").alias("body")))
    narrow = rows.select("row", "id", F.sha2(body, 256).alias("text_sha256"), "kept_columns")
    joined = narrow.join(groups, "row", "left")
    return joined.select(
        F.col("id").alias(id_col),
        F.when(F.col("keep_row").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("keep_row") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256", *[F.col(f"kept_columns.{c}").alias(f"{c}") for c in keep if c != id_col],
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are."""
    rows = numbered(docs.select(F.struct(*docs.columns).alias("kept_columns")), "radix-docs")
    kept = F.col("kept_columns")
    body = normal_text(kept[text_col]).cast("binary")
    groups = copy_groups(rows.select("row", kept[id_col].alias("id"), body.alias("body")))
    gone = staged(groups.filter("row <> keep_row").select("row"), "radix-gone")
    return rows.join(gone, "row", "left_anti").select("kept_columns.*")
