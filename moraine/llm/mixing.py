"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source is dealt into blocks by a hash of its rows.  Its target decides how
many block instances it gives: whole passes over its blocks, then a part of one
more pass in a permuted order, whose last block is cut between documents.  A
binary tree over the output shards splits the vector of block quotas: the left
half draws its share without replacement from all sources at once, the right
half keeps the rest, down to the single shard.  The draws say which stretch of
each source's permuted blocks a shard owns, so shards are disjoint and together
take exactly the quotas.  Inside a shard, rows follow a seeded hash.

Data on the driver: one row per source (its quota).  Everything that grows with
the documents stays in joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from moraine.llm.common import WORD, numbered
from moraine.session import staged

BLOCKS = 4096  # blocks of a source at most; the block that is cut is sorted as a whole


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``: the share of all sizes by weight.

    A target stops at ``cap`` times its source's size and the excess is shared
    again by weight, until none is above.  Sorted by cap over weight, the capped
    sources come first, so running sums give the level at which the rest settles.
    """
    limit = F.lit(float(cap)) * F.col("source_size")
    order = Window.orderBy("full_at", "sid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    ranked = sources.withColumn("full_at", limit / F.col("weight")) \
        .withColumn("all_words", F.lit(float(share)) * F.sum("source_size").over(whole)) \
        .withColumn("level", (F.col("all_words") - F.coalesce(F.sum(limit).over(before), F.lit(0.0)))
                    / F.sum("weight").over(rest)) \
        .withColumn("capped", F.col("full_at") <= F.col("level"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(whole)  # levels fall once a source is not capped
    return ranked.withColumn("settled", level).withColumn(
        "target", F.when(F.col("capped") | F.col("settled").isNull(), limit)
        .otherwise(F.col("settled") * F.col("weight")).cast("double"),
    ).drop("full_at", "all_words", "level", "capped", "settled")


def _tree_leaf(shard: int, shards: int, quotas: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and number of the block instances of each source that one shard owns.

    Every node draws from a generator seeded by its place, so each shard walks
    its own path from the root and all agree on the splits they share.
    """
    lo, hi, start, left = 0, shards, np.zeros(len(quotas), np.int64), quotas.copy()
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        total = int(left.sum())
        part = rng.multivariate_hypergeometric(left, total * (mid - lo) // (hi - lo), method="marginals") \
            if total else left * 0
        if shard < mid:
            hi, left = mid, part
        else:
            lo, start, left = mid, start + part, left - part
    return start, left


def mix_rows(docs: DataFrame, source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0,
             cap: float = 3.0, seed: int = 17, shard_words: int = 1 << 20, id_col: str = "doc_id",
             text_col: str = "text", keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(sized, drawn): one row per document, and one per time the mix takes it.

    sized: row, id, sid, size, source_size, target, ``keep``.  drawn: row, sid, size, epoch, shard, spot (the order
    inside the shard).  Sources are ranked by code point, null last, and take the
    weights in turn.  Null and empty texts have size 0.  Empty tables give empty
    frames.  Reruns over the same files agree.
    """
    spark = docs.sparkSession
    rows = numbered(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.struct(*[F.col(c) for c in keep] or [F.lit(0).alias("none")]).alias("kept_columns")), "mix-docs")
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows")) \
        .withColumn("sid", F.row_number().over(by_name) - 1) \
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                           (F.col("sid") % len(weights) + 1).cast("int")))
    sources = staged(
        source_targets(sources, share, cap)
        .withColumn("n_blocks", F.least(F.col("n_rows"), F.lit(BLOCKS)).cast("long"))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                    .otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "mix-sources")

    spread = F.xxhash64(F.lit(seed), F.col("sid"), F.col("id"), F.col("size"))
    sized = rows.join(sources.select("source", "sid", "source_size", "target", "n_blocks").withColumnRenamed(
        "source", "s_name"), F.col("source").eqNullSafe(F.col("s_name"))) \
        .withColumn("spread", spread).withColumn("block", F.pmod("spread", "n_blocks"))
    sized = staged(sized.drop("s_name", "n_blocks"), "mix-sized")

    # Blocks of one pass in permuted order, with the words before each.
    blocks = sized.groupBy("sid", "block").agg(F.sum("size").alias("words"))
    epochs = sources.select("sid", "passes", "rest", F.explode(F.sequence(F.lit(0).cast("long"), "passes")).alias("epoch"))
    turn = Window.partitionBy("sid", "epoch").orderBy(F.xxhash64(F.lit(seed), "sid", "epoch", "block"), "block")
    ordered = blocks.join(epochs, "sid").withColumn("turn", F.row_number().over(turn)) \
        .withColumn("end", F.sum("words").over(turn.rowsBetween(Window.unboundedPreceding, 0))) \
        .withColumn("begin", F.col("end") - F.col("words")) \
        .filter((F.col("epoch") < F.col("passes")) | (F.col("begin") < F.col("rest"))) \
        .withColumn("cut", F.when((F.col("epoch") == F.col("passes")) & (F.col("end") > F.col("rest")),
                                  F.col("rest") - F.col("begin")))
    place = Window.partitionBy("sid").orderBy("epoch", "turn")
    instances = staged(ordered.select(
        "sid", "block", "epoch", "cut", (F.row_number().over(place) - 1).cast("long").alias("place")), "mix-blocks")

    quotas = {r.sid: (r.quota, r.words) for r in sources.select("sid", F.col("target").alias("words")).join(
        instances.groupBy("sid").agg(F.count("*").alias("quota")), "sid").collect()}
    sids = np.array(sorted(quotas), np.int32)
    counts = np.array([quotas[s][0] for s in sids.tolist()], np.int64)
    shards = max(1, int(-(-sum(q[1] for q in quotas.values()) // shard_words)))

    def leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                start, n = _tree_leaf(int(shard), shards, counts, seed)
                yield pd.DataFrame({"sid": sids, "shard": int(shard), "start": start, "n": n})[n > 0]

    owned = spark.range(shards).mapInPandas(leaves, "sid int, shard long, start long, n long").select(
        "sid", "shard", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("place"))
    dealt = staged(instances.join(owned, ["sid", "place"]).select("sid", "block", "epoch", "cut", "shard"), "mix-dealt")

    # The cut block of a source gives the documents whose middle lies before the cut.
    line = Window.partitionBy("sid").orderBy(F.xxhash64("spread"), "id", "row") \
        .rowsBetween(Window.unboundedPreceding, 0)
    whole = sized.join(dealt.filter("cut IS NULL"), ["sid", "block"])
    part = sized.join(dealt.filter("cut IS NOT NULL"), ["sid", "block"]) \
        .withColumn("middle", F.sum("size").over(line) - F.col("size") / 2).filter("middle <= cut").drop("middle")
    drawn = whole.unionByName(part).select(
        "row", "sid", "size", "epoch", "shard", F.xxhash64(F.lit(seed), "shard", "epoch", "id", "row").alias("spot"))
    return sized, drawn


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """One row per document: id, size, source_size, target, taken (its words in the mix, repeats counted)."""
    sized, drawn = mix_rows(docs, **options)
    times = drawn.groupBy("row").agg(F.sum("size").alias("taken"), F.count("*").alias("times"))
    return sized.join(times, "row", "left").select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        F.coalesce("times", F.lit(0)).cast("long").alias("times"))


def mixed(docs: DataFrame, placed: bool = True, **options) -> DataFrame:
    """The mix itself: every column of ``docs`` for each time a document is taken, with shard and place.

    Shards hold about ``shard_words`` words, so ordering one is bounded work.
    Without ``placed`` only the columns of ``docs`` are returned; a column of
    theirs that is called like one of the two keeps its name, and the added one
    gets underscores behind its own.
    """
    columns = tuple(docs.columns)
    sized, drawn = mix_rows(docs, keep=columns, **options)
    taken = drawn.select("row", "epoch", "shard", "spot").join(sized.select("row", "kept_columns"), "row")
    if not placed:
        return taken.select("kept_columns.*")
    here = Window.partitionBy("shard").orderBy("spot", "row", "epoch")
    names, known = [], {c.lower() for c in columns}
    for name in ("mix_shard", "mix_place"):
        while name in known:
            name += "_"
        names.append(name)
    return taken.withColumn("place", F.row_number().over(here)).select(
        "kept_columns.*", F.col("shard").alias(names[0]), F.col("place").alias(names[1]))
