"""Connected components of a table of links, without any of it on the driver.

Large-star and small-star in turn: every node hands its larger neighbours, then
its smaller ones, to the smallest node it knows, which halves the depth of every
tree.  Each half is an aggregate with map-side combine and an equi-join, written
to the shared folder, so lineage stays short.  The rounds end when nothing moves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from moraine.session import staged


def _star(links: DataFrame, larger: bool) -> DataFrame:
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    side = both if larger else both.filter("b < a")
    # smallest of a node and its neighbours
    least = side.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    moved = side.filter("b > a" if larger else "b < a").join(least, "a").select(F.col("b").alias("x"), "m")
    if not larger:
        moved = moved.unionAll(least.select(F.col("a").alias("x"), "m"))
    return moved.filter("x <> m").select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node it reaches) for every node of ``links`` (a, b; both long)."""
    now = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                 "links")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, 7, a))")).first()
        if mark == before:
            break
        before = mark
        now = staged(_star(staged(_star(now, True), "links"), False), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
