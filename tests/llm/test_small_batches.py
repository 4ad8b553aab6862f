"""Texts reach Python workers in batches of bounded bytes, and the words a task remembers are few."""

import pyarrow as pa
from pyspark.sql import functions as F

from moraine.llm import jaccard
from moraine.llm.common import small_batches


def batch_sizes(spark):
    def sizes(source):
        for batch in source:
            yield pa.record_batch({"n": pa.array([batch.num_rows]), "bytes": pa.array([batch.nbytes])})

    texts = spark.range(4000, numPartitions=1).select(F.repeat(F.lit("x"), 4000).cast("binary").alias("text"))
    return [(r.n, r.bytes) for r in texts.mapInArrow(sizes, "n long, bytes long").collect()]


def test_batches_are_bounded_by_bytes_only_inside(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    with small_batches(spark, 1 << 20):
        inside = batch_sizes(spark)
    assert sum(n for n, _ in inside) == 4000 and max(size for _, size in inside) < 2 << 20
    assert spark.conf.get(name) == before


def test_join_bounds_batches_and_words(spark, monkeypatch):
    """Each job of the join that compares whole texts runs with the small bound."""
    seen = []
    links = jaccard.Join.links
    monkeypatch.setattr(jaccard.Join, "links", lambda self: seen.append(
        int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("bB"))) or links(self))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "q r s t u")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3} and max(seen) <= 8 << 20
    words = jaccard.WordHashes()
    for i in range(300_000):
        words[b"%d" % i]
    assert len(words) <= 100_000
