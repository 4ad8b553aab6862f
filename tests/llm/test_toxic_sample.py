"""The sample of the toxicity model: one very long text or one often repeated id does not take it over."""

import random

import pytest
from pyspark.sql import functions as F

from moraine.llm import toxicity
from moraine.llm.common import fold


@pytest.mark.parametrize("first", [0, 1])
def test_both_labels_are_sampled(spark, monkeypatch, first):
    monkeypatch.setattr(toxicity, "SAMPLE", 100)
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1 << 17)
    rnd = random.Random(3)
    words = [f"word{i}" for i in range(60)]
    ids = [r.id for r in spark.range(300).filter(fold(F.col("id")) != 0).orderBy(F.xxhash64(F.lit(29), "id"), "id").collect()]
    label = {i: int(k % 2 == 0) for k, i in enumerate(ids)}
    label[ids[0]] = label[ids[1]] = first

    def text(i):
        return " ".join(rnd.choices(words, k=20) + ["vilest insult"] * label[i])

    rows = [(i, text(i)) for i in ids[2:]]
    rows.append((ids[0], " ".join(rnd.choices(words, k=40_000))))  # over all bytes, first in order
    rows += [(ids[1], text(ids[1]) + f" copy{k}") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(list(label.items()), "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, labels).collect()}
    assert [got[i] for i in ids[2:]] == [label[i] for i in ids[2:]]
