"""Columns of the input keep their values, whatever their names."""

import pytest

from moraine.llm import exact_dedup, jaccard, mixing, toxicity


@pytest.mark.parametrize("name", ["row", "ROW", "kept_columns"])
@pytest.mark.parametrize("stage", [exact_dedup.drop_copies, jaccard.keep_one])
def test_values_stay(spark, stage, name):
    texts = ["one two three four five six", "one two three four five six", "seven eight nine ten eleven twelve"]
    docs = spark.createDataFrame([(i, t, 70 + i) for i, t in enumerate(texts)], f"doc_id long, text string, {name} int")
    kept = stage(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [(0, texts[0], 70), (2, texts[2], 72)]


@pytest.mark.parametrize("name", ["mix_shard", "mix_place", "my col", "Kept_Columns"])
def test_values_stay_in_the_mix_and_beside_scores(spark, name):
    texts = ["one two three", "four five", ""]
    docs = spark.createDataFrame([(i, t, "s", 70 + i) for i, t in enumerate(texts)], f"doc_id long, text string, source string, `{name}` int")
    labels = spark.createDataFrame([(0, 0)], "doc_id long, toxic int")
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted(map(tuple, docs.collect()))
    mix = mixing.mixed(docs, placed=False)
    assert mix.columns == docs.columns and set(map(tuple, mix.collect())) <= set(map(tuple, docs.collect()))
    assert len(set(mixing.mixed(docs).columns)) == 6
