"""Products that a long can not hold: order of their texts, and queries that end in them."""

from moraine.llm import pivots

VECTORS = "vec_id long, embedding array<double>, source string, label int, lang string"


def test_texts_sort_as_the_scores():
    scores = [-10**40, -10**20 - 1, -10**20, -2**63, 2**63 - 1, 2**63, 10**20, 10**20 + 1, 10**40]
    texts = [pivots.past_long(s) for s in scores]
    assert texts[4:] == sorted(texts[4:]) and texts[:4] == sorted(texts[:4]) and len(set(texts)) == len(scores)
    assert pivots.past_long(2**63 - 2) is None and pivots.past_long(-2**63 + 1) is None


def test_smallest_longs_rank_exactly(spark):
    rows = [(0, [1e12, 1.0]), (1, [-1e12, 2.0]), (2, [-1e12, 3.0]), (3, [-2e12, 1.0])]
    table = spark.createDataFrame([(i, e, "x", 1, "c") for i, e in rows], VECTORS)
    got = sorted(map(tuple, pivots.top_products(table, 3, 5).collect()))
    assert [r[2] for r in got] == [2, 1, 3] and {r[3] for r in got} == {-2**63}
