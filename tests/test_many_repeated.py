"""Deduplication where many keys repeat, and the counts of a set of tables."""

from moraine.operators import checks as ck
from moraine.workload import queries


def test_many_repeated_keys_move_once(spark, monkeypatch):
    monkeypatch.setattr(ck, "MANY_REPEATED", 2, raising=False)
    rows = [(i % 7, i % 3, 100 - i) for i in range(60)] + [(None, 1, i) for i in range(4)] + [(50 + i, 0, i) for i in range(5)]
    df = spark.createDataFrame(rows, "k long, s int, id long")
    got = ck.dedupe_keep_first(df, ["k", "s"], ["id"])
    first = {}
    for k, s, i in rows:
        if k is not None:
            first[k, s] = min(i, first.get((k, s), i))
    expected = [(k, s, i) for (k, s), i in first.items()] + [r for r in rows if r[0] is None]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_table_set_counts_of_empty_and_odd_columns(spark, tmp_path):
    spark.createDataFrame([], "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string") \
        .write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "a", 1, 0.0), (2, "", 1, -0.0), (3, None, None, 1.5), (3, "a", 2, None)],
                          "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1, [1.0, None], 0), (2, [1.0], 0), (3, None, 0), (4, [1.0], 0)], "vec_id bigint, embedding array<float>, label int") \
        .write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries_of(spark, tmp_path)
    assert got["customer"] == {c: (0, 0) for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")}
    assert got["supplier"] == {"s_suppkey": (4, 3), "s_name": (4, 2), "s_nationkey": (4, 2), "s_acctbal": (4, 2)}
    assert got["embeddings"] == {"vec_id": (4, 4), "embedding": (4, 2), "label": (4, 1)}


def queries_of(spark, folder):
    out = {}
    for r in queries()["read_table_set"](spark, str(folder)).collect():
        out.setdefault(r.table_name, {})[r.column_name] = (r.rows, r.distinct_values)
    return out
