"""The skew join against a plain one, and the shared folder."""

from collections import Counter

from tessera.llm.common import materialize, skew_join, work_uri


def test_skew_join(spark):
    left = spark.createDataFrame([(k, i) for i, k in enumerate(["hot"] * 900 + ["warm"] * 60 + [f"k{j}" for j in range(50)] + [None] * 5)], "key string, i long")
    right = spark.createDataFrame([("hot", 900, "H"), ("warm", 60, "W"), *((f"k{j}", 1, str(j)) for j in range(40)), ("unused", 0, "U")], "key string, n long, value string")
    got = Counter((r.i, r.key, r.value) for r in skew_join(left, right, "key", "n", ["i"]).collect())
    want = Counter((r.i, r.key, r.value) for r in left.join(right.drop("n"), "key", "left").collect())
    assert got == want and len(got) == 1015
    assert skew_join(left.limit(0), right, "key", "n", ["i"]).count() == 0
    assert skew_join(left, right.limit(0), "key", "n", ["i"]).where("value is null").count() == 1015


def test_written_tables(spark):
    uri = work_uri(spark, "test")
    assert uri.startswith(spark.conf.get("spark.checkpoint.dir")) and uri != work_uri(spark, "test")
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    back = materialize(df, uri)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str) and back.inputFiles()
