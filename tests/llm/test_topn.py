import random

from pyspark.sql import functions as F

from insumo.llm.topn import top_n


def test_against_brute_force(spark):
    r = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 7}", r.randint(0, 5), f"i{i:04d}", None if i % 50 == 0 else i) for i in range(600)] + [(None, 1, "n1", 0), (None, 1, "n2", 0)]
    df = spark.createDataFrame(rows, "g string, score int, id string, _salt_like int")
    got = top_n(df, ["g"], [F.col("score").desc()], "id", 3, salts=5)
    want = {}
    for g, s, i, _ in rows:
        want.setdefault(g, []).append((-s, i))
    assert {(x.g, x.rank_no, x.id) for x in got.collect()} == {(g, k + 1, i) for g, v in want.items() for k, (_, i) in enumerate(sorted(v)[:3])}


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "x"), ("a", None, "y")], "g string, score int, id string")
    assert [(x.rank_no, x.id) for x in top_n(df, ["g"], [F.col("score").desc()], "id", 3).orderBy("rank_no").collect()] == [(1, "x"), (2, "x"), (3, "y")]
    assert top_n(df.limit(0), ["g"], [F.col("score").desc()], "id", 3).count() == 0
