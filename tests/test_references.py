import datetime as dt

from pyspark.sql import functions as F

from insumo.operators.references import classify, orphan_report, orphans, references

T = lambda d: dt.datetime(2024, 1, d)
PARENTS = "key string, loaded_at timestamp, deleted_at timestamp"


def refs(spark, rows):
    df = spark.createDataFrame(rows, "k string, ref string, at timestamp, state string")
    return references(df, "t", F.col("k"), F.col("ref"), F.col("at"))


def test_states(spark):
    parents = spark.createDataFrame([("a", T(2), None), ("b", T(2), T(10)), ("c", T(20), None), ("d", None, None), ("b", T(15), T(16)), (None, T(1), None)], PARENTS)
    r = refs(spark, [("1", " a ", T(5), ""), ("2", "a", T(1), ""), ("3", "b", T(10), ""), ("4", "b", T(9), ""), ("5", "c", T(19), ""), ("6", "c", T(20), ""), ("7", "x", T(5), ""), ("8", "d", T(5), ""), ("9", "b", T(15), ""), ("10", " ", T(5), ""), ("11", None, T(5), ""), ("12", "a", None, "")])
    got = {x.row_key: x.state for x in classify(r, parents, 3).collect()}
    assert got == {"1": "valid", "2": "late", "3": "deleted", "4": "valid", "5": "late", "6": "valid", "7": "missing", "8": "missing", "9": "valid", "12": "late"}


def test_hot_key_and_report(spark):
    parents = spark.createDataFrame([("hot", T(10), None)], PARENTS)
    r = refs(spark, [(str(i), "hot", T(1 + i % 20), "") for i in range(400)])
    assert orphans(r, parents).count() == sum(1 + i % 20 < 10 for i in range(400))
    assert {(x.period, x.state): x.n for x in orphan_report(r, parents).collect()} == {("2024-01", "late"): 180, ("2024-01", "valid"): 220}


def test_empty(spark):
    assert orphans(refs(spark, []), spark.createDataFrame([], PARENTS)).count() == 0
