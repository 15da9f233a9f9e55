import random

from pyspark.sql import functions as F

from insumo.operators import features, nearest, resolve


def shuffled(spark, made):
    """Rows that the stages of a job write for other stages, and its rows."""
    jvm = spark._jvm
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}

    before = written()
    rows = made().collect()
    return sum(n for k, n in written().items() if k not in before), rows


def test_rows_of_one_kind_and_size_make_no_table_of_pairs(spark):
    p = spark.createDataFrame([(f"{i:04}", f"Chapa inox lisa 2 mm x{i % 7:02}", "") for i in range(1000)], "id string, name string, code string")
    n, got = shuffled(spark, lambda: resolve.similar_products(p, p))
    assert len(got) == 5000 and n < 50_000
    q = p.select(F.col("id").alias("qid"), F.col("name").alias("text"))
    n, got = shuffled(spark, lambda: features.matches(q, p.select("id", "name")))
    assert len(got) == 5000 and n < 50_000


def test_rows_of_one_code(spark):
    p = spark.createDataFrame([(f"{i:02}", f"nome{i}", " k1") for i in range(9)] + [("01", "nome1", "K1")], "id string, name string, code string")
    got = {(r.qid, r.rank_no): r.id for r in resolve.similar_products(p.filter("id = '03'"), p, n=4).collect()}
    assert got == {("03", 1): "00", ("03", 2): "01", ("03", 3): "01", ("03", 4): "02"}


def test_blocks_lose_none(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 8)
    r = random.Random(7)
    text = lambda: f"{r.choice(['Chapa', 'Chapa', 'Tubo', 'Cabo', 'Peça', ''])} {r.choice(['inox', 'pvc', ''])} {r.choice(['304', '304L', '316', ''])} {r.choice(['lisa', 'fina'])} {r.choice(['2 mm', '2,01 mm', '3 x 4 m', ''])} {r.choice(['alfa', 'beta', 'gama'])}"
    q = spark.createDataFrame([(f"q{i:02}", text()) for i in range(30)] + [(None, "Chapa"), ("q98", None), ("q99", "")], "qid string, text string")
    c = spark.createDataFrame([(f"c{i:03}", text(), r.random() < 0.3) for i in range(120)] + [(None, "Chapa", True), ("c998", None, None)], "id string, name string, preferred boolean")
    cols = ["kind", "material", "alloys", "tokens", "dims"]
    dq = features.described(q, "text").filter("qid is not null").select("qid", F.struct(*cols).alias("q"))
    dc = features.described(c, "name").filter("id is not null").select("id", F.coalesce("preferred", F.lit(False)).alias("preferred"), F.struct(*cols).alias("c"))
    every = dq.crossJoin(dc).select("qid", "id", "preferred", features.match_score("q", "c").alias("score")).filter("score >= 45").collect()
    want = set()
    for k in {x.qid for x in every}:
        for i, x in enumerate(sorted((x for x in every if x.qid == k), key=lambda x: (-x.score, not x.preferred, x.id))[:3]):
            want.add((k, i + 1, x.id, x.score))
    got = features.matches(q, c, n=3).collect()
    assert {(x.qid, x.rank_no, x.id, x.score) for x in got} == want and len(got) == len(want) > 60


def test_similarity_is_rounded_as_decimals_are(spark):
    # 0.25 + 0.3 * 3 / 16 is 0.30625
    import numpy as np

    one = np.array([1.0])
    got = resolve._similar_points(one > 0, one < 0, one < 0, one * 3 / 16, np.array([0]), 0, np.array([0]))
    want = spark.range(1).select(F.round(F.lit(0.25) + F.lit(0.0) + F.lit(0.3) * 0.0 + F.lit(0.3) * (F.lit(3) / F.lit(16)), 4)).first()[0]
    assert got[0] / 10_000 == want
