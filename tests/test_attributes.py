import itertools
import random

import pytest
from pyspark.sql import functions as F

from insumo.operators import audit, features, resolve


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_scored_types(spark):
    df = spark.createDataFrame([("Parafsuo sextavado",), ("tubo pvc",), ("nada",), (None,), ("chapas",)], "t string")
    assert [r[0] for r in df.select(features.scored_type(F.col("t"))).collect()] == ["parafuso", "tubo", "", "", "chapa"]


@pytest.mark.parametrize("text, kind", [("Flange de cadeira", ""), ("Flange aço DN 50", "flange"), ("Barra chata 2 x 1", "barra_chata"), ("ch. lisa", "chapa"), (None, ""), ("Luva 1/2", "conexao")])
def test_types(spark, text, kind):
    assert spark.createDataFrame([(text,)], "t string").select(features.material_type(F.col("t")).alias("k")).first().k == kind


def test_facts(spark):
    df = spark.createDataFrame([("a", "Motor 4 polos 0,5 cv 220 V IP55"), ("b", None), ("c", "Cabo 2,5 mm² 100 m")], "id string, t string")
    assert rows(features.facts(df, "id", "t"), "id", "kind", "value") == [("a", "poles", 4.0), ("a", "power", 367.7494), ("a", "protection", 55.0), ("a", "voltage", 220.0), ("c", "area_mm2", 2.5), ("c", "length", 100000.0)]


def test_facts_of_specifications_and_repeats(spark):
    df = spark.createDataFrame([("a", "Motor 2 polos ou 4 polos 220 V", '[{"label": "Tensão", "value": "220 V"}, {"label": "Pressão", "value": "2 bar"}, {"label": "Potência", "value": "5 W"}]'), ("b", None, None)], "id string, t string, s string")
    assert rows(features.facts(df, "id", "t", "s"), "id", "kind", "value") == [("a", "poles", 2.0), ("a", "poles", 4.0), ("a", "power", 5.0), ("a", "pressure", 200.0), ("a", "voltage", 220.0)]


def test_specs(spark):
    df = spark.createDataFrame([("Largura: 2 m\nx\nComprimento : 3",)], "t string")
    assert [tuple(s) for s in df.select(features.parsed_specs(F.col("t"))).first()[0]] == [("Largura", "2 m"), ("Comprimento", "3")]
    s = spark.createDataFrame([([("medida", "2"), ("size", "3"), ("cor", "azul"), ("color", "azul"), ("x", "")],)], "s array<struct<label:string,value:string>>")
    assert [tuple(x) for x in s.select(features.tidy_specs(F.col("s"))).first()[0]] == [("Cor", "azul"), ("Medida", "2 × 3")]


def test_similar_products_lose_none(spark):
    r = random.Random(4)
    names = [f"{r.choice(['Chapa', 'Tubo', 'Parafuso'])} {r.choice(['inox 304', 'pvc', 'aluminio', ''])} {r.choice(['lisa', 'fina', 'azul', 'preta', 'longa'])} {r.choice([2, 3, 4, 5])} mm {r.choice(['alfa', 'beta', 'gama', 'delta'])}" for _ in range(60)]
    p = spark.createDataFrame([(f"{i:03d}", n, r.choice(["", "K1", f"C{i}"])) for i, n in enumerate(names)], "id string, name string, code string")
    got = {(x.qid, x.id): x.similarity for x in resolve.similar_products(p, p, n=1000).collect()}
    d = {x.id: x for x in features.described(p, "name").collect()}
    want = {}
    for a, b in itertools.permutations(d.values(), 2):
        differ = any(a[f] and b[f] and a[f] != b[f] for f in ("kind", "material")) or (a.alloys and b.alloys and not set(a.alloys) & set(b.alloys))
        met = sum(any(abs(x - y) <= max(0.001, x * 0.005) for y in b.dims) for x in a.dims)
        s = 0.25 * bool(a.kind and b.kind) + 0.15 * bool(a.material and b.material) + 0.3 * met / max(len(a.dims), len(b.dims), 1) + 0.3 * len(set(a.tokens) & set(b.tokens)) / len(set(a.tokens) | set(b.tokens))
        s = 1.0 if a.code and a.code == b.code else 0.0 if differ else s
        if s >= 0.5801:
            want[a.id, b.id] = round(s, 4)
    assert want and all(abs(got.get(k, -1) - v) < 2e-4 for k, v in want.items())


def test_attribute_rank(spark):
    p = spark.createDataFrame([("1", "Chapa inox 304 lisa 2 mm", "A", False), ("2", "Chapa inox 316 lisa", "B", False), ("3", "Tubo inox 304", "C", False), ("4", "Chapa lisa", "D", False), ("5", "Chapa inox 304", "E", True)], "id string, name string, code string, archived boolean")
    got = [(r.id, r.tier) for r in features.attribute_rank(p, "chapa inox 304").collect()]
    assert got[0] == ("1", 3) and ("4", 1) in got and ("2", 0) in got and ("3", 0) in got and "5" not in dict(got)
    assert features.attribute_rank(p, "b").first().tier == 5


def test_queue_and_scores(spark):
    flags = spark.createDataFrame([("a", "stale", "warning"), ("b", "needs-review", "critical"), ("c", "missing-code", "info")], "id string, flag string, level string")
    assert rows(audit.audit_queue(flags), "position", "priority", "id") == [(1, "P0", "b"), (2, "P1", "a"), (3, "P2", "c")]
    assert rows(audit.mean_score(flags, flags.select("id")), "n", "score") == [(3, 83)]
    r = spark.createDataFrame([(["a", "a", "b"], ["b"]), (["x"], None)], "r array<string>, d array<string>")
    assert [x[0] for x in r.select(audit.unresolved(F.col("r"), F.col("d"))).collect()] == [["a", "a"], ["x"]]
