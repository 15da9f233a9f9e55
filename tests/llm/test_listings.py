from insumo.llm import listings

CAND = "id string, name string, raw_name string, product_type string, manufacturer string, manufacturer_code string, unit string, specs array<struct<label:string,value:string>>, description string, extra int"
PROD = "id string, code string, name string, family string, manufacturer string, external_codes_json string, unit string, specs_json string, extra string"


def pairs(spark, cands, prods=()):
    c = spark.createDataFrame([(i, n, None, k, m, code, None, s, None, 1) for i, n, k, m, code, s in cands], CAND)
    p = spark.createDataFrame(list(prods), PROD)
    return sorted((r.key_a, r.key_b) for r in listings.same_item_pairs(c, p).collect())


def test_wordings_units_order_and_brand(spark):
    cands = [
        ("c1", "Paraf. sext. M8x45milímetros latao Furotele", "parafuso", None, None, []),
        ("c2", "NOVO Furotele Parafuso cabeça sextavada em latão M8", None, "FUROTELE Ind.", "FUR ZM3U6 1", [("Compr.", "0,045M")]),
        ("c3", "Parafuso sextavado latão M8 x 4,5 cm Furotle", "PARAFUSO", None, None, None),
        ("c4", "Parafuso sextavado latão M8 x 50 mm", "parafuso", "Furotele", "FURZM3U6/2", []),
        ("c5", "Parafuso sextavado latão M8", "parafuso", "Furotele", "REF FURZM3U6-1", []),
        ("c6", "Parafuso sextavado latão M10", "parafuso", "Furotele", "S/REF", []),
        ("c7", None, None, None, None, None),
    ]
    prods = [("p1", "PF-ZM3U6-01", "Parafuso sextavado latão M8 x 45 mm Furotele", "Fixadores", "Furotele", None, "pç", "[]", "x"), ("p2", "", "Parafuso sextavado latão M8 x 45 mm Outrama", "Fixadores", "Outrama", "[]", "pç", None, "x")]
    same = ["c1", "c2", "c3", "c5"]
    assert pairs(spark, cands, prods) == sorted([(a, b) for a in same for b in same if a < b] + [(a, "p1") for a in same])


def test_code_of_contradicting_rows_links_nothing(spark):
    cands = [("a", "Chapa lisa inox 304 1 mm x 2 m x 1 m Xotele", "chapa", "Xotele", "XOTAB123/1", []), ("b", "Chapa xadrez inox 304 1 mm x 2 m x 1 m Xotele", "chapa", "Xotele", "XOTAB123/1", []), ("c", "Chapa inox 304 Xotele", "chapa", "Xotele", "XOTAB123/1", [])]
    assert pairs(spark, cands) == []


def test_keys_link_rows_of_any_kind_and_chains_of_keys(spark):
    breaker = [("a1", "Disjuntor SH201 20A", "disjuntor", "Xotele", "SH201-C20", []), ("a2", "Disjuntor mono curva C", "disjuntor", "Xotele", "SH201C20", []), ("a3", "Disjuntor mono", "disjuntor", "Outrama", "SH201C20X", [])]
    # two listings share a GTIN, one of them shares a code with a third
    chain = [("b1", "Rolamento 4006381333931", None, None, None, []), ("b2", "Rolamento blindado 4006381333931", None, None, "ROL6203ZZ", []), ("b3", "Rol. esferas", None, None, "ROL-6203-ZZ", []), ("b4", "Rol. esferas", None, None, None, [])]
    torn = [("c1", "Rele", None, "Xotele", "REL7203ZZ", []), ("c2", "Rele", None, "Outrama", "REL7203ZZ", [])]
    assert pairs(spark, breaker + chain + torn) == [("a1", "a2"), ("b1", "b2"), ("b1", "b3"), ("b2", "b3")]


def test_gtin_and_empty(spark):
    assert pairs(spark, []) == []
    df = spark.createDataFrame([("x 4006381333931",), ("x 4006381333932",), ("00000000",), (None,)], "t string")
    assert [r[0] for r in df.select(listings.gtin_key(df.t)).collect()] == ["04006381333931", None, None, None]
