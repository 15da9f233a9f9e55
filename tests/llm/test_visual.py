from insumo.llm.visual import canonical, lookalike_pairs

SCHEMA = "field string, key string, raw string, noise int"


def make(spark, *raws):
    return spark.createDataFrame([("f", f"k{i}", r, i) for i, r in enumerate(raws)], SCHEMA)


def canon(spark, *raws):
    return {r.key: r.canon for r in canonical(make(spark, *raws)).collect()}


def test_forms(spark):
    got = canon(spark, "Cabo flexível", "Сabo ﬂexível", "ＣＡＢＯ  x", "Ca​bo­ fle‑x", "10 mm²", "3” x 2\"", "Привет мир", "СОР", "μm 5", None, "")
    assert got["k1"] == got["k0"] and got["k2"] == "CABO  x" and got["k3"] == "Cabo fle-x"
    assert got["k4"] == "10 mm²" and got["k5"] == "3” x 2\"" and got["k6"] == "Привет мир" and got["k8"] == "μm 5" and got["k10"] == "" and "k9" not in got


def test_only_into_words_of_the_corpus(spark):
    assert canon(spark, "Сabо azul")["k0"] == "Сabо azul"  # no such word elsewhere
    got = canon(spark, "РF-1", "РF-2", "ΡF-3", "PF-9")
    assert got == {"k0": "PF-1", "k1": "PF-2", "k2": "PF-3", "k3": "PF-9"}
    assert canon(spark, "ΧYΖ", "ХYΖ") == {"k0": "XYZ", "k1": "XYZ"}  # two spellings attest one another


def test_pairs(spark):
    got = {(r.key_a, r.key_b) for r in lookalike_pairs(make(spark, "Cabo", "Cabo", "Саbo", "cabo", "Cábo", "", " ")).collect()}
    assert got == {("k0", "k2"), ("k1", "k2")}
    assert lookalike_pairs(make(spark, "x").limit(0)).count() == 0


def test_repeated_rows_count_once(spark):
    df = make(spark, "a-b", "a‐b")
    assert lookalike_pairs(df.union(df)).count() == 1


def test_many_equal_rows_make_no_pairs(spark):
    df = spark.range(3000).selectExpr("'f' field", "cast(id as string) key", "if(id = 7, 'a b', 'a b') raw")
    assert lookalike_pairs(df).count() == 2999


def test_every_word_of_the_corpus_attests(spark):
    same = lambda *raws: len(set(canon(spark, *raws).values())) == 1
    assert same("Привет", "Пpивет")  # a Cyrillic word without Latin form, and one with a Latin p
    assert same("Cabo Привет", "Сabo Привет")  # the Latin word stands in a value of two scripts only
    assert same("café", "cafе\u0301") and same("código", "cόdigo")  # accents over a look-alike
    assert same("fita", "fıta") and not same("fita", "fitа1")
    assert canon(spark, "fıta")["k0"] == "fıta"  # nothing looks like it
