import pytest
from pyspark.sql import functions as F

from insumo.functions import norms, numbers
from insumo.functions.text import fold


def one(spark, f, *values):
    cols = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{c} {'double' if isinstance(v, float) else 'string'}" for c, v in zip(cols, values)))
    return df.select(f(*(F.col(c) for c in cols)).alias("x")).first().x


@pytest.mark.parametrize("f, text, want", [
    (norms.norm, "Aço Inoxidável 316 L", "inox 316l"), (norms.norm, "10×20 “x” 2,5", '10x20 "x" 2.5'), (norms.squeeze, "  a \n b ", "a b"), (norms.norm_index, "Tubo 1/2 polegada ✓ 3 milímetros", 'tubo 1/2 " 3 mm'),
    (norms.company_key, "Metal Sul Ltda", "metal sul"), (norms.company_key, "METAL SUL ME", "metal sul"), (norms.norm_audit, "Cabo 10 metros", "cabo 10 m"), (norms.clean_title, "Chapa™ inox | Loja X", "Chapa inox"),
    (norms.host, "https://www.Loja.example/a?b", "loja.example"), (norms.escape_xml, "a<b & 'c'", "a&lt;b &amp; &apos;c&apos;"), (norms.unescape_xml, "&lt;&amp;lt;", "<&lt;"), (fold, "ＡÇ​ãо", "acao"),
    (numbers.index_number, "1.234,56", 1234.56), (numbers.index_number, "12,5", 12.5), (numbers.index_number, "1.234", 1.234), (numbers.index_number, "1,234,567", None), (numbers.index_number, "", None),
    (numbers.loose_number, "1,234.56", 1234.56), (numbers.loose_number, "R$ 10", 10.0), (numbers.loose_number, "abc", 0.0), (numbers.fraction_number, "1.1/2", 1.5), (numbers.fraction_number, "x", None), (numbers.fraction_number, "1/0", None),
    (numbers.amounts, "R$ 1.234,56 e 12.50 e 12,50", [12.5, 1234.56]), (numbers.gtin_valid, "4006381333931", True), (numbers.gtin_valid, "4006381333932", False), (numbers.gtin_valid, "1234567890", False), (numbers.gtin_valid, None, False),
])
def test_scalars(spark, f, text, want):
    assert one(spark, f, text) == want


@pytest.mark.parametrize("text, want", [("45000", "2023-03-15"), ("29/02/2024", "2024-02-29"), ("29/02/2023", None), ("2024-02-29", None), ("31/02/2026", None)])
def test_sheet_date(spark, text, want):
    got = one(spark, numbers.sheet_date, text)
    assert (str(got) if got else None) == want


@pytest.mark.parametrize("a, b, want", [("parafuso", "parafsuo", True), ("porca", "porcas", True), ("304", "316", False), ("cabo", "tubo", False)])
def test_fuzzy(spark, a, b, want):
    assert one(spark, numbers.fuzzy_equal, a, b) is want


def test_units_percent_lines(spark):
    assert one(spark, numbers.to_mm, "1/2", '"') == 12.7 and one(spark, numbers.to_mm, "6", "m") == 6000 and one(spark, numbers.to_mm, "5", "kg") is None
    assert one(spark, numbers.percent, 0.1) == 10 and one(spark, numbers.percent, 1.0) == 1
    assert one(spark, numbers.last_amount, "PFI4 Parafuso Philips M5x16  R$ 0,24")[:2] == (0.24, "PFI4 Parafuso Philips M5x16")
    assert one(spark, lambda a, b: norms.jaccard(norms.bigrams(a), norms.bigrams(b)), "", "") == 1
