import pytest
from pyspark.sql import functions as F

from insumo.functions.units import figure_value
from insumo.operators.measures import measures

SCHEMA = "id string, name string, unit string, specs_json string, extra int"


@pytest.mark.parametrize("text, value", [("1.234,56", 1234.56), ("6.000", 6000), ("0.025", 0.025), ("12,5", 12.5), ("1.5", 1.5), ("1 1/2", 1.5), ("1.1/2", 1.5), ("3/8", 0.375), ("1/0", None), ("1.000.000", 1_000_000), ("x", None)])
def test_figures(spark, text, value):
    got = spark.createDataFrame([(text,)], "t string").select(figure_value(F.col("t"))).first()[0]
    assert (got is None and value is None) or float(got) == value


def found(spark, *rows):
    got = measures(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)).collect()
    return sorted((r.product_id, r.measure, r.amount) for r in got)


def test_name_slots_and_conversion(spark):
    got = found(spark, ("a", "Chapa lisa inox 316L 1/4 pol 100 cm x 900 MM X", "pç", None), ("b", "Tubo PVC 1,25 pol 3 m", "un", "[]"), ("c", "Motor trifásico 0,5 cv 0,22 KV", "un", ""), ("d", "Válvula esfera 3” 10 kgf/cm²", "un", "x"))
    assert got == [("a", "length", 1_000_000), ("a", "thickness", 6350), ("a", "width", 900_000), ("b", "diameter", 31750), ("b", "length", 3_000_000), ("c", "power", 368), ("c", "voltage", 220), ("d", "diameter", 76200), ("d", "pressure", 981)]


def test_unit_from_label_name_and_unit_column(spark):
    spec = '[{"label":"%s","value":"%s"}]'
    got = found(
        spark,
        ("a", "Parafuso M8", "un", spec % ("Compr. (cm)", "1.000")),
        ("b", "Parafuso M8 x 12 centímetros", "un", spec % ("Comprimento", "12")),
        ("c", "Cabo rígido", "metros", spec % ("Extensão", "25")),
        ("d", "Tinta azul", "cm³", spec % ("Conteúdo", "5.000")),
        ("e", "Graxa NLGI 2", "pote 80 g", "[]"),
        ("f", "Parafuso M8", "rolo", spec % ("Comprimento", "12")),
        ("g", "Cabo 4 mm² azul", "bobina 2.000 cm", None),
    )
    assert got == [("a", "length", 10_000_000), ("b", "length", 120_000), ("c", "length", 25_000_000), ("d", "volume", 5000), ("e", "mass", 80_000), ("g", "length", 20_000_000)]


def test_look_alike_characters_repeats_and_nulls(spark):
    got = found(spark, ("a", "Саbо flexível 4 mm² １００００ ｍｍ", None, None), ("a", "Саbо flexível 4 mm² １００００ ｍｍ", None, None), (None, None, None, None), ("z", "", "", ""))
    assert got == [("a", "length", 10_000_000)]


def test_empty(spark):
    assert found(spark) == [] if False else measures(spark.createDataFrame([], SCHEMA)).count() == 0
