"""Quantities in text: figures, unit aliases and common units, as tables and Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A figure: mixed fraction, fraction, or decimal number in either notation. It doesn't continue a word or number.
FIGURE = r"(?<![a-z0-9.,/])(?:\d{1,2}[ .]\d{1,2}/\d{1,2}|\d{1,3}/\d{1,3}|\d+(?:[.,]\d+)*)"

# Unit alias (folded) -> kind, factor to the common unit of that kind, offset. Common units: micrometre, milligram, millilitre, volt, watt, kilopascal.
UNITS = [
    ("um", "length", "1", "0"), ("mm", "length", "1000", "0"), ("milimetro", "length", "1000", "0"), ("milimetros", "length", "1000", "0"),
    ("cm", "length", "10000", "0"), ("centimetro", "length", "10000", "0"), ("centimetros", "length", "10000", "0"),
    ("m", "length", "1000000", "0"), ("mt", "length", "1000000", "0"), ("mts", "length", "1000000", "0"), ("metro", "length", "1000000", "0"), ("metros", "length", "1000000", "0"),
    ('"', "length", "25400", "0"), ("''", "length", "25400", "0"), ("in", "length", "25400", "0"), ("pol", "length", "25400", "0"), ("polegada", "length", "25400", "0"), ("polegadas", "length", "25400", "0"),
    ("mg", "mass", "1", "0"), ("g", "mass", "1000", "0"), ("gr", "mass", "1000", "0"), ("grama", "mass", "1000", "0"), ("gramas", "mass", "1000", "0"),
    ("kg", "mass", "1000000", "0"), ("kgs", "mass", "1000000", "0"), ("quilo", "mass", "1000000", "0"), ("quilos", "mass", "1000000", "0"), ("t", "mass", "1000000000", "0"),
    ("ml", "volume", "1", "0"), ("cc", "volume", "1", "0"), ("cm3", "volume", "1", "0"), ("l", "volume", "1000", "0"), ("lt", "volume", "1000", "0"), ("lts", "volume", "1000", "0"), ("litro", "volume", "1000", "0"), ("litros", "volume", "1000", "0"), ("m3", "volume", "1000000", "0"),
    ("v", "voltage", "1", "0"), ("volt", "voltage", "1", "0"), ("volts", "voltage", "1", "0"), ("kv", "voltage", "1000", "0"), ("mv", "voltage", "0.001", "0"),
    ("w", "power", "1", "0"), ("watt", "power", "1", "0"), ("watts", "power", "1", "0"), ("kw", "power", "1000", "0"), ("cv", "power", "735.49875", "0"), ("c.v", "power", "735.49875", "0"), ("hp", "power", "745.699872", "0"),
    ("pa", "pressure", "0.001", "0"), ("kpa", "pressure", "1", "0"), ("mpa", "pressure", "1000", "0"), ("bar", "pressure", "100", "0"), ("psi", "pressure", "6.894757293", "0"), ("lbf/pol2", "pressure", "6.894757293", "0"), ("kgf/cm2", "pressure", "98.0665", "0"),
]
# How labels of a specification begin (folded), and the measure they name.
LABELS = [
    ("comp", "length"), ("extensao", "length"), ("larg", "width"), ("esp", "thickness"), ("diam", "diameter"), ("bitola", "diameter"), ("ø", "diameter"),
    ("massa", "mass"), ("peso", "mass"), ("conteudo", "content"), ("vol.", "volume"), ("volume", "volume"), ("capacidade", "volume"),
    ("tensao", "voltage"), ("voltagem", "voltage"), ("pot", "power"), ("pressao", "pressure"),
]

_ALIASES = "|".join(sorted((a.replace(".", r"\.") for a, *_ in UNITS), key=len, reverse=True))
#: A figure with its unit; the unit ends there (mm2 is no length, and NLGI 2 has no unit).
QUANTITY = rf"{FIGURE}\s?(?:{_ALIASES})(?![a-z0-9/²³])"


def unit_table(spark: SparkSession) -> DataFrame:
    """alias, kind, factor, offset; a constant of a few dozen rows, so it may be broadcast."""
    return spark.createDataFrame(UNITS, "alias string, kind string, factor string, offset string").select("alias", "kind", F.col("factor").cast("decimal(20,9)").alias("factor"), F.col("offset").cast("decimal(20,9)").alias("offset"))


def figure_value(c: Column) -> Column:
    """Decimal value of a figure. A comma is decimal; a point groups thousands where exactly three digits follow a number
    not beginning with 0, else it is decimal. Fractions may be mixed (1 1/2, 1.1/2). What is no figure gives NULL."""
    dec = "decimal(22,10)"
    whole, over, under = (F.regexp_extract(c, r"^(?:(\d+)[ .])?(\d+)/(\d+)$", i) for i in (1, 2, 3))
    fraction = F.try_divide(over.try_cast(dec), under.try_cast(dec)).cast(dec) + F.when(whole != "", whole.try_cast(dec)).otherwise(F.lit(0).cast(dec))
    plain = (
        F.when(c.rlike(r"^[1-9]\d{0,2}(\.\d{3})+(,\d+)?$"), F.translate(F.translate(c, ".", ""), ",", "."))
        .when(c.rlike(r"^\d{1,3}(,\d{3})+\.\d+$"), F.translate(c, ",", ""))
        .when(c.rlike(r"^\d+([.,]\d+)?$"), F.translate(c, ",", "."))
    )
    return F.when(c.contains("/"), fraction.cast(dec)).otherwise(plain.try_cast(dec))


def spread_x(c: Column) -> Column:
    """Blanks around the x between dimensions (M4x45mm, 3 m x0,9 m)."""
    return F.regexp_replace(c, r'(?<=\d|"|m|s|n|l)\s*x\s*(?=\d)', " x ")
