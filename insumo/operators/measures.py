"""Problem 1: measures recorded in different units, brought to one common unit per kind of measure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from insumo.functions.text import fold
from insumo.functions.units import FIGURE, LABELS, QUANTITY, figure_value, spread_x, unit_table

SPECS = "array<struct<label:string,value:string>>"
#: A stainless grade is no figure (316L is no volume), unless a unit makes it one.
ALLOY = r"(?<=inox |inoxidavel |aisi )[234]\d{2}(?:\s?l(?![a-z]))?(?!\d|\s?(?:mm|cm|m|pol|milimetros|centimetros)(?![a-z]))"
#: From this length on (micrometres), a tube's or hose's only length is its length, not its diameter.
LONG_UM = 500_000
# Measures that the lengths of a name stand for, by kind of item, in order.
ORDER = {"chapa": ["thickness", "length", "width"], "tubo": ["diameter", "length"], "mangueira": ["diameter", "length"], "parafuso": ["length"], "cabo": ["length"], "eletrodo": ["diameter"], "valvula": ["diameter"]}


def _split(quantity: Column) -> list[Column]:
    """Figure and unit alias of a text that starts with a figure; alias '' where none follows."""
    figure = F.regexp_extract(quantity, f"^({FIGURE})", 1)
    return [figure.alias("figure"), F.rtrim(F.regexp_replace(F.trim(F.substr(quantity, F.length(figure) + 1)), r"\.$", "")).alias("alias")]


def statements(products: DataFrame, item: Column | None = None) -> DataFrame:
    """One row per stated figure: id, item, origin (name, spec, unit), pos, label measure, figure, alias.

    item: what the row is of; else the first word of its name.
    Names and units state figures with units; a specification states one by a label, with the unit in the value, in the
    label or nowhere. Null or broken JSON and blank texts state nothing."""
    base = products.select(
        F.col("id").alias("product_id"),
        F.regexp_replace(spread_x(fold(F.col("name"))), ALLOY, " ").alias("name"),
        fold(F.col("unit")).alias("unit"),
        F.from_json("specs_json", SPECS).alias("specs"),
        (F.lit(None).cast("string") if item is None else item).alias("item"),
    ).withColumn("item", F.coalesce("item", F.regexp_extract("name", r"^\W*(\w+)", 1)))
    none = F.lit(None).cast("string")
    quantities = lambda c: F.transform(F.regexp_extract_all(c, F.lit(f"({QUANTITY})"), 1), lambda q, i: F.struct(i.cast("int").alias("pos"), none.alias("measure"), q.alias("text"), F.lit("").alias("fallback")))
    in_name, in_unit = quantities(F.col("name")), quantities(F.col("unit"))
    label = lambda s: fold(F.trim(s["label"]))
    measure = lambda s: F.coalesce(*(F.when(F.trim(s).startswith(a), F.lit(m)) for a, m in LABELS))
    in_label = lambda s: F.regexp_extract(s, r"(?:[(\[]([^)\]]+)[)\]]| em (\S+)| (\S+))\s*$", 0)
    in_spec = F.transform(
        F.filter(F.col("specs"), lambda s: measure(label(s)).isNotNull() & s["value"].isNotNull()),
        lambda s, i: F.struct(i.cast("int").alias("pos"), measure(label(s)).alias("measure"), F.trim(fold(s["value"])).alias("text"), F.regexp_replace(F.regexp_replace(in_label(label(s)), r"^\s*em ", ""), r"[\s()\[\]]", "").alias("fallback")),
    )
    empty = F.array().cast("array<struct<pos:int,measure:string,text:string,fallback:string>>")
    tagged = lambda origin, c: F.transform(F.coalesce(c, empty), lambda s: F.struct(F.lit(origin).alias("origin"), *(s[x].alias(x) for x in ("pos", "measure", "text", "fallback"))))
    stated = F.concat(tagged("name", in_name), tagged("spec", in_spec), tagged("unit", in_unit))
    # what the unit column names alone is the unit of bare figures
    bare = F.regexp_replace(F.regexp_extract("unit", r"(c?m3|[^\s\d]+(?:/[a-z]+2)?)\s*$", 1), r"\.$", "")
    rows = base.select("product_id", "item", bare.alias("unit_alias"), F.explode(stated).alias("s"))
    return rows.select("product_id", "item", "unit_alias", "s.origin", "s.pos", "s.measure", *_split(F.col("s.text")), F.regexp_replace("s.fallback", r"\.$", "").alias("fallback")).filter("figure <> ''")


def stated_amounts(products: DataFrame) -> DataFrame:
    """product_id, measure, amount, origin, pos and rn (1: the statement that holds) of every statement in the common unit."""
    spark = products.sparkSession
    units = F.broadcast(unit_table(spark))
    s = statements(products).withColumn("value", figure_value(F.col("figure"))).filter("value is not null")
    as_ = lambda p: units.select(*(F.col(c).alias(f"{p}_{c}") for c in units.columns))
    s = s.join(as_("t"), F.col("alias") == F.col("t_alias"), "left").join(as_("l"), F.col("fallback") == F.col("l_alias"), "left").join(as_("u"), F.col("unit_alias") == F.col("u_alias"), "left").repartition("product_id")
    lengths = Window.partitionBy("product_id", "origin", F.col("t_kind") == "length")
    nth, many = F.dense_rank().over(lengths.orderBy("pos")), F.max("pos").over(lengths)
    s = s.withColumn("nth", nth).withColumn("many", F.size(F.collect_set("pos").over(lengths)))
    um = F.col("value") * F.col("t_factor")
    by_order = F.coalesce(*(F.when(F.col("item").startswith(item[:5]) & (F.col("nth") == i + 1), F.lit(m)) for item, ms in ORDER.items() for i, m in enumerate(ms)))
    one = F.col("item").isin("tubo", "mangueira") & (F.col("many") == 1)
    named = F.when(one, F.when(um >= LONG_UM, "length").otherwise("diameter")).otherwise(by_order)
    kind = F.coalesce("t_kind", "l_kind")
    content = F.when(F.col("measure") == "content", F.coalesce(kind, F.col("u_kind"))).otherwise(F.col("measure"))
    s = s.withColumn(
        "measure",
        F.when((F.col("origin") == "name") & (F.col("t_kind") == "length"), named)
        .when(F.col("origin") == "name", F.col("t_kind"))
        .when(F.col("origin") == "unit", F.col("t_kind"))
        .otherwise(content),
    ).filter("measure is not null or origin = 'spec'")
    # a bare figure has the unit that the same figure of that measure has in the name
    same = Window.partitionBy("product_id", "measure", "value")
    from_name = lambda c: F.first(F.when(F.col("origin") == "name", F.col(c)), ignorenulls=True).over(same.orderBy("origin", "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    for c in ("kind", "factor", "offset"):
        s = s.withColumn(f"n_{c}", from_name(f"t_{c}"))
    s = s.withColumn("kind", F.coalesce("t_kind", "l_kind", "n_kind", "u_kind")).withColumn("factor", F.coalesce("t_factor", "l_factor", "n_factor", "u_factor")).withColumn("offset", F.coalesce("t_offset", "l_offset", "n_offset", "u_offset"))
    spatial = ["length", "width", "thickness", "diameter"]
    fits = F.when(F.col("measure").isin(*spatial), F.col("kind") == "length").when((F.col("measure") == "mass") | (F.col("measure") == "volume"), F.col("kind").isin("mass", "volume")).otherwise(F.col("kind") == F.col("measure"))
    s = s.filter(fits).withColumn("measure", F.when(F.col("kind").isin("mass", "volume"), F.col("kind")).otherwise(F.col("measure")))
    amount = F.round(F.col("value") * F.col("factor") + F.col("offset"), 0).cast("long")
    rank = F.when(F.col("origin") == "name", 0).when(F.col("origin") == "spec", 1).otherwise(2)
    best = Window.partitionBy("product_id", "measure").orderBy(rank, "pos", "figure", "alias")
    return s.select("product_id", "measure", amount.alias("amount"), "origin", "pos", F.row_number().over(best).alias("rn"))


def measures(products: DataFrame) -> DataFrame:
    """product_id, measure, amount (long): every measure a product states, once, in the common unit.

    Pure SQL in one pass: figures and units come out of the texts by regular expressions, aliases are normalised by a join
    with a constant table, the unit is the first known of text, label, the name's unit of the same figure, and `unit`; then
    factor and offset apply, in decimals, and half rounds up. A figure without any unit, and a measure whose unit is of
    another kind, give nothing. If a product states a measure twice, the name goes before the specification, and that before
    `unit`; then the earlier. Repeated rows of a product give one row. Everything is partitioned by product alone."""
    return stated_amounts(products).filter("rn = 1").select("product_id", "measure", "amount")
