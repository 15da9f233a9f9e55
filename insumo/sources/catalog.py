"""The nested catalogue document, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insumo.functions.norms import norm_index, squeeze
from insumo.functions.numbers import index_number
from insumo.operators.audit import keep_first

SCHEMA = """revision long, schemaVersion int, settings struct<staleDays:int,priceAlertThreshold:int>,
suppliers array<struct<id:string,name:string,email:string,phone:string,aliases:array<string>>>,
products array<struct<id:string,code:string,name:string,family:string,subcategory:string,unit:string,manufacturer:string,aliases:array<string>,externalCodes:array<string>,
 specs:array<struct<label:string,value:string>>,supplierLinks:array<struct<supplierId:string,name:string,kind:string,source:string>>,
 offers:array<struct<id:string,supplierId:string,supplierName:string,basePrice:string,quantity:string,divisor:string,finalPrice:string,updatedAt:string,notes:string>>,
 quality:struct<needsReview:boolean>,archived:boolean>>"""


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """Documents, one row each; values of wrong shape are null. Older ones' `divisor` stands for a missing quantity."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def suppliers(doc: DataFrame) -> DataFrame:
    s = doc.select(F.explode("suppliers").alias("s")).select("s.*")
    return s.select("id", squeeze(F.col("name")).alias("name"), norm_index(F.col("name")).alias("name_norm"), "email", "phone", F.to_json("aliases").alias("aliases_json"))


def products(doc: DataFrame) -> DataFrame:
    p = doc.select(F.explode("products").alias("p")).select("p.*")
    return p.select("id", squeeze(F.col("code")).alias("code"), squeeze(F.col("name")).alias("name"), norm_index(F.col("name")).alias("name_norm"), squeeze(F.col("family")).alias("family"), squeeze(F.col("subcategory")).alias("subcategory"), F.coalesce(F.nullif(squeeze(F.col("unit")), F.lit("")), F.lit("un")).alias("unit"), squeeze(F.col("manufacturer")).alias("manufacturer"), F.to_json("specs").alias("specs_json"), F.to_json("aliases").alias("aliases_json"), F.to_json("externalCodes").alias("external_codes_json"), F.coalesce("archived", F.lit(False)).alias("archived"), F.coalesce("quality.needsReview", F.lit(False)).alias("needs_review"), F.coalesce(F.size("offers"), F.lit(0)).alias("offer_count"))


def offers(doc: DataFrame) -> DataFrame:
    """Price events; of offers with one id the last of the document holds."""
    p = doc.select(F.posexplode("products").alias("i", "p")).select("i", F.col("p.id").alias("product_id"), F.posexplode("p.offers").alias("j", "o"))
    rows = p.select(F.coalesce(F.nullif("o.id", F.lit("")), F.concat_ws("_", F.lit("off"), "product_id", "j")).alias("id"), F.shiftleft(F.col("i").cast("long"), 31).bitwiseOR(F.col("j").cast("long")).alias("ingest_seq"), "product_id", squeeze(F.col("o.supplierId")).alias("supplier_id"), squeeze(F.col("o.supplierName")).alias("supplier_name"), index_number(F.col("o.basePrice")).alias("base_price"), F.coalesce(index_number(F.coalesce("o.quantity", "o.divisor")), F.lit(1.0)).alias("quantity"), index_number(F.col("o.finalPrice")).alias("final_price"), squeeze(F.col("o.updatedAt")).alias("updated_at"), "o.notes")
    return keep_first(rows, ["id"], [F.col("ingest_seq").desc()])


def links(doc: DataFrame) -> DataFrame:
    p = doc.select(F.explode("products").alias("p")).select(F.col("p.id").alias("product_id"), F.explode("p.supplierLinks").alias("l"))
    return p.select("product_id", squeeze(F.col("l.supplierId")).alias("supplier_id"), squeeze(F.col("l.name")).alias("supplier_name"), squeeze(F.col("l.kind")).alias("kind"), squeeze(F.col("l.source")).alias("source")).dropDuplicates(["product_id", "supplier_name", "kind", "source"])


def migrated(old: DataFrame, seed: DataFrame) -> DataFrame:
    """seed (id, code, name, ...) and the old rows whose id, or code and name, it lacks."""
    key = lambda d: d.withColumn("_k", F.concat_ws("|", norm_index(F.col("code")), norm_index(F.col("name"))))
    rest = old.join(seed.select("id"), "id", "left_anti")
    rest = key(rest).join(key(seed).select("_k"), "_k", "left_anti").drop("_k")
    return seed.unionByName(rest, allowMissingColumns=True)
