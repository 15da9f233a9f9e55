"""Queries of the problems for training data (2, 3, 6 to 10), over whole tables, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from insumo.functions.text import valid_date
from insumo.llm import leaks, listings, mixing, parties, residue, topn, visual
from insumo.operators.series import latest
from insumo.sources.shared import saved
from insumo.sources.tables import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return listings.same_item_pairs(table(spark, sf, "match_candidate"), table(spark, sf, "product"))


def p2_items(spark: SparkSession, sf: str) -> DataFrame:
    """Each listing and product with its item, and how many listings and products that has."""
    rows = listings.listing_rows(table(spark, sf, "match_candidate")).unionByName(listings.product_rows(table(spark, sf, "product")))
    keyed = saved(listings.items(listings.features(rows)).distinct(), "item-keys")
    sizes = keyed.groupBy("item").agg(F.count_if(F.col("side") == "listing").alias("listings"), F.count_if(F.col("side") == "product").alias("products"))
    return keyed.join(sizes, "item").select("id", "side", "item", "listings", "products")


def p2_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Per kind of reliable key: listings and products that have one, and that share it."""
    rows = listings.listing_rows(table(spark, sf, "match_candidate")).unionByName(listings.product_rows(table(spark, sf, "product")))
    return listings.kinds_of_key(listings.features(rows))


def _unnamed(spark: SparkSession, sf: str) -> DataFrame:
    # of rows with a supplier only that they are the latest matters, so their names aren't shuffled
    name = F.when(F.col("supplier_id").isNull(), F.col("supplier_name"))
    return latest(table(spark, sf, "offers").select("id", "ingest_seq", name.alias("name"))).filter("name is not null").select("id", "name")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return parties.same_party_pairs(table(spark, sf, "suppliers").select("id", "name", "aliases_json"), _unnamed(spark, sf))


def p3_parties(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier record with its party and how many records that has."""
    suppliers = table(spark, sf, "suppliers")
    names = suppliers.select("id", "name").union(suppliers.select("id", F.explode(F.from_json("aliases_json", "array<string>")).alias("name")))
    of_record, _ = parties.parties(names, suppliers.select("id", "name").limit(0))
    of_record = saved(of_record, "record-parties")
    return of_record.join(of_record.groupBy("party").agg(F.count("*").alias("records")), "party").select("id", "party", "records")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    valid = latest(table(spark, sf, "offers")).select("product_id", "id", "final_price", "updated_at", "supplier_name")
    valid = valid.filter((F.nanvl("final_price", F.lit(0.0)) > 0) & valid_date(F.col("updated_at")).isNotNull())
    order = [F.col("updated_at").desc(), F.col("final_price").asc(), F.col("supplier_name").asc_nulls_first()]
    best = topn.top_n(valid.filter("product_id is not null"), ["product_id"], order, "id", 3)
    return best.select("product_id", "rank_no", F.col("id").alias("offer_id"))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    fields = [("product", "name"), ("product", "code"), ("suppliers", "name")]
    return reduce(DataFrame.unionByName, (table(spark, sf, t).select(F.lit(f"{t}.{c}").alias("field"), F.col("id").alias("key"), F.col(c).alias("raw")) for t, c in fields))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return visual.lookalike_pairs(_texts(spark, sf))


def p7_canonical(spark: SparkSession, sf: str) -> DataFrame:
    return visual.canonical(_texts(spark, sf)).select("field", "key", "canon")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf: str) -> DataFrame:
    """Per evaluation item: the documents that leak it, and the largest share that one holds."""
    items = table(spark, sf, "eval_items")
    found = leaks.leaks(table(spark, sf, "documents"), items).groupBy("item_id").agg(F.count("*").alias("docs"), F.max("held").alias("most"))
    return items.select("item_id", "task").join(found, "item_id", "left").select("item_id", "task", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("most", F.lit(0.0)).alias("most"))


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(mixing.counted(table(spark, sf, "documents")), table(spark, sf, "mix_target"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    tokens, targets = mixing.counted(table(spark, sf, "documents")), table(spark, sf, "mix_target")
    return mixing.shares(tokens, targets, mixing.mix(tokens, targets))


#: Two domains of sources: texts of trade with other parties, and texts of the house.
DOMAINS = {"cotacao_email": "trade", "nota_fiscal": "trade", "pagina_fornecedor": "trade", "chat_compras": "trade", "ficha_tecnica": "house", "relato_auditoria": "house", "manual_uso": "house"}


def p9_domains(spark: SparkSession, sf: str) -> DataFrame:
    """Per domain: target and actual share, where a source's shortage goes to the sources of its domain before others."""
    tokens, targets = mixing.counted(table(spark, sf, "documents")), table(spark, sf, "mix_target")
    got = mixing.shares(tokens, targets, mixing.mix(tokens, targets, domains=DOMAINS))
    named = F.coalesce(*(F.when(F.col("source") == s, F.lit(d)) for s, d in DOMAINS.items()), F.lit("other"))
    return got.groupBy(named.alias("domain")).agg(F.round(F.sum("target_share"), 6).alias("target_share"), F.round(F.sum("actual_share"), 6).alias("actual_share"), F.sum("used").alias("used"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.residue(table(spark, sf, "documents")).select("doc_id").distinct()


def p10_report(spark: SparkSession, sf: str) -> DataFrame:
    """Documents per kind of residue and source; a document may count under several kinds."""
    docs = table(spark, sf, "documents")
    return residue.residue(docs).distinct().join(docs.select("doc_id", "source").distinct(), "doc_id").groupBy("kind", "source").agg(F.count("*").alias("docs"))


QUERIES = {q.__name__: q for q in (p2_found, p2_items, p2_keys, p3_found, p3_parties, p6_found, p7_found, p7_canonical, p8_found, p8_items, p9_mix, p9_shares, p9_domains, p10_found, p10_report)}
ORACLES = {
    "p6_found": """
with valid as (select * from (select *, row_number() over (partition by id order by ingest_seq desc) as rn from offers where id is not null) where rn = 1),
good as (select * from valid where product_id is not null and final_price > 0 and regexp_matches(updated_at, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$')
         and try_cast(updated_at as date) between date '2010-01-01' and date '2026-06-30'),
ranked as (select product_id, id, cast(row_number() over (partition by product_id order by updated_at desc, final_price, supplier_name nulls first, id) as integer) as rank_no from good)
select product_id, rank_no, id as offer_id from ranked where rank_no <= 3""",
}
