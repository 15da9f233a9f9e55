"""Price history of the catalogue: events, current offer, changes, last prices, age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from insumo.functions.numbers import iso_date
from insumo.operators.series import latest


def price_events(offers: DataFrame) -> DataFrame:
    """The valid offers (highest ingest_seq of an id), dates as text with '' for unknown."""
    return latest(offers).withColumn("updated_at", F.coalesce("updated_at", F.lit("")))


def positive(events: DataFrame) -> DataFrame:
    return events.filter(F.nanvl("final_price", F.lit(0.0)) > 0)


def newest(events: DataFrame, n: int) -> DataFrame:
    """The n newest priced events of each product with rank `rn`: date as text descending, then id descending."""
    w = Window.partitionBy("product_id").orderBy(F.col("updated_at").desc(), F.col("id").desc())
    return positive(events).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def current_offers(events: DataFrame) -> DataFrame:
    return newest(events, 1).drop("rn")


def last_prices(events: DataFrame, n: int = 3) -> DataFrame:
    """One row per product: price_1..n, date_1..n, newest first. The rank bounds each group to n rows before it is pivoted."""
    pick = lambda c, k: F.max(F.when(F.col("rn") == k, F.col(c)))
    return newest(events, n).groupBy("product_id").agg(*(x for k in range(1, n + 1) for x in (pick("final_price", k).alias(f"price_{k}"), pick("updated_at", k).alias(f"date_{k}"))))


def pct_change(current: Column, previous: Column) -> Column:
    """Change in percent; NULL unless both are over 0."""
    return F.when((current > 0) & (previous > 0), (current - previous) / previous * 100)


def price_alerts(events: DataFrame, threshold_pct: float = 30.0) -> DataFrame:
    """Products whose two newest prices differ by at least the threshold."""
    two = last_prices(events, 2)
    delta = pct_change(F.col("price_1"), F.col("price_2"))
    return two.select("product_id", F.bround(delta, 2).alias("delta_pct"), F.col("price_1").alias("cur_price"), F.col("price_2").alias("prev_price"), F.col("date_1").alias("cur_date"), F.col("date_2").alias("prev_date")).filter(F.abs(delta) >= threshold_pct)


def history(events: DataFrame) -> DataFrame:
    """All events of each product with their ordinal: newest date first, then latest delivered."""
    w = Window.partitionBy("product_id").orderBy(F.col("updated_at").desc(), F.col("ingest_seq").desc())
    return events.withColumn("ordinal", F.row_number().over(w))


def price_formula(base: Column, ipi: Column, adjustment: Column, quantity: Column, manual: Column | None = None) -> Column:
    """base * (1 + ipi% + adjustment%) / quantity; a manual price over 0 stands instead; 0 for a quantity of 0 or less."""
    value = F.when(quantity > 0, base * (1 + ipi / 100 + adjustment / 100) / quantity).otherwise(0.0)
    return value if manual is None else F.when(manual > 0, manual).otherwise(value)


def import_price(final: Column, base: Column, ipi: Column, adjustment: Column, quantity: Column) -> Column:
    """A stated final price, else the base with shares, over at least one piece."""
    return F.when(final > 0, final).otherwise(base * (1 + ipi / 100 + adjustment / 100) / F.greatest(F.lit(1.0), quantity))


def days_since(day: Column, as_of: Column) -> Column:
    return F.datediff(as_of, day)


def status(products: DataFrame, events: DataFrame, as_of: str, stale_days: int = 180) -> DataFrame:
    """product_id, status: missing (no price), undated, stale (older than stale_days), dated."""
    cur = current_offers(events).select(F.col("product_id").alias("cur_id"), "updated_at")
    day = iso_date(F.col("updated_at"))
    joined = products.select(F.col("id").alias("product_id")).join(cur, F.col("product_id") == F.col("cur_id"), "left")
    age = days_since(day, F.lit(as_of).cast("date"))
    return joined.select("product_id", F.when(F.col("cur_id").isNull(), "missing").when(day.isNull(), "undated").when(age > stale_days, "stale").otherwise("dated").alias("status"), age.alias("days"))


def staleness(events: DataFrame, as_of: str, stale_days: int = 180) -> DataFrame:
    """Current offers older than stale_days, with their age."""
    age = days_since(iso_date(F.col("updated_at")), F.lit(as_of).cast("date"))
    return current_offers(events).select("product_id", "final_price", "updated_at", age.alias("days")).filter(F.col("days") > stale_days)
