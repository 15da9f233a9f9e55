"""Problem 5: references to records that weren't in being when the reference was recorded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Parts that every key is split into, so that one key with a third of all references is no single task.
SALTS = 16


def references(rows: DataFrame, table: str, row_key: Column, key: Column, recorded_at: Column) -> DataFrame:
    """table_name, row_key, ref_key (trimmed), recorded_at of a table's references; null and blank keys refer to nothing."""
    trimmed = F.regexp_replace(key, r"^\s+|\s+$", "")
    out = rows.select(F.lit(table).alias("table_name"), row_key.cast("string").alias("row_key"), trimmed.alias("ref_key"), recorded_at.alias("recorded_at"))
    return out.filter("ref_key is not null and ref_key <> ''")


def classify(refs: DataFrame, parents: DataFrame, salts: int = SALTS) -> DataFrame:
    """refs with `state`: valid, missing (no parent ever), deleted (had one, ended by then), late (its parent came later).

    parents: key, loaded_at, deleted_at (null: still in being); a parent is in being from loaded_at until before deleted_at.
    References and parents are put into one stream, co-partitioned by key and salt, sorted by key and time, and merged
    linearly: running maxima carry the latest end of the intervals that began so far, and whether one began at all. Parents
    are copied to every salt (three narrow columns), references are not. At the same instant parents come first. A null
    loaded_at of a parent is never in being; a null recorded_at of a reference is found missing, late or deleted as if it
    lay before all time. Parents may repeat; each row counts as an interval."""
    spread = F.pmod(F.xxhash64("table_name", "row_key"), F.lit(salts)).cast("int")
    never = F.lit("9999-12-31 00:00:00").cast("timestamp")
    null = lambda t: F.lit(None).cast(t)
    side = parents.select(
        F.col("key").alias("ref_key"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.col("loaded_at").alias("at"), F.lit(0).alias("side"),
        F.coalesce("deleted_at", never).alias("until"), null("string").alias("table_name"), null("string").alias("row_key"), null("timestamp").alias("recorded_at"),
    ).filter("ref_key is not null and at is not null")
    stream = refs.select("ref_key", spread.alias("salt"), F.col("recorded_at").alias("at"), F.lit(1).alias("side"), null("timestamp").alias("until"), "table_name", "row_key", "recorded_at").unionByName(side)
    group = Window.partitionBy("ref_key", "salt")
    before = group.orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = group.orderBy(F.col("at").desc_nulls_last(), F.col("side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = stream.withColumn("reach", F.max("until").over(before)).withColumn("later", F.max(F.when(F.col("side") == 0, F.lit(1))).over(after))
    state = (
        F.when(F.col("reach") > F.col("recorded_at"), "valid")
        .when(F.col("reach").isNotNull(), "deleted")
        .when(F.col("later").isNotNull(), "late")
        .otherwise("missing")
    )
    return merged.filter("side = 1").select("table_name", "row_key", "ref_key", "recorded_at", state.alias("state"))


def orphans(refs: DataFrame, parents: DataFrame, salts: int = SALTS) -> DataFrame:
    """The references whose parent wasn't in being: table_name, period (UTC month yyyy-MM of recorded_at), row_key, state."""
    found = classify(refs, parents, salts).filter("state <> 'valid'")
    return found.select("table_name", F.date_format("recorded_at", "yyyy-MM").alias("period"), "row_key", "state")


def orphan_report(refs: DataFrame, parents: DataFrame, salts: int = SALTS) -> DataFrame:
    """Number of references and orphans per table, month and state, so that the share of each can be read off."""
    all_ = classify(refs, parents, salts)
    return all_.groupBy("table_name", F.date_format("recorded_at", "yyyy-MM").alias("period"), "state").agg(F.count("*").alias("n"), F.countDistinct("ref_key").alias("n_keys"))
