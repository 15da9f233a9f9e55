"""Problem 6: the N best items of every group, with a total order, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Subgroups that each group is hashed into in the first stage.
SALTS = 32


def top_n(rows: DataFrame, group: list[str], order: list[Column], item: str, n: int, salts: int = SALTS) -> DataFrame:
    """The first n rows of each group by `order`, with rank_no from 1; `item` spreads a group's rows over subgroups and breaks last ties.

    Two stages: every subgroup keeps its first n (Spark also limits the rank before the shuffle, so at most n rows of a
    subgroup leave a task), then at most n * salts survivors of a group are ranked. No task holds a whole group. Null group
    keys form a group of their own. Rows equal in order and item are interchangeable, and all of them count."""
    by = [*order, F.col(item).asc_nulls_last()]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(item), F.lit(salts)))
    first = Window.partitionBy(*group, "_salt").orderBy(*by)
    kept = salted.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= n).drop("_rank", "_salt")
    return kept.withColumn("rank_no", F.row_number().over(Window.partitionBy(*group).orderBy(*by))).filter(F.col("rank_no") <= n)
