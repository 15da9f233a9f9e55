"""Suppression of repeats in time: an event is kept if none of its key was kept within the window before it (a greedy fold)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def suppress(events: DataFrame, key: str, at: str, tie: str, window_s: float) -> DataFrame:
    """The events kept, per key in order of time. Runs are cut where two events are further apart than the window, as the
    first after such a gap is always kept, so the fold works on single runs: rows are sorted by key and time within
    partitions, spread by key and run, and folded as they stream by; no group is held in memory. Null keys or times are
    left out; events at the same instant as one kept are dropped (the least `tie` is kept)."""
    from pyspark.sql.window import Window

    e = events.filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    w = Window.partitionBy(key).orderBy(at, tie)
    gap = F.col("_t") - F.lag("_t").over(w)
    e = e.withColumn("_t", F.unix_micros(F.col(at).cast("timestamp"))).withColumn("_new", (F.coalesce(gap, F.lit(1 << 62)) > int(window_s * 1e6)).cast("int")).withColumn("_run", F.sum("_new").over(w))
    schema = events.schema
    names = schema.names

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, last = None, None
        for b in batches:
            keep = []
            for k, r, t in zip(b[key], b["_run"], b["_t"], strict=True):
                if (k, r) != run:
                    run, last = (k, r), None
                ok = last is None or t - last > window_s * 1e6
                if ok:
                    last = t
                keep.append(ok)
            yield b.loc[keep, names]

    return e.repartition(key, "_run").sortWithinPartitions(key, "_run", "_t", tie).mapInPandas(fold, schema)
