"""Problem 4: spikes, stuck values and impossible readings in price series (one supplier's offers for one product)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from insumo.functions.text import valid_date
from insumo.sources.shared import saved

KEY = ["product_id", "supplier_id"]
#: Rows at either end of a piece that its neighbours see too: the reach of the run and level windows.
HALO = 5
#: Logarithms are whole numbers of this part, so details are exact and equal prices have a zero detail.
UNIT = 10**12
#: Bits of a detail's size that the selection of a median settles a pass, and passes; sizes are under UNIT * 2000 < 2**51.
BITS, PASSES = 17, 3


def latest(rows: DataFrame, key: str = "id", order: str = "ingest_seq") -> DataFrame:
    """The valid row of each key: the one with the highest order. Null keys give none; ties keep one row.

    Ranking by 1 is limited before the shuffle too, so a key that comes very often is no hot task."""
    top = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last())
    return rows.filter(F.col(key).isNotNull()).withColumn("_rn", F.row_number().over(top)).filter("_rn = 1").drop("_rn")


def _pieces(readings: DataFrame, parts: int | None) -> tuple[DataFrame, DataFrame]:
    """The readings with `piece` and `own`; and the series that lie in several pieces.

    Rows are cut into ranges of the order by series, day and id, so a piece is a range's part of a series and every range is
    about as long, however long a series is. Rows near a cut are copied to the neighbour (own = false). A series lies in
    several pieces only if it begins in one range and ends in another: there are fewer such series than ranges, which is what
    bounds the broadcast."""
    key = [*KEY, "day", "id"]
    ranged = readings.repartitionByRange(parts, *key) if parts else readings.repartitionByRange(*key)
    rows = saved(ranged.withColumn("piece", F.spark_partition_id()), "pieces")
    ends = rows.groupBy("piece").agg(F.min(F.struct(*KEY)).alias("first"), F.max(F.struct(*KEY)).alias("last"))
    ends = ends.select(F.explode(F.array(F.struct("piece", F.col("first").alias("s")), F.struct("piece", F.col("last").alias("s")))).alias("e")).select("e.piece", "e.s.*").distinct()
    several = saved(ends.groupBy(*KEY).agg(F.count("*").alias("pieces")).filter("pieces > 1").select(*KEY), "several")
    cut = rows.join(F.broadcast(several), KEY, "left_semi")
    order = ["day", "id"]
    up, down = Window.partitionBy("piece", *KEY).orderBy(*order), Window.partitionBy("piece", *KEY).orderBy(*(F.col(c).desc() for c in order))
    edges = cut.withColumn("_up", F.row_number().over(up)).withColumn("_down", F.row_number().over(down)).filter((F.col("_up") <= HALO) | (F.col("_down") <= HALO)).drop("_up", "_down")
    # at most 2 * HALO rows of each range
    near = Window.partitionBy(*KEY).orderBy("piece", *order)
    others = F.array_except(F.array_compact(F.array(*(f("piece", k).over(near) for k in range(1, HALO + 1) for f in (F.lag, F.lead)))), F.array("piece"))
    copies = edges.withColumn("to", others).withColumn("piece", F.explode("to")).drop("to").withColumn("own", F.lit(False))
    return rows.withColumn("own", F.lit(True)).unionByName(copies), several


def _median3(a: Column, b: Column, c: Column) -> Column:
    """Median of up to three values, the nearest first; those missing are null."""
    return F.when(b.isNull(), a).when(c.isNull(), (a + b) / 2).otherwise(a + b + c - F.greatest(a, b, c) - F.least(a, b, c))


def median_of(values: DataFrame, keys: list[str]) -> DataFrame:
    """keys, median: the exact median (mean of the two middle ones) of `v`, whole numbers from 0, per key, for few keys with many
    values each. Every pass counts values by their next bits and keeps the interval with the wanted rank, so no task holds a group."""
    n = values.groupBy(*keys).agg(F.count("v").alias("n")).filter("n > 0")
    want = saved(n.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.floor((F.col("n") - 1) / 2).alias("r")), F.struct(F.lit(1).alias("side"), F.floor(F.col("n") / 2).alias("r")))).alias("t"), F.lit(0).cast("long").alias("p")).select(*keys, "t.side", "t.r", "p"), "ranks")
    for shift in range(BITS * (PASSES - 1), -1, -BITS):
        inside = values.join(F.broadcast(want), keys).filter(F.shiftright("v", shift + BITS) == F.col("p"))
        counts = inside.groupBy(*keys, "side", "r", F.shiftright("v", shift).alias("b")).agg(F.count("*").alias("c"))
        upto = F.sum("c").over(Window.partitionBy(*keys, "side").orderBy("b"))
        counts = counts.withColumn("upto", upto).filter((F.col("upto") > F.col("r")) & (F.col("upto") - F.col("c") <= F.col("r")))
        want = saved(counts.select(*keys, "side", (F.col("r") - F.col("upto") + F.col("c")).alias("r"), F.col("b").alias("p")), "ranks")
    return want.groupBy(*keys).agg(F.avg("p").alias("median"))


def _counts(own: Column) -> dict[str, Column]:
    """Sums over a series: readings, changes, rests outside long runs, long runs."""
    one = lambda c: F.sum(F.when(own & c, 1).otherwise(0))
    return {"n": one(F.lit(True)), "changes": one(F.col("d1") != 0), "rests": one((F.col("d1") == 0) & ~F.col("in_run")), "runs": one(F.col("in_run") & ~F.coalesce(F.col("z_before"), F.lit(False)))}


def implausible(offers: DataFrame, threshold: float = 5.8, floor: float = 0.01, least: int = 10, run: int = 5, parts: int | None = None) -> DataFrame:
    """offer_id, price_bad, date_bad, spike, stuck of each valid offer (highest ingest_seq of its id) with at least one of them.

    price_bad: a price of zero or less. date_bad: a date that is neither empty nor a calendar date of 2010-01-01..2026-06-30.
    Other offers of a series, with a price and a date, are ordered by date and id, and the logarithm of the price is split
    by the undecimated Haar wavelet: a detail of scale 1 is the difference of neighbours, one of scale 2 that of the means of
    neighbouring pairs. Details are scaled by 1.4826 times the median size of the series' non-zero ones of their scale (at
    least `floor`). One offer is a spike where the two details of scale 1 about it are opposite and both over `threshold`;
    two are where the two details of scale 2 that enclose the pair are, and those of scale 1 at its ends. Then the level before (median of three)
    and after must agree: a step has no second detail. Stuck is a run of zero details at least `run` offers long, but its
    first, in a series whose other details are nearly all non-zero. Series under `least` readings have neither. Null
    prices, suppliers or products, and blank dates, are in no series; NaN is no price.
    Series are cut into pieces by a range partitioning (`parts` ranges; by default as many as the session shuffles by), alike
    for every length; the figures of a series are exact either way. `run` is at most 6."""
    valid = latest(offers).select("id", *KEY, F.nanvl("final_price", F.lit(None).cast("double")).alias("price"), "updated_at").withColumn("day", valid_date(F.col("updated_at")))
    price_bad = F.coalesce(F.col("price") <= 0, F.lit(False))
    date_bad = F.coalesce((F.trim("updated_at") != "") & F.col("day").isNull(), F.lit(False))
    bounds = valid.filter(price_bad | date_bad).select(F.col("id").alias("offer_id"), price_bad.alias("price_bad"), date_bad.alias("date_bad"), F.lit(False).alias("spike"), F.lit(False).alias("stuck"))
    readings = valid.filter("price > 0 and day is not null and product_id is not null and trim(supplier_id) <> ''").select("id", *KEY, "day", F.round(F.log("price") * UNIT).cast("long").alias("x"))
    rows, several = _pieces(readings, parts)

    group = Window.partitionBy(*KEY, "piece")
    w = group.orderBy("day", "id")
    at = lambda k: F.col("x") if k == 0 else F.lag("x", -k).over(w) if k < 0 else F.lead("x", k).over(w)
    rows = rows.withColumns({f"x{k}".replace("-", "_"): at(k) for k in range(-HALO, HALO + 1) if k})
    x = {k: F.col(f"x{k}".replace("-", "_")) if k else F.col("x") for k in range(-HALO, HALO + 1)}
    fine = lambda k: x[k] - x[k - 1]
    # twice the difference of the means of the pair that ends here and the one before it
    coarse = lambda k: x[k] + x[k - 1] - x[k - 2] - x[k - 3]
    rest = lambda k: F.coalesce(fine(k) == 0, F.lit(False)).cast("int")
    chain = lambda fs: reduce(lambda a, f: (a[0] + a[1] * f, a[1] * f), fs, (F.lit(0), F.lit(1)))[0]
    around = chain([rest(-k) for k in range(run - 1)]) + chain([rest(k) for k in range(1, run)])
    rows = rows.withColumns({"d1": fine(0), "d2": coarse(0), "z_before": fine(-1) == 0}).withColumn("in_run", (F.coalesce(F.col("d1"), F.lit(1)) == 0) & (around >= run - 1))
    sized = lambda c: F.when(F.col("own") & (F.col(c) != 0), F.abs(c))
    # long series: sums by pieces, medians by selection
    cut = saved(rows.join(F.broadcast(several), KEY, "left_semi").select(*KEY, "own", "in_run", "z_before", "d1", "d2"), "long-series")
    sums = cut.groupBy(*KEY).agg(*(c.alias(f"h_{k}") for k, c in _counts(F.col("own")).items()))
    sizes = cut.select(*KEY, F.explode(F.array(*(F.struct(F.lit(s).alias("scale"), sized(f"d{s}").alias("v")) for s in (1, 2)))).alias("e")).select(*KEY, "e.scale", "e.v").filter("v is not null")
    medians = median_of(sizes, [*KEY, "scale"]).groupBy(*KEY).agg(*(F.max(F.when(F.col("scale") == s, F.col("median"))).alias(f"h_size{s}") for s in (1, 2)))
    long = sums.join(medians, KEY, "left")
    # the others lie in one piece whole
    rows = rows.withColumns({k: c.over(group) for k, c in _counts(F.col("own")).items()} | {f"size{s}": F.percentile(sized(f"d{s}"), 0.5).over(group) for s in (1, 2)})
    rows = rows.join(F.broadcast(long), KEY, "left")
    rows = rows.withColumns({k: F.when(F.col("h_n").isNotNull(), F.col(f"h_{k}")).otherwise(F.col(k)) for k in ("n", "changes", "rests", "runs", "size1", "size2")})

    lively = (F.col("changes") >= 3 * F.col("runs")) & (F.col("rests") <= 0.25 * (F.col("rests") + F.col("changes")))
    moving = lively | (F.col("changes") > 0.5 * (F.col("n") - 1))
    scale = {s: F.greatest(F.lit(floor * UNIT * s), F.when(moving, 1.4826 * F.col(f"size{s}")).otherwise(0.0)) for s in (1, 2)}

    def pulse(at: int, long: int) -> Column:
        """Whether a spike of `long` offers begins `at` offers from here."""
        none = F.lit(None).cast("long")
        before, after = _median3(*(x.get(at - k, none) for k in (1, 2, 3))), _median3(*(x.get(at + long - 1 + k, none) for k in (1, 2, 3)))
        enter, leave = fine(at), fine(at + long)
        opposite = (enter * 1.0 * leave < 0) & (F.least(F.abs(enter), F.abs(leave)) > threshold * scale[1])
        if long == 2:
            # nothing lies before the first pair of a series, nor behind the last
            into, out = F.coalesce(coarse(at + 1), 2 * enter), F.coalesce(coarse(at + 3), 2 * leave)
            opposite &= (into * 1.0 * out < 0) & (F.least(F.abs(into), F.abs(out)) > threshold * scale[2])
        off = F.least(*(F.abs(x[at + i] - level) for i in range(long) for level in (before, after)))
        back = (off > threshold * scale[1]) & (F.abs(before - after) <= 0.5 * off) & (F.abs(x[at] - x[at + long - 1]) <= 0.5 * off)
        return F.coalesce(opposite & back, F.lit(False))

    spike = pulse(0, 1) | pulse(0, 2) | pulse(-1, 2)
    flagged = rows.filter(F.col("own") & (F.col("n") >= least)).select(F.col("id").alias("offer_id"), F.lit(False).alias("price_bad"), F.lit(False).alias("date_bad"), spike.alias("spike"), (F.col("in_run") & lively).alias("stuck"))
    return bounds.unionByName(flagged.filter("spike or stuck"))
