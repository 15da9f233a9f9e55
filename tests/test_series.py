import datetime as dt
import random

import numpy as np

from insumo.operators.series import implausible, latest, median_of

SCHEMA = "ingest_seq long, id string, product_id string, supplier_id string, final_price double, updated_at string, note string"


def offers(spark, series, start=0):
    rows, n = [], start
    for key, prices in series.items():
        for i, p in enumerate(prices):
            rows.append((n, f"{key}-{i:03d}", "p", key, p, str(dt.date(2020, 1, 1) + dt.timedelta(days=i)), None))
            n += 1
    return spark.createDataFrame(rows, SCHEMA)


def noisy(n, seed=1, level=100.0):
    r = random.Random(seed)
    return [round(level * (1 + r.uniform(-0.02, 0.02)), 4) for _ in range(n)]


def flags(df, **kw):
    return {r.offer_id: {k for k in ("price_bad", "date_bad", "spike", "stuck") if r[k]} for r in implausible(df, **kw).collect()}


def test_spikes_of_one_and_two_steps_and_level_changes(spark):
    one, two, step = noisy(20, 1), noisy(20, 2), noisy(10, 3) + noisy(10, 4, 200.0)
    one[8] *= 3
    two[5] *= 0.3
    two[6] *= 0.3
    got = flags(offers(spark, {"one": one, "two": two, "step": step, "short": [1.0, 1.0, 9.0, 1.0, 1.0]}))
    assert got == {"one-008": {"spike"}, "two-005": {"spike"}, "two-006": {"spike"}}


def test_stuck_runs_not_habits(spark):
    stuck = noisy(8, 5) + [101.0] * 6 + noisy(8, 6)
    steps = [10.0] * 8 + [12.0] * 8 + [13.0] * 8
    constant = [48.5] * 30
    constant[12] = 4.85
    got = flags(offers(spark, {"stuck": stuck, "steps": steps, "constant": constant}))
    assert got == {f"stuck-{i:03d}": {"stuck"} for i in range(9, 14)} | {"constant-012": {"spike"}}


def test_bounds_nulls_and_corrections(spark):
    rows = [
        (1, "a", "p", "s", 0.0, "2020-01-01", None), (2, "b", "p", "s", -1.0, "", None), (3, "c", "p", "s", 5.0, "2031-01-01", None), (4, "d", None, None, None, None, None), (5, "e", "p", "s", float("nan"), "2020-02-30", None),
        (6, "f", "p", "s", 0.0, "2020-01-01", None), (7, "f", "p", "s", 1.0, "2020-01-01", None), (8, None, "p", "s", 0.0, "2020-01-01", None),
    ]
    got = flags(spark.createDataFrame(rows, SCHEMA))
    assert got == {"a": {"price_bad"}, "b": {"price_bad"}, "c": {"date_bad"}, "e": {"date_bad"}}
    assert latest(spark.createDataFrame(rows, SCHEMA)).count() == 6
    assert flags(spark.createDataFrame([], SCHEMA)) == {}


def test_hot_series_in_chunks_give_the_same(spark):
    series = {f"s{k}": noisy(60, k) for k in range(4)}
    for k, s in enumerate(series.values()):
        for i in (11, 21, 22, 40):
            s[i] *= 2 + k
        s[30:37] = [s[30]] * 7
    df = offers(spark, series)
    one = flags(df, parts=1)
    assert one == flags(df, parts=24) != {}


def test_exact_median_of_long_series(spark):
    r = random.Random(3)
    values = {k: [r.randrange(2**50) >> r.randrange(40) for _ in range(n)] for k, n in (("odd", 101), ("even", 40), ("one", 1), ("equal", 7))}
    values["equal"] = [5] * 7
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k string, v long")
    assert {r.k: r.median for r in median_of(df, ["k"]).collect()} == {k: float(np.median(v)) for k, v in values.items()}
