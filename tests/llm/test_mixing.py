from pathlib import Path

import pytest

from insumo.llm import mixing, tokens

TARGETS = "source string, target_share double, max_repeats int"
ROWS = "doc_id long, source string, lang string, tokens long"


def test_fill_leaves_shortage_to_siblings_then_ancestors():
    assert mixing.fill(100, {"a": 0.5, "b": 0.25, "c": 0.25}, {"a": 20, "b": 1000, "c": 1000}) == {"a": 20, "b": 40, "c": 40}
    leaves = [("a", "pt", 10), ("a", "en", 10), ("b", "pt", 1000), ("c", "pt", 1000)]
    targets = {"a": (0.4, 1), "b": (0.1, 1), "c": (0.5, 1), "absent": (0.0, 1)}
    got = mixing.budgets(leaves, targets, 1000, {"a": "x", "b": "x", "c": "y"})
    assert got == pytest.approx({("a", "pt"): 10, ("a", "en"): 10, ("b", "pt"): 480, ("c", "pt"): 500})
    assert sum(mixing.budgets(leaves, targets, 1000).values()) == pytest.approx(1000)


def test_shares_and_repeats(spark):
    rows = [(i, "big" if i % 5 else "small", "pt" if i % 2 else None, 10 + i % 7) for i in range(2000)] + [(5000, None, "pt", 10), (5001, "other", "pt", 10), (5002, "big", "pt", 0)]
    df = spark.createDataFrame(rows, ROWS).fillna("und", ["lang"])
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3), ("none", 0.0, 2)], TARGETS)
    mixed = mixing.mix(df, targets, parts=16)
    total = sum(r[3] for r in rows)
    got = {r.source: r for r in mixing.shares(df, targets, mixed).collect()}
    assert abs(got["big"].used - total * 0.5) < 40 and abs(got["small"].used - total * 0.5) < 40 and got["small"].most_times == 3 and got["none"].used == 0
    assert mixed.filter("source = 'other' or source is null or times > 3").count() == 0
    # how finely the order is cut changes where a prefix ends in no way
    assert sorted(mixed.collect()) == sorted(mixing.mix(df, targets, parts=4096).collect())
    times = [r.times for r in mixed.filter("source = 'small'").collect()]
    assert max(times) - min(times) <= 1  # whole epochs, then a prefix


def test_shortage_stays_in_its_domain(spark):
    df = spark.createDataFrame([(i, s, "pt", 10) for i, s in enumerate(["a"] * 10 + ["b"] * 400 + ["c"] * 400)], ROWS)
    targets = spark.createDataFrame([("a", 0.3, 1), ("b", 0.2, 2), ("c", 0.5, 2)], TARGETS)
    used = lambda domains: {r.source: r.used for r in mixing.shares(df, targets, mixing.mix(df, targets, domains=domains)).collect()}
    # a holds 100 of the 2,430 that it should give; what it lacks goes to its sibling alone
    assert used({"a": "x", "b": "x", "c": "y"}) == {"a": 100, "b": 3950, "c": 4050}
    assert used({"a": "y", "b": "x", "c": "y"}) == {"a": 100, "b": 1620, "c": 6380}


def test_too_many_targets_raise(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAVES", 2)
    df = spark.createDataFrame([(1, "a", "pt", 10)], ROWS)
    with pytest.raises(ValueError):
        mixing.mix(df, spark.createDataFrame([(s, 0.3, 1) for s in "abc"], TARGETS))


def test_empty(spark):
    df = spark.createDataFrame([], ROWS)
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    assert mixing.mix(df, targets).count() == 0


@pytest.mark.skipif(not Path(tokens.RANKS).exists(), reason="no tokenizer files")
def test_counts_are_the_tokenizers():
    c = tokens.counter(tokens.RANKS)
    for t in ("", "Ação de 10 mm² ½ — it's  \n\n ok_ _x", "тест ٣٤ 漢字   x y", "a" * 5000, " " * 50, "I'll\t\tgo\r\n"):
        assert c.count(t) == len(c.encoding.encode_ordinary(t))
    assert c.count(None) == 0
