"""Problem 9: sources mixed to target shares of all tokens, with capped repetition."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from insumo.llm.tokens import RANKS, token_count
from insumo.sources.shared import saved

#: The domain of each source, between the whole and the source in the tree. The corpus names none, so all sources are one
#: domain ("other"), and what a source can't give goes to all others by weight, which keeps every share as near as can be.
DOMAINS: dict[str, str] = {}
#: Leaves (source and language) that budgets are made for at most; targets are a short table, and languages are few.
LEAVES = 100_000
#: Parts of each leaf by the seeded hash, whose sums find the end of a prefix.
PARTS = 4096


def fill(budget: float, weights: dict, capacity: dict) -> dict:
    """The budget shared by weight; what a child can't hold goes to its siblings by weight. Up to the sum of capacities."""
    given, open_ = dict.fromkeys(weights, 0.0), {k for k in weights if weights[k] > 0 and capacity[k] > 0}
    rest = min(budget, sum(capacity[k] for k in open_))
    while open_:
        per = rest / sum(weights[k] for k in open_)
        full = {k for k in open_ if per * weights[k] >= capacity[k]}
        for k in full or open_:
            given[k] = min(capacity[k], per * weights[k])
        if not full:
            break
        rest -= sum(given[k] for k in full)
        open_ -= full
    return given


def budgets(leaves: list[tuple[str, str, int]], targets: dict[str, tuple[float, int]], total: float, domains: dict[str, str] = DOMAINS) -> dict[tuple[str, str], float]:
    """Tokens that each leaf (source, language) is to give. leaves: source, language, tokens; targets: source -> share, repeats.

    Weights go down the tree of domains, sources and languages (a source's languages weigh what they hold). A leaf that
    can't give its part leaves it to its siblings, these to their parent's siblings, and so on."""
    tree: dict = defaultdict(lambda: defaultdict(dict))
    for source, lang, tokens in leaves:
        if source in targets:
            tree[domains.get(source, "other")][source][lang] = (tokens, tokens * max(0, targets[source][1]))
    room = {d: {s: sum(c for _, c in ls.values()) for s, ls in ss.items()} for d, ss in tree.items()}
    shares: dict = defaultdict(float)
    for source, (share, _) in targets.items():
        shares[domains.get(source, "other")] += share
    by_domain = fill(total, {d: shares[d] for d in tree}, {d: sum(r.values()) for d, r in room.items()})
    out = {}
    for d, ss in tree.items():
        by_source = fill(by_domain[d], {s: targets[s][0] for s in ss}, room[d])
        for s, ls in ss.items():
            for lang, b in fill(by_source[s], {x: float(t) for x, (t, _) in ls.items()}, {x: float(c) for x, (_, c) in ls.items()}).items():
                out[s, lang] = b
    return out


def counted(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, source, lang ('und' if null), tokens of the documents, written once; texts are read and tokenized once."""
    rows = docs.select("doc_id", "source", F.coalesce("lang", F.lit("und")).alias("lang"), token_count(F.col("text"), ranks).alias("tokens"))
    return saved(rows, "tokens")


def mix(tokens: DataFrame, targets: DataFrame, seed: int = 9, domains: dict[str, str] = DOMAINS, parts: int = PARTS) -> DataFrame:
    """tokens with `times`, how often each document is used (those used at all).

    The result is as large as all tokens, if the repeats allow. A leaf's documents are used in whole epochs, and for the
    rest the prefix of the last epoch's seeded order that ends nearest to the budget: sums over parts of the order
    find where it ends, and only that part is ordered, so no leaf, however large, is one task. No document is used more than
    max_repeats times. Sources without target aren't used; a null source has none. Documents without tokens aren't used."""
    spark = tokens.sparkSession
    full = tokens.filter("tokens > 0")
    leaves = full.groupBy("source", "lang").agg(F.sum("tokens").alias("t")).limit(LEAVES + 1).collect()
    if len(leaves) > LEAVES:
        raise ValueError(f"over {LEAVES} pairs of source and language")
    asked = targets.filter("source is not null").limit(LEAVES + 1).collect()
    if len(asked) > LEAVES:
        raise ValueError(f"over {LEAVES} targets")
    wanted = {r.source: (r.target_share or 0.0, r.max_repeats or 0) for r in asked}
    plan = budgets([(r.source, r.lang, r.t) for r in leaves], wanted, sum(r.t for r in leaves), domains)
    rows = []
    for r in leaves:
        if budget := plan.get((r.source, r.lang), 0):
            epochs, rest = divmod(float(budget), r.t)
            # a budget within rounding of a whole number of epochs is that number
            rows.append((r.source, r.lang, int(epochs) + 1, 0.0) if r.t - rest < 0.5 else (r.source, r.lang, int(epochs), rest))
    plans = F.broadcast(spark.createDataFrame(rows, "source string, lang string, epochs int, rest double"))
    order = F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id"))
    docs = full.join(plans, ["source", "lang"]).withColumn("h", order).withColumn("part", F.floor((F.shiftright("h", 1) / 2.0**62 + 1) / 2 * parts).cast("int"))
    leaf = ["source", "lang"]
    sums = docs.groupBy(*leaf, "part").agg(F.sum("tokens").alias("in_part"))
    sums = sums.withColumn("before", F.sum("in_part").over(Window.partitionBy(*leaf).orderBy("part")) - F.col("in_part"))
    docs = docs.join(sums, [*leaf, "part"])
    whole = docs.filter("before + in_part <= rest").withColumn("last", F.lit(1))
    none = docs.filter("before >= rest").withColumn("last", F.lit(0))
    cut = docs.filter("before < rest and before + in_part > rest")
    upto = F.col("before") + F.sum("tokens").over(Window.partitionBy(*leaf).orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    cut = cut.withColumn("upto", upto).withColumn("last", (F.col("upto") - F.col("rest") < F.col("rest") - (F.col("upto") - F.col("tokens"))).cast("int")).drop("upto")
    used = whole.unionByName(none).unionByName(cut)
    return used.select("doc_id", *leaf, "tokens", (F.col("epochs") + F.col("last")).alias("times")).filter("times > 0")


def shares(tokens: DataFrame, targets: DataFrame, mixed: DataFrame) -> DataFrame:
    """Per source with a target: target and actual share, tokens held and used, most uses of a document."""
    held = tokens.groupBy("source").agg(F.sum("tokens").alias("held"))
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("used"), F.max("times").alias("most_times"))
    out = targets.select("source", "target_share", "max_repeats").join(held, "source", "left").join(used, "source", "left").fillna(0, ["held", "used", "most_times"])
    total = mixed.agg(F.sum(F.col("tokens") * F.col("times")).alias("total"))
    return out.crossJoin(F.broadcast(total)).select("source", "target_share", F.round(F.try_divide(F.col("used"), F.col("total")), 6).alias("actual_share"), "held", "used", "most_times", "max_repeats")
