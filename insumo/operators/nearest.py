"""The best rows for each query by a score of described() features, over all rows that don't contradict it, without a table of pairs.

Rows lie in blocks of one kind, or of seldom kinds, of about BLOCK rows; a query goes to the blocks of its kind and of rows without one, and, if
it has no kind, to all. In a block, queries of equal kind, material and alloys have the same rows that fit; shared words and dimensions are
counted along posting lists, in whole arrays. Of a block only the best rows of each query leave it, so what is shuffled is the rows,
the queries once for each of their blocks, and the best."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a block, about.
BLOCK = 40_000
#: What a score is made of: for each fitting row, whether both sides have a kind, a material, alloys; the Jaccard share of words; the
#: query's dimensions that are met; the query's number of dimensions, the row's. Gives whole numbers; negative is none.
Score = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, np.ndarray], np.ndarray]


def _fits(asked: str, found: str) -> bool:
    """alloy_fits() of joined alloys."""
    b = set(found.split("|"))
    return any(a in b or (not a.endswith("L") and a + "L" in b) for a in asked.split("|"))


def _lists(values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of the arrays and their values one after the other."""
    n = np.fromiter((len(x) for x in values), np.int64, len(values))
    return n, np.concatenate(list(values)) if n.sum() else np.array([], np.float64)


def _block(score: Score, least: int, n: int, near: tuple[float, float], apart: bool):
    """The n best rows (score of `least` or more) of a block's queries: score, then preferred, then the least id."""

    def f(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({k: pd.Series([], dtype=d) for k, d in (("qid", object), ("id", object), ("preferred", bool), ("points", "int32"))})
        c = c.sort_values(["preferred", "id"], ascending=[False, True], kind="stable", ignore_index=True)
        ids, kinds, mats, grades = (c[x].to_numpy(object) for x in ("id", "kind", "material", "grades"))
        codes, names = pd.factorize(grades)
        (nt, words), (nd, dims) = _lists(c["tokens"]), _lists(c["dims"])
        word, vocabulary = pd.factorize(words)
        order = np.argsort(word, kind="stable")
        word, word_of = word[order], np.repeat(np.arange(len(c)), nt)[order]
        order = np.argsort(dims, kind="stable")
        dims, dim_of = dims[order], np.repeat(np.arange(len(c)), nd)[order]
        at = {w: i for i, w in enumerate(vocabulary.tolist())}
        own: dict = {}
        if apart:
            for i, x in enumerate(ids):
                own.setdefault(x, []).append(i)
        found: list[tuple] = []
        for (kind, mat, grade), rows in q.groupby(["kind", "material", "grades"], sort=False):
            fit = np.ones(len(c), bool)
            if kind:
                fit &= (kinds == kind) | (kinds == "")
            if mat:
                fit &= (mats == mat) | (mats == "")
            if grade:
                fit &= np.array([x == "" or _fits(grade, x) for x in names])[codes]
            sub = np.flatnonzero(fit)
            if not len(sub):
                continue
            both = lambda asked, x: (x[sub] != "") if asked else np.zeros(len(sub), bool)
            bk, bm, ba = both(kind, kinds), both(mat, mats), both(grade, grades)
            place = np.full(len(c), -1)
            place[sub] = np.arange(len(sub))
            here = place[word_of] >= 0
            listed, starts = place[word_of[here]], np.searchsorted(word[here], np.arange(len(vocabulary) + 1))
            here = place[dim_of] >= 0
            values, value_of = dims[here], place[dim_of[here]]
            sub_nt, sub_nd = nt[sub], nd[sub]
            for qid, tokens, asked in zip(rows["qid"], rows["tokens"], rows["dims"], strict=True):
                shared, met = np.zeros(len(sub), np.int32), np.zeros(len(sub), np.int32)
                for t in tokens.tolist():
                    if (i := at.get(t)) is not None:
                        shared[listed[starts[i] : starts[i + 1]]] += 1
                for a in asked.tolist():
                    most = max(near[0], abs(a) * near[1])
                    lo, hi = np.searchsorted(values, [a - most - 1e-6, a + most + 1e-6])
                    met[np.unique(value_of[lo:hi][np.abs(a - values[lo:hi]) <= most])] += 1
                either = len(tokens) + sub_nt - shared
                points = score(bk, bm, ba, shared / np.maximum(either, 1), met, len(asked), sub_nd)
                for i in own.get(qid, ()):
                    if place[i] >= 0:
                        points[place[i]] = -1
                good = np.flatnonzero(points >= least)
                if len(good) > n:
                    good = good[points[good] >= np.partition(points[good], -n)[-n]]
                    good = good[np.argsort(-points[good], kind="stable")][:n]
                found += zip([qid] * len(good), sub[good].tolist(), points[good].tolist(), strict=True)
        got = pd.DataFrame(found, columns=["qid", "i", "points"])
        i = got["i"].to_numpy(np.int64)
        return pd.DataFrame({"qid": got["qid"], "id": ids[i], "preferred": c["preferred"].to_numpy()[i], "points": got["points"].astype("int32")})

    return f


def best(queries: DataFrame, candidates: DataFrame, score: Score, least: int, n: int, near: tuple[float, float], apart: bool = False) -> DataFrame:
    """qid, id, preferred, points: the n best candidates of each query with so many points; ties: preferred, then the least id. near: how far
    off a dimension may be, at least and as a share of the query's; apart: a query isn't its own candidate. queries: qid, kind, material,
    alloys, tokens, dims; candidates: id, preferred and the same."""
    counts = candidates.groupBy("kind").count()
    own = {r["kind"]: -(-r["count"] // BLOCK) for r in counts.filter((F.col("count") >= BLOCK // 2) | (F.col("kind") == "")).collect()}
    rest = counts.filter(F.col("count") < BLOCK // 2).agg(F.sum("count")).first()[0] or 0
    seldom = max(1, -(-rest // BLOCK))
    own.setdefault("", 1)
    parts = F.try_element_at(F.create_map(*(F.lit(x) for kv in own.items() for x in kv)), F.col("kind"))
    other = F.concat(F.lit("r:"), F.pmod(F.xxhash64("kind"), F.lit(seldom)).cast("string"))
    name = lambda i: F.concat(F.lit("k:"), i.cast("string"), F.lit(":"), F.col("kind"))
    of_row = F.when(parts.isNotNull(), name(F.pmod(F.xxhash64("id"), parts))).otherwise(other)
    blank = [f"k:{i}:" for i in range(own[""])]
    every = [f"k:{i}:{k}" for k, m in own.items() for i in range(m)] + [f"r:{i}" for i in range(seldom)]
    of_kind = F.when(parts.isNotNull(), F.transform(F.sequence(F.lit(0), parts - 1), name)).otherwise(F.array(other))
    of_query = F.when(F.col("kind") == "", F.array(*map(F.lit, every))).otherwise(F.concat(of_kind, F.array(*map(F.lit, blank))))
    features = ["kind", "material", F.array_join("alloys", "|").alias("grades"), F.transform("tokens", lambda t: F.xxhash64(t)).alias("tokens"), "dims"]
    q = queries.filter("qid is not null").select("qid", *features, F.explode(of_query).alias("block"))
    c = candidates.filter("id is not null").select("id", "preferred", *features, of_row.alias("block"))
    kinds = dict(queries.dtypes)["qid"], dict(candidates.dtypes)["id"]
    return q.groupBy("block").cogroup(c.groupBy("block")).applyInPandas(_block(score, least, n, near, apart), f"qid {kinds[0]}, id {kinds[1]}, preferred boolean, points int")


def ranked(found: DataFrame, points: str, n: int, *ties: Column) -> DataFrame:
    """The n best rows of each qid, with rank_no."""
    top = Window.partitionBy("qid").orderBy(F.col(points).desc(), *ties, F.col("id"))
    return found.withColumn("rank_no", F.row_number().over(top)).filter(F.col("rank_no") <= n)
