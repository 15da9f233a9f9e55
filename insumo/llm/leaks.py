"""Problem 8: passages of evaluation texts in a corpus, whole or in part."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of an item's words that a document must hold, in order and in one place.
SHARE = 0.4
#: Window sizes, in words; an item takes the largest that its smallest passage holds.
WINDOWS = (8, 4, 2, 1)
#: Embeddings of each window, and positions sampled of each (per word of the window).
ROUNDS, SAMPLED = 8, 1.0
#: Words of items indexed, and sent to the executors, at a time; more items go in blocks.
BLOCK_WORDS = 1_000_000
#: Characters of documents looked at together by a worker.
BATCH_CHARS = 4_000_000
# Fixed values of the local alignment: a word replaced, left out or put in.
PENALTY = 0.5

_MARKUP = re.compile(r"<[^<>]{0,200}>|&#?\w{1,8};")
_MARKS = re.compile("[̀-ͯ­​-‍⁠﻿]+")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Words without case, accents, punctuation, markup and spacing."""
    return _WORD.findall(_MARKS.sub("", unicodedata.normalize("NFKD", _MARKUP.sub(" ", text or "").lower())))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of integers."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def keys(windows: np.ndarray, bits: np.ndarray, sample: np.ndarray, coefficients: np.ndarray, pad: int) -> np.ndarray:
    """A key of each window (rows of symbols): its random-walk embedding, read at the sampled positions.

    The walk writes the symbol that it stands on and steps on or stays by a random bit of step and symbol, three times as many
    steps as symbols, so texts at a small edit distance give sequences at a small Hamming distance."""
    n, size = windows.shape
    padded = np.concatenate([windows, np.full((n, 1), pad, windows.dtype)], axis=1).ravel()
    at, row = np.zeros(n, np.int64), np.arange(n, dtype=np.int64) * (size + 1)
    out = np.zeros(n, np.uint64)
    weight = dict(zip(sample.tolist(), coefficients, strict=True))
    for step in range(int(sample.max()) + 1):
        symbol = padded[row + at]
        if step in weight:
            out += _mix(symbol.astype(np.uint64) + np.uint64(1)) * weight[step]
        at = np.minimum(at + bits[step, symbol], size)
    return out


class Masks:
    """Where each symbol stands in an item, as bits, and which symbols it has."""

    def __init__(self, own: np.ndarray, pad: int):
        self.bits: dict[int, int] = {}
        for k, s in enumerate(own.tolist()):
            self.bits[s] = self.bits.get(s, 0) | 1 << k
        self.symbols, self.pad = own, pad

    @cached_property
    def member(self) -> np.ndarray:
        """Made where it is used: an index of many items is sent without it."""
        out = np.zeros(self.pad + 1, bool)
        out[self.symbols] = True
        return out


class Index:
    """Windows of a block of items by their keys; made on the driver, sent to the workers."""

    def __init__(self, items: list[tuple[int, list[str]]], share: float = SHARE, rounds: int = ROUNDS, seed: int = 8):
        self.share, self.items = share, {i: w for i, w in items if w}
        self.ids = {w: k for k, w in enumerate(sorted({x for ws in self.items.values() for x in ws}), 1)}
        self.symbols = {i: np.array([self.ids[x] for x in ws], np.int32) for i, ws in self.items.items()}
        self.pad = len(self.ids) + 1
        self.masks = {i: Masks(s, self.pad) for i, s in self.symbols.items()}
        rng = np.random.default_rng(seed)
        self.tables = []
        for size in WINDOWS:
            own = [i for i, w in self.items.items() if max(s for s in WINDOWS if s <= max(1, np.ceil(share * len(w)))) == size]
            if not own:
                continue
            at = [(i, p) for i in own for p in range(len(self.items[i]) - size + 1)]
            windows = np.stack([self.symbols[i][p : p + size] for i, p in at])
            ids, pos = np.array([i for i, _ in at]), np.array([p for _, p in at])
            for _ in range(rounds if size > 2 else 1):
                bits = rng.integers(0, 2, (3 * size, self.pad + 1), dtype=np.int8)
                sample = np.sort(rng.choice(3 * size, max(1, round(SAMPLED * size)), replace=False)) if size > 2 else np.arange(3 * size)
                coefficients = rng.integers(1, 2**63, len(sample), dtype=np.uint64) | np.uint64(1)
                k = keys(windows, bits, sample, coefficients, self.pad)
                order = np.argsort(k, kind="stable")
                self.tables.append((size, bits, sample, coefficients, k[order], ids[order], pos[order]))

    def candidates(self, symbols: np.ndarray) -> pd.DataFrame:
        """item, at (where its first word would stand) of windows that share a key; few columns, distinct rows."""
        found = []
        known = np.concatenate([[0], np.cumsum(symbols > 0)])
        for size in {t[0] for t in self.tables}:
            if len(symbols) < size:
                continue
            # a window of the passage has its words, but for single ones replaced, in the items' vocabulary
            start = np.flatnonzero(known[size:] - known[:-size] >= max(1, size - size // 4))
            for lo in range(0, len(start), 200_000):
                some = start[lo : lo + 200_000]
                windows = symbols[some[:, None] + np.arange(size)]
                for t in self.tables:
                    if t[0] != size:
                        continue
                    k = keys(windows, *t[1:4], self.pad)
                    left, right = np.searchsorted(t[4], k, "left"), np.searchsorted(t[4], k, "right")
                    hit = np.flatnonzero(right > left)
                    n = (right - left)[hit]
                    flat = np.repeat(left[hit] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    found.append(pd.DataFrame({"item": t[5][flat], "at": np.repeat(some[hit], n) - t[6][flat]}))
        return pd.concat(found).drop_duplicates() if found else pd.DataFrame({"item": [], "at": []}, dtype="int64")

    def held(self, item: int, symbols: np.ndarray, at: int) -> float:
        """Share of the item's words that the text holds in order about this place, by local alignment; 0 if surely under the share."""
        own = self.symbols[item]
        n = len(own)
        lo, hi = max(0, at - n // 2), min(len(symbols), at + n + n // 2)
        region = symbols[lo:hi]
        masks = self.masks[item]
        # the words of the text that are the item's at all bound its share; the others can't be in a common subsequence
        common = region[masks.member[region]]
        if len(common) < self.share * n:
            return 0.0
        # bit-parallel longest common subsequence: no alignment holds more words
        full = v = (1 << n) - 1
        for s in common.tolist():
            u = v & masks.bits[s]
            v = (v + u | v - u) & full
        if n - v.bit_count() < self.share * n:
            return 0.0
        # the score of the best alignment, by rows at once; with less than half the share there are as many slips as matches
        if _best_score(own, region) < self.share * n / 2:
            return 0.0
        return _aligned(own, region) / n


def _best_score(a: np.ndarray, b: np.ndarray) -> float:
    """Score of the best local alignment, as _aligned() has it."""
    ramp = PENALTY * np.arange(len(b) + 1)
    row, best = np.zeros(len(b) + 1), 0.0
    for x in a:
        step = np.zeros(len(b) + 1)
        step[1:] = row[:-1] + np.where(b == x, 1.0, -PENALTY)
        np.maximum(step, row - PENALTY, out=step)
        np.maximum(step, 0.0, out=step)
        # words put in: a running maximum along the row
        row = np.maximum.accumulate(step + ramp) - ramp
        best = max(best, row.max())
    return best


def _aligned(a: np.ndarray, b: np.ndarray) -> int:
    """Words in common of the best local alignment (a match 1; replaced, left out or put in -PENALTY)."""
    best, most = 0.0, 0
    score, common = [0.0] * (len(b) + 1), [0] * (len(b) + 1)
    right = b.tolist()
    for x in a.tolist():
        new, held = [0.0] * (len(right) + 1), [0] * (len(right) + 1)
        for j, y in enumerate(right, 1):
            s, m = (score[j - 1] + 1, common[j - 1] + 1) if x == y else (score[j - 1] - PENALTY, common[j - 1])
            if score[j] - PENALTY > s:
                s, m = score[j] - PENALTY, common[j]
            if new[j - 1] - PENALTY > s:
                s, m = new[j - 1] - PENALTY, held[j - 1]
            if s > 0:
                new[j], held[j] = s, m
                if s > best or (s == best and m > most):
                    best, most = s, m
        score, common = new, held
    return most


def _search(index: Index, docs: list[tuple[int, str]]) -> list[tuple[int, int, float]]:
    """doc_id, item_id, share of the documents that hold at least the index' share of an item."""
    gap = np.zeros(max(WINDOWS), np.int32)
    texts = [np.fromiter((index.ids.get(w, 0) for w in words(t)), np.int32) for _, t in docs]
    starts = np.cumsum([0, *(len(t) + len(gap) for t in texts)])
    found: dict[tuple[int, int], float] = {}
    hits = index.candidates(np.concatenate([x for t in texts for x in (t, gap)])) if texts else pd.DataFrame({"item": [], "at": []})
    # a hit's place may lie before its document's start
    n = hits["item"].map({i: len(w) for i, w in index.items.items()}).to_numpy()
    doc = np.searchsorted(starts, np.maximum(hits["at"].to_numpy(), 0), "right") - 1
    for shift in (0, 1):
        seen: set[tuple[int, int, int]] = set()
        for d, item, at, size in zip(doc + shift, hits["item"].to_numpy(), hits["at"].to_numpy(), n, strict=True):
            if d >= len(texts) or (shift and at + size <= starts[d]):
                continue
            place = (int(d), int(item), int(at) // max(1, int(size) // 4))
            key = (docs[d][0], int(item))
            if place in seen or found.get(key, 0) >= 1:
                continue
            seen.add(place)
            share = index.held(int(item), texts[d], int(at - starts[d]))
            if share >= index.share:
                found[key] = max(found.get(key, 0), share)
    return [(d, i, s) for (d, i), s in found.items()]


def leaks(docs: DataFrame, items: DataFrame, share: float = SHARE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, held: the documents that hold at least `share` of an item's words, in its order and in one place.

    docs: doc_id, text; items: item_id, item_text, a stated query set that is indexed in blocks of a bounded number of words
    (each block is one pass over the documents; an evaluation set of usual size is one block). Windows of every document, at each
    word, are embedded by a random walk (edit to Hamming distance) and looked up by several samples of positions among all
    windows of the items; windows with too few of the items' words are passed over before. Hits are verified: the longest
    common subsequence about the place bounds, and a local alignment of words decides. Null or wordless texts hold and are
    nothing; repeated rows count once. Documents aren't shuffled, only the pairs found are."""
    rows = items.filter("item_text is not null")
    total = rows.agg(F.sum(F.size(F.split("item_text", r"\s+"))).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_words))
    sc = docs.sparkSession.sparkContext

    def block(b: int) -> DataFrame:
        own = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).select("item_id", "item_text")
        index = sc.broadcast(Index(sorted((r.item_id, words(r.item_text)) for r in own.toLocalIterator()), share))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                part, size = [], 0
                for d, t in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                    part.append((d, t))
                    size += len(t or "")
                    if size > BATCH_CHARS:
                        yield pd.DataFrame(_search(index.value, part), columns=["doc_id", "item_id", "held"])
                        part, size = [], 0
                yield pd.DataFrame(_search(index.value, part), columns=["doc_id", "item_id", "held"])

        return docs.select("doc_id", "text").filter("text is not null").mapInPandas(scan, "doc_id long, item_id long, held double")

    found = reduce(DataFrame.unionByName, (block(b) for b in range(blocks)))
    return found.groupBy("doc_id", "item_id").agg(F.max("held").alias("held"))
