"""Problem 7: text that looks the same but differs in its characters."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from insumo.functions.text import HYPHENS, LOOKALIKES, SPACES, ZERO_WIDTH
from insumo.sources.shared import saved

_WORDS = r"[\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}]+"
# Joined letters and their parts.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij", "Ǆ": "DŽ", "ǅ": "Dž", "ǆ": "dž", "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj", "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj", "㎜": "mm", "㎝": "cm", "㎏": "kg"}
#: A small mu is a sign of the trade (micro), not a u.
_TO_LATIN = {k: v for k, v in LOOKALIKES.items() if k != "μ"}
_TO_CYRILLIC = {v: k for k, v in reversed([(k, v) for k, v in LOOKALIKES.items() if "CYRILLIC" in unicodedata.name(k)])}
#: Letters of other scripts, and those of Latin script that look like another one.
_FOREIGN = f"[Ͱ-ϿЀ-ԯ{''.join(_TO_LATIN)}]"
_TO_GREEK = {v: k for k, v in reversed([(k, v) for k, v in LOOKALIKES.items() if "GREEK" in unicodedata.name(k)])}


def _translate(c: Column, table: dict[str, str]) -> Column:
    kept = {k: v for k, v in table.items() if v}
    return F.translate(c, "".join([*kept, *(k for k, v in table.items() if not v)]), "".join(kept.values()))


@F.pandas_udf(StringType())
def _compose(texts: pd.Series) -> pd.Series:
    """Letters and combining accents as one letter. Plain ASCII, nearly all, passes through."""
    return pd.Series([x if x is None or x.isascii() else unicodedata.normalize("NFC", x) for x in texts], dtype="object")


def settle(c: Column) -> Column:
    """Characters without script questions: full-width forms, joined letters, kinds of space and hyphen, characters without
    width, combining accents. Case, accents, superscripts and inch marks stay. NULL stays NULL."""
    table = {chr(x): chr(x - 0xFEE0) for x in range(0xFF01, 0xFF5F)} | {x: " " for x in SPACES} | {x: "-" for x in HYPHENS if x != "—"} | {x: "" for x in ZERO_WIDTH}
    # letters and figures of mathematical alphabets, by rule
    table |= {chr(x): y for x in range(0x1D400, 0x1D800) if len(y := unicodedata.normalize("NFKC", chr(x))) == 1 and y.isascii()}
    table |= {"K": "K", "Å": "Å", "Ω": "Ω", "µ": "μ"}
    out = _translate(c, table)
    for joined, parts in LIGATURES.items():
        out = F.replace(out, F.lit(joined), F.lit(parts))
    return F.trim(_compose(out))


@F.pandas_udf(StringType())
def _looks(words: pd.Series) -> pd.Series:
    """One form for all words that look the same: every letter by its Latin look-alike, under its accents; where letters without one
    leave several scripts, the look-alikes of Cyrillic, else of Greek, if these give one script."""

    # everything stands in here, as workers may not have this module
    def one_script(word: str) -> bool:
        return len({unicodedata.name(c, "?").split()[0] for c in word if c.isalpha()}) <= 1

    def form(word: str) -> str:
        bare = "".join(_TO_LATIN.get(c, c) for c in unicodedata.normalize("NFD", word))
        for table in ({}, _TO_CYRILLIC, _TO_GREEK):
            x = unicodedata.normalize("NFC", "".join(table.get(c, c) for c in bare))
            if one_script(x):
                return x
        return unicodedata.normalize("NFC", bare)

    return pd.Series([form(x) for x in words], dtype="object")


def canonical(values: DataFrame) -> DataFrame:
    """values (field, key, raw) with `canon`, one form in which values that look the same are equal.

    After settle(), words with letters of other scripts (or look-alikes within the Latin one) are brought to the form that all words
    looking like them share: of one script where there is one, Latin first. A word takes this form if the corpus attests it: some
    other word of any value, in any script, looks the same. Words that nothing else looks like stay. Words are matched by joins;
    only values with foreign letters are taken apart. Null values are left out; empty ones stay empty. Repeated rows give repeated rows."""
    settled = saved(values.filter("raw is not null").select("field", "key", "raw", settle(F.col("raw")).alias("text")), "settled")
    mixed = settled.filter(F.col("text").rlike(_FOREIGN))
    plain = settled.filter(~F.col("text").rlike(_FOREIGN))
    words = mixed.select("field", "key", "raw", F.posexplode(F.regexp_extract_all("text", F.lit(f"({_WORDS})"), 1)).alias("pos", "word"))
    of_mixed = words.filter(F.col("word").rlike(r"[\p{L}\p{N}]")).select("word").distinct().withColumn("form", _looks(F.col("word")))
    # words of plain values are their own form
    of_plain = plain.select(F.explode(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}\p{M}]+)"), 1)).alias("word")).distinct().select("word", F.col("word").alias("form"))
    wanted = of_mixed.filter(F.col("word").rlike(_FOREIGN))
    attested = of_mixed.union(of_plain).distinct().join(wanted.select("form").distinct(), "form", "left_semi").groupBy("form").agg(F.count("*").alias("n")).filter("n > 1").select("form")
    chosen = wanted.join(attested, "form").select("word", F.col("form").alias("repair"))
    repaired = words.join(chosen, "word", "left").withColumn("word", F.coalesce("repair", "word"))
    joined = repaired.groupBy("field", "key", "raw").agg(F.array_sort(F.collect_set(F.struct("pos", "word"))).alias("ws"))
    canon = joined.select("field", "key", "raw", F.array_join(F.transform("ws", lambda w: w["word"]), "").alias("canon"))
    return plain.select("field", "key", "raw", F.col("text").alias("canon")).unionByName(canon)


def lookalike_pairs(values: DataFrame) -> DataFrame:
    """field, key_a, key_b (key_a < key_b) of rows whose values look the same but aren't equal character by character.

    Pairs are formed between the different spellings of a form and only then spread to their rows, so rows with equal text,
    however many, are never paired with one another. Empty values pair with nothing."""
    rows = saved(canonical(values).filter("canon <> ''").select("field", "key", "raw", "canon").distinct(), "canonical")
    spelled = rows.groupBy("field", "canon").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).filter("lo <> hi").select("field", "canon")
    rows = rows.join(spelled, ["field", "canon"], "left_semi")
    forms = rows.select("field", "canon", "raw").distinct()
    pairs = forms.alias("a").join(forms.alias("b"), (F.col("a.field") == F.col("b.field")) & (F.col("a.canon") == F.col("b.canon")) & (F.col("a.raw") != F.col("b.raw"))).select("a.field", F.col("a.raw").alias("raw_a"), F.col("b.raw").alias("raw_b"))
    member = rows.select("field", "key", "raw")
    left = pairs.join(member.select("field", F.col("raw").alias("raw_a"), F.col("key").alias("key_a")), ["field", "raw_a"])
    both = left.join(member.select("field", F.col("raw").alias("raw_b"), F.col("key").alias("key_b")), ["field", "raw_b"])
    return both.filter("key_a < key_b").select("field", "key_a", "key_b").distinct()
