"""Text normalisation as Column expressions (JVM side, inside whole-stage codegen; no Python workers)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of other scripts that look like a Latin letter.
LOOKALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ѕ": "s", "х": "x", "у": "y", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "ϲ": "c", "ϳ": "j", "υ": "u", "κ": "k", "τ": "t", "χ": "x", "γ": "y", "η": "n", "ω": "w", "ε": "e", "μ": "u",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ⅼ": "l", "Ⅰ": "I", "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M", "Ⅴ": "V", "Ⅹ": "X", "ⅰ": "i", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m", "ⅴ": "v", "ⅹ": "x", "K": "K", "Å": "Å",
}
# Marks of the trade with a plain spelling; kinds of space; kinds of hyphen; characters without width.
SIGNS = {"²": "2", "³": "3", "”": '"', "“": '"', "″": '"', "×": "x", "’": "'", "‘": "'", "Ø": "ø", "º": "o", "ª": "a"}
SPACES = "                 　"
HYPHENS = "‐‑‒–—―−﹘﹣－­"[:-1]
ZERO_WIDTH = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩︀︎️﻿"


def _fold_table() -> dict[str, str]:
    """Accented Latin letters and full-width forms by rule, the rest from the fixed values; '' deletes."""
    table = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(c))
        if len(base) > 1 and base[0].isascii():
            table[chr(c)] = base[0]
    table |= {k: v if v.isascii() else "A" for k, v in LOOKALIKES.items()} | SIGNS
    table |= {c: " " for c in SPACES} | {c: "-" for c in HYPHENS}
    return table | {chr(c): "" for c in range(0x300, 0x370)} | {c: "" for c in ZERO_WIDTH}


FOLD = _fold_table()
_KEPT = {k: v for k, v in FOLD.items() if v}
_FROM = "".join([*_KEPT, *(k for k, v in FOLD.items() if not v)])
_TO = "".join(_KEPT.values())


def plain(c: Column) -> Column:
    """As fold(), with the case kept."""
    return F.translate(c, _FROM, _TO)


def fold(c: Column) -> Column:
    """One plain lower-case form: accents, full-width forms, look-alike letters and odd spaces folded. NULL stays NULL."""
    return F.lower(F.translate(c, _FROM, _TO))


def strip_accents(c: Column) -> Column:
    """Accents of Latin letters removed, case kept."""
    accents = {k: v for k, v in FOLD.items() if v and 0xC0 <= ord(k) < 0x1F00 and unicodedata.name(k, "").startswith("LATIN") and unicodedata.decomposition(k)}
    marks = "".join(chr(c) for c in range(0x300, 0x370))
    return F.translate(c, "".join(accents) + marks, "".join(accents.values()))


def clean(c: Column) -> Column:
    """White space collapsed and trimmed; NULL becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def valid_date(c: Column, first: str = "2010-01-01", last: str = "2026-06-30") -> Column:
    """The date of an ISO text, NULL unless it is a calendar date from first to last."""
    day = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))
    return F.when(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")), day)
