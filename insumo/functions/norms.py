"""The catalogue's normal forms of text. They differ on purpose; each is named after where it is used."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from insumo.functions.text import strip_accents

_BLANK = r"[\s\p{Z}]+"
# Legal forms and trade words that a company's key leaves out.
COMPANY_WORDS = "ltda|eireli|epp|me|sa|s/a|comercio|comercial|industria|industrial|materiais|ferragens|ferramentas|distribuidora|distribuicao"
STOP_WORDS = ["de", "da", "do", "das", "dos", "e", "a", "o", "os", "as", "para", "por", "com", "sem", "em", "no", "na", "nos", "nas", "the", "of"]


def squeeze(c: Column) -> Column:
    """White space of any kind collapsed and trimmed; NULL becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), _BLANK, " "))


def ascii_lower(c: Column) -> Column:
    """Accents folded, what is then not ASCII dropped, lower case. Curly quotes and the times sign are kept as plain ones."""
    plain = F.translate(squeeze(c), "“”″’‘′×", "\"\"\"'''x")
    return F.lower(F.regexp_replace(strip_accents(plain), r"[^\x00-\x7f]", ""))


def norm(c: Column) -> Column:
    """Form for matching: decimal comma to point, steel grades joined (316 l), stainless steel named inox."""
    x = F.regexp_replace(ascii_lower(c), r"(?<=\d),(?=\d)", ".")
    x = F.regexp_replace(x, r"\b(304|316|310|321|409|410|420|430|440)\s+l\b", "$1l")
    return squeeze(F.regexp_replace(x, r"\baco\s+(?:inoxidavel|inox)\b", "inox"))


def norm_index(c: Column) -> Column:
    """Form of the search index: also millimetres and inches by their signs, other punctuation dropped."""
    x = F.regexp_replace(ascii_lower(c), r"(?<=\d),(?=\d)", ".")
    x = F.regexp_replace(x, r"\baco\s+(?:inoxidavel|inox)\b", "inox")
    x = F.regexp_replace(F.regexp_replace(x, r"\bmilimetros?\b", "mm"), r"\bpolegadas?|\bpol\b", '"')
    return squeeze(F.regexp_replace(x, r"[^a-z0-9#/+.'\" -]+", " "))


def norm_audit(c: Column) -> Column:
    """Form of the audits: as the index, with metres too, and without apostrophes."""
    x = F.regexp_replace(ascii_lower(c), r"(?<=\d),(?=\d)", ".")
    x = F.regexp_replace(x, r"\baco\s+(?:inoxidavel|inox)\b", "inox")
    x = F.regexp_replace(F.regexp_replace(x, r"\b(?:polegadas?|pol)\b", '"'), r"\bmilimetros?\b", "mm")
    x = F.regexp_replace(x, r"\b(?:metros?|mt)\b", "m")
    return squeeze(F.regexp_replace(x, r"[^a-z0-9#/+.\-\" ]+", " "))


def tokens(c: Column) -> Column:
    """Words of the audit form without stop words, in order."""
    return F.filter(F.split(norm_audit(c), " "), lambda t: (t != "") & ~t.isin(*STOP_WORDS))


def token_set(c: Column) -> Column:
    """Distinct words of at least two letters or figures."""
    return F.filter(F.array_distinct(F.regexp_extract_all(norm(c), F.lit("([a-z0-9]+)"), 1)), lambda t: F.length(t) > 1)


def company_key(c: Column) -> Column:
    """Company name without legal forms and trade words."""
    x = F.regexp_replace(norm(c), rf"\b(?:{COMPANY_WORDS})\b", " ")
    return squeeze(F.regexp_replace(x, r"[^a-z0-9 ]+", " "))


def compact(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def bigrams(key: Column) -> Column:
    """Distinct pairs of neighbouring characters of a key without blanks; a single character is its own."""
    s = compact(key)
    pairs = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2)))
    return F.when(F.length(s) >= 2, F.array_distinct(pairs)).when(F.length(s) == 1, F.array(s)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column, of_empty: float = 1.0) -> Column:
    """Shared part of two arrays' distinct values; of_empty for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(of_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    """Shared values over the larger array's; 0 for empty ones."""
    most = F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(most == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / most)


def clean_title(c: Column) -> Column:
    """Page title without marks of trade and the site's name at its end."""
    x = F.regexp_replace(squeeze(c), "[™®©]", "")
    x = F.regexp_replace(x, r"\s*[|｜]\s*[^|]{2,90}$", "")
    return squeeze(F.regexp_replace(x, r"(?i)\s[-–—]\s(?:Amazon(?:\.com\.br)?|Mercado\s*Livre|Loja\s*Oficial)\s*$", ""))


def host(url: Column) -> Column:
    """Host of an address, lower case, without www.; '' if it has none."""
    return F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), r"^www\.", "")


def safe_label(c: Column, most: int = 40) -> Column:
    """A label fit for a file name."""
    x = F.regexp_replace(squeeze(c), r"[^A-Za-z0-9_-]+", "-")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(x, r"^-+|-+$", ""), 1, most), F.lit("")), F.lit("snapshot"))


def unescape_xml(c: Column) -> Column:
    """The five entities of XML as characters; the ampersand last."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def escape_xml(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c
