"""Numbers, amounts, codes and dates in text, as Column expressions. What can't be read is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from insumo.functions.norms import squeeze


def index_number(c: Column) -> Column:
    """Points group where there is also one comma (1.234,56); else a comma is decimal."""
    one_comma = F.length(c) - F.length(F.translate(c, ",", "")) == 1
    grouped = F.translate(F.translate(c, ".", ""), ",", ".")
    return F.when(one_comma & c.contains("."), grouped).otherwise(F.translate(c, ",", ".")).try_cast("double")


def loose_number(c: Column) -> Column:
    """The last separator is decimal, whatever else stands in the text; 0 if nothing is left."""
    x = F.regexp_replace(c, r"[^0-9,.\-]", "")
    comma, point = F.length(x) - F.locate(",", F.reverse(x)), F.length(x) - F.locate(".", F.reverse(x))
    has_comma = x.contains(",")
    decimal_comma = has_comma & (~x.contains(".") | (comma > point))
    y = F.when(decimal_comma, F.translate(F.translate(x, ".", ""), ",", ".")).otherwise(F.translate(x, ",", ""))
    return F.coalesce(y.try_cast("double"), F.lit(0.0))


def percent(c: Column) -> Column:
    """A share below one is meant as percent of it (0.1 is 10)."""
    return F.when((c > 0) & (c < 1), c * 100).otherwise(c)


def fraction_number(c: Column) -> Column:
    """Mixed fraction (1 1/2, 1.1/2), fraction or decimal. A fraction by zero is NULL."""
    x = F.translate(squeeze(c), ",", ".")
    g = lambda i: F.regexp_extract(x, r"^(?:(\d+)[. ])?(\d+)/(\d+)$", i).try_cast("double")
    return F.when(x.contains("/"), F.coalesce(g(1), F.lit(0.0)) + F.try_divide(g(2), g(3))).otherwise(x.try_cast("double"))


def to_mm(figure: Column, unit: Column) -> Column:
    u = F.lower(squeeze(unit))
    n = fraction_number(figure)
    return F.when(u.isin('"', "pol", "inch"), n * 25.4).when(u == "cm", n * 10).when(u.isin("m", "mt"), n * 1000).when(u.isin("mm", ""), n)


def amounts(text: Column) -> Column:
    """All money amounts of a text, distinct and sorted, over 0 and under a thousand million."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![\d.])(?:[Rr]\$\s*)?(\d{1,3}(?:\.\d{3})+,\d{2}|\d+[.,]\d{2})(?!\d)"), 1)
    values = F.transform(raw, lambda r: F.round(F.when(r.contains(","), F.translate(F.translate(r, ".", ""), ",", ".")).otherwise(r).try_cast("double"), 4))
    return F.array_sort(F.array_distinct(F.filter(values, lambda v: (v > 0) & (v < 1e9))))


def last_amount(line: Column) -> Column:
    """struct(amount, rest): the last amount of an invoice line and the text before it; both NULL if there is none."""
    pattern = r"^(.*?)(?:[Rr]\$\s*)?((?:\d{1,3}(?:\.\d{3})+|\d+)[.,]\d{2,4})\s*$"
    found = F.regexp_extract(line, pattern, 2)
    value = F.when(found.contains(","), F.translate(F.translate(found, ".", ""), ",", ".")).otherwise(found).try_cast("double")
    return F.when(found != "", F.struct(value.alias("amount"), squeeze(F.regexp_extract(line, pattern, 1)).alias("rest")))


def gtin_valid(c: Column) -> Column:
    """Whether the figures of a text are 8, 12, 13 or 14 and their check digit is right; NULL counts as not."""
    d = F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")
    padded = F.lpad(d, 14, "0")
    total = F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.lit(0), lambda a, i: a + F.substring(padded, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 3).otherwise(1))
    return F.length(d).isin(8, 12, 13, 14) & (total % 10 == 0)


def fuzzy_equal(a: Column, b: Column) -> Column:
    """Words without figures, of at least four letters, one slip apart (two if both have nine), or with two neighbours swapped."""
    short = F.least(F.length(a), F.length(b))
    most = F.when(short >= 9, 2).otherwise(1)
    i = F.array_position(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), True).cast("int")
    swapped = (F.length(a) == F.length(b)) & (i > 0) & (F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b)
    words = ~a.rlike(r"\d") & ~b.rlike(r"\d") & (short >= 4)
    return (a == b) | (words & ((F.levenshtein(a, b) <= most) | swapped))


def within(a: Column, b: Column, absolute: float, relative: float) -> Column:
    """Whether b is a within the larger of two tolerances."""
    return F.abs(a - b) <= F.greatest(F.lit(absolute), F.abs(a) * relative)


def iso_date(c: Column) -> Column:
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def sheet_date(c: Column) -> Column:
    """Date of a spreadsheet cell: a serial number over 30000 and under 80000, or day/month/year from 1900 to 2100; ISO is refused."""
    serial = c.try_cast("double")
    parts = F.try_to_date(F.regexp_extract(F.trim(c), r"^(\d{1,2}/\d{1,2}/\d{4})$", 1), "d/M/yyyy")
    by_serial = F.when((serial > 30000) & (serial < 80000), F.date_add(F.lit("1899-12-30").cast("date"), F.round(serial).cast("int")))
    return F.coalesce(by_serial, F.when(F.year(parts).between(1900, 2100), parts))


def typed_date(c: Column) -> Column:
    """Date as people type it: ISO, d/m/y or d.m.y with two or four figures of the year (two mean 2000 on), or a serial number."""
    m = lambda i: F.regexp_extract(F.trim(c), r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{2}|\d{4})$", i)
    year = F.when(F.length(m(3)) == 2, F.concat(F.lit("20"), m(3))).otherwise(m(3))
    short = F.when(m(1) != "", F.try_to_date(F.concat_ws("/", m(1), m(2), year), "d/M/yyyy"))
    return F.coalesce(iso_date(F.trim(c)), short, sheet_date(c))


def br_date(c: Column) -> Column:
    return F.date_format(c, "dd/MM/yyyy")


def br_money(c: Column) -> Column:
    """1234.5 as R$ 1.234,50."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(c, 2), ",.", ".,"))


def rounded(c: Column, digits: int) -> Column:
    """Half up on the binary value, with a hair's breadth for sums whose order varies; the same in any engine."""
    return F.floor(c * 10**digits + 0.500001) / 10**digits
