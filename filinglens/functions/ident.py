"""Codes, dates, report classes and periods as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filinglens import lexicon as L
from filinglens.functions.text import squash


def _digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[^0-9]", "")


def _zero_fill(c: Column, width: int) -> Column:
    return F.when((c == "") | (F.length(c) >= width), c).otherwise(F.lpad(c, width, "0"))


def stock_code(c: Column) -> Column:
    return _zero_fill(_digits(c), 6)


def corp_code(c: Column) -> Column:
    return F.lpad(c.cast("string"), 8, "0")


def compact_date(c: Column) -> Column:
    """Eight digits, or null when the value holds another number of digits."""
    d = _digits(c)
    return F.when(F.length(d) == 8, d)


def to_day(c: Column) -> Column:
    return F.to_date(compact_date(c), "yyyyMMdd")


def dashed_to_compact(c: Column) -> Column:
    return F.date_format(F.to_date(c, "yyyy-MM-dd"), "yyyyMMdd")


def report_type(name: Column, classes=None) -> Column:
    """First class, in order, whose name occurs in the report name."""
    classes = L.REPORT_TYPES if classes is None else classes
    out = None
    for term, kind in classes.items():
        out = F.when(name.contains(term), F.lit(kind)) if out is None else out.when(name.contains(term), F.lit(kind))
    return out


def lookup(c: Column, table: dict) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def form_code(kind: Column) -> Column:
    return lookup(kind, L.FORM_CODES)


def statement_report_code(kind: Column) -> Column:
    return lookup(kind, L.STATEMENT_REPORT_CODES)


def report_period(name: Column) -> Column:
    hit = F.regexp_extract(name, r"\((\d{4}\.\d{2})\)", 1)
    return F.when(hit != "", hit)


def viewer_url(rcept_no: Column) -> Column:
    return F.concat(F.lit(L.VIEWER_URL), rcept_no)


def period_type(kind: Column) -> Column:
    return lookup(kind, L.PERIOD_TYPES)


def period_key(year: Column, kind: Column) -> Column:
    return F.concat_ws("_", year.cast("string"), period_type(kind))


def period_order(key: Column) -> Column:
    """``year * 10 + priority``; null for a malformed key."""
    parts = F.split(key, "_", 2)
    year = F.try_element_at(parts, F.lit(1)).try_cast("int")
    return year * 10 + lookup(F.try_element_at(parts, F.lit(2)), L.PERIOD_PRIORITY)


def first_filled(*columns: Column) -> Column:
    """First value that is neither null nor blank."""
    return F.coalesce(*[F.when(squash(c.cast("string")) != "", c.cast("string")) for c in columns])


def _last_year(c: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(20\d{2})[.\-/년]"), F.lit(1)), F.lit(-1)).try_cast("int")


def _first_year(c: Column) -> Column:
    hit = F.regexp_extract(F.coalesce(c, F.lit("")), r"(20\d{2})", 1)
    return F.when(hit != "", hit.cast("int"))


def business_year(kind: Column, name: Column, filename: Column, filed: Column) -> Column:
    """Settlement year in the name, then the file name, else derived from a year seen."""
    shift = F.when(kind == "annual", 1).otherwise(0)
    loose = F.coalesce(_first_year(filed), _first_year(F.concat_ws(" ", name, filename)))
    return F.coalesce(_last_year(name), _last_year(filename), loose - shift)


def statement_report_kind(kind: Column, name: Column, filename: Column) -> Column:
    """annual / semiannual / quarterly_1 / quarterly_3; null when undecidable."""
    text = F.concat_ws(" ", name, filename)
    first = text.contains("1분기") | text.contains(".03") | text.contains("-03")
    third = text.contains("3분기") | text.contains(".09") | text.contains("-09")
    quarter = F.when(first, F.lit("quarterly_1")).when(third, F.lit("quarterly_3"))
    return F.when(kind.isin("annual", "semiannual"), kind).when(kind == "quarterly", quarter)
