"""Amounts and ratios as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT_TYPE = "decimal(38,4)"


def parse_amount(c: Column) -> Column:
    """Text amount to decimal: thousands commas, bracketed negatives.

    Blanks, dashes and words such as N/A are no numbers, so the cast gives null.
    One short expression keeps wide statement plans inside JIT-compiled code.
    """
    bare = F.translate(F.trim(c), ",", "")
    return F.regexp_replace(bare, r"^\((.*)\)$", "-$1").try_cast(AMOUNT_TYPE)


def parse_int(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), "[^0-9]", "").try_cast("bigint")


def parse_float(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), "[^0-9.]", "").try_cast("double")


def account_name(c: Column) -> Column:
    """Lower case without blanks and middle dots."""
    return F.translate(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", ""), "ㆍ·", "")


def safe_ratio(numerator: Column, denominator: Column, times: float = 100.0, digits: int = 4) -> Column:
    d = denominator.cast("double")
    return F.round(F.when(d != 0, numerator.cast("double") / d * times), digits)


def growth(current: Column, previous: Column, digits: int = 4) -> Column:
    return safe_ratio(current.cast("double") - previous.cast("double"), F.abs(previous.cast("double")), 100.0, digits)


def per(market_cap: Column, net_income: Column) -> Column:
    return safe_ratio(market_cap, net_income, 1.0)


def roe(net_income: Column, equity: Column) -> Column:
    return safe_ratio(net_income, equity)


def roa(net_income: Column, assets: Column) -> Column:
    return safe_ratio(net_income, assets)


def pbr(market_cap: Column, equity: Column) -> Column:
    return safe_ratio(market_cap, equity, 1.0)


def ev_ebitda(market_cap: Column, debt: Column, cash: Column, ebitda: Column) -> Column:
    return safe_ratio(market_cap.cast("double") + debt.cast("double") - cash.cast("double"), ebitda, 1.0)
