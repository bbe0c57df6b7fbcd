"""Amounts, terms and dates, in exact decimals rounded half to even."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MONEY = "decimal(12,2)"


def round_even(c: Column, places: int = 2) -> Column:
    return F.bround(c, places)


def term_days(term: Column, custom: Column) -> Column:
    return (
        F.when(term == "NET_10", 10).when(term == "NET_30", 30).when(term == "DUE_ON_RECEIPT", 0)
        .when(term == "CUSTOM", F.greatest(F.lit(0), F.coalesce(custom, F.lit(0)))).otherwise(0)
    )


def due_date(date: Column, term: Column, days: Column, default_term: str, default_days: int) -> Column:
    """date plus the customer's term, or the company's if there is none."""
    own = F.coalesce(F.col("net_terms") if term is None else term, F.lit(None))
    n = F.when(own.isNull(), term_days(F.lit(default_term), F.lit(default_days))).otherwise(term_days(own, days))
    return F.date_add(date, n)


def tax_rate(exempt: Column, own: Column, default: float) -> Column:
    return F.when(exempt, F.lit(0)).otherwise(F.coalesce(own, F.lit(default))).cast("decimal(5,2)")


def line_total(quantity: Column, price: Column, discount_pct: Column) -> Column:
    keep = F.lit(1).cast("decimal(5,2)") - (discount_pct / 100).cast("decimal(7,4)")
    return round_even((quantity.cast("decimal(10,0)") * price * keep), 2).cast(MONEY)


def margin_pct(cost: Column, price: Column) -> Column:
    value = (price.cast("double") - cost.cast("double")) / cost.cast("double") * 100
    return F.when((cost > 0) & price.isNotNull(), F.round(value, 1))


def stock_value(cost: Column, quantity: Column) -> Column:
    return (cost * F.coalesce(quantity, F.lit(0))).cast("decimal(14,2)")


def sell_price(cost: Column, margin: Column) -> Column:
    """cost / (1 - margin / 100), with a margin of 99 at most."""
    rate = F.lit(1) - F.when(margin >= 100, F.lit(99)).otherwise(margin).cast("decimal(5,2)") / 100
    return round_even(cost.cast("decimal(10,2)") / rate.cast("decimal(7,4)"), 2).cast(MONEY)


def form_price(cost: Column, method: Column, value: Column) -> Column:
    """The part form's formulas: `margin` adds a share of the cost, `markup` divides by it; nothing for values up to 0."""
    v = value.cast("decimal(7,2)")
    up = cost * (F.lit(1) + v / 100).cast("decimal(9,4)")
    return F.when(v <= 0, None).when(method == "margin", round_even(up, 2)).when(method == "markup", round_even(cost / v, 2)).cast(MONEY)


def unit_price(rebuilt: Column, new: Column) -> Column:
    """rebuilt, else new, else 0; a zero counts as missing."""
    zero = F.lit(0).cast("decimal(10,2)")
    return F.coalesce(F.nullif(rebuilt, zero), F.nullif(new, zero), zero)


def overdue(due: Column, status: Column, as_of: Column) -> Column:
    return (due < as_of) & status.isin("DRAFT", "SENT")


def due_soon(due: Column, as_of: Column, days: int = 7) -> Column:
    return due.between(as_of, F.date_add(as_of, days))


def lenient_decimal(c: Column) -> Column:
    return c.try_cast("decimal(10,2)")


def lenient_int(c: Column, default: int = 0) -> Column:
    return F.coalesce(c.try_cast("int"), F.lit(default))
