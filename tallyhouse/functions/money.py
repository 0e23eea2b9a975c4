"""Price, discount and currency rules.

Money is a whole number of the currency's smallest unit (BIGINT), so sums are
exact and stay in generated code.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, functions as F

from .fixed_values import WON_PER_USD

MONEY = "bigint"


def money(col: Column) -> Column:
    return col.cast(MONEY)


def default_if_falsy(col: Column, default, empty=0) -> Column:
    """Null and the empty value (0, '' or false) both take the default."""
    return F.coalesce(F.nullif(col, F.lit(empty)), F.lit(default))


def coupon_discount(kind: Column, value: Column, total: Column) -> Column:
    """Percent (a decimal) of the total rounded down, uncapped; anything else is
    a fixed amount that cannot exceed the total."""
    percent = F.floor(total * value / F.lit(100)).cast(MONEY)
    return F.when(kind == "percent", percent).otherwise(F.least(money(value), total))


def final_amount(total: Column, discount: Column) -> Column:
    return never_negative(total - discount)


def never_negative(amount: Column) -> Column:
    return F.greatest(F.lit(0).cast(MONEY), amount)


def in_usd(amount: Column, rate: int = WON_PER_USD) -> Column:
    return F.round(amount.cast("decimal(18,0)") / F.lit(rate), 2).cast("decimal(18,2)")


def asks_for_price(price: Column) -> Column:
    return F.coalesce(price, F.lit(0)) == 0


def shown_price(price: Column, discounted: Column) -> Column:
    """Discounted price if set and non-zero, else the price; null means
    'ask for the price'."""
    return F.when(~asks_for_price(price),
                  F.coalesce(F.nullif(discounted, F.lit(0).cast(MONEY)), price))


def badge(is_new: Column, is_best: Column) -> Column:
    return F.when(is_new, "NEW").when(is_best, "BEST").otherwise("ON SALE")


def one_decimal_mean(total: Column, count: Column, top: int = 5) -> Column:
    """Mean of whole-number ratings with one decimal, as text.

    The shop rounds the binary value of the quotient.  That differs from
    decimal half-up only where the quotient is an exact tie k/20 whose nearest
    double lies below it; those ties follow from the rule in the comprehension.
    """
    down = [k for k in range(1, 20 * top, 2) if Fraction(k / 20) < Fraction(k, 20)]
    is_tie = F.pmod(total * 20, count) == 0
    rounds_down = is_tie & (total * 20 / count).cast("bigint").isin(down)
    tenths = F.when(rounds_down, F.floor(total * 10 / count)) \
        .otherwise(F.floor((total * 20 + count) / (count * 2)))
    return F.format_string("%d.%d", (tenths / 10).cast("bigint"), F.pmod(tenths, F.lit(10)).cast("bigint"))
