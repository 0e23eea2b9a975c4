"""Grade, recency and account-state rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from .fixed_values import REGULAR_MAX, SPROUT_MAX, VIP_MAX


@dataclass(frozen=True)
class GradeLimits:
    """Monthly upper limits, inclusive.  Must ascend."""

    sprout_max: int = SPROUT_MAX
    regular_max: int = REGULAR_MAX
    vip_max: int = VIP_MAX

    def __post_init__(self):
        if not 0 < self.sprout_max < self.regular_max < self.vip_max:
            raise ValueError("grade limits must be positive and ascend")


def grade(total_orders: Column, monthly_amount: Column, limits: GradeLimits = GradeLimits(),
          manual: Column | None = None) -> Column:
    computed = F.when(total_orders == 0, "new") \
        .when(monthly_amount <= limits.sprout_max, "sprout") \
        .when(monthly_amount <= limits.regular_max, "regular") \
        .when(monthly_amount <= limits.vip_max, "vip") \
        .otherwise("vvip")
    return computed if manual is None else F.coalesce(F.nullif(manual, F.lit("")), computed)


def recency_risk(total_orders: Column, days: Column) -> Column:
    return F.when(total_orders == 0, "none").when(days <= 30, "safe") \
        .when(days <= 90, "mid").otherwise("high")


def account_state(is_active: Column, is_dormant: Column) -> Column:
    return F.when(~is_active, "inactive").when(is_dormant, "dormant").otherwise("normal")
