"""Imports every query module, which fills the registry."""

from . import catalog, changes, coupons, customers, expressions, filters, joins, quality, reports, sources, streams, history  # noqa: F401
from .registry import QUERIES  # noqa: F401
