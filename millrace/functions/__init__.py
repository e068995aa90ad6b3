"""Scalar and aggregate functions of the dialect, as Column expressions and as SQL functions."""

from .aggregates import AGGREGATES
from .registry import Registry, register_sql
from .scalar import SCALARS

__all__ = ["AGGREGATES", "SCALARS", "Registry", "register_sql"]
