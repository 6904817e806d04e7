"""Bind a computed value once inside a column expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once per row, even when ``fn`` uses it inside lambdas."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))
