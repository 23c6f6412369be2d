"""Naming an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def apply_where(value: Column, test: Callable[[Column], Column],
                rule: Callable[[Column], Column]) -> Column:
    """``rule(value)`` where ``test(value)`` holds, else the value itself."""
    return let(value, lambda v: F.when(test(v), rule(v)).otherwise(v))
