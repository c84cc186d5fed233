"""Aggregates that keep a bounded number of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql.internal import InternalFunction


def smallest(value: Column, n: int) -> Column:
    """Aggregate: array of the `n` least values, rising; nulls don't count. Each task keeps a heap of n, and heaps merge."""
    return InternalFunction.collect_top_k(value, n, True)
