"""Normalized numbers: z (by mean and standard deviation) and unity (by mean and range)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalized(rows: DataFrame, column: str, how: str) -> Column:
    """The column's normalized value; null where all values are equal. The statistics are one scalar subquery."""
    v = F.col(column).cast("double")
    spread = {"z": F.stddev_samp(v), "unity": F.max(v) - F.min(v)}
    if how not in spread:
        raise ValueError(f"unknown normalization {how}")
    stats = rows.agg(F.struct(F.avg(v).alias("mean"), spread[how].alias("by"))).scalar()
    return (v - stats["mean"]) / F.nullif(stats["by"], F.lit(0.0))


def statistics(rows: DataFrame, column: str) -> DataFrame:
    v = F.col(column).cast("double")
    return rows.agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("avg"), F.stddev_samp(v).alias("stdev"), F.count(v).alias("n"))
