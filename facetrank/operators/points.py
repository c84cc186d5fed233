"""Selections of points by place: in a box, within a distance, the nearest within a distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetrank.functions.measures import planar


def in_box(rows: DataFrame, column: str, low: tuple[float, float], high: tuple[float, float]) -> DataFrame:
    """Rows whose point lies in the box, its edges included."""
    x, y = F.col(f"{column}.x"), F.col(f"{column}.y")
    return rows.where(x.between(low[0], high[0]) & y.between(low[1], high[1]))


def within(rows: DataFrame, column: str, centre: tuple[float, float], distance: float) -> DataFrame:
    """Rows within a distance, with it as column `distance`. The box around comes first, as ranges for the files."""
    here = F.struct(F.lit(float(centre[0])).alias("x"), F.lit(float(centre[1])).alias("y"))
    low, high = (centre[0] - distance, centre[1] - distance), (centre[0] + distance, centre[1] + distance)
    near = in_box(rows, column, low, high).withColumn("distance", planar(F.col(column), here))
    return near.where(F.col("distance") <= distance)


def nearest(rows: DataFrame, column: str, centre: tuple[float, float], distance: float, count: int) -> DataFrame:
    """The `count` nearest rows within a distance; ties by id."""
    return within(rows, column, centre, distance).orderBy("distance", "id").limit(count)
