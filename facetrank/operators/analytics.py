"""Comparison of rankings and frequencies of keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def aligned(a: DataFrame, b: DataFrame, column: str = "score") -> DataFrame:
    """(id, a, b): two rankings on the union of their ids, 0 where an id is absent."""
    return (
        a.select("id", F.col(column).alias("a"))
        .join(b.select("id", F.col(column).alias("b")), "id", "full")
        .select("id", F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b"))
    )


def correlations(a: DataFrame, b: DataFrame, column: str = "score") -> DataFrame:
    """One row: pearson, spearman (mean ranks for ties) and kendall (tau-b) of two rankings of a few hundred results."""
    both = aligned(a, b, column)
    everything = Window.partitionBy()

    def ranked(c: str):
        ties = F.count("*").over(Window.partitionBy(c))
        return F.rank().over(everything.orderBy(c)) + (ties - 1) / 2

    ranks = both.withColumns({"ra": ranked("a"), "rb": ranked("b")})
    pairs = both.alias("x").join(both.alias("y"), F.col("x.id") < F.col("y.id"))
    sign = lambda c: F.signum(F.col(f"x.{c}") - F.col(f"y.{c}"))
    tau = pairs.agg(
        (F.sum(sign("a") * sign("b")) / F.sqrt(F.sum(F.abs(sign("a"))) * F.sum(F.abs(sign("b"))))).alias("kendall")
    ).scalar()
    return ranks.agg(F.corr("a", "b").alias("pearson"), F.corr("ra", "rb").alias("spearman")).withColumn("kendall", tau)


def keyword_frequency(rows: DataFrame, keywords: str = "keywords", share: bool = False) -> DataFrame:
    """(keyword, n), or (keyword, share) of all keywords."""
    counted = rows.select(F.explode(keywords).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"))
    if not share:
        return counted
    return counted.select("keyword", (F.col("n") / counted.agg(F.sum("n")).scalar()).alias("share"))


def frequent(counted: DataFrame, least: float | None = None) -> DataFrame:
    """Keywords with at least `least` occurrences, by default more than the median."""
    if least is not None:
        return counted.where(F.col("n") >= least)
    return counted.where(F.col("n") > counted.agg(F.median("n")).scalar())


def bounding_box(points: DataFrame, column: str = "point") -> DataFrame:
    x, y = F.col(f"{column}.x"), F.col(f"{column}.y")
    return points.agg(F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"))


def histogram(rows: DataFrame, column: str, low: float, high: float, buckets: int) -> DataFrame:
    """(bucket, n): 1 to `buckets` within [low, high), 0 below and buckets + 1 beyond."""
    bucket = F.expr(f"width_bucket(cast(`{column}` as double), {float(low)}, {float(high)}, {int(buckets)})")
    return rows.where(F.col(column).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def flattened(results: DataFrame) -> DataFrame:
    """One row a result and attribute: combo, rank, id, score, name, value, attribute_score."""
    return results.select("combo", "rank", "id", "score", F.explode("attributes").alias("a")).select(
        "combo", "rank", "id", "score", "a.name", "a.value", F.col("a.score").alias("attribute_score")
    )
