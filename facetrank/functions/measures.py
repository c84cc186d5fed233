"""Distances and similarities as Spark columns. A null operand gives a null distance, and a null distance similarity 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default decay factor, default length of character n-grams, most results with several attributes,
#: and candidates of an attribute per result.
DECAY, QGRAM, MOST_RESULTS, INFLATION = 0.05, 3, 50, 1000

Metric = Callable[[Column, Column], Column]


def absolute(a: Column, b: Column) -> Column:
    """Numbers, and dates as epoch seconds."""
    return F.abs(a - b)


def planar(a: Column, b: Column) -> Column:
    """Points, in the units of their coordinates."""
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"])


def haversine(a: Column, b: Column, axis_order: str = "lon_lat") -> Column:
    """Great-circle distance of points, in degrees. axis_order "lat_lon" takes x as the latitude."""
    lon, lat = ("x", "y") if axis_order == "lon_lat" else ("y", "x")
    p, q = F.radians(a[lat]), F.radians(b[lat])
    h = F.pow(F.sin((q - p) / 2), F.lit(2)) + F.cos(p) * F.cos(q) * F.pow(F.sin((F.radians(b[lon]) - F.radians(a[lon])) / 2), F.lit(2))
    return F.degrees(2 * F.asin(F.sqrt(F.least(h, F.lit(1.0)))))


def jaccard(a: Column, b: Column) -> Column:
    """Sets: 1 - |common| / |either|; two empty sets are at distance 0."""
    def of(x: Column, y: Column) -> Column:
        common = F.size(F.array_intersect(x, y))
        either = F.size(F.array_union(x, y))
        return F.when(either > 0, 1 - common / either).otherwise(0.0)

    # Each operand is bound once: it may itself be the cutting of a long text into tokens.
    bound = F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda s: F.when(s["a"].isNotNull() & s["b"].isNotNull(), of(s["a"], s["b"])))
    return F.get(bound, 0)


def _differences(a: Column, b: Column, each: Callable[[Column], Column]) -> Column:
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: each(x - y)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def manhattan(a: Column, b: Column) -> Column:
    """Vectors; different lengths give null, as in the other vector metrics."""
    return _sum(_differences(a, b, F.abs))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(_differences(a, b, lambda d: d * d)))


def chebyshev(a: Column, b: Column) -> Column:
    return F.array_max(_differences(a, b, F.abs))


def vector_haversine(a: Column, b: Column) -> Column:
    """Two-element vectors (longitude, latitude)."""
    point = lambda v: F.struct(F.get(v, 0).alias("x"), F.get(v, 1).alias("y"))
    return haversine(point(a), point(b))


METRICS: dict[str, Metric] = {
    "manhattan": manhattan,
    "euclidean": euclidean,
    "chebyshev": chebyshev,
    "haversine": vector_haversine,
    "jaccard": jaccard,
}


def metric(name: str | None) -> Metric:
    """Metric of vectors by name, whichever its case; Euclidean if there is none or none of that name."""
    return METRICS.get((name or "euclidean").lower(), euclidean)


def or_missing(distance: Column, at: float) -> Column:
    """A distance for vectors of which one is missing."""
    return F.coalesce(distance, F.lit(float(at)))


def similarity(distance: Column, scale: Column, decay: float = DECAY, sets: bool = False) -> Column:
    """exp(-decay * distance / scale). With `sets`, sets without a common element get 0.

    Where there is no scale (no positive distance at all), distance 0 gives 1.
    """
    decayed = F.when(distance == 0, 1.0).otherwise(F.exp(-F.lit(float(decay)) * distance / scale))
    if sets:
        decayed = F.when(F.abs(distance - 1) < 1e-6, 0.0).otherwise(decayed)
    return F.coalesce(decayed, F.lit(0.0))


def vector_mean(vectors: Column, count: Column, size: int) -> Column:
    """Sum of an array of vectors divided by `count`."""
    zero = F.array_repeat(F.lit(0.0), size)
    total = F.aggregate(vectors, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / count)


#: Bounds of set-similarity joins: least size of a partner, least overlap, prefix that must share a token.
def least_partner(size: Column, threshold: float, measure: str = "jaccard") -> Column:
    factor = {"jaccard": threshold, "cosine": threshold**2, "dice": threshold / (2 - threshold)}[measure]
    return F.ceil(size * factor - 1e-9)


def most_partner(size: Column, threshold: float, measure: str = "jaccard") -> Column:
    factor = {"jaccard": threshold, "cosine": threshold**2, "dice": threshold / (2 - threshold)}[measure]
    return F.floor(size / factor + 1e-9)


def least_overlap(a: Column, b: Column, threshold: float, measure: str = "jaccard") -> Column:
    if measure == "cosine":
        bound = F.sqrt(a * b) * threshold
    elif measure == "dice":
        bound = (a + b) * (threshold / 2)
    else:
        bound = (a + b) * (threshold / (1 + threshold))
    return F.ceil(bound - 1e-9)


def prefix_length(size: Column, threshold: float, measure: str = "jaccard") -> Column:
    return size - least_partner(size, threshold, measure) + 1
