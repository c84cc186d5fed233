"""Metric search over several vector attributes, by distances to pivots.

Attributes are vectors (numbers and dates have one element). From a bounded sample the driver estimates each
attribute's scale, shares the pivots out among attributes and picks them far apart. Rows get their distances to the
pivots as columns; the triangle inequality then bounds what a row can be away from a query, as range predicates that
reach the files. The k nearest rows by weighted distance are scored by similarity and ranked by it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetrank.functions import measures
from facetrank.functions.runtime import cut
from facetrank.functions.topk import smallest
from facetrank.operators.ranking import automatic_weight

#: Pivots in all, rows of the sample.
PIVOTS, SAMPLE = 8, 500


@dataclass(frozen=True)
class Metric:
    """An indexed attribute: a column of vectors and a metric; `scale` and `pivots` are found by `fit`."""

    name: str
    metric: str = "euclidean"
    scale: float = 1.0
    pivots: tuple[tuple[float, ...], ...] = ()
    columns: tuple[str, ...] = field(default=())


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances between the rows of two small matrices."""
    name = metric.lower()
    if name == "haversine":
        lon1, lat1, lon2, lat2 = (np.radians(v) for v in (a[:, None, 0], a[:, None, 1], b[None, :, 0], b[None, :, 1]))
        h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
        return np.degrees(2 * np.arcsin(np.sqrt(np.minimum(h, 1))))
    d = np.abs(a[:, None, :] - b[None, :, :])
    if name == "manhattan":
        return d.sum(axis=2)
    return d.max(axis=2) if name == "chebyshev" else np.sqrt((d**2).sum(axis=2))


def sample_of(rows: DataFrame, column: str, size: int = SAMPLE, seed: int = 0) -> np.ndarray:
    """The vectors that come first by a hash of the id: a bounded sample that any run repeats."""
    some = rows.where(F.col(column).isNotNull()).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(size)
    values = [r[0] for r in some.select(column).collect()]
    # Vectors of another length than most have no distance to them.
    usual = Counter(map(len, values)).most_common(1)[0][0] if values else 1
    return np.array([v for v in values if len(v) == usual], dtype=float).reshape(-1, usual)


def typical_gap(sample: np.ndarray, metric: str) -> float:
    """Mean distance of a sampled vector from the nearest other one: the default scale of an attribute."""
    if len(sample) < 2:
        return 1.0
    d = distances(sample, sample, metric)
    np.fill_diagonal(d, np.inf)
    gap = float(d.min(axis=1).mean())
    return gap if gap > 0 else 1.0


def spread_out(sample: np.ndarray, count: int, metric: str, seed: int = 0) -> np.ndarray:
    """`count` pivots of the sample: two that lie far apart, then each the one whose distances to those before are most
    like the distance of the first two."""
    if not len(sample) or count < 1:
        return sample[:0]
    start = np.random.default_rng(seed).integers(len(sample))
    d = distances(sample, sample, metric)
    first = int(d[start].argmax())
    chosen = [first]
    if count > 1 and len(sample) > 1:
        second = int(d[first].argmax())
        edge = d[first, second]
        chosen.append(second)
        error = np.abs(edge - d[first]) + np.abs(edge - d[second])
        while len(chosen) < min(count, len(sample)):
            error[chosen] = np.inf
            chosen.append(int(error.argmin()))
            error = error + np.abs(edge - d[chosen[-1]])
    return sample[chosen]


def pruned_share(sample: np.ndarray, pivots: np.ndarray, gap: float, metric: str) -> float:
    """Share of the sample's pairs that some pivot decides for a search radius of `gap`."""
    if len(sample) < 2 or not len(pivots):
        return 0.0
    to = distances(sample, pivots, metric)
    decided = np.zeros((len(sample), len(sample)), dtype=bool)
    for j in range(to.shape[1]):
        decided |= np.abs(to[:, None, j] - to[None, :, j]) > gap
        decided |= to[:, None, j] + to[None, :, j] <= gap
    return float(decided[np.triu_indices(len(sample), 1)].mean())


def allocated(samples: dict[str, np.ndarray], gaps: dict[str, float], metrics: dict[str, str], pivots: int = PIVOTS) -> dict[str, int]:
    """How many pivots each attribute gets: one each, then the next to the attribute that gains most by it."""
    counts = dict.fromkeys(samples, 1)
    offered = {n: spread_out(s, pivots, metrics[n]) for n, s in samples.items()}
    share = {(n, c): pruned_share(samples[n], offered[n][:c], gaps[n], metrics[n]) for n in samples for c in range(1, pivots + 1)}
    while sum(counts.values()) < pivots:
        gain = {n: share[n, c + 1] - share[n, c] for n, c in counts.items() if c < pivots}
        counts[max(sorted(gain), key=lambda n: gain[n])] += 1
    return counts


def fit(rows: DataFrame, metrics: Sequence[Metric], pivots: int = PIVOTS, sample: int = SAMPLE, seed: int = 0) -> tuple[Metric, ...]:
    """The metrics with their scales and pivots, from a bounded sample of each attribute."""
    samples = {m.name: sample_of(rows, m.name, sample, seed) for m in metrics}
    kinds = {m.name: m.metric for m in metrics}
    gaps = {n: typical_gap(s, kinds[n]) for n, s in samples.items()}
    counts = allocated(samples, gaps, kinds, max(pivots, len(metrics)))
    return tuple(
        Metric(
            m.name, m.metric, gaps[m.name],
            tuple(map(tuple, spread_out(samples[m.name], counts[m.name], m.metric, seed).tolist())),
            tuple(f"pd_{m.name}_{i}" for i in range(counts[m.name])),
        )
        for m in metrics
    )


def _vector(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def embedded(rows: DataFrame, metrics: Sequence[Metric]) -> DataFrame:
    """The rows with their distances to all pivots; null where the attribute is missing."""
    return rows.withColumns(
        {c: measures.metric(m.metric)(F.col(m.name), _vector(p)) for m in metrics for c, p in zip(m.columns, m.pivots)}
    )


def stored(rows: DataFrame, metrics: Sequence[Metric], path: str) -> DataFrame:
    """The embedded rows as files, ranged by the first pivot distance, so that range predicates skip files."""
    first = metrics[0].columns[0]
    embedded(rows, metrics).repartitionByRange(first).sortWithinPartitions(first).write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


def exported(rows: DataFrame, metrics: Sequence[Metric], path: str) -> None:
    """The embedding as text files `id;vector`: all pivot distances of a row, joined by commas, empty where missing."""
    vector = F.array_join(F.array(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for m in metrics for c in m.columns)), ",")
    embedded(rows, metrics).select("id", vector.alias("vector")).write.mode("overwrite").options(sep=";", header=True).csv(path)


def range_scale(rows: DataFrame, metric: Metric) -> float:
    """Another scale: the widest range of the attribute's pivot distances."""
    ranges = rows.agg(*(F.max(c) - F.min(c) for c in metric.columns)).first()
    return max((r for r in ranges if r), default=1.0)


def neighbour_scale(rows: DataFrame, metric: Metric, value: Sequence[float], k: int) -> float:
    """Another scale: the distance of the k-th nearest row."""
    d = measures.metric(metric.metric)(F.col(metric.name), _vector(value)).alias("d")
    row = rows.select(d).where("d is not null").orderBy("d").limit(k).agg(F.max("d")).first()
    return row[0] or 1.0


@dataclass(frozen=True)
class Wanted:
    """A query on one indexed attribute."""

    name: str
    value: tuple[float, ...] | None
    #: None: found from the sample's scores.
    weights: tuple[float, ...] | None = (1.0,)
    scale: float | None = None
    decay: float = measures.DECAY


def _weighted(sample: DataFrame, wanted: Sequence[Wanted], scales: Sequence[float], k: int) -> list[Wanted]:
    """Attributes without weights get the percentile 100 - 100 k / N of their N scores in the sample (see
    `automatic_weight`); a value that is missing has no score."""
    asked = [j for j, w in enumerate(wanted) if w.weights is None]
    scores = {j: sample.where(f"d{j} is not null").select(F.exp(-F.lit(float(wanted[j].decay)) * F.col(f"d{j}") / scales[j]).alias("s")) for j in asked}
    made = sample.sparkSession.range(1).select(*(automatic_weight(s, k).alias(str(j)) for j, s in scores.items())).first()
    return [replace(w, weights=(made[str(j)] or 0.0,)) if j in asked else w for j, w in enumerate(wanted)]


def search(
    rows: DataFrame, metrics: Sequence[Metric], wanted: Sequence[Wanted], k: int, bound: bool = False, extra: Sequence[str] = ()
) -> DataFrame:
    """The k nearest rows of each combination by weighted distance, ranked by score.

    rows: id, vector columns, and pivot distances if `bound`. Distance: sum of w d / scale over the attributes a row
    has, divided by the sum of all weights. Score: sum of w exp(-decay d / scale) over them, divided likewise.
    With `bound`, an upper bound from the rows of a sample limits the pivot distances; rows that lack an attribute pass.
    Attributes without weights get them from the sample. The sample: the SAMPLE first rows by a hash of their id.
    """
    by_name = {m.name: m for m in metrics}
    wanted = [w for w in wanted if w.value is not None]
    if not wanted:
        raise ValueError("no indexed attribute is queried")
    unknown = [w.name for w in wanted if w.name not in by_name]
    if unknown:
        raise ValueError(f"not indexed: {', '.join(unknown)}")
    if k < 1 or (len(wanted) > 1 and k > measures.MOST_RESULTS):
        raise ValueError("k must be positive, and not above 50 with several attributes")
    scales = [w.scale or by_name[w.name].scale for w in wanted]
    d = {f"d{j}": measures.metric(by_name[w.name].metric)(F.col(w.name), _vector(w.value)) for j, w in enumerate(wanted)}
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", *(c.alias(n) for n, c in d.items()))
    if any(w.weights is None for w in wanted):
        sample = cut(sample)
        wanted = _weighted(sample, wanted, scales, k)
    n = max(len(w.weights) for w in wanted)
    each = [[w.weights[i] if len(w.weights) > 1 else w.weights[0] for w in wanted] for i in range(n)]

    def whole(weight: Sequence[float]) -> Column:
        parts = (weight[j] * F.coalesce(F.col(f"d{j}") / scales[j], F.lit(0.0)) for j in range(len(wanted)))
        return sum(parts, F.lit(0.0)) / (sum(weight) or 1.0)

    # The k-th nearest of the sample bounds how far the k nearest of all rows are; one scan for all combinations.
    reached = sample.agg(*(smallest(whole(weight), k).alias(f"r{i}") for i, weight in enumerate(each))).first() if bound else None
    results = []
    for i, weight in enumerate(each):
        total = sum(weight)
        scale = scales
        candidates = rows
        if bound and total > 0 and len(reached[f"r{i}"]) == k:
            for j, w in enumerate(wanted):
                m = by_name[w.name]
                if weight[j] > 0:
                    reach = reached[f"r{i}"][-1] * total * scale[j] / weight[j] * (1 + 1e-9) + 1e-12
                    here = distances(np.array([w.value], dtype=float), np.array(m.pivots), m.metric)[0]
                    for column, at in zip(m.columns, here):
                        inside = F.col(f"`{column}`").between(float(at - reach), float(at + reach))
                        candidates = candidates.where(F.col(f"`{column}`").isNull() | inside)
        parts = [
            weight[j] * F.coalesce(F.exp(-F.lit(float(w.decay)) * F.col(f"d{j}") / scale[j]), F.lit(0.0)) for j, w in enumerate(wanted)
        ]
        near = (
            candidates.withColumns(d)
            .withColumn("distance", whole(weight))
            .orderBy(F.round("distance", 12), "id")
            .limit(k)
            .withColumns({f"s{j}": parts[j] / weight[j] if weight[j] else F.exp(-F.lit(float(w.decay)) * F.coalesce(F.col(f"d{j}"), F.lit(0.0)) / scale[j]) for j, w in enumerate(wanted)})
            .withColumn("score", sum(parts, F.lit(0.0)) / (total or 1.0))
        )
        order = Window.orderBy(F.round("score", 9).desc(), "id")
        results.append(
            near.select(
                F.lit(i).alias("combo"), F.row_number().over(order).cast("bigint").alias("rank"), "id", "score", F.lit(True).alias("exact"), "distance",
                *(F.col(w.name).alias(f"v{j}") for j, w in enumerate(wanted)), *(f"s{j}" for j in range(len(wanted))), *(F.col(e).alias(f"x_{e}") for e in extra),
            )
        )
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out
