"""Top-k entities by weighted mean similarity over several attributes.

An entity table has one row an id; each criterion names a column expression of it and a query value. A search scans the
table twice at most, whatever the number of attributes: one aggregate with bounded heaps gives the nearest distances of
all attributes, and with them scales, automatic weights and lists; then one scan scores all rows with these as literals
(or fetches the values of the k results), and the k best come from per-partition heaps.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetrank.functions import measures
from facetrank.functions.runtime import cut, width
from facetrank.functions.text import qgrams
from facetrank.functions.topk import smallest

ALGORITHMS = ("threshold", "partial_random_access", "no_random_access", "pivot_based")


@dataclass(frozen=True)
class Criterion:
    """One queried attribute. kind: number, date (epoch seconds), point, keywords, text or vector."""

    name: str
    kind: str
    value: Column
    query: Any
    weights: tuple[float, ...] | None = None
    decay: float = measures.DECAY
    scale: float | None = None
    qgram: int = measures.QGRAM
    metric: str | None = None
    labels: dict = field(default_factory=dict, compare=False)

    @property
    def sets(self) -> bool:
        return self.kind in ("keywords", "text")

    def literal(self) -> Column:
        """The query value; `max` stands for the greatest value (see `resolved`)."""
        q = self.query
        if q is None or isinstance(q, Column):
            return F.lit(None) if q is None else q
        if self.kind in ("number", "date"):
            return F.lit(float(q))
        if self.kind == "point":
            return F.struct(F.lit(float(q[0])).alias("x"), F.lit(float(q[1])).alias("y"))
        if self.kind == "keywords":
            return F.array(*(F.lit(str(t)) for t in q)).cast("array<string>")
        if self.kind == "text":
            return F.lit(str(q))
        return F.array(*(F.lit(float(v)) for v in q))

    def between(self, a: Column, b: Column) -> Column:
        """Distance of two values of this attribute."""
        if self.kind in ("number", "date"):
            return measures.absolute(a, b)
        if self.kind == "point":
            return measures.planar(a, b)
        if self.kind == "keywords":
            return measures.jaccard(a, b)
        if self.kind == "text":
            return measures.jaccard(qgrams(a, self.qgram), qgrams(b, self.qgram))
        return measures.metric(self.metric)(a, b)


def resolved(entities: DataFrame, criteria: Sequence[Criterion]) -> tuple[Criterion, ...]:
    """Criteria whose query value `max` is replaced by the greatest value there is."""
    asked = [j for j, c in enumerate(criteria) if c.kind in ("number", "date") and c.query == "max"]
    if not asked:
        return tuple(criteria)
    most = entities.agg(*(F.max(criteria[j].value).cast("double").alias(f"m{j}") for j in asked)).first()
    return tuple(replace(c, query=most[f"m{j}"]) if j in asked else c for j, c in enumerate(criteria))


def distances(entities: DataFrame, criterion: Criterion) -> DataFrame:
    """(id, d). The value is a projection of its own, so that what it costs is paid once a row."""
    return entities.select("id", criterion.value.alias("v")).select("id", criterion.between(F.col("v"), criterion.literal()).alias("d"))


def batch(entities: DataFrame, criteria: Sequence[Criterion], k: int, block: int = 50) -> DataFrame:
    """(query, rank, id, d): the k nearest entities of each criterion, which is named by its `name`. Any number of query
    values of the same or other attributes; each `block` of them is one scan, with one heap a query."""
    if k < 1 or not criteria:
        raise ValueError("k must be positive, and there must be a query")
    criteria = resolved(entities, criteria)
    out: DataFrame | None = None
    for a in range(0, len(criteria), block):
        some = criteria[a : a + block]
        near = nearest(entities.where("id is not null"), some, k)
        name = F.get(F.array(*(F.lit(c.name) for c in some)), F.col("j")).alias("query")
        rows = near.select(name, F.posexplode("near").alias("i", "x")).select("query", (F.col("i") + 1).cast("bigint").alias("rank"), "x.id", "x.d")
        out = rows if out is None else out.unionByName(rows)
    return out


def _counts(criterion: Criterion, d: Column) -> Column:
    """Whether an entity at that distance can be in the attribute's list. Sets without a common element aren't listed."""
    there = d.isNotNull() & ~F.isnan(d)
    return there & (d < 1 - 1e-6) if criterion.sets else there


def listed(entities: DataFrame, criterion: Criterion, length: int) -> DataFrame:
    """(id, d): the `length` entities nearest by one attribute."""
    return distances(entities, criterion).where(_counts(criterion, F.col("d"))).orderBy("d", "id").limit(length)


def nearest(entities: DataFrame, criteria: Sequence[Criterion], length: int, ids: bool = True) -> DataFrame:
    """(j, near ARRAY<STRUCT<d[, id]>>, positive): of each criterion its `length` nearest entities, nearest first, and
    its least positive distance. One scan for all criteria; tasks send on a heap of `length` for each."""
    rows = entities.select("id", *(c.value.alias(f"v{j}") for j, c in enumerate(criteria)))
    rows = rows.select("id", *(c.between(F.col(f"v{j}"), c.literal()).alias(f"d{j}") for j, c in enumerate(criteria)))
    rows = rows.withColumn("_slice", F.spark_partition_id() % width(entities.sparkSession))
    aggregates = []
    for j, c in enumerate(criteria):
        d = F.col(f"d{j}")
        item = F.struct(d.alias("d"), F.col("id")) if ids else F.struct(d.alias("d"))
        counts = _counts(c, d)
        aggregates += [smallest(F.when(counts, item), length).alias(f"n{j}"), F.min(F.when(counts & (d > 0), d)).alias(f"p{j}")]
    # Heaps meet in as many tasks as there are slices before they meet in one a criterion.
    sliced = rows.groupBy("_slice").agg(*aggregates)
    each = F.array(*(F.struct(F.lit(j).alias("j"), F.col(f"n{j}").alias("near"), F.col(f"p{j}").alias("positive")) for j in range(len(criteria))))
    parts = sliced.select(F.explode(each).alias("x")).select("x.j", "x.positive", F.explode_outer("x.near").alias("near"))
    return parts.groupBy("j").agg(smallest(F.col("near"), length).alias("near"), F.min("positive").alias("positive"))


def batch(entities: DataFrame, criteria: Sequence[Criterion], k: int, block: int = 50) -> DataFrame:
    """(query, rank, id, d): the k nearest entities of each criterion, which is named by its `name`. Any number of query
    values of the same or other attributes; each `block` of them is one scan, with one heap a query."""
    if k < 1 or not criteria:
        raise ValueError("k must be positive, and there must be a query")
    criteria = resolved(entities, criteria)
    out: DataFrame | None = None
    for a in range(0, len(criteria), block):
        some = criteria[a : a + block]
        near = nearest(entities.where("id is not null"), some, k)
        name = F.get(F.array(*(F.lit(c.name) for c in some)), F.col("j")).alias("query")
        rows = near.select(name, F.posexplode("near").alias("i", "x")).select("query", (F.col("i") + 1).cast("bigint").alias("rank"), "x.id", "x.d")
        out = rows if out is None else out.unionByName(rows)
    return out


def _counts(criterion: Criterion, d: Column) -> Column:
    """Whether an entity at that distance can be in the attribute's list. Sets without a common element aren't listed."""
    there = d.isNotNull() & ~F.isnan(d)
    return there & (d < 1 - 1e-6) if criterion.sets else there


def listed(entities: DataFrame, criterion: Criterion, length: int) -> DataFrame:
    """(id, d): the `length` entities nearest by one attribute."""
    return distances(entities, criterion).where(_counts(criterion, F.col("d"))).orderBy("d", "id").limit(length)


def nearest(entities: DataFrame, criteria: Sequence[Criterion], length: int, ids: bool = True) -> DataFrame:
    """(j, near ARRAY<STRUCT<d[, id]>>, positive): of each criterion its `length` nearest entities, nearest first, and
    its least positive distance. One scan for all criteria; tasks send on a heap of `length` for each."""
    rows = entities.select("id", *(c.value.alias(f"v{j}") for j, c in enumerate(criteria)))
    rows = rows.select("id", *(c.between(F.col(f"v{j}"), c.literal()).alias(f"d{j}") for j, c in enumerate(criteria)))
    rows = rows.withColumn("_slice", F.spark_partition_id() % width(entities.sparkSession))
    aggregates = []
    for j, c in enumerate(criteria):
        d = F.col(f"d{j}")
        item = F.struct(d.alias("d"), F.col("id")) if ids else F.struct(d.alias("d"))
        counts = _counts(c, d)
        aggregates += [smallest(F.when(counts, item), length).alias(f"n{j}"), F.min(F.when(counts & (d > 0), d)).alias(f"p{j}")]
    # Heaps meet in as many tasks as there are slices before they meet in one a criterion.
    sliced = rows.groupBy("_slice").agg(*aggregates)
    each = F.array(*(F.struct(F.lit(j).alias("j"), F.col(f"n{j}").alias("near"), F.col(f"p{j}").alias("positive")) for j in range(len(criteria))))
    parts = sliced.select(F.explode(each).alias("x")).select("x.j", "x.positive", F.explode_outer("x.near").alias("near"))
    return parts.groupBy("j").agg(smallest(F.col("near"), length).alias("near"), F.min("positive").alias("positive"))


def automatic_weight(scores: DataFrame, k: int) -> Column:
    """The percentile 100 - 100 k / N of a list's N scores (column s), interpolated at p (N + 1) / 100; at N <= k the
    greatest score. About the k-th best score."""
    ordered = scores.select("s", F.row_number().over(Window.orderBy("s")).alias("i"), F.count("*").over(Window.partitionBy()).alias("n"))
    position = (F.col("n") + 1) * (1 - F.lit(float(k)) / F.col("n"))
    low = F.floor(position)
    at = lambda i: F.max(F.when(F.col("i") == i, F.col("s")))
    part = F.max(position - low)
    between = at(low) + part * (at(low + 1) - at(low))
    value = (
        F.when((F.max("n") <= k) | (F.max(position) >= F.max("n")), F.max("s")).when(F.max(position) < 1, F.min("s")).otherwise(between)
    )
    return ordered.agg(value).scalar()


def score_statistics(entities: DataFrame, p: Prepared) -> DataFrame:
    """(name, n, min, max, avg, stdev) of the scores in each attribute's list."""
    near = nearest(entities, p.criteria, p.length) if p.near is None else p.near
    name = F.get(F.array(*(F.lit(c.name) for c in p.criteria)), F.col("j"))
    return _list_scores(near, p).groupBy(name.alias("name")).agg(
        F.count("*").alias("n"), F.min("s").alias("min"), F.max("s").alias("max"), F.avg("s").alias("avg"), F.stddev_samp("s").alias("stdev")
    )


def deviation_weights(statistics: DataFrame) -> DataFrame:
    """(name, weight): each attribute's standard deviation of scores as a share of their sum."""
    return statistics.select("name", (F.col("stdev") / statistics.agg(F.sum("stdev")).scalar()).alias("weight"))


def rescored(found: DataFrame, p: Prepared) -> DataFrame:
    """Results of a list algorithm with their exact scores as column `exact_score`."""
    score = F.lit(0.0)
    for i in range(len(p.weights[0])):
        score = F.when(F.col("combo") == i, _mean(p, i, lambda j: F.coalesce(F.col(f"s{j}"), F.lit(0.0)))).otherwise(score)
    return found.withColumn("exact_score", score)


def _combinations(criteria: Sequence[Criterion]) -> int:
    counts = {len(c.weights) for c in criteria if c.weights and len(c.weights) > 1}
    if len(counts) > 1:
        raise ValueError("attributes have different numbers of weights")
    return counts.pop() if counts else 1


def check_weights(criteria: Sequence[Criterion]) -> None:
    for c in criteria:
        for w in c.weights or ():
            if not 0 <= w <= 1:
                raise ValueError(f"weight {w} of {c.name} is not within 0 and 1")


@dataclass(frozen=True)
class Prepared:
    """Criteria with their similarity expressions, scales and weights by combination."""

    criteria: tuple[Criterion, ...]
    scales: tuple[Column, ...]
    weights: tuple[tuple[Column, ...], ...]
    length: int
    #: The lists (see `nearest`), where they were asked for, and the distance of each one's last entity.
    near: DataFrame | None = None
    last: tuple[float | None, ...] = ()
    #: The weights as numbers, of each criterion by combination.
    numbers: tuple[tuple[float | None, ...], ...] = ()

    def similarity(self, j: int, distance: Column) -> Column:
        c = self.criteria[j]
        return measures.similarity(distance, self.scales[j], c.decay, c.sets)

    def total(self, combo: int) -> Column:
        return sum((w[combo] for w in self.weights), F.lit(0.0))


def prepare(entities: DataFrame, criteria: Sequence[Criterion], k: int, length: int | None = None, lists: bool = False) -> Prepared:
    """Scales and weights as literals. Scale: the one given, else the distance of the k-th nearest entity; if that is 0,
    the least positive distance. One scan, or none if all scales and weights are given and no lists are asked for."""
    if k < 1:
        raise ValueError("k must be positive")
    if not criteria:
        raise ValueError("no attribute is queried")
    if len(criteria) > 1 and k > measures.MOST_RESULTS:
        raise ValueError(f"k must not exceed {measures.MOST_RESULTS} with several attributes")
    check_weights(criteria)
    n = _combinations(criteria)
    criteria = resolved(entities, criteria)
    length = length or (k * measures.INFLATION if len(criteria) > 1 else k)
    automatic = [j for j, c in enumerate(criteria) if not c.weights and len(criteria) > 1]
    lists = lists or bool(automatic)
    given = [c.scale is not None and c.scale > 0 for c in criteria]
    near, of = None, {}
    if lists or not all(given):
        near = nearest(entities, criteria, max(k, length) if lists else k, ids=lists)
        near = cut(near) if lists else near
        at = lambda i: F.get("near", i)["d"]
        size = F.size("near")
        kth, last = at(F.least(F.lit(k), size) - 1), at(F.least(F.lit(length), size) - 1)
        of = {r["j"]: r for r in near.select("j", "positive", kth.alias("kth"), last.alias("last")).collect()}
    found = [of[j]["kth"] or of[j]["positive"] if j in of else None for j in range(len(criteria))]
    scales = tuple(F.lit(float(c.scale) if g else f).cast("double") for c, g, f in zip(criteria, given, found))
    p = Prepared(criteria, scales, (), length, near if lists else None, tuple(of[j]["last"] if j in of else None for j in range(len(criteria))))
    made = {}
    if automatic:
        scores = _list_scores(near, p)
        values = (automatic_weight(scores.where(F.col("j") == j).select("s"), k).alias(str(j)) for j in automatic)
        made = entities.sparkSession.range(1).select(*values).first().asDict()
    numbers = [tuple(c.weights or ((made[str(j)],) if j in automatic else (1.0,))) for j, c in enumerate(criteria)]
    numbers = tuple(x * n if len(x) == 1 else x for x in numbers)
    return replace(p, weights=tuple(tuple(F.lit(w).cast("double") for w in x) for x in numbers), numbers=numbers)


def _scored(entities: DataFrame, p: Prepared, extra: Sequence[str] = ()) -> DataFrame:
    """id, values v<j>, distances d<j>, similarities s<j> and extra columns."""
    rows = entities.select(
        "id",
        *(c.value.alias(f"v{j}") for j, c in enumerate(p.criteria)),
        *(F.col(f"`{e}`").alias(f"x_{e}") for e in extra),
    ).withColumns({f"d{j}": c.between(F.col(f"v{j}"), c.literal()) for j, c in enumerate(p.criteria)})
    return rows.withColumns({f"s{j}": p.similarity(j, F.col(f"d{j}")) for j in range(len(p.criteria))})


def _best(rows: DataFrame, p: Prepared, k: int, means: Sequence[Column]) -> DataFrame:
    """The k first rows of each combination by its mean, ranked; ties by id. One scan, heaps of k in each task."""
    if len(means) == 1:
        first = rows.withColumns({"combo": F.lit(0), "score": means[0]}).orderBy(F.round("score", 9).desc(), "id").limit(k)
        order = Window.partitionBy("combo").orderBy(F.round("score", 9).desc(), "id")
        return first.withColumns({"exact": F.lit(True), "rank": F.row_number().over(order).cast("bigint")})
    names = [c for c in rows.columns if c != "id"]
    scored = rows.withColumns({f"_m{i}": mean for i, mean in enumerate(means)}).withColumn("_slice", F.spark_partition_id() % width(rows.sparkSession))
    # Ids are distinct, so that of an item nothing behind the id decides its place.
    item = lambda i: F.struct((-F.round(f"_m{i}", 9)).alias("by"), F.col("id"), F.col(f"_m{i}").alias("score"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    sliced = scored.groupBy("_slice").agg(*(smallest(item(i), k).alias(f"b{i}") for i in range(len(means))))
    each = F.array(*(F.struct(F.lit(i).alias("combo"), F.col(f"b{i}").alias("best")) for i in range(len(means))))
    parts = sliced.select(F.explode(each).alias("x")).select("x.combo", F.explode("x.best").alias("best"))
    found = parts.groupBy("combo").agg(smallest(F.col("best"), k).alias("best")).select("combo", F.posexplode("best").alias("i", "x"))
    return found.select("x.id", "x.row.*", "combo", "x.score", F.lit(True).alias("exact"), (F.col("i") + 1).cast("bigint").alias("rank"))


def _mean(p: Prepared, combo: int, part) -> Column:
    total = p.total(combo)
    summed = sum((part(j) * p.weights[j][combo] for j in range(len(p.criteria))), F.lit(0.0))
    return F.when(total > 0, summed / total).otherwise(F.lit(0.0))


def singleton(entities: DataFrame, criterion: Criterion, k: int, extra: Sequence[str] = ()) -> DataFrame:
    """One attribute: its nearest entities, scored by similarity."""
    return _singleton(entities, criterion, k, extra)[0]


def _singleton(entities: DataFrame, criterion: Criterion, k: int, extra: Sequence[str]) -> tuple[DataFrame, Prepared]:
    """One scan gives the k nearest, and by the last of them the scale; only where all are at distance 0, another one
    looks for the least positive distance."""
    if k < 1:
        raise ValueError("k must be positive")
    check_weights([criterion])
    (criterion,) = resolved(entities, [criterion])
    rows = entities.select("id", criterion.value.alias("v0"), *(F.col(f"`{e}`").alias(f"x_{e}") for e in extra))
    rows = rows.withColumn("d0", criterion.between(F.col("v0"), criterion.literal())).where(_counts(criterion, F.col("d0")))
    first = cut(rows.orderBy("d0", "id").limit(k))
    scale = criterion.scale if criterion.scale is not None and criterion.scale > 0 else first.agg(F.max("d0")).first()[0]
    if scale == 0:
        scale = rows.where("d0 > 0").agg(F.min("d0")).first()[0]
    numbers = (tuple(criterion.weights or (1.0,)),)
    p = Prepared((criterion,), (F.lit(scale).cast("double"),), (tuple(F.lit(w).cast("double") for w in numbers[0]),), k, numbers=numbers)
    order = Window.orderBy("d0", "id")
    out = first.withColumn("s0", p.similarity(0, F.col("d0"))).withColumns({"rank": F.row_number().over(order).cast("bigint"), "score": F.col("s0"), "exact": F.lit(True)})
    return out.withColumn("combo", F.explode(F.array(*(F.lit(i) for i in range(len(numbers[0])))))), p


def threshold(entities: DataFrame, criteria: Sequence[Criterion], k: int, extra: Sequence[str] = ()) -> tuple[DataFrame, Prepared]:
    """The exact k best by weighted mean; an attribute that an entity lacks counts 0 and keeps its weight."""
    p = prepare(entities, criteria, k)
    n = len(p.weights[0])
    means = [_mean(p, i, lambda j: F.col(f"s{j}")) for i in range(n)]
    return _best(_scored(entities, p, extra), p, k, means), p


def _list_scores(near: DataFrame, p: Prepared) -> DataFrame:
    """(j, id, s): the entities of the lists and their scores there."""
    rows = near.select("j", F.explode(F.slice("near", 1, p.length)).alias("x")).select("j", "x.*")
    score = F.lit(None).cast("double")
    for j in range(len(p.criteria)):
        score = F.when(F.col("j") == j, p.similarity(j, F.col("d"))).otherwise(score)
    return rows.withColumn("s", score).drop("d")


def _by_bounds(entities: DataFrame, criteria: Sequence[Criterion], k: int, extra: Sequence[str], length: int | None, middle: bool) -> tuple[DataFrame, Prepared]:
    """By the attributes' lists only. An entity's score is at least that of its attributes that are listed, and at most
    that with the lowest score of the list for each other one. Ranked by the middle of the two, or by the lower bound.

    The lists have at most `length` entities each, so the windows over a combination's candidates are bounded.
    """
    p = prepare(entities, criteria, k, length, lists=True)
    m, n = len(p.criteria), len(p.weights[0])
    known = _list_scores(p.near, p).groupBy("id").agg(*(F.max(F.when(F.col("j") == j, F.col("s"))).alias(f"l{j}") for j in range(m)))
    lowest = [p.similarity(j, F.lit(p.last[j]).cast("double")) for j in range(m)]
    bounds = F.array(
        *(
            F.struct(
                F.lit(i).alias("combo"),
                F.round(_mean(p, i, lambda j: F.coalesce(F.col(f"l{j}"), F.lit(0.0))), 9).alias("low"),
                F.round(_mean(p, i, lambda j: F.coalesce(F.col(f"l{j}"), lowest[j])), 9).alias("high"),
                _mean(p, i, lambda j: F.coalesce(F.col(f"l{j}"), (lowest[j] / 2) if middle else F.lit(0.0))).alias("score"),
            )
            for i in range(n)
        )
    )
    rows = known.select("id", F.explode(bounds).alias("b")).select("id", "b.*")
    order = Window.partitionBy("combo").orderBy(F.round("score", 9).desc(), "id")
    sure = F.col("low") == F.col("high")
    if not middle:
        others = F.max("high").over(order.rowsBetween(1, Window.unboundedFollowing))
        sure = sure & (F.col("low") >= F.coalesce(others, F.lit(0.0)))
    ranked = rows.withColumns({"rank": F.row_number().over(order).cast("bigint"), "_sure": sure})
    # A result is exact if its score is certain and so are those before it.
    ranked = ranked.withColumn("exact", F.min("_sure").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = ranked.where(F.col("rank") <= k).select("id", "combo", "rank", "score", "exact")
    # At most k rows a combination; all of them are entities.
    return _scored(entities, p, extra).join(F.broadcast(found), "id"), p


def partial_random_access(entities: DataFrame, criteria: Sequence[Criterion], k: int, extra: Sequence[str] = (), length: int | None = None) -> tuple[DataFrame, Prepared]:
    """Lists only, ranked by the middle of the bounds. exact: the entity is in all lists that count, and so are all
    before it; as they are ranked by the middle, no other can be better."""
    return _by_bounds(entities, criteria, k, extra, length, middle=True)


def no_random_access(entities: DataFrame, criteria: Sequence[Criterion], k: int, extra: Sequence[str] = (), length: int | None = None) -> tuple[DataFrame, Prepared]:
    """Lists only, ranked by the lower bound. exact: the entity is in all lists that count, no entity after it has a
    greater upper bound, and so it is for all before it."""
    return _by_bounds(entities, criteria, k, extra, length, middle=False)


def rank(entities: DataFrame, criteria: Sequence[Criterion], k: int, algorithm: str = "threshold", extra: Sequence[str] = (), length: int | None = None) -> tuple[DataFrame, Prepared]:
    """(rows, what they were made with): combo, rank, id, score, exact, v<j>, s<j>, x_<extra>.

    entities: column id and those that the criteria use; a null value is a missing one, rows with a null id are left
    out, and an empty table gives no rows. Ids must be distinct.
    """
    entities = entities.where("id is not null")
    if len(criteria) == 1:
        return _singleton(entities, criteria[0], k, extra)
    run = {"threshold": threshold, "partial_random_access": partial_random_access, "no_random_access": no_random_access}
    if algorithm not in run:
        raise ValueError(f"unknown algorithm {algorithm}")
    if algorithm == "threshold":
        return threshold(entities, criteria, k, extra)
    return run[algorithm](entities, criteria, k, extra, length)


def similarity_matrix(rows: DataFrame, p: Prepared) -> DataFrame:
    """(combo, id_l, id_r, score) of each ordered pair of results of a combination, the diagonal included.

    By the scales, decays and weights of the query; at most MOST_RESULTS rows a combination meet each other.
    """
    m, n = len(p.criteria), len(p.weights[0])
    side = lambda s: rows.where(F.col("rank") <= measures.MOST_RESULTS).select("combo", F.col("id").alias(f"id_{s}"), *(F.col(f"v{j}").alias(f"{s}{j}") for j in range(m)))
    pairs = side("l").join(side("r"), "combo")
    pairs = pairs.withColumns(
        {f"s{j}": p.similarity(j, p.criteria[j].between(F.col(f"l{j}"), F.col(f"r{j}"))) for j in range(m)}
    )
    score = F.lit(0.0)
    for i in range(n):
        score = F.when(F.col("combo") == i, _mean(p, i, lambda j: F.col(f"s{j}"))).otherwise(score)
    return pairs.select("combo", "id_l", "id_r", score.alias("score"))
