import math

import pytest
from pyspark.sql import functions as F

from facetrank.operators import ranking
from facetrank.operators.ranking import Criterion

ROWS = [("a", 1.0, 10.0), ("b", 2.0, None), ("c", 4.0, 30.0), ("d", None, 11.0), ("e", 4.0, 30.0), (None, 1.0, 1.0)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id string, x double, y double").withColumn("score", F.lit("clash"))


def x(**more):
    return Criterion("x", "number", F.col("x"), 1.0, **more)


def y(**more):
    return Criterion("y", "number", F.col("y"), 10.0, **more)


def ids(found):
    return [r["id"] for r in found.orderBy("combo", "rank").collect()]


def test_single_attribute_leaves_missing_values_out(rows):
    found, _ = ranking.rank(rows, [x()], 10)
    assert ids(found) == ["a", "b", "c", "e"]
    first = found.orderBy("rank").first()
    assert first["score"] == 1.0 and first["exact"]


def test_scale_is_the_kth_distance_and_a_zero_one_gives_way(rows):
    found, _ = ranking.rank(rows, [x()], 2)
    assert [r["score"] for r in found.orderBy("rank").collect()] == pytest.approx([1.0, math.exp(-0.05)])
    found, _ = ranking.rank(rows, [x()], 1)
    assert [r["score"] for r in found.collect()] == [1.0]


def test_missing_attribute_counts_zero_and_keeps_its_weight(rows):
    found, _ = ranking.rank(rows, [x(weights=(1.0,), scale=1.0), y(weights=(1.0,), scale=1.0)], 5)
    scores = {r["id"]: r["score"] for r in found.collect()}
    assert scores["a"] == pytest.approx(1.0)
    assert scores["b"] == pytest.approx(math.exp(-0.05) / 2)
    assert scores["d"] == pytest.approx(math.exp(-0.05) / 2)
    assert scores["c"] == pytest.approx((math.exp(-0.15) + math.exp(-1)) / 2)
    assert ids(found) == ["a", "c", "e", "b", "d"], "ties go by id"


def test_weight_combinations_rank_on_their_own(rows):
    found, _ = ranking.rank(rows, [x(weights=(1.0, 0.0)), y(weights=(0.0, 1.0))], 2)
    by = {(r["combo"], r["rank"]): r["id"] for r in found.collect()}
    assert by[0, 1] == "a" and by[0, 2] == "b" and by[1, 1] == "a" and by[1, 2] == "d"


@pytest.mark.parametrize("algorithm", ["partial_random_access", "no_random_access"])
def test_list_algorithms_agree_on_complete_rows(rows, algorithm):
    complete = rows.where("x is not null and y is not null")
    criteria = [x(weights=(0.7,)), y(weights=(0.3,))]
    exact, _ = ranking.rank(complete, criteria, 3)
    found, _ = ranking.rank(complete, criteria, 3, algorithm)
    assert ids(found) == ids(exact) and all(r["exact"] for r in found.collect())


def test_bounds_of_list_algorithms(rows):
    criteria = [x(weights=(1.0,), scale=1.0), y(weights=(1.0,), scale=1.0)]
    by_low, _ = ranking.rank(rows, criteria, 5, "no_random_access")
    by_middle, _ = ranking.rank(rows, criteria, 5, "partial_random_access")
    low, middle = ({r["id"]: r for r in f.collect()} for f in (by_low, by_middle))
    assert not low["b"]["exact"] and middle["b"]["score"] > low["b"]["score"]


def test_automatic_weights(spark):
    scores = spark.createDataFrame([(float(i),) for i in range(1, 6)], "s double")
    value = spark.range(1).select(ranking.automatic_weight(scores, 1).alias("w")).first()["w"]
    assert value == pytest.approx(4.8)  # position 6 * 0.8 of 1..5
    value = spark.range(1).select(ranking.automatic_weight(scores, 9).alias("w")).first()["w"]
    assert value == 5.0


def test_requests_that_are_refused(rows):
    for bad in (
        lambda: ranking.rank(rows, [x()], 0),
        lambda: ranking.rank(rows, [x(), y()], 51),
        lambda: ranking.rank(rows, [x(weights=(1.5,)), y()], 5),
        lambda: ranking.rank(rows, [x(weights=(1, 1)), y(weights=(1, 1, 1))], 5),
        lambda: ranking.rank(rows, [], 5),
        lambda: ranking.rank(rows, [x(), y()], 5, "none"),
    ):
        with pytest.raises(ValueError):
            bad()
    assert ranking.rank(rows, [x()], 60)[0].count() == 4


def test_empty_table(rows):
    found, p = ranking.rank(rows.limit(0), [x(), y()], 5)
    assert found.count() == 0 and ranking.similarity_matrix(found, p).count() == 0


def test_matrix_is_symmetric_with_ones_on_the_diagonal(rows):
    found, p = ranking.rank(rows.where("x is not null and y is not null"), [x(weights=(0.5,)), y(weights=(0.2,))], 3)
    m = {(r["id_l"], r["id_r"]): r["score"] for r in ranking.similarity_matrix(found, p).collect()}
    assert len(m) == 9 and all(m[a, b] == pytest.approx(m[b, a]) for a, b in m) and m["a", "a"] == 1.0


def test_sets_without_common_elements(spark):
    rows = spark.createDataFrame([("a", ["u", "v"]), ("b", ["w"]), ("c", []), ("d", None), ("e", ["u", "v"])], "id string, t array<string>")
    found, _ = ranking.rank(rows, [Criterion("t", "keywords", F.col("t"), ["u", "v"])], 5)
    assert ids(found) == ["a", "e"]
    found, _ = ranking.rank(rows, [Criterion("n", "text", F.col("id"), "a")], 5)
    assert ids(found) in ([], ["a", "b", "c", "d", "e"])


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("algorithm", ["threshold", "partial_random_access", "no_random_access"])
@pytest.mark.parametrize("weights", [None, (0.5,), (0.5, 0.1)])
def test_two_scans_and_no_shuffle_of_the_entities(spark, data, algorithm, weights):
    entities = spark.read.parquet(f"{data}/orders.parquet").withColumn("id", F.col("o_orderkey").cast("string"))
    criteria = [
        Criterion("price", "number", F.col("o_totalprice").cast("double"), 150000, weights),
        Criterion("day", "date", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double"), 8.3e8, weights),
        Criterion("status", "keywords", F.array("o_orderstatus"), ["F"], weights),
    ]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        statistics = plan_of(ranking.nearest(entities, criteria, 1000))
        found, _ = ranking.rank(entities, criteria, 5, algorithm, extra=("o_custkey",))
        plan = plan_of(found)
        assert statistics.count("FileScan parquet") == 1 and plan.count("FileScan parquet") == 1
        assert "SortMergeJoin" not in plan and found.count() == 5 * len(weights or (1,))
        if algorithm != "threshold":
            assert "BroadcastHashJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def bounded(algorithm, lists, k):
    """(id, score, exact) by brute force from (id, score) lists of two attributes with weights 1 and 1."""
    known = [dict(x) for x in lists]
    lowest = [min(x.values()) for x in known]
    rows = []
    for i in {i for x in known for i in x}:
        low = sum(x.get(i, 0) for x in known) / 2
        high = sum(x.get(i, least) for x, least in zip(known, lowest)) / 2
        rows.append((i, low, high, (low + high) / 2 if algorithm == "partial_random_access" else low))
    rows.sort(key=lambda r: (-round(r[3], 9), r[0]))
    out, sure = [], True
    for n, (i, low, high, score) in enumerate(rows[:k]):
        rest = max((r[2] for r in rows[n + 1 :]), default=0) if algorithm == "no_random_access" else 0
        sure = sure and round(low, 9) == round(high, 9) and low >= rest - 1e-9
        out.append((i, round(score, 6), sure))
    return out


@pytest.mark.parametrize("algorithm", ["partial_random_access", "no_random_access"])
def test_bounds_decide_what_is_exact(spark, algorithm):
    import random

    rng = random.Random(4)
    data = [(f"{i:03}", float(rng.randrange(60)), float(rng.randrange(60))) for i in range(200)]
    table = spark.createDataFrame(data, "id string, x double, y double")
    criteria = [Criterion(c, "number", F.col(c), 0.0, (1.0,), decay=1.0, scale=20.0) for c in "xy"]
    found, _ = ranking.rank(table, criteria, 30, algorithm, length=80)
    got = [(r["id"], round(r["score"], 6), r["exact"]) for r in found.orderBy("rank").collect()]
    near = [sorted((r[j], r[0]) for r in data)[:80] for j in (1, 2)]
    want = bounded(algorithm, [[(i, math.exp(-d / 20)) for d, i in x] for x in near], 30)
    assert got == want and {e for _, _, e in got} == {True, False}
