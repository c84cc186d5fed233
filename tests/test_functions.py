import json

import pytest
from pyspark.sql import functions as F

from facetrank.functions import measures, values
from facetrank.functions.skew import lookup, numbered
from facetrank.functions.text import clean_tokens, qgrams, split_tokens


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


@pytest.mark.parametrize(
    ("text", "point"),
    [
        ("POINT (1 2)", (1, 2)), ("point(-1.50 2e0)", (-1.5, 2)), ("SRID=4326;POINT( 3  4 )", (3, 4)), ("5, 6", (5, 6)), ("[7,8]", (7, 8)), ('["9", "-1"]', (9, -1)),
        ("POINT EMPTY", None), ("POINT (1)", None), ("POINT (NaN NaN)", None), ("POINT (1; n/a)", None), ("200, 1", None), ("1, 91", None), ("", None), (None, None), ("x", None),
        ("POINT (1 2", None), ("[1, 2", None),
    ],
)
def test_points(spark, text, point):
    got = one(spark, values.point_of(F.lit(text).cast("string")))
    assert (got and (got["x"], got["y"])) == point


def test_query_points():
    assert values.parse_point("POINT (-77.04 38.9))") == (-77.04, 38.9)
    assert values.parse_point(["1", "2"]) == (1, 2) == values.parse_point("[1, 2]") == values.parse_point('["1", "2"]')
    assert values.parse_point("nowhere") is None


@pytest.mark.parametrize(
    ("text", "epoch"),
    [
        ("1970-01-02T00:00:01", 86401), ("1970-01-02T00:00:01Z", 86401), ("1970-01-02T00:00:01.500Z", 86401.5), ("1970-01-02 00:00:01+01", 82801), ("1970-01-02 00:00:01", 86401),
        ("19700102000001", 86401), ("1970-01-02", 86400), ("02/01-1970", 86400), ("02/01/1970", 86400), ("1970-02", 2678400), ("1971", 31536000), ("00:01:00", 60),
        ("1970-13-01", None), ("soon", None), ("", None), (None, None),
    ],
)
def test_dates(spark, text, epoch):
    assert one(spark, values.epoch_of(F.lit(text).cast("string"))) == epoch
    if text:
        assert values.parse_date(text) == epoch


def test_query_values():
    assert values.parse_value("POINT(1 2)") == ("point", (1, 2))
    assert values.parse_value("20191104084500")[0] == "number"
    assert values.parse_value("2019-11-04")[0] == "date"
    assert values.parse_value("[joe  biden, donald trump,joe biden]") == ("keywords", ["joe biden", "donald trump"])
    assert values.parse_value([1, 2.5]) == ("vector", [1.0, 2.5])
    assert values.parse_value(["a ", "b", "a"]) == ("keywords", ["a", "b"])
    assert values.parse_value(None) == ("null", None)
    assert values.is_json(json.dumps([])) and not values.is_json("{")


def test_tokens(spark):
    raw = F.array(*(F.lit(t) for t in (" Ab|4|5", "ab", "|x", "", "  ", None, "é ")))
    assert one(spark, clean_tokens(raw)) == ["ab", "|x", "é"]
    assert one(spark, clean_tokens(F.lit(None).cast("array<string>"))) == []
    assert one(spark, split_tokens(F.lit('"a , b|2,a,|c,,b|3"'))) == ["a", "b", "|c"]
    assert one(spark, qgrams(F.lit("abab"), 2)) == ["ab", "ba"]
    assert one(spark, qgrams(F.lit("a"), 2)) == [] and one(spark, qgrams(F.lit(None).cast("string"), 2)) is None


def test_distances(spark):
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(4.0), F.lit(6.0))
    assert one(spark, measures.manhattan(a, b)) == 7 and one(spark, measures.euclidean(a, b)) == 5 and one(spark, measures.chebyshev(a, b)) == 4
    assert one(spark, measures.manhattan(a, F.array(F.lit(1.0)))) is None
    assert one(spark, measures.or_missing(measures.euclidean(a, F.lit(None).cast("array<double>")), 3)) == 3
    p = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    q = F.struct(F.lit(90.0).alias("x"), F.lit(0.0).alias("y"))
    assert one(spark, measures.haversine(p, q)) == pytest.approx(90)
    assert one(spark, measures.haversine(p, q, "lat_lon")) == pytest.approx(90)
    assert measures.metric("Manhattan") is measures.manhattan and measures.metric("?") is measures.euclidean is measures.metric(None)
    s = lambda *t: F.array(*(F.lit(x) for x in t)).cast("array<string>")
    assert one(spark, measures.jaccard(s("a", "a", "b"), s("b", "c"))) == pytest.approx(2 / 3)
    assert one(spark, measures.jaccard(s(), s())) == 0
    assert one(spark, measures.similarity(F.lit(1.0), F.lit(2.0), sets=True)) == 0
    assert one(spark, measures.similarity(F.lit(0.0), F.lit(None).cast("double"))) == 1


def test_bounds_of_set_joins(spark):
    n, m = F.lit(10), F.lit(8)
    assert [one(spark, measures.least_partner(n, 0.8, k)) for k in ("jaccard", "cosine", "dice")] == [8, 7, 7]
    assert one(spark, measures.most_partner(n, 0.8)) == 12 and one(spark, measures.least_overlap(n, m, 0.8)) == 8 and one(spark, measures.prefix_length(n, 0.8)) == 3


def test_lookup_with_a_heavy_key(spark, monkeypatch):
    monkeypatch.setattr("facetrank.functions.skew.HEAVY_PARTS", 5)
    rows = spark.createDataFrame([("h", i) for i in range(20)] + [(f"k{i}", i) for i in range(15)] + [(None, 1)], "k string, i int")
    keyed = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    got = lookup(rows, "k", keyed, "n", 36).collect()
    assert len(got) == 35 and {r["n"] for r in got if r["k"] == "h"} == {20}


@pytest.mark.parametrize("slices", [1, 3])
def test_numbered(spark, slices):
    rows = spark.createDataFrame([("g", float(i % 7), i) for i in range(50)] + [("h", 1.0, 99)], "g string, x double, i int")
    got = numbered(rows, ["g"], F.floor("x"), [F.col("x"), F.col("i")], F.col("i"), slices, "n").collect()
    assert sorted(r["n"] for r in got if r["g"] == "g") == list(range(1, 51))
    order = [r["x"] for r in sorted((r for r in got if r["g"] == "g"), key=lambda r: r["n"])]
    assert order == sorted(order)


def test_scales_and_helpers_that_no_query_uses(spark):
    from facetrank.functions import measures
    from facetrank.functions.text import qgram_length
    from facetrank.operators import analytics, pivot

    strings = spark.createDataFrame([("abcdefgh",), ("abcde",), (None,)], "s string")
    assert qgram_length(strings, "s", 0.8) == 4 and qgram_length(strings.limit(0), "s", 0.8) == 1
    mean = spark.range(1).select(measures.vector_mean(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(6.0))), F.lit(2), 2).alias("v")).first()["v"]
    assert mean == [2.0, 4.0]
    rows = spark.createDataFrame([(str(i), [float(i * i)]) for i in range(6)] + [("n", None)], "id string, v array<double>")
    metric = pivot.Metric("v", "manhattan", 1.0, ((0.0,), (9.0,)), ("pd_v_0", "pd_v_1"))
    assert pivot.range_scale(pivot.embedded(rows, [metric]), metric) == 25.0
    assert pivot.neighbour_scale(rows, metric, (10.0,), 3) == 6.0
    nested = spark.sql("select 0 combo, 1 rank, 'a' id, 0.5D score, array(named_struct('name', 'x', 'value', '1', 'score', 0.25D), named_struct('name', 'y', 'value', '2', 'score', 0.75D)) attributes")
    assert [(r["name"], r["value"], r["attribute_score"]) for r in analytics.flattened(nested).collect()] == [("x", "1", 0.25), ("y", "2", 0.75)]
