import numpy as np
import pytest
from pyspark.sql import functions as F

from facetrank.operators import spatial_join as sj


def brute(points, distance):
    out = set()
    for i, (a, x, y) in enumerate(points):
        for b, u, v in points[i + 1 :]:
            if a != b and np.hypot(x - u, y - v) <= distance + 1e-12:
                out.add((min(a, b), max(a, b)))
    return out


@pytest.mark.parametrize("tile", [50_000, 40])
def test_near_pairs_as_by_brute_force(spark, monkeypatch, tile):
    """Clusters, a crowded place, copies at one place, repeated rows; tiles force crowded leaves apart."""
    rng = np.random.default_rng(1)
    xy = np.concatenate([rng.normal((10, 5), 0.02, (150, 2)), rng.uniform(-1, 1, (100, 2)), np.full((12, 2), 0.5), [[0.006, 0.008], [0.0, 0.0]]])
    points = [(f"p{i:03}", float(x), float(y)) for i, (x, y) in enumerate(xy)]
    rows = spark.createDataFrame(points + points[:20] + [(None, 0.0, 0.0), ("n", None, 1.0), ("m", float("nan"), 1.0)], "id string, x double, y double")
    monkeypatch.setattr(sj, "LEAF", 60)
    real = sj.near_pairs
    monkeypatch.setattr(sj, "near_pairs", lambda p, d, t: real(p, d, t, tile))
    got = sj.spatial_pairs(rows.withColumn("leaf", F.lit(1)), None, 0.01).collect()
    assert {tuple(r) for r in got} == brute(points, 0.01) and len(got) == len({tuple(r) for r in got})


def test_areas(spark):
    areas = spark.createDataFrame(
        [
            ("a1", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))"),
            ("a2", "multipolygon (((10 0, 12 0, 11 2, 10 0)), ((20 0, 22 0, 22 2, 21 1, 20 2, 20 0)))"),
            ("a3", "POINT (1 1)"), ("a4", None), (None, "POLYGON ((0 0, 9 0, 9 9, 0 0))"),
        ],
        "area_id string, geometry string",
    )
    points = spark.createDataFrame(
        [("in", 3.0, 3.0), ("hole", 1.5, 1.5), ("edge", 4.0, 2.0), ("tip", 11.0, 1.0), ("dent", 21.0, 1.5), ("leg", 20.2, 1.5), ("out", 50.0, 50.0)], "id string, x double, y double"
    )
    got = {tuple(r) for r in sj.spatial_pairs(points, areas, 0.0).collect()}
    assert got == {("a1", "in"), ("a2", "tip"), ("a2", "leg")}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id string, x double, y double")
    areas = spark.createDataFrame([], "area_id string, geometry string")
    assert sj.spatial_pairs(none, areas, 0.01).count() == 0
    one = spark.createDataFrame([("a", 1.0, 1.0)], "id string, x double, y double")
    assert sj.spatial_pairs(one, areas, 0.01).count() == 0


def test_rtree_finds_what_a_scan_finds():
    rng = np.random.default_rng(0)
    for n in (1, 5, 16, 17, 300):
        p = rng.random((n, 2))
        boxes = np.concatenate([p - 0.1, p + 0.1], axis=1)
        got = {(a, b) for q, r in sj.RTree(p[:, 0], p[:, 1]).probe(boxes, 7) for a, b in zip(q, r)}
        assert got == {(i, j) for i in range(n) for j in range(n) if (np.abs(p[i] - p[j]) <= 0.1).all()}


def test_quadtree_leaves_cover_the_plane():
    rng = np.random.default_rng(0)
    xs, ys = rng.random(500), rng.random(500)
    tree = sj.Quadtree(xs, ys, 0.01, 40)
    assert tree.starts[0] == 0 and len(set(tree.leaf(xs, ys))) > 10
    assert set(tree.touched(0.2, 0.2, 0.4, 0.5)) >= set(tree.leaf(np.array([0.2, 0.3, 0.4]), np.array([0.2, 0.5, 0.3])))


@pytest.mark.parametrize("parts", [2000, 2])
def test_links_as_by_brute_force(spark, monkeypatch, parts):
    monkeypatch.setattr("facetrank.functions.skew.HEAVY_PARTS", parts)
    rng = np.random.default_rng(8)
    rows = [(f"p{i:03}", float(x), float(y)) for i, (x, y) in enumerate(rng.random((150, 2)).round(2))]
    rows += [(f"c{i:02}", 0.5, 0.5) for i in range(40)] + rows[:5] + [(None, 0.1, 0.1), ("n", None, 1.0), ("nan", float("nan"), 1.0)]
    got = {(r["id"], r["x"], r["y"]): (r["copies"], r["links"]) for r in sj.spatial_links(spark.createDataFrame(rows, "id string, x double, y double"), 0.05).collect()}
    clean = {r for r in rows if r[0] is not None and r[1] is not None and r[1] == r[1]}
    want = {}
    for r in clean:
        apart = [np.hypot(r[1] - o[1], r[2] - o[2]) for o in clean if o[1:] != r[1:]]
        want[r] = (sum(o[1:] == r[1:] for o in clean), sum(d <= 0.05 + sj.SLACK for d in apart))
    assert got == want
    assert sj.spatial_links(spark.createDataFrame([], "id string, x double, y double"), 0.05).count() == 0


@pytest.mark.parametrize("size", [10_000, 3])
def test_twins(spark, size):
    from facetrank.functions.skew import twins

    rows = [("k", f"v{i:02}") for i in range(23)] + [("l", "a"), ("l", "b"), ("m", "z")]
    got = [tuple(r) for r in twins(spark.createDataFrame(rows, "k string, v string"), "k", "v", size).collect()]
    want = {(a, b) for x, a in rows for y, b in rows if x == y and a < b}
    assert len(got) == len(want) and set(got) == want


def test_leaves_grow_with_the_points(spark):
    places = spark.range(300_000).select((F.col("id") % 997).cast("double").alias("x"), (F.col("id") / 997).alias("y"))
    few, many = (len(sj.draw(places, 0.0, leaf=leaf).starts) for leaf in (30_000, 100))
    assert 10 <= few < 100 and many > 2000
