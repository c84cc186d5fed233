import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from facetrank.llm import fused_rank as f


def made(seed=0, searches=3, articles=40):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(searches):
        for j, c in enumerate(("u", "v", "w")):
            x = rng.random(articles)
            x = [x, x * 1e9 - 5e8, np.exp(30 * x)][(s + j) % 3]
            rows += [(s, f"a{i:02}", c, float(x[i])) for i in range(articles) if rng.random() > 0.1]
    return rows


WEIGHTS = [(s, c, None, w) for s in range(3) for c, w in (("u", ["0.9", " .1", "1"]), ("v", ["0.1", "1.0", "x"]), ("w", ["0.05", "0.05", "-1"]))]
PIVOT = "search_id long, column_name string, query_value string, weights array<string>"
SCORES = "search_id long, article_id string, column_name string, score double"


@pytest.mark.parametrize("cell", [50_000, 7])
def test_follows_weights_whatever_the_ranges(spark, monkeypatch, cell):
    monkeypatch.setattr(f, "CELL", cell)
    rows = made()
    dirty = rows + rows[:30] + [(0, "a00", "u", None), (0, "zz", "u", float("nan")), (None, "a00", "u", 1.0), (0, None, "u", 1e12), (0, "a00", None, 1.0), (9, "a00", "u", 1.0)]
    scores = spark.createDataFrame(dirty, SCORES).withColumns({"r": F.lit(1), "n": F.lit(2)})
    got = f.fused(scores, spark.createDataFrame(WEIGHTS, PIVOT)).toPandas()
    assert len(got) == len(got.drop_duplicates(["search_id", "combo", "article_id"]))
    frame = pd.DataFrame(rows, columns=["s", "a", "c", "x"])
    frame["r"] = frame.groupby(["s", "c"]).x.rank(pct=True)
    for (s, combo), part in got.groupby(["search_id", "combo"]):
        w = [{"u": 0.9, "v": 0.1, "w": 0.05}, {"u": 0.1, "v": 1.0, "w": 0.05}, {"u": 1.0}][combo]
        mean = (frame[frame.s == s].r * frame[frame.s == s].c.map(w).fillna(0)).groupby(frame[frame.s == s].a).sum()
        projection = part.set_index("article_id").projection
        assert projection.rank().corr(mean[projection.index].rank()) > 0.97
        assert set(projection.nlargest(3).index) <= set(mean.nlargest(6).index)
    assert set(got.search_id) == {0, 1, 2}


@pytest.mark.parametrize("cell", [50_000, 2])
def test_ranks(spark, monkeypatch, cell):
    monkeypatch.setattr(f, "CELL", cell)
    scores = spark.createDataFrame([(1, f"a{i}", "c", x) for i, x in enumerate([5.0, 5.0, -1.0, 1e300, 5.0, 0.0, -0.0])], SCORES)
    got = {r["article_id"]: r["r"] for r in f.rank_scores(scores).collect()}
    assert got == pytest.approx({"a2": 1 / 7, "a5": 3 / 7, "a6": 3 / 7, "a0": 6 / 7, "a1": 6 / 7, "a4": 6 / 7, "a3": 1.0})
    turned = {r["article_id"]: r["r"] for r in f.rank_scores(scores, F.lit(True)).collect()}
    assert turned["a2"] == 1.0 and turned["a3"] == pytest.approx(1 / 7)


def test_ties_go_by_id_and_empty_tables(spark):
    scores = spark.createDataFrame([(0, a, c, 1.0) for a in "dcba" for c in "uv"], SCORES)
    pivot = spark.createDataFrame(WEIGHTS, PIVOT)
    top = f.top_articles(scores, pivot, 2).where("combo = 0").orderBy("place").collect()
    assert [r["article_id"] for r in top] == ["a", "b"]
    assert f.top_articles(scores.limit(0), pivot).count() == 0 and f.top_articles(scores, pivot.limit(0)).count() == 0


def test_first_component_has_positive_loadings():
    v = f.first_component(np.array([[1.0, 0.4], [0.4, 0.3]]))
    assert (v > 0).all() and v[0] > v[1]


def brute(rows, weights):
    """Loadings by numpy: correlations over articles that have both, shrunk, weighted, first component."""
    frame = pd.DataFrame(rows, columns=["a", "c", "x"])
    frame["r"] = frame.groupby("c").x.rank(pct=True, method="max")
    rho = frame.pivot(index="a", columns="c", values="r").corr().fillna(0).to_numpy(copy=True)
    np.fill_diagonal(rho, 1)
    root = np.sqrt(np.array(weights))
    v = f.first_component(((1 - f.AGREED) * rho + f.AGREED) * np.outer(root, root)) * root
    return v / v.sum()


def test_loadings_are_the_component_and_differ_from_the_weights(spark):
    rng = np.random.default_rng(3)
    base = rng.random(60)
    x = {"u": base + 0.1 * rng.random(60), "v": base + 0.1 * rng.random(60), "w": rng.random(60), "z": -base}
    rows = [(f"a{i:02}", c, float(x[c][i])) for c in x for i in range(60) if (i + ord(c)) % 9]
    w = {"u": 0.5, "v": 0.5, "w": 0.5, "z": 0.5}
    scores = spark.createDataFrame([(1, a, c, v) for a, c, v in rows], SCORES)
    pivot = spark.createDataFrame([(1, c, None, [str(v)]) for c, v in w.items()] + [(1, "other", None, ["1"])], PIVOT)
    got = {r["column_name"]: r["loading"] for r in f.loadings(f.rank_scores(scores), f.weight_table(pivot)).collect()}
    want = dict(zip("uvwz", brute(rows, list(w.values()))))
    assert got == pytest.approx(want, abs=1e-9) and sum(got.values()) == pytest.approx(1)
    # Equal weights, but what goes along with others counts more than what goes against them.
    assert got["u"] > got["w"] > got["z"] > 0 and got["u"] - 0.25 > 0.02
    plain = {r["column_name"]: r["against"] for r in f.components(scores).collect()}
    assert plain == {"u": False, "v": False, "w": plain["w"], "z": True}
    ranking = [r["article_id"] for r in f.top_articles(scores, pivot, 60).orderBy("place").collect()]
    frame = pd.DataFrame(rows, columns=["a", "c", "x"])
    mean = frame.assign(r=frame.groupby("c").x.rank(pct=True)).groupby("a").r.sum().sort_values(ascending=False).index.tolist()
    assert ranking != mean, "not the weighted mean of ranks"


def test_one_column_holds_most_rows_and_all_weights_zero(spark):
    rows = [(1, f"a{i:05}", "u", float(i % 3)) for i in range(6000)] + [(2, "b", "u", 1.0), (2, "c", "u", 2.0)]
    pivot = spark.createDataFrame([(1, "u", None, ["1", "0"]), (2, "u", None, ["0.5"])], PIVOT)
    got = f.fused(spark.createDataFrame(rows, SCORES), pivot)
    by = {(r["search_id"], r["combo"], r["article_id"]): r["projection"] for r in got.collect()}
    assert len(by) == 12_002 and by[1, 0, "a00002"] == 1.0 and by[1, 0, "a00000"] == pytest.approx(1 / 3) and by[1, 1, "a00002"] == 0.0 and by[2, 0, "c"] == 1.0
