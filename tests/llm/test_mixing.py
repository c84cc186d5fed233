import pytest
from pyspark.sql import functions as F

from facetrank.llm import mixing as m

TARGETS = [("big", 0.5, 1), ("small", 0.3, 4), ("tiny", 0.1, 2), ("absent", 0.1, 5)]


@pytest.fixture
def targets(spark):
    return spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


@pytest.fixture
def sizes(spark):
    rows = [(i, "big", 10 + i % 50) for i in range(3000)] + [(5000 + i, "small", 20 + i % 7) for i in range(300)] + [(9000 + i, "tiny", 5) for i in range(20)]
    return spark.createDataFrame(rows + [(9990, None, 7), (9991, "other", 7), (9992, "big", 0)], "doc_id long, source string, n_tokens long").withColumn("copy", F.lit("clash"))


@pytest.mark.parametrize("cell", [50_000, 200])
def test_shares_and_caps(sizes, targets, monkeypatch, cell):
    monkeypatch.setattr(m, "CELL", cell)
    goals = {g["source"]: g for g in m.rates(sizes, targets, 40_000)}
    assert goals["tiny"]["wanted"] == 200 and goals["absent"]["wanted"] == 0
    assert goals["big"]["wanted"] / goals["small"]["wanted"] == pytest.approx(5 / 3)
    assert sum(g["wanted"] for g in goals.values()) == pytest.approx(40_000)
    rows = m.mixed(sizes, list(goals.values()), seed=3).collect()
    for name, g in goals.items():
        got = [r for r in rows if r["source"] == name]
        assert sum(r["n_tokens"] for r in got) == pytest.approx(g["wanted"], rel=0.02)
        assert max([r["copy"] for r in got], default=0) <= g["max_repeats"]
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows) and not {9990, 9991, 9992} & {r["doc_id"] for r in rows}


def test_each_document_gets_its_rate_rounded_down_or_up(sizes, targets):
    goals = m.rates(sizes, targets, 40_000)
    rows = m.mixed(sizes, goals).groupBy("source", "doc_id").count().collect()
    rate = {g["source"]: g["rate"] for g in goals}
    assert all(int(rate[r["source"]]) <= r["count"] <= -(-rate[r["source"]] // 1) for r in rows)


def test_exact_shares(sizes, targets):
    goals = {g["source"]: g for g in m.rates(sizes, targets, exact=True)}
    assert goals["tiny"]["rate"] == pytest.approx(2) and goals["big"]["wanted"] / goals["tiny"]["wanted"] == pytest.approx(5)


def test_report_and_real_texts(spark, targets):
    docs = spark.createDataFrame([(i, f"some words of document {i}", "big") for i in range(50)] + [(99, None, "small"), (98, "", "tiny"), (97, "text", None)], "doc_id long, text string, source string")
    report = {r["source"]: r for r in m.mixture_report(docs, targets).collect()}
    assert len(report) == 4 and report["big"]["actual_share"] == 1.0 and not report["small"]["reachable"] and report["absent"]["tokens"] == 0
    assert {r["copy"] for r in m.mixture(docs, targets).collect()} == {1}


def test_empty(spark, targets):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert m.mixture(none, targets).count() == 0 and m.mixture_report(none, targets).count() == 4
    docs = spark.createDataFrame([(1, "text", "big")], "doc_id long, text string, source string")
    assert m.mixture(docs, targets.limit(0)).count() == 0
