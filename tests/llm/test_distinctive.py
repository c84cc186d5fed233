import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from facetrank.llm import distinctive as d

ROWS = [
    ("a", ["Common", "x", "rare|3", None, " "]), ("b", ["common", "X ", "rare"]), ("c", ["common", "x"]), ("d", ["common"]), ("d", ["COMMON"]), ("e", None), ("f", []), (None, ["x"]), ("g", ["only"]),
    ("h", ["x", "common", "pair"]), ("i", ["pair", "pair|2"]),
]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "id string, tokens array<string>").withColumns({"token": F.lit(1), "df": F.lit(2), "score": F.lit("s")})


def test_pairs_are_clean_and_distinct(rows):
    got = sorted((r["id"], r["token"]) for r in d.token_pairs(rows).collect())
    assert got == sorted(
        [("a", "common"), ("a", "x"), ("a", "rare"), ("b", "common"), ("b", "x"), ("b", "rare"), ("c", "common"), ("c", "x"), ("d", "common"), ("g", "only"), ("h", "x"), ("h", "common"), ("h", "pair"), ("i", "pair")]
    )


@pytest.mark.parametrize("parts", [2000, 3])
def test_scores(rows, monkeypatch, parts):
    monkeypatch.setattr("facetrank.functions.skew.HEAVY_PARTS", parts)
    scored = d.distinctiveness(d.token_pairs(rows)).collect()
    n, df = 7, Counter(r["token"] for r in scored)
    assert len(scored) == 14
    for r in scored:
        assert r["df"] == r["cf"] == df[r["token"]]
        assert r["score"] == pytest.approx(-math.log2(r["df"] / n) + math.log2(1 - math.exp(-r["cf"] / n)))
    by = {r["token"]: r["score"] for r in scored}
    assert by["only"] > by["rare"] == by["pair"] > by["x"] > by["common"]


def test_record_frequency_counts(spark):
    pairs = spark.createDataFrame([("a", "t", 4), ("b", "u", 1), ("c", "u", 1), ("d", "u", 1), ("e", "u", 1)], "id string, token string, tf long")
    by = {(r["id"], r["token"]): r["score"] for r in d.distinctiveness(pairs).collect()}
    assert by["a", "t"] > 0 > by["b", "u"], "the same number of occurrences in one record, and in four"


def test_telling_tokens(rows):
    got = {tuple(r) for r in d.telling_tokens(rows).collect()}
    assert got == {("a", "rare"), ("b", "rare"), ("h", "pair"), ("i", "pair")}


def test_empty(rows):
    assert d.telling_tokens(rows.limit(0)).count() == 0
    assert d.telling_tokens(rows.where("id = 'e'")).count() == 0


def test_occurrences_count_and_concentration_is_rewarded(rows):
    pairs = {(r["id"], r["token"]): r["tf"] for r in d.token_counts(rows).collect()}
    assert pairs["i", "pair"] == 2 and pairs["d", "common"] == 1 and len(pairs) == 14
    scored = {(r["id"], r["token"]): r for r in d.distinctiveness(d.token_counts(rows)).collect()}
    pair, rare = scored["i", "pair"], scored["a", "rare"]
    assert pair["df"] == rare["df"] == 2 and pair["cf"] == 3 and pair["score"] > 0 > rare["score"], "held by as many, but more often"
    assert d.token_counts(rows.limit(0)).count() == 0
