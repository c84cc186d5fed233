import numpy as np
import pytest
from pyspark.sql import functions as F

from facetrank.llm import perm_index as p

SCHEMA = "term string, lda_vector array<double>"


def brute(vectors, k, most):
    names = sorted(vectors)
    x = np.array([vectors[n] for n in names])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    out = set()
    for i in range(len(names)):
        for j in np.lexsort((np.arange(len(names)), d[i]))[:k]:
            if d[i, j] <= most:
                out.add((min(names[i], names[j]), max(names[i], names[j])))
    return out


def clustered(n=400, size=8, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 4, size)) * 2
    return {f"t{i:04}": (centres[i // 4] + rng.normal(size=size) * 0.1).round(3) for i in range(n)}


@pytest.mark.parametrize("options", [{}, {"file": 15}, {"file": 15, "pivots": 3}])
def test_recall_against_brute_force(spark, options):
    """Also with files that are split by a second pivot, and with ones that stay too long and go in tiles."""
    vectors = clustered()
    rows = spark.createDataFrame([(t, v.tolist()) for t, v in vectors.items()], SCHEMA)
    got = {tuple(r) for r in p.near_terms(rows, 3, 1.0, 8, **options).collect()}
    want = brute(vectors, 3, 1.0)
    assert len(got & want) / len(want) >= 0.97 and len(got - want) <= 0.02 * len(want)


def test_dirt_copies_and_ties(spark):
    v = lambda *x: [float(i) for i in x]
    rows = [
        ("a", v(1, 0)), ("a", v(1, 0)), ("b", v(1, 0)), ("c", v(1, 0)), ("d", v(1, 0)), ("e", v(1, 0)), ("f", v(1, 0.5)), ("g", v(9, 9)),
        (None, v(1, 0)), ("h", None), ("i", v(1)), ("j", v(1, float("nan"))), ("k", v(0, 0)), ("l", [1.0, None]), ("m", v(1, float("inf"))), ("n", v(9, 9.25)),
    ]
    got = {tuple(r) for r in p.near_terms(spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit(1), "v": F.lit(2)}), 3, 1.0, 2).collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "d"), ("b", "c"), ("b", "d"), ("c", "d"), ("a", "e"), ("b", "e"), ("c", "e"), ("a", "f"), ("b", "f"), ("c", "f"), ("g", "n")}


def test_empty_and_single(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert p.near_terms(none).count() == 0
    assert p.near_terms(spark.createDataFrame([("a", [1.0])], SCHEMA), size=1).count() == 0


def test_every_vector_of_a_long_file_is_compared(spark):
    """One pivot makes one file of all vectors: nothing is then left to chance."""
    rng = np.random.default_rng(4)
    vectors = {f"t{i:04}": x for i, x in enumerate(rng.normal(size=(1500, 8)).round(3))}
    rows = spark.createDataFrame([(t, v.tolist()) for t, v in vectors.items()], SCHEMA)
    assert {tuple(r) for r in p.near_terms(rows, 3, 1.5, 8, pivots=1).collect()} == brute(vectors, 3, 1.5)


def test_footrule_by_shared_ones():
    rng = np.random.default_rng(2)
    prefixes = np.array([rng.choice(9, 4, replace=False) for _ in range(40)], dtype=np.int32)
    ones = p._ones(prefixes)

    def footrule(a, b):
        place = lambda x, q: list(x).index(q) if q in x else 4
        return sum(abs(place(a, q) - place(b, q)) for q in set(a) | set(b))

    for i in range(0, 40, 3):
        for j in range(40):
            if i != j:
                most = 2 * sum(4 - t for t in range(4))
                assert footrule(list(prefixes[i]), list(prefixes[j])) == most - 2 * ones[i] @ ones[j]


def test_a_small_share_still_finds_most(spark, monkeypatch):
    monkeypatch.setattr(p, "RERANK_LEAST", 8)
    vectors = clustered(n=800)
    rows = spark.createDataFrame([(t, v.tolist()) for t, v in vectors.items()], SCHEMA)
    want = brute(vectors, 3, 1.0)
    some, whole = ({tuple(r) for r in p.near_terms(rows, 3, 1.0, 8, pivots=20, rerank=s).collect()} for s in (0.05, 1))
    assert len(some & want) >= 0.9 * len(want) and len(whole & want) >= len(some & want)
