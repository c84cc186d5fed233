import random

import pytest
from pyspark.sql import functions as F

from facetrank.llm import set_join as s

SCHEMA = "id string, tokens array<string>"


def clean(tokens):
    out = set()
    for t in tokens or []:
        if t is not None:
            at = t.find("|")
            t = (t[:at] if at > 0 else t).strip().lower()
            if t:
                out.add(t)
    return out


def brute(rows, similarity, least):
    sets = {i: clean(t) for i, t in rows if i is not None}
    sets = sorted((i, x) for i, x in sets.items() if len(x) >= least)
    return {(a, b) for n, (a, x) in enumerate(sets) for b, y in sets[n + 1 :] if len(x & y) >= similarity * len(x | y) - 1e-9}


def made(n=300, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        base = rng.sample(words, rng.randrange(3, 12)) + ["hot"] * (rng.random() < 0.6)
        rows.append((f"r{i:04}", base))
        if rng.random() < 0.5:
            other = list(base)
            other[rng.randrange(len(other))] = rng.choice(words)
            rows.append((f"s{i:04}", [t.upper() + " |2" for t in other]))
        if rng.random() < 0.1:
            rows.append((f"c{i:04}", base[::-1]))
    return rows + rows[:20] + [(None, ["a", "b", "c", "d"]), ("n1", None), ("n2", []), ("n3", ["", None, " ", "|"]), ("long", [f"l{i}" for i in range(3000)]), ("lonh", [f"l{i}" for i in range(2990)])]


@pytest.mark.parametrize("options", [{}, {"neighbourhood": 2, "depth": 1}, {"neighbourhood": 1, "depth": 7}])
def test_pairs_as_by_brute_force(spark, options):
    """Also with neighbourhoods so small that sets go on through several rounds, to the last."""
    rows = made()
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"rep": F.lit(1), "h": F.lit(2), "prefix": F.lit(3)})
    got = [tuple(r) for r in s.similar_records(frame, 0.6, 4, **options).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 0.6, 4)


def test_links_count_without_expansion(spark):
    rows = made()
    want = brute(rows, 0.6, 4)
    got = {r["id"]: r for r in s.linked_records(spark.createDataFrame(rows, SCHEMA)).collect()}
    sets = {i: clean(t) for i, t in rows if i}
    for i, r in got.items():
        partners = {b if a == i else a for a, b in want if i in (a, b)}
        assert r["links"] == sum(sets[x] != sets[i] for x in partners) and r["copies"] == 1 + sum(sets[x] == sets[i] for x in partners)


def test_two_tables(spark):
    left = spark.createDataFrame([("1", ["a", "b", "c"]), ("2", ["x"])], SCHEMA)
    right = spark.createDataFrame([("1", ["A", "b", "c "]), ("3", ["a", "b", "c", "d"]), ("4", ["q"])], SCHEMA)
    assert {tuple(r) for r in s.similar_between(left, right, 0.6).collect()} == {("1", "1"), ("1", "3")}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert s.similar_records(none).count() == 0 and s.linked_records(none).count() == 0


def test_trees():
    assert s.trees_for(0.6, 3, 0.9999) == 38 and s.trees_for(1.0, 5, 0.99) == 1


def test_candidates_are_never_dropped_by_sizes_and_bits():
    import numpy as np

    rng = random.Random(3)
    for _ in range(3000):
        x = set(rng.sample(range(10**6), rng.randrange(1, 90)))
        y = set(rng.sample(sorted(x), rng.randrange(1, len(x) + 1))) | set(rng.sample(range(10**6), rng.randrange(3)))
        places = {t: rng.randrange(64) for t in x | y}
        bits = [np.array([sum({1 << places[t] for t in z})], dtype=np.uint64).view(np.int64) for z in (x, y)]
        h = [np.array([(rng.randrange(1 << 40) << 8) | min(len(z), 255)], dtype=np.int64) for z in (x, y)]
        fits = s._fitting(h[0], bits[0], h[1], bits[1], 0.6)[0]
        assert fits or len(x & y) < 0.6 * len(x | y)


def test_places_have_the_order_of_the_values():
    import numpy as np

    hashes = np.arange(1, 4001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    starts = np.arange(0, 4000, 4)
    deep, flat = (s.signatures(hashes, starts, 5, d, 1) for d in (3, 1))
    for t in range(5):
        order = np.argsort(deep[:, t])
        assert (np.diff(flat[order, t]) >= 0).all() and (deep[:, t] > 0).all() or t == 0


def test_crowded_neighbourhoods_over_several_batches(spark):
    """Thousands of sets that share most tokens: held rows, crowds, tiles; every pair against brute force."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        rows = [(f"q{i:04}", [f"core{j}" for j in range(8)] + [f"own{i % 90}", f"x{i % 7}"]) for i in range(180)] + [(f"z{i:03}", [f"v{i}", "a", "b", "c"]) for i in range(60)]
        frame = spark.createDataFrame(rows, SCHEMA)
        got = {tuple(r) for r in s.similar_records(frame, 0.6, 4, neighbourhood=20).collect()}
        assert got == brute(rows, 0.6, 4) and len(got) > 16_000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_hot_places_by_sample(spark, monkeypatch):
    monkeypatch.setattr(s, "SAMPLE", 50)
    rows = made()
    got = {tuple(r) for r in s.similar_records(spark.createDataFrame(rows, SCHEMA), 0.6, 4, neighbourhood=3).collect()}
    assert got == brute(rows, 0.6, 4)
