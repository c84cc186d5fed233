"""Most similar vectors for every vector, by a permutation index.

Pivots are drawn from a bounded sample. Each vector is represented by its PREFIX nearest pivots in order, and posted in
the inverted files of its POSTS nearest ones. Within a file, the others are ranked by the footrule distance of their
prefixes, and those that come first, a share of the file and all of equal rank, are compared by exact distance. The share
makes their number grow with the file, so that recall doesn't fall as files get longer; a share of 1 compares whole files.
The k best of all its files are the vector's neighbours.
A file that is too long is split by a second pivot of the prefix, and what is still too long goes in tiles.

Exact copies are one vector until the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetrank.functions.runtime import cut, ship, wide

POSTS = 3
PREFIX = 5
#: Pivots per root of the number of vectors, and the bounds of their number: files then have some POSTS * sqrt(N) /
#: DENSITY vectors, and the work grows as N to the power 1.5 until the most pivots are reached.
DENSITY = 8
PIVOTS = (32, 8192)
#: Most vectors of a file that one task compares with each other.
FILE = 2000
#: Share of a file's vectors that are compared exactly, and how many they are at least.
RERANK, RERANK_LEAST = 0.1, 64


def usable(vector: Column, size: int) -> Column:
    """Exactly `size` finite values, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) == size) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _prefixes(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    out = np.empty((len(vectors), length), dtype=np.int32)
    norms = (pivots**2).sum(axis=1)
    for a in range(0, len(vectors), 2048):
        d = norms[None] - 2 * vectors[a : a + 2048] @ pivots.T
        near = np.argpartition(d, length - 1, axis=1)[:, :length]
        order = np.argsort(np.take_along_axis(d, near, axis=1), axis=1, kind="stable")
        out[a : a + 2048] = np.take_along_axis(near, order, axis=1)
    return out


def _ones(prefixes: np.ndarray) -> np.ndarray:
    """Of each prefix, for each pivot and each length t, whether the pivot is among the first t: the footrule distance
    of two prefixes, where a missing pivot counts as one behind the last, falls by 2 for each of these they share."""
    n, length = prefixes.shape
    _, column, count = np.unique(prefixes, return_inverse=True, return_counts=True)
    # A pivot of one prefix only is shared by none.
    place = np.where(count > 1, np.cumsum(count > 1) - 1, -1)[column.reshape(n, length)]
    out = np.zeros((n, int((count > 1).sum()), length), dtype=np.float32)
    for i in range(length):
        some = np.flatnonzero(place[:, i] >= 0)
        out[some, place[some, i], i:] = 1
    return out.reshape(n, -1)


def _neighbours(ids: np.ndarray, vectors: np.ndarray, prefixes: np.ndarray, left: np.ndarray, right: np.ndarray, k: int, rerank: float) -> pd.DataFrame:
    """For each of `left` (positions), the k nearest of `right` that are compared; of equally near ones the first."""
    rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = len(right)
    compared = size if rerank >= 1 else min(size, max(RERANK_LEAST, k + 1, int(np.ceil(rerank * size))))
    ones = _ones(prefixes) if compared < size else None
    squares = (vectors**2).sum(axis=1)
    others = vectors[right]
    slack = 1e-9 * squares.max()
    block = max(1, 1_000_000 // size)
    for a in range(0, len(left), block):
        some = left[a : a + block]
        # The distances of a block are one matrix product, which costs less than picking the candidates out of it.
        d = squares[right] + squares[some][:, None] - 2 * vectors[some] @ others.T
        d[some[:, None] == right[None]] = np.inf
        if ones is not None:
            shared = ones[some] @ ones[right].T
            # Of equal footrule distances all are candidates.
            d[shared < np.partition(shared, size - compared, axis=1)[:, size - compared : size - compared + 1]] = np.inf
        # Products round: what may be among the k nearest candidates is measured again by differences.
        n = min(k, size)
        at, of = np.nonzero(np.isfinite(d) & (d <= np.partition(d, n - 1, axis=1)[:, n - 1 : n] + slack))
        q, c = some[at], right[of]
        exact = np.sqrt(((vectors[q] - vectors[c]) ** 2).sum(axis=1))
        order = np.lexsort((c, exact, q))
        q, c, exact = q[order], c[order], exact[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        rows.append((q[first], c[first], exact[first]))
    q, c, d = (np.concatenate(x) for x in zip(*rows))
    return pd.DataFrame({"q": ids[q], "c": ids[c], "d": d})


def neighbours(vectors: DataFrame, k: int, posts: int = POSTS, prefix: int = PREFIX, pivots: int | None = None, file: int = FILE, rerank: float = RERANK) -> DataFrame:
    """(q, near ARRAY<STRUCT<d, c>>): for each vector its k nearest others found, nearest first; equal ones by key.

    vectors: key STRING, v ARRAY<DOUBLE>, all usable, of one length, distinct keys and distinct vectors. rerank: share
    of a file that is compared exactly; 1 compares whole files.
    """
    n = vectors.count()
    pivots = pivots or int(np.clip(DENSITY * np.sqrt(n), *PIVOTS))
    sample = vectors.orderBy(F.xxhash64("key"), "key").limit(pivots).select("v").toPandas()
    matrix = np.array(sample["v"].tolist(), dtype=float)
    if not len(matrix):
        return vectors.selectExpr("key q", "cast(null as array<struct<d:double,c:string>>) near")
    prefix = min(prefix, len(matrix))
    posts = min(posts, prefix)
    at_pivots = vectors.sparkSession.sparkContext.broadcast(matrix)

    def represent(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                v = np.array(frame["v"].tolist(), dtype=float)
                found = _prefixes(v, at_pivots.value, prefix)
                yield pd.DataFrame({"key": frame["key"], "v": [x.tobytes() for x in v], "p": found.tolist()})

    indexed = cut(wide(vectors, "key").mapInPandas(represent, "key string, v binary, p array<int>"))
    posted = indexed.select("key", "v", "p", F.explode(F.slice("p", 1, posts)).alias("file"))
    # One row a pivot, and the pivots are bounded.
    sizes = {r["file"]: r["count"] for r in posted.groupBy("file").count().where(F.col("count") > file).collect()}
    posted = posted.withColumn("second", F.lit(-1))
    if sizes:
        long = F.col("file").isin(sorted(sizes))
        split = posted.where(long).withColumn("second", F.explode(F.array_except("p", F.array("file"))))
        posted = posted.where(~long).unionByName(split)
        # Only files of long pivots are counted again: at most POSTS * N / `file` of them times the pivots.
        tiles = split.groupBy("file", "second").agg(F.ceil(F.count("*") / file).cast("int").alias("tiles")).where("tiles > 1")
        posted = posted.join(F.broadcast(tiles) if pivots * len(sizes) < 200_000 else tiles, ["file", "second"], "left")
        posted = posted.withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        posted = posted.withColumn("own", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int")).withColumn(
            "other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
        )
        posted = posted.select("file", "second", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "key", "v", "p")
    else:
        posted = posted.selectExpr("file", "second", "0 a", "0 b", "0 own", "key", "v", "p")

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"q": pd.Series(dtype=str), "c": pd.Series(dtype=str), "d": pd.Series(dtype=float)})
        if len(frame) < 2:
            return none
        frame = frame.sort_values("key", ignore_index=True)
        ids = frame["key"].to_numpy()
        v = np.frombuffer(b"".join(frame["v"]), dtype=float).reshape(len(ids), -1)
        p = np.array(frame["p"].tolist(), dtype=np.int32)
        own = frame["own"].to_numpy()
        left, right = np.flatnonzero(own == frame["a"].iat[0]), np.flatnonzero(own == frame["b"].iat[0])
        if not len(left) or not len(right):
            return none
        if frame["a"].iat[0] == frame["b"].iat[0]:
            return _neighbours(ids, v, p, left, left, k, rerank)
        return pd.concat([_neighbours(ids, v, p, left, right, k, rerank), _neighbours(ids, v, p, right, left, k, rerank)])

    cell = ["file", "second", "a", "b"]
    found = wide(posted, *cell).groupBy(*cell).applyInPandas(search, "q string, c string, d double")
    # At most k rows of each file that a vector is posted in: a bounded list.
    return found.groupBy("q").agg(F.slice(F.array_sort(F.collect_set(F.struct("d", "c"))), 1, k).alias("near"))


def near_terms(dictionary: DataFrame, k: int = 3, most: float = 1.0, size: int = 50, **index: float) -> DataFrame:
    """(term_a, term_b), smaller term first: one is among the k nearest of the other and they are at most `most` apart.

    dictionary: term STRING, lda_vector ARRAY<DOUBLE>. Null terms and unusable vectors are left out; repeated rows
    count once; of several vectors of a term the least counts. Terms with the very same vector are at distance 0 of
    each other; of equally near terms those first in order count. Other columns are ignored.
    """
    terms = (
        dictionary.where(F.col("term").isNotNull() & usable(F.col("lda_vector"), size))
        .select("term", F.transform("lda_vector", lambda x: x + 0.0).alias("v"))
        .groupBy("term")
        .agg(F.min("v").alias("v"))
    )
    copies = Window.partitionBy("v").orderBy("term")
    # The k + 1 first terms of each vector are all that a ranking of k can need of it.
    heads = (
        terms.withColumn("place", F.row_number().over(copies))
        .where(F.col("place") <= k + 1)
        .groupBy("v")
        .agg(F.min("term").alias("key"), F.array_sort(F.collect_list("term")).alias("terms"))
    )
    heads = cut(heads)
    lists = heads.select("key", "terms")
    found = neighbours(heads.select("key", "v"), k, **index)
    near = found.select("q", F.explode("near").alias("n")).selectExpr("q key", "n.d d", "n.c c")
    others = near.join(lists.selectExpr("key c", "terms theirs"), "c").select("key", "d", F.explode("theirs").alias("other"))
    own = lists.select("key", F.lit(0.0).alias("d"), F.explode("terms").alias("other"))
    offered = others.unionByName(own).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("d", "other"))).alias("offers"))
    # Every term of a vector, not only the first ones, gets its k nearest from the vector's offers.
    of_first = lists.select("key", F.explode("terms").alias("term"))
    more = terms.withColumn("place", F.row_number().over(copies)).where(F.col("place") > k + 1).select("term", "v")
    of_more = more.join(heads.select("key", "v"), "v").select("key", "term")
    ranked = of_first.unionByName(of_more).join(offered, "key")
    kept = F.slice(F.filter("offers", lambda o: o["other"] != F.col("term")), 1, k)
    pairs = ranked.select("term", F.explode(kept).alias("o")).where(F.col("o.d") <= most)
    return pairs.select(F.least("term", "o.other").alias("term_a"), F.greatest("term", "o.other").alias("term_b")).distinct()


ship(__name__)
