"""All pairs of records whose token sets overlap above a threshold, by sorted sketch forests.

Each of many independent trees orders the sets lexicographically by its own sequence of minhash values: a number whose
leading bits are the tree and whose further bits are the values in turn, so that order of numbers is that order. Sets with
a common prefix of values lie side by side there. A round sorts all trees at once and reads them in order; it compares the
sets within each neighbourhood of one prefix length, in as many trees as the wanted recall needs at that length (the
probability of sharing a prefix of length p in one tree is J to the power p). Sets in a neighbourhood too large to compare
go on to the next round, at a longer prefix and in more trees. What is too large in the last round is compared in tiles.
Candidates are verified exactly.

Equal sets are one set until the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetrank.functions.runtime import cut, ship, wide
from facetrank.functions.skew import HEAVY_PARTS, twins
from facetrank.functions.text import clean_tokens

RECALL = 0.9999
DEPTH = 3
DEEPEST = 8
#: Largest neighbourhood that is compared as a whole.
NEIGHBOURHOOD = 5000
#: Sets by which it is estimated, where there are more, which neighbourhoods hold so many that one task shouldn't read them.
SAMPLE = 100_000


def trees_for(similarity: float, depth: int, recall: float) -> int:
    """Trees in which a pair of that similarity shares a prefix of `depth` at least once, with probability `recall`."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**depth))) if similarity < 1 else 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(hashes: np.ndarray, starts: np.ndarray, trees: int, depth: int, seed: int) -> np.ndarray:
    """Place of each set in the order of each tree, sets x trees: the tree's number, then the minhash values in turn.

    hashes: 64-bit token hashes, set after set. A value keeps as many bits as fit; sets that agree in these by chance
    are candidates in vain.
    """
    bits = (63 - trees.bit_length()) // depth
    out = np.empty((len(starts), trees), dtype=np.int64)
    with np.errstate(over="ignore"):
        for t in range(trees):
            place = np.full(len(starts), t, dtype=np.uint64)
            for d in range(depth):
                salt = _mixed(np.array([seed * 1_000_003 + t * 1009 + d], dtype=np.uint64))
                least = np.minimum.reduceat(_mixed(hashes ^ salt), starts)
                place = (place << np.uint64(bits)) | (_mixed(least) >> np.uint64(64 - bits))
            out[:, t] = place.view(np.int64)
    return out


def _posts(sets: DataFrame, trees: int, depth: int, seed: int, hot: np.ndarray | None = None) -> DataFrame:
    """(place, h, bits): one row a set and tree. Those of `hot` places get negative ones instead, all different."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            starts = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))[:-1]]).astype(np.int64)
            places = signatures(flat, starts, trees, depth, seed)
            if hot is not None and len(hot):
                h = batch.column(0).to_numpy()[:, None]
                places = np.where(np.isin(places, hot), np.minimum(h, ~h), places)
            for t in range(trees):
                yield pa.RecordBatch.from_arrays([pa.array(places[:, t]), batch.column(0), batch.column(1)], names=["place", "h", "bits"])

    hashed = sets.select("h", "bits", F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes"))
    return hashed.mapInArrow(run, "place long, h long, bits long")


def _fitting(h_a: np.ndarray, bits_a: np.ndarray, h_b: np.ndarray, bits_b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether two sets can be similar, by their sizes (255 may be more) and by bits that only one of them has."""
    size_a, size_b = h_a & 255, h_b & 255
    # Of negative numbers, numpy counts the bits of the absolute value.
    only_a, only_b = (np.bitwise_count((x & ~y).view(np.uint64)).astype(np.int64) for x, y in ((bits_a, bits_b), (bits_b, bits_a)))
    most = np.minimum(size_a - only_a, size_b - only_b)
    return (np.maximum(size_a, size_b) == 255) | (most * (1 + similarity) >= (size_a + size_b) * similarity - 1e-9)


def _compared(posts: DataFrame, similarity: float, neighbourhood: int) -> DataFrame:
    """(a, b, place): candidates a < b of neighbourhoods, and with b null each set of a neighbourhood that is too large.

    posts: in each partition sorted by place, all of a place in one. At most a neighbourhood and a batch are held.
    """

    def table(a: np.ndarray, b: np.ndarray | None, place: np.ndarray | None) -> pa.RecordBatch:
        n = len(a)
        columns = [pa.array(a), pa.nulls(n, pa.int64()) if b is None else pa.array(b), pa.nulls(n, pa.int64()) if place is None else pa.array(place)]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "place"])

    def whole(place: np.ndarray, h: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Neighbourhoods that are complete."""
        if not len(place):
            return
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        sizes = np.diff(np.append(first, len(place)))
        many = np.repeat(sizes > neighbourhood, sizes)
        if many.any():
            yield table(h[many], None, place[many])
        end = np.repeat(first + sizes, sizes)
        at = np.flatnonzero(~many & (np.arange(len(place)) + 1 < end))
        for step in range(1, neighbourhood):
            at = at[at + step < end[at]]
            if not len(at):
                return
            other = at + step
            fits = _fitting(h[at], bits[at], h[other], bits[other], similarity) & (h[at] != h[other])
            if fits.any():
                a, b = h[at[fits]], h[other[fits]]
                yield table(np.minimum(a, b), np.maximum(a, b), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        crowd = None
        for batch in batches:
            rows = [batch.column(i).to_numpy() for i in range(3)]
            single = rows[0] < 0
            if single.any():
                yield table(rows[1][single], None, rows[0][single])
                rows = [x[~single] for x in rows]
            if crowd is not None and len(rows[0]):
                more = rows[0] == crowd
                if more.any():
                    yield table(rows[1][more], None, rows[0][more])
                if more.all():
                    continue
                rows, crowd = [x[~more] for x in rows], None
            rows = [np.concatenate([x, y]) for x, y in zip(held, rows)]
            if not len(rows[0]):
                continue
            start = int(np.searchsorted(rows[0], rows[0][-1]))
            yield from whole(*(x[:start] for x in rows))
            held = [x[start:] for x in rows]
            if len(held[0]) > neighbourhood:
                crowd = held[0][0]
                yield table(held[1], None, held[0])
                held = [np.zeros(0, np.int64)] * 3
        yield from whole(*held)

    return posts.mapInArrow(run, "a long, b long, place long")


def _tiled(crowded: DataFrame, bits: DataFrame, similarity: float, neighbourhood: int) -> DataFrame:
    """(a, b): candidates of neighbourhoods (place, a) of any size, in tiles of about `neighbourhood` sets."""
    tiles = crowded.groupBy("place").agg(F.ceil(F.count("*") / neighbourhood).cast("int").alias("tiles"))
    rows = crowded.select("place", F.col("a").alias("h")).join(bits, "h").join(tiles, "place").withColumn("own", F.pmod(F.xxhash64("h"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("place", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "h", "bits")
    x, y = (rows.where(F.col("own") == F.col(at)).selectExpr("place", "lo", "hi", f"h h_{s}", f"h & 255 size_{s}", f"bits bits_{s}") for s, at in (("a", "lo"), ("b", "hi")))
    most = F.expr("least(size_a - bit_count(bits_a & ~bits_b), size_b - bit_count(bits_b & ~bits_a))")
    fitting = (F.greatest("size_a", "size_b") == 255) | (most * (1 + similarity) >= (F.col("size_a") + F.col("size_b")) * similarity - 1e-9)
    pairs = x.join(y, ["place", "lo", "hi"]).where("(lo < hi and h_a <> h_b) or h_a < h_b").where(fitting)
    return pairs.select(F.least("h_a", "h_b").alias("a"), F.greatest("h_a", "h_b").alias("b"))


def similar_sets(sets: DataFrame, similarity: float, recall: float = RECALL, depth: int = DEPTH, neighbourhood: int = NEIGHBOURHOOD) -> DataFrame:
    """(rep_a, rep_b, common, size_a, size_b), rep_a < rep_b: pairs of different sets with Jaccard >= `similarity`.

    sets: rep STRING, tokens ARRAY<STRING> (distinct, not empty), each set once.
    """
    # What goes through the trees is a number: a hash of rep, whose last byte is the set's size (255 and more alike).
    # Should two hashes be equal, both their sets are verified.
    size = F.least(F.size("tokens"), F.lit(255)).cast("bigint")
    sets = sets.withColumn("h", F.shiftleft(F.xxhash64("rep"), 8).bitwiseOR(size))
    # One bit of 64 for each token. A bit that only one of two sets has is a token that the other lacks.
    bits = F.expr("aggregate(tokens, 0L, (s, t) -> s | shiftleft(1L, cast(pmod(xxhash64(t), 64L) as int)))")
    sets = sets.withColumn("bits", bits)
    left, n = wide(sets, "h"), sets.count()
    found: DataFrame | None = None
    while True:
        last = depth >= DEEPEST
        trees = trees_for(similarity, depth, recall)
        hot = None
        if not last and n > SAMPLE:
            # Only where rows go depends on the sample: sets of a place that is taken as hot go on to the next round.
            parts = n // SAMPLE
            some = _posts(left.where(F.pmod("h", F.lit(parts * 256)) < 256), trees, depth, depth)
            often = some.groupBy("place").count().where(F.col("count") * parts > F.lit(max(neighbourhood, n // HEAVY_PARTS)))
            hot = np.array([r["place"] for r in often.select("place").collect()], dtype=np.int64)
        posts = wide(_posts(left, trees, depth, depth, hot), "place").sortWithinPartitions("place")
        out = cut(_compared(posts, similarity, neighbourhood))
        pairs = out.where("b is not null").select("a", "b")
        crowded = out.where("b is null").select("place", "a")
        if last:
            pairs = pairs.unionByName(_tiled(crowded, sets.select("h", "bits"), similarity, neighbourhood))
        found = pairs if found is None else found.unionByName(pairs)
        crowded = crowded.select(F.col("a").alias("h")).distinct()
        if last or crowded.isEmpty():
            break
        left = cut(left.join(crowded, "h", "left_semi"))
        n = left.count()
        depth += 1
    found = found.selectExpr("a h_a", "b h_b")
    x, y = (sets.selectExpr(f"h h_{s}", f"rep rep_{s}", f"tokens tokens_{s}") for s in "ab")
    ordered = F.col("rep_a") < F.col("rep_b")
    pick = lambda name, s, t: F.when(ordered, F.col(f"{name}_{s}")).otherwise(F.col(f"{name}_{t}"))
    verified = (
        found.distinct()
        .join(x, "h_a")
        .join(y, "h_b")
        .select(
            pick("rep", "a", "b").alias("rep_a"),
            pick("rep", "b", "a").alias("rep_b"),
            F.size(F.array_intersect("tokens_a", "tokens_b")).alias("common"),
            F.size(pick("tokens", "a", "b")).alias("size_a"),
            F.size(pick("tokens", "b", "a")).alias("size_b"),
        )
    )
    union = F.col("size_a") + F.col("size_b") - F.col("common")
    return verified.where(F.col("common") >= union * similarity - 1e-9)


def sets_of(records: DataFrame, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(members: id, rep; sets: rep, tokens) of the ids with at least `least` clean tokens.

    records: id STRING, tokens ARRAY<STRING>. Null ids are left out; an id counts once; of several sets of an id the
    greatest in order counts; an empty table gives empty tables; other columns are ignored. rep is the least id of
    those that have the same set.
    """
    of_ids = (
        records.where("id is not null")
        .select("id", clean_tokens(F.col("tokens")).alias("tokens"))
        .where(F.size("tokens") >= least)
        .groupBy("id")
        .agg(F.max("tokens").alias("tokens"))
    )
    of_ids = cut(of_ids)
    sets = cut(of_ids.groupBy("tokens").agg(F.min("id").alias("rep")))
    members = of_ids.join(sets, "tokens").select("id", "rep")
    return members, sets


def similar_records(records: DataFrame, similarity: float = 0.6, least: int = 4, **forest: float) -> DataFrame:
    """(id_a, id_b), smaller id first: different ids whose clean token sets have Jaccard >= `similarity`."""
    members, sets = sets_of(records, least)
    members = cut(members)
    pairs = similar_sets(sets, similarity, **forest).select("rep_a", "rep_b")
    a, b = (members.selectExpr(f"id id_{s}", f"rep rep_{s}") for s in "ab")
    across = pairs.join(a, "rep_a").join(b, "rep_b").select("id_a", "id_b")
    same = twins(members, "rep", "id").selectExpr("a id_a", "b id_b")
    return across.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).unionByName(same)


def linked_records(records: DataFrame, similarity: float = 0.6, least: int = 4, **forest: float) -> DataFrame:
    """(id, rep, copies, links): each id with its class of equal sets, the class's size and the number of ids of other
    classes that it is similar to. Copies aren't expanded into pairs."""
    members, sets = sets_of(records, least)
    members = cut(members)
    sizes = members.groupBy("rep").agg(F.count("*").alias("copies"))
    pairs = similar_sets(sets, similarity, **forest).select("rep_a", "rep_b")
    both = pairs.unionByName(pairs.selectExpr("rep_b rep_a", "rep_a rep_b"))
    links = (
        both.join(sizes.selectExpr("rep rep_b", "copies"), "rep_b")
        .groupBy(F.col("rep_a").alias("rep"))
        .agg(F.sum("copies").alias("links"))
    )
    return (
        members.join(sizes, "rep")
        .join(links, "rep", "left")
        .select("id", "rep", "copies", F.coalesce("links", F.lit(0).cast("bigint")).alias("links"))
    )


def similar_between(left: DataFrame, right: DataFrame, similarity: float = 0.6, least: int = 1, **forest: float) -> DataFrame:
    """(id_l, id_r): records of two tables whose clean token sets have Jaccard >= `similarity`."""
    marked = left.select(F.concat(F.lit("l"), "id").alias("id"), "tokens").unionByName(
        right.select(F.concat(F.lit("r"), "id").alias("id"), "tokens")
    )
    members, sets = sets_of(marked, least)
    members = cut(members)
    pairs = similar_sets(sets, similarity, **forest).select("rep_a", "rep_b")
    both = pairs.unionByName(pairs.selectExpr("rep_b rep_a", "rep_a rep_b")).unionByName(sets.selectExpr("rep rep_a", "rep rep_b"))
    l = members.where("id like 'l%'").selectExpr("substring(id, 2) id_l", "rep rep_a")  # noqa: E741
    r = members.where("id like 'r%'").selectExpr("substring(id, 2) id_r", "rep rep_b")
    return both.join(l, "rep_a").join(r, "rep_b").select("id_l", "id_r")


ship(__name__)
