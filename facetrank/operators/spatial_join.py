"""Points near points and points in areas, over a quadtree drawn from a sample.

The plane is cut into quadtree leaves that hold about equally many points of a bounded sample. Every point is sent
to the leaves that its box of half the distance touches; every area to the leaves that its bounding box touches.
Inside a leaf an R-tree is bulk-loaded over the points and probed with the boxes; what it finds is refined exactly.
A pair of points meets in every leaf that both boxes touch, and is reported only by the leaf that holds the
lower left corner of the boxes' common part (its reference point).

Points at the very same place are one location until the end, so that a place with very many of them costs one
location; leaves that cannot be cut any further are processed in tiles of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetrank.functions.runtime import cut, ship, wide
from facetrank.functions.skew import lookup, twins

#: Leaves are drawn from a sample to hold about LEAF points each, at most LEAVES of them before clusters are cut finer
#: (beyond a billion points they hold more, up to TILE at some 10 billion).
LEAF = 4000
LEAVES = 250_000
#: Sampled points that come to the driver: SAMPLE, or SAMPLED for each leaf, so two million (of 16 bytes) at most.
SAMPLE = 20_000
SAMPLED = 8
#: Cells of the finest quadtree level are numbered by Morton codes of 2 * DEPTH bits.
DEPTH = 26
#: Most points of a leaf that one task joins with each other; a fuller leaf is tiled.
TILE = 50_000
#: Distances are compared with this slack, which covers the rounding of coordinates of up to 180.
SLACK = 1e-12
FANOUT = 16


class Quadtree:
    """Leaves as intervals of Morton codes; the first code of each, ascending."""

    def __init__(self, xs: np.ndarray, ys: np.ndarray, side: float, leaves: int) -> None:
        """side: no leaf gets narrower than this, so that a box of that side touches no more than four leaves."""
        self.x0 = float(xs.min()) - side if len(xs) else 0.0
        self.y0 = float(ys.min()) - side if len(ys) else 0.0
        span = max(float(np.ptp(xs)), float(np.ptp(ys))) + 2 * side if len(xs) else 1.0
        self.width = span if span > 0 else 1.0
        deepest = DEPTH if side <= 0 else int(np.clip(np.floor(np.log2(self.width / side)), 0, DEPTH))
        codes = np.sort(self.codes(xs, ys))
        capacity = max(1, len(codes) // leaves)
        starts: list[int] = []
        todo = [(0, 0)]
        while todo:
            first, level = todo.pop()
            size = 1 << (2 * (DEPTH - level))
            held = np.searchsorted(codes, first + size) - np.searchsorted(codes, first)
            if level < deepest and held > capacity:
                todo += [(first + i * size // 4, level + 1) for i in range(4)]
            else:
                starts.append(first)
        self.starts = np.array(sorted(starts), dtype=np.int64)

    def grid(self, xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scale = (1 << DEPTH) / self.width
        top = (1 << DEPTH) - 1
        return tuple(
            np.clip(np.floor((v - v0) * scale), 0, top).astype(np.int64) for v, v0 in ((xs, self.x0), (ys, self.y0))
        )

    def codes(self, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
        def gaps(v: np.ndarray) -> np.ndarray:
            for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
                v = (v | (v << shift)) & mask
            return v

        gx, gy = self.grid(np.asarray(xs, float), np.asarray(ys, float))
        return gaps(gx) | (gaps(gy) << 1)

    def leaf(self, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, self.codes(xs, ys), side="right") - 1

    def boxes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Least and greatest grid numbers of each leaf in x and y."""

        def every_second(v: np.ndarray) -> np.ndarray:
            v = v & 0x5555555555555555
            for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
                v = (v | (v >> shift)) & mask
            return v

        gx, gy = every_second(self.starts), every_second(self.starts >> 1)
        ends = np.append(self.starts[1:], 1 << (2 * DEPTH))
        side = np.sqrt((ends - self.starts).astype(float)).astype(np.int64)
        return gx, gx + side - 1, gy, gy + side - 1

    def touched(self, x1: float, y1: float, x2: float, y2: float) -> np.ndarray:
        """Leaves that a box touches."""
        (ax, bx), (ay, by) = self.grid(np.array([x1, x2]), np.array([y1, y2]))
        lx, hx, ly, hy = self.boxes()
        return np.flatnonzero((lx <= bx) & (hx >= ax) & (ly <= by) & (hy >= ay))


class RTree:
    """Points packed by sort-tile-recursive loading; levels of bounding boxes from the root down."""

    def __init__(self, xs: np.ndarray, ys: np.ndarray) -> None:
        n = len(xs)
        strips = max(1, int(np.ceil(np.sqrt(np.ceil(n / FANOUT)))))
        by_x = np.argsort(xs, kind="stable")
        strip = np.empty(n, dtype=np.int64)
        strip[by_x] = np.arange(n) * strips // max(1, n)
        self.order = np.lexsort((ys, strip))
        self.xs, self.ys = xs[self.order], ys[self.order]
        self.levels: list[np.ndarray] = []
        box = np.stack([self.xs, self.ys, self.xs, self.ys], axis=1)
        while len(box) > 1:
            cuts = np.arange(0, len(box), FANOUT)
            box = np.concatenate(
                [np.minimum.reduceat(box[:, :2], cuts, axis=0), np.maximum.reduceat(box[:, 2:], cuts, axis=0)], axis=1
            )
            self.levels.insert(0, box)

    def probe(self, boxes: np.ndarray, block: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number of the box, number of the point) for each point inside a box, block by block of boxes."""
        for start in range(0, len(boxes), block):
            some = boxes[start : start + block]
            q = np.arange(len(some))
            node = np.zeros(len(some), dtype=np.int64)
            for depth, level in enumerate([*self.levels, None]):
                if depth:
                    q, node = np.repeat(q, FANOUT), (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                    there = node < (len(self.xs) if level is None else len(level))
                    q, node = q[there], node[there]
                at = (
                    level[node]
                    if level is not None
                    else np.stack([self.xs[node], self.ys[node], self.xs[node], self.ys[node]], axis=1)
                )
                b = some[q]
                hit = (at[:, 0] <= b[:, 2]) & (at[:, 2] >= b[:, 0]) & (at[:, 1] <= b[:, 3]) & (at[:, 3] >= b[:, 1])
                q, node = q[hit], node[hit]
            yield q + start, self.order[node]


def rings(wkt: str | None) -> list[np.ndarray]:
    """All rings of a POLYGON or MULTIPOLYGON; none for any other text."""
    if not wkt or not re.match(r"(?i)\s*(?:SRID\s*=\s*\d+\s*;\s*)?(?:MULTI)?POLYGON\s*\(", wkt):
        return []
    found = []
    for ring in re.findall(r"\(([^()]+)\)", wkt):
        try:
            points = np.array([[float(v) for v in p.split()[:2]] for p in ring.split(",")])
        except ValueError:
            return []
        if points.ndim == 2 and points.shape[1] == 2 and len(points) >= 3:
            found.append(points)
    return found


def inside(ring_list: list[np.ndarray], xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Even-odd rule over all rings: inside a shell and not in a hole. A point on an edge isn't inside."""
    odd = np.zeros(len(xs), dtype=bool)
    edge = np.zeros(len(xs), dtype=bool)
    for ring in ring_list:
        if (ring[0] != ring[-1]).any():
            ring = np.vstack([ring, ring[:1]])
        for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:]):
            cross = (x2 - x1) * (ys - y1) - (y2 - y1) * (xs - x1)
            spans = (y1 > ys) != (y2 > ys)
            odd ^= spans & ((cross > 0) == (y2 > y1))
            edge |= (
                (cross == 0)
                & (xs >= min(x1, x2)) & (xs <= max(x1, x2))
                & (ys >= min(y1, y2)) & (ys <= max(y1, y2))
            )
    return odd & ~edge


def draw(points: DataFrame, side: float, sample: int = SAMPLE, leaf: int = LEAF) -> Quadtree:
    """Quadtree from a sample of distinct locations (columns x, y), taken by a hash: uniform, and the same in any run."""
    n = points.count()
    leaves = min(LEAVES, max(4, n // leaf))
    wanted = max(sample, SAMPLED * leaves)
    rows = points.select("x", "y")
    if n > wanted:
        rows = rows.where(F.pmod(F.xxhash64("x", "y"), F.lit(1 << 40)) < int(wanted / n * (1 << 40)))
    found = rows.toPandas()
    return Quadtree(found["x"].to_numpy(float), found["y"].to_numpy(float), side, leaves)


def _tiles(sent: DataFrame, tile: int) -> DataFrame:
    """The rows with `tiles`, the number of tiles of their leaf. Full leaves are a table of two numbers a row and at
    most as many rows as there are leaves (LEAVES, and those of clusters), so it is broadcast."""
    full = sent.groupBy("leaf").count().where(F.col("count") > tile).select("leaf", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    return sent.join(F.broadcast(full), "leaf", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))


def _locations(points: DataFrame) -> DataFrame:
    return points.select("x", "y").distinct()


def near_pairs(places: DataFrame, distance: float, tree: Quadtree | None = None, tile: int = TILE) -> DataFrame:
    """Pairs of distinct locations no farther apart than `distance`: (xa, ya, xb, yb), each pair once.

    places: columns x, y DOUBLE, finite, each location once.
    """
    tree = tree or draw(places, distance)
    half = distance / 2 * (1 + 1e-9) + 1e-9

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            xs, ys = frame["x"].to_numpy(), frame["y"].to_numpy()
            corners = np.stack([tree.leaf(xs + sx * half, ys + sy * half) for sx in (-1, 1) for sy in (-1, 1)], axis=1)
            corners.sort(axis=1)
            new = np.ones(corners.shape, dtype=bool)
            new[:, 1:] = corners[:, 1:] != corners[:, :-1]
            row, _ = np.nonzero(new)
            yield pd.DataFrame({"leaf": corners[new].astype("int64"), "x": xs[row], "y": ys[row]})

    sent = places.select("x", "y").mapInPandas(send, "leaf long, x double, y double")
    sent = _tiles(sent, tile)
    sent = (
        sent.withColumn("own", F.pmod(F.xxhash64("x", "y"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("leaf", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "x", "y")
    )

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        leaf, a, b = int(frame["leaf"].iat[0]), int(frame["a"].iat[0]), int(frame["b"].iat[0])
        xs, ys, own = frame["x"].to_numpy(), frame["y"].to_numpy(), frame["own"].to_numpy()
        left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
        found = [np.empty((0, 2), dtype=np.int64)]
        if len(left) and len(right):
            packed = RTree(xs[right], ys[right])
            reach = distance + SLACK
            boxes = np.stack([xs[left] - reach, ys[left] - reach, xs[left] + reach, ys[left] + reach], axis=1)
            for q, p in packed.probe(boxes):
                i, j = left[q], right[p]
                keep = np.hypot(xs[i] - xs[j], ys[i] - ys[j]) <= reach
                if a == b:
                    keep &= i < j
                i, j = i[keep], j[keep]
                corner = tree.leaf(np.maximum(xs[i], xs[j]) - half, np.maximum(ys[i], ys[j]) - half)
                found.append(np.stack([i, j], axis=1)[corner == leaf])
        i, j = np.concatenate(found).T
        return pd.DataFrame({"xa": xs[i], "ya": ys[i], "xb": xs[j], "yb": ys[j]})

    return wide(sent, "leaf", "a", "b").groupBy("leaf", "a", "b").applyInPandas(join, "xa double, ya double, xb double, yb double")


def containing(places: DataFrame, areas: DataFrame, tree: Quadtree | None = None) -> DataFrame:
    """(area_id, x, y) for each location inside an area, not in a hole and not on an edge.

    areas: area_id, geometry (WKT POLYGON or MULTIPOLYGON; rows that are no such text hold nothing).
    Each location goes to its one leaf; each area to the leaves that its bounding box touches.
    """
    tree = tree or draw(places, 0.0)

    def home(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            leaf = tree.leaf(frame["x"].to_numpy(), frame["y"].to_numpy()).astype("int64")
            yield pd.DataFrame({"leaf": leaf, "x": frame["x"], "y": frame["y"]})

    def cover(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, wkt in zip(frame["area_id"], frame["geometry"]):
                if key is not None and (r := rings(wkt)):
                    corners = np.concatenate(r)
                    leaves = tree.touched(*corners.min(axis=0), *corners.max(axis=0))
                    yield pd.DataFrame({"leaf": leaves.astype("int64"), "area_id": key, "geometry": wkt})

    at_home = places.select("x", "y").mapInPandas(home, "leaf long, x double, y double")
    covers = areas.select("area_id", "geometry").mapInPandas(cover, "leaf long, area_id string, geometry string")
    # A leaf's points go in slices to several tasks; each slice meets all areas of the leaf.
    at_home = _tiles(at_home, TILE)
    slices = at_home.groupBy("leaf").agg(F.max("tiles").alias("tiles")).where("tiles > 1")
    at_home = at_home.withColumn("slice", F.pmod(F.xxhash64("x", "y"), F.col("tiles")).cast("int"))
    covers = covers.join(F.broadcast(slices), "leaf", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)))

    def test(points: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"area_id": pd.Series(dtype=str), "x": pd.Series(dtype=float), "y": pd.Series(dtype=float)})]
        if len(points) and len(around):
            xs, ys = points["x"].to_numpy(), points["y"].to_numpy()
            packed = RTree(xs, ys)
            shapes = [rings(w) for w in around["geometry"]]
            boxes = np.array([[*np.concatenate(r).min(axis=0), *np.concatenate(r).max(axis=0)] for r in shapes])
            for q, p in packed.probe(boxes, block=64):
                order = np.argsort(q, kind="stable")
                q, p = q[order], p[order]
                for one in np.unique(q):
                    some = p[q == one]
                    some = some[inside(shapes[one], xs[some], ys[some])]
                    out.append(pd.DataFrame({"area_id": around["area_id"].iat[one], "x": xs[some], "y": ys[some]}))
        return pd.concat(out, ignore_index=True)

    return (
        wide(at_home, "leaf", "slice")
        .groupBy("leaf", "slice")
        .cogroup(wide(covers, "leaf", "slice").groupBy("leaf", "slice"))
        .applyInPandas(test, "area_id string, x double, y double")
    )


def _members(points: DataFrame) -> DataFrame:
    there = "id is not null and x is not null and y is not null and not isnan(x) and not isnan(y)"
    return cut(points.select("id", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y")).where(there).distinct())


def spatial_links(points: DataFrame, distance: float) -> DataFrame:
    """(id, x, y, copies, links): one row an id and place: how many ids are at that very place, itself included, and how
    many are at other places within the distance. Nothing is expanded into pairs of ids; an id with several places has
    a row for each. Points as in `spatial_pairs`."""
    members = _members(points)
    places = cut(members.groupBy("x", "y").agg(F.count("*").alias("copies")))
    near = near_pairs(places, distance)
    both = near.unionByName(near.selectExpr("xb xa", "yb ya", "xa xb", "ya yb"))
    links = both.join(places.selectExpr("x xb", "y yb", "copies"), ["xb", "yb"]).groupBy(F.col("xa").alias("x"), F.col("ya").alias("y")).agg(F.sum("copies").alias("links"))
    of_places = cut(places.join(links, ["x", "y"], "left").select(F.struct("x", "y").alias("place"), "copies", F.coalesce("links", F.lit(0).cast("bigint")).alias("links")))
    rows = lookup(members.select("id", "x", "y", F.struct("x", "y").alias("place")), "place", of_places, "copies", members.count())
    return rows.select("id", "x", "y", "copies", "links")


def spatial_pairs(points: DataFrame, areas: DataFrame | None, distance: float) -> DataFrame:
    """(id_a, id_b), smaller key first, each pair once: keys of points within `distance`, and (area, point inside it).

    points: id STRING, x DOUBLE, y DOUBLE. Rows with a null id or coordinate are left out; repeated rows count once;
    an id with several places pairs by any of them, never with itself. Empty tables give no rows. Other columns are
    ignored. areas: area_id, geometry.
    """
    members = _members(points)
    places = _locations(members)
    tree = draw(places, distance)
    near = near_pairs(places, distance, tree)
    a, b = (members.selectExpr(f"id id_{s}", f"x x{s}", f"y y{s}") for s in "ab")
    apart = near.join(a, ["xa", "ya"]).join(b, ["xb", "yb"])
    same = twins(members.select(F.struct("x", "y").alias("place"), "id"), "place", "id")
    pairs = apart.select("id_a", "id_b").unionByName(same.selectExpr("a id_a", "b id_b"))
    if areas is not None:
        held = containing(places, areas, tree).join(members, ["x", "y"])
        pairs = pairs.unionByName(held.selectExpr("area_id id_a", "id id_b"))
    return (
        pairs.where("id_a <> id_b")
        .select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
        .distinct()
    )


ship(__name__)
