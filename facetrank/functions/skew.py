"""Joins and ranks that stay balanced when one key or group holds a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetrank.functions.runtime import cut

#: A key is heavy if it holds at least one part in HEAVY_PARTS of the rows that were counted, so that there are at
#: most HEAVY_PARTS heavy keys whatever the size of the data. This bounds what `lookup` broadcasts.
HEAVY_PARTS = 2000


def lookup(rows: DataFrame, key: str, keyed: DataFrame, weight: str, total: int) -> DataFrame:
    """Inner join of `rows` with `keyed` on `key`, without a skewed shuffle.

    `keyed` has one row a key, whose column `weight` says how many of the `total` rows have that key. Keys with at
    least total / HEAVY_PARTS rows are at most HEAVY_PARTS in number; they are broadcast, and their rows don't
    move. The others are joined by a shuffle in which no key has more than total / HEAVY_PARTS rows.
    """
    least = max(1, total // HEAVY_PARTS)
    if total <= HEAVY_PARTS:
        return rows.join(F.broadcast(keyed), key)
    heavy = keyed.where(F.col(weight) >= least)
    marked = rows.join(F.broadcast(heavy.select(key, F.lit(True).alias("_heavy"))), key, "left")
    of_heavy = marked.where("_heavy").drop("_heavy").join(F.broadcast(heavy), key)
    of_light = marked.where("_heavy is null").drop("_heavy").join(keyed.where(F.col(weight) < least), key)
    return of_heavy.unionByName(of_light)


def numbered(
    rows: DataFrame,
    group: Sequence[str],
    coarse: Column,
    fine: Sequence[Column],
    spread_by: Column,
    slices: int,
    as_name: str,
    weight: Column | None = None,
    ties: bool = False,
) -> DataFrame:
    """Running count (or running sum of `weight`) of each row within its group, without one task a group.

    Rows are ordered by `coarse` (a whole number with few distinct values, rising with the wanted order), then by
    slice, then by `fine`. Each (group, coarse, slice) is numbered on its own; a table of the sizes of these cells,
    which has no more rows than there are cells, gives each cell its start. With `slices` = 1 the order is exactly
    (coarse, fine). `ties` gives rows that are equal in `fine` the number of the last of them.
    """
    group = list(group)
    one = F.lit(1).cast("bigint") if weight is None else weight
    cells = rows.withColumns(
        {
            "_coarse": coarse.cast("bigint"),
            "_slice": F.pmod(spread_by, F.lit(slices)).cast("int") if slices > 1 else F.lit(0),
            "_one": one,
        }
    )
    cell = [*group, "_coarse", "_slice"]
    before = Window.partitionBy(*group).orderBy("_coarse", "_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cells.groupBy(*cell)
        .agg(F.sum("_one").alias("_size"))
        .withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0).cast("bigint")))
        .drop("_size")
    )
    inside = Window.partitionBy(*cell).orderBy(*fine)
    inside = (
        inside.rangeBetween(Window.unboundedPreceding, 0) if ties else inside.rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        cells.withColumn("_within", F.sum("_one").over(inside))
        .join(starts, cell)
        .withColumn(as_name, F.col("_start") + F.col("_within"))
        .drop("_coarse", "_slice", "_one", "_within", "_start")
    )


def twins(rows: DataFrame, key: str, value: str, size: int = 10_000) -> DataFrame:
    """(a, b), a < b: all pairs of values of the same key. rows: key, value, each pair of them once.

    A key with more than `size` values goes in tiles of about that size, each two of which meet in a task of their own.
    """
    counts = cut(rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1"))
    several = lookup(rows.select(key, value), key, counts, "_n", counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0])
    tiles = F.ceil(F.col("_n") / size).cast("int")
    tiled = several.withColumns({"_tiles": tiles, "_own": F.pmod(F.xxhash64(value), tiles).cast("int")})
    tiled = tiled.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    tiled = tiled.select(key, value, "_own", F.least("_own", "_other").alias("_lo"), F.greatest("_own", "_other").alias("_hi"))
    left = tiled.where("_own = _lo").select(key, "_lo", "_hi", F.col(value).alias("_l"))
    right = tiled.where("_own = _hi").select(key, "_lo", "_hi", F.col(value).alias("_r"))
    met = left.join(right, [key, "_lo", "_hi"]).where("_lo < _hi or _l < _r")
    return met.select(F.least("_l", "_r").alias("a"), F.greatest("_l", "_r").alias("b"))
