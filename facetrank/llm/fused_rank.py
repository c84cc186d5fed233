"""One ranking from several differently scaled scores: first principal component of rank-transformed scores.

Scores become ranks within their column (0 for a missing one, up to 1 for the best, after each column is turned to its
declared direction), so that neither range nor shape nor extreme values matter. One distributed aggregate gives the
correlation matrix of each search's columns. It is shrunk towards full agreement in the declared directions, by AGREED;
columns are scaled by the roots of their weights; the first component of that matrix, oriented to the declared
directions, gives the loadings, and the projection on it the ranking.

Without the shrinking, the component of columns that are hardly correlated follows chance or the one heaviest column, and
not the weights (`components` shows it, and which columns it would turn against their declared direction). With it, the
loadings are the weights, changed by how columns go together. As the second eigenvalue is at most (1 - AGREED) / AGREED of
the first one, a fixed number of multiplications gives the component, in expressions of SQL.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetrank.functions.runtime import cut, ship, width
from facetrank.functions.skew import lookup, numbered

#: Rows of one (search, column) beyond which ranks are made in several cells.
CELL = 50_000
#: Share of full agreement in the matrix whose component is taken; the rest is what was observed.
AGREED = 2 / 3
#: Multiplications by the matrix; each halves at least what is left of other components.
STEPS = 50


def rank_scores(scores: DataFrame, descending: Column | None = None) -> DataFrame:
    """(search_id, article_id, column_name, r): share of the column's values that are no better, in (0, 1].

    scores: search_id, article_id, column_name, score DOUBLE. Rows with a null in any of them or a NaN score add
    nothing; repeated rows count once; of several scores of one article the best counts; equal scores get equal
    ranks. `descending` is true for columns whose low values are good.
    """
    value = F.col("score") if descending is None else F.when(descending, -F.col("score")).otherwise(F.col("score"))
    keys = ["search_id", "column_name"]
    clean = (
        scores.where("score is not null and not isnan(score) and article_id is not null")
        .where("search_id is not null and column_name is not null")
        .groupBy(*keys, "article_id")
        .agg(F.max(value + F.lit(0.0)).alias("score"))
    )
    clean = cut(clean)
    sizes = clean.groupBy(F.struct(*keys).alias("key")).agg(F.count("*").alias("n"), F.count_distinct("score").alias("values"))
    # Equal scores are counted together before anything is sorted: a value that very many rows share is one row.
    values = clean.groupBy(*keys, "score").agg(F.count("*").alias("same"))
    key = F.struct(*keys).alias("key")
    of_keys = cut(sizes.withColumn("n", F.col("n").cast("double")))
    most, all_values, all_rows = of_keys.agg(F.max("values"), F.sum("values"), F.sum("n")).first()
    if (most or 0) <= CELL:
        running = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
        ranked = values.withColumn("place", F.sum("same").over(running))
    else:
        # Quantiles cut the values of columns that have more into cells of about equal size; at most 1,001 a column.
        cells = int(min(1000, -(-most // CELL) * 4))
        at = [i / cells for i in range(1, cells)]
        large = of_keys.where(F.col("values") > CELL).select("key", "values")
        keyed = values.select("*", key)
        cuts = lookup(keyed, "key", large, "values", all_values).groupBy("key").agg(F.percentile_approx("score", at, 10 * cells).alias("cuts"))
        small = lookup(keyed, "key", of_keys.where(F.col("values") <= CELL).select("key", "values"), "values", all_values)
        placed = lookup(keyed, "key", cut(cuts.join(large, "key")), "values", all_values)
        placed = placed.withColumn("cell", F.size(F.filter("cuts", lambda c: c < F.col("score"))))
        placed = placed.drop("cuts").unionByName(small.withColumn("cell", F.lit(0))).drop("key", "values")
        ranked = numbered(placed, keys, F.col("cell"), [F.col("score")], F.lit(0), 1, "place", weight=F.col("same"))
    shared = lookup(ranked.select("score", "same", "place", key), "key", of_keys, "values", all_values or 0)
    shared = cut(shared.select(F.struct("key", "score").alias("at"), "same", (F.col("place") / F.col("n")).alias("r")))
    rows = clean.select("search_id", "article_id", "column_name", F.struct(key, F.col("score")).alias("at"))
    return lookup(rows, "at", shared, "same", int(all_rows or 0)).select("search_id", "article_id", "column_name", "r")


def weight_table(pivot: DataFrame) -> DataFrame:
    """(search_id, combo, column_name, weight) of search_pivot's weight texts; combo counts positions from 0.

    Texts that are no number, and negative ones, give no weight. Repeated rows count once.
    """
    return (
        pivot.select("search_id", "column_name", F.posexplode("weights").alias("combo", "text"))
        .select("search_id", F.col("combo").cast("bigint").alias("combo"), "column_name", F.trim("text").try_cast("double").alias("weight"))
        .where("weight >= 0 and not isnan(weight) and search_id is not null and column_name is not null")
        .groupBy("search_id", "combo", "column_name")
        .agg(F.max("weight").alias("weight"))
    )


def first_component(moments: np.ndarray) -> np.ndarray:
    """Loadings of the first principal component of a symmetric matrix, with a positive sum."""
    _, vectors = np.linalg.eigh(moments)
    v = vectors[:, -1]
    return v if v.sum() >= 0 else -v


def correlations(ranks: DataFrame) -> DataFrame:
    """(search_id, ca, cb, rho): correlation of the ranks of each two columns of a search, over articles that have both.

    An array of ranks an article, one of each column of its search, and a map-side aggregate of pairs of columns.
    """
    rows = ranks.groupBy("search_id", "article_id").agg(F.collect_list(F.struct("column_name", "r")).alias("rs"))
    pairs = rows.select("search_id", F.explode("rs").alias("a"), "rs").select("search_id", "a", F.explode("rs").alias("b"))
    # A column whose ranks are all equal goes along with none.
    both = F.stddev_pop("a.r") * F.stddev_pop("b.r")
    rho = F.when(F.col("ca") == F.col("cb"), 1.0).when(F.col("both") > 1e-12, F.col("together") / F.col("both")).otherwise(0.0)
    return (
        pairs.groupBy("search_id", F.col("a.column_name").alias("ca"), F.col("b.column_name").alias("cb"))
        .agg(F.covar_pop("a.r", "b.r").alias("together"), both.alias("both"))
        .select("search_id", "ca", "cb", rho.alias("rho"))
    )


def _matrices(ranks: DataFrame) -> DataFrame:
    """(search_id, columns ARRAY<STRUCT<name, rho MAP>>): one row a search, columns in order of their names."""
    rows = correlations(ranks).groupBy("search_id", F.col("ca").alias("name")).agg(F.map_from_entries(F.collect_list(F.struct("cb", "rho"))).alias("rho"))
    # A map has no order: columns are sorted by their names, which are distinct.
    return rows.groupBy("search_id").agg(F.collect_list(F.struct("name", "rho")).alias("columns")).withColumn(
        "columns", F.array_sort("columns", lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0))
    )


def loadings(ranks: DataFrame, weights: DataFrame) -> DataFrame:
    """(search_id, combo, column_name, weight, loading): what a rank of that column adds to the projection.

    The loadings of a search and combination sum to 1; they are 0 if all its weights are.
    """
    of_combos = weights.groupBy("search_id", "combo").agg(F.map_from_entries(F.collect_list(F.struct("column_name", "weight"))).alias("w"))
    rows = _matrices(ranks).join(of_combos, "search_id")

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, t: s + t)

    root = F.transform("columns", lambda c: F.sqrt(F.coalesce(F.try_element_at("w", c["name"]), F.lit(0.0))))
    rows = rows.withColumn("root", root).withColumn("sum", dot(F.col("root"), F.col("root")))

    def line(c: Column, i: Column) -> Column:
        """A row of the matrix, divided by its greatest possible eigenvalue."""
        return F.transform(
            "columns",
            lambda d, j: F.get("root", i) * F.get("root", j) * ((1 - AGREED) * F.coalesce(F.try_element_at(c["rho"], d["name"]), F.lit(0.0)) + AGREED) / F.nullif(F.col("sum"), F.lit(0.0)),
        )

    rows = rows.withColumn("m", F.transform("columns", line))
    component = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.col("root"), lambda v, _: F.transform("m", lambda x: dot(x, v)))
    rows = rows.withColumn("v", F.when(F.col("sum") > 0, component).otherwise(F.col("root")))
    # It starts in the declared directions, and the matrix has no negative eigenvalues to turn it.
    rows = rows.withColumn("along", dot(F.col("v"), F.col("root")))
    each = rows.select("search_id", "combo", "w", "root", "v", "along", F.posexplode("columns").alias("i", "c"))
    loading = F.when(F.col("along") > 0, F.get("v", F.col("i")) * F.get("root", F.col("i")) / F.col("along")).otherwise(0.0)
    return (
        each.withColumn("weight", F.try_element_at("w", F.col("c.name")))
        .where("weight is not null")
        .select("search_id", "combo", F.col("c.name").alias("column_name"), "weight", loading.alias("loading"))
    )


def components(scores: DataFrame) -> DataFrame:
    """(search_id, column_name, component, against): the first component of each search's correlation matrix alone, of
    length 1 and turned so that most of it goes along the declared directions; whether a column's goes against its own."""

    def solve(frame):
        import pandas as pd

        (search, columns), *_ = frame.itertuples(index=False)
        names = [c["name"] for c in columns]
        rho = [dict(c["rho"]) for c in columns]
        v = first_component(np.array([[r.get(n, 0.0) for n in names] for r in rho]))
        return pd.DataFrame({"search_id": search, "column_name": names, "component": v, "against": v < -1e-9})

    rows = _matrices(cut(rank_scores(scores)))
    kind = rows.schema["search_id"].dataType.simpleString()
    schema = f"search_id {kind}, column_name string, component double, against boolean"
    return rows.repartition(width(rows.sparkSession), "search_id").groupBy("search_id").applyInPandas(solve, schema)


def fused(scores: DataFrame, pivot: DataFrame) -> DataFrame:
    """(search_id, combo, article_id, projection) for every article that has a score in a weighted column of the search.

    A search or column without weights gives no rows; a search whose scores are all missing gives none either.
    """
    ranks = cut(rank_scores(scores))
    key = F.struct("search_id", "column_name").alias("key")
    sizes = ranks.groupBy(key).agg(F.count("*").alias("n"))
    of_columns = loadings(ranks, weight_table(pivot)).groupBy(key).agg(F.collect_list(F.struct("combo", "loading")).alias("by_combo"))
    of_columns = cut(of_columns.join(sizes, "key"))
    rows = lookup(ranks.select("search_id", "article_id", "r", key), "key", of_columns, "n", ranks.count())
    return (
        rows.select("search_id", "article_id", "r", F.explode("by_combo").alias("l"))
        .groupBy("search_id", F.col("l.combo").alias("combo"), "article_id")
        .agg(F.sum(F.col("r") * F.col("l.loading")).alias("projection"))
    )


def top_articles(scores: DataFrame, pivot: DataFrame, k: int = 5) -> DataFrame:
    """(search_id, combo, article_id, place): the k first of each ranking; equal projections go by article_id."""
    order = Window.partitionBy("search_id", "combo").orderBy(F.round("projection", 12).desc(), "article_id")
    return (
        fused(scores, pivot)
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= k)
        .select("search_id", "combo", "article_id", "place")
    )


ship(__name__)
