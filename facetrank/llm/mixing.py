"""A collection in which each source has its target share of the size, by systematic sampling.

A source's documents get its rate, the copies expected of each. Along the source's documents the rates are summed up;
with one random offset added, a document is emitted once for each whole number that the sum passes at it. As documents
are lined up by size, what a source gets in tokens follows its rate closely, and not only in documents. The running
sums come from counts of small cells, so that no source, however large, has to pass through one task.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetrank.functions.runtime import cut
from facetrank.functions.skew import numbered
from facetrank.llm.bpe import encode_texts

#: Rows of a cell that is numbered in one go, about.
CELL = 50_000


def sized(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) by byte_bpe_50k, written once."""
    return cut(encode_texts(documents, vocabulary=vocabulary, count_only=True, keep=("source",)))


def rates(sizes: DataFrame, targets: DataFrame, total: int | None = None, exact: bool = False) -> list[dict]:
    """For each row of `targets`: source, target_share, max_repeats, available (tokens), wanted (tokens), rate.

    targets has one row a source, a table of settings that comes to the driver. The size aimed at is `total`, by
    default all tokens of the sources named. Sources that cannot reach their share of it even with all their repeats
    give what they have; what they lack goes to the others in proportion to their targets, and again until nothing
    changes. With `exact`, the size shrinks instead until no source that has documents lacks anything, so that the
    shares of those sources are in exact proportion. Sources without documents cannot contribute either way.
    """
    goals = [
        {"source": r["source"], "target_share": float(r["target_share"]), "max_repeats": int(r["max_repeats"] or 0)}
        for r in targets.where("source is not null and target_share > 0").select("source", "target_share", "max_repeats").orderBy("source").toLocalIterator()
    ]
    have = {
        r["source"]: int(r["tokens"])
        for r in sizes.join(F.broadcast(targets.select("source").distinct()), "source").groupBy("source").agg(F.sum("n_tokens").alias("tokens")).toLocalIterator()
    }
    for g in goals:
        g["available"] = have.get(g["source"], 0)
        g["most"] = g["available"] * max(0, g["max_repeats"])
    able = [g for g in goals if g["most"]]
    size = float(total if total is not None else sum(g["available"] for g in goals))
    if exact and able:
        size = min(size, min(g["most"] / g["target_share"] for g in able) * sum(g["target_share"] for g in able))
    open_, left = list(able), size
    for g in goals:
        g["wanted"] = 0.0
    while open_:
        shares = sum(g["target_share"] for g in open_)
        short = [g for g in open_ if left * g["target_share"] / shares > g["most"]]
        for g in short or open_:
            g["wanted"] = float(g["most"]) if short else left * g["target_share"] / shares
        if not short:
            break
        left -= sum(g["most"] for g in short)
        open_ = [g for g in open_ if g not in short]
    for g in goals:
        g["rate"] = min(float(g["max_repeats"]), g["wanted"] / g["available"]) if g["available"] else 0.0
    return goals


def mixed(sizes: DataFrame, goals: list[dict], seed: int = 0) -> DataFrame:
    """(doc_id, source, n_tokens, copy): one row for each use of a document, copy counting from 1.

    sizes: doc_id, source, n_tokens. Documents without tokens, of a null source or of one without a target are left
    out. No document is used more than its source's max_repeats times.
    """
    spark = sizes.sparkSession
    rng = random.Random(seed)
    rows = [(g["source"], g["rate"], rng.randrange(1 << 20) / (1 << 20), g["max_repeats"]) for g in goals if g["rate"] > 0]
    if not rows:
        return sizes.limit(0).select("doc_id", "source", "n_tokens", F.lit(1).alias("copy"))
    table = F.broadcast(spark.createDataFrame(rows, "source string, rate double, start double, most int"))
    used = sizes.where("n_tokens > 0").join(table, "source")
    slices = max(1, sizes.count() // CELL)
    # 8 size classes a doubling, from the smallest to the largest documents.
    placed = numbered(
        used, ["source"], F.floor(F.log2("n_tokens") * 8), [F.col("n_tokens"), F.xxhash64("doc_id"), F.col("doc_id")],
        F.xxhash64("doc_id"), slices, "place",
    )
    passed = lambda k: F.floor(F.col("start") + F.col("rate") * k)
    copies = F.least(passed(F.col("place")) - passed(F.col("place") - 1), F.col("most").cast("bigint")).cast("int")
    return (
        placed.withColumn("copies", copies)
        .where("copies > 0")
        .select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    )


def mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, exact: bool = False, seed: int = 0, vocabulary: str | None = None) -> DataFrame:
    """The collection: (doc_id, source, n_tokens, copy). doc_id is unique in `documents`; other columns are ignored."""
    sizes = sized(documents, vocabulary)
    return mixed(sizes, rates(sizes, targets, total, exact), seed)


def mixture_report(documents: DataFrame, targets: DataFrame, total: int | None = None, exact: bool = False, seed: int = 0, vocabulary: str | None = None) -> DataFrame:
    """One row a target: source, target_share, max_repeats, available and wanted tokens, documents and rows used,
    tokens reached, actual_share, and whether its share of the size aimed at was within reach."""
    sizes = sized(documents, vocabulary)
    goals = rates(sizes, targets, total, exact)
    got = mixed(sizes, goals, seed).groupBy("source").agg(
        F.sum((F.col("copy") == 1).cast("bigint")).alias("documents"), F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens")
    )
    size = sum(g["wanted"] for g in goals)
    rows = [
        (g["source"], g["target_share"], g["max_repeats"], g["available"], round(g["wanted"]), bool(g["most"] >= g["target_share"] * size and g["most"]))
        for g in goals
    ]
    kinds = "source string, target_share double, max_repeats int, available bigint, wanted bigint, reachable boolean"
    table = documents.sparkSession.createDataFrame(rows, kinds)
    full = table.join(got, "source", "left").na.fill(0, ["documents", "rows", "tokens"])
    # One row a target: the sum over all of them is a sum of settings, not of data.
    everything = full.agg(F.sum("tokens").alias("all_tokens"))
    return (
        full.crossJoin(F.broadcast(everything))
        .withColumn("actual_share", F.round(F.col("tokens") / F.greatest("all_tokens", F.lit(1)), 6))
        .drop("all_tokens")
    )
