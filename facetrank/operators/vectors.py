"""Keyword sets as vectors, by a dictionary of term vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A dictionary is broadcast only up to that many bytes of numbers.
BROADCAST_BYTES = 64 << 20


def keyword_vectors(rows: DataFrame, dictionary: DataFrame, keywords: str = "keywords", size: int | None = None) -> DataFrame:
    """(id, vector): the mean of the vectors of the row's keywords.

    A keyword of words joined by `+` has the mean of its words' vectors. Terms that the dictionary lacks add nothing
    but count in the mean. Terms are compared in lower case. Rows without keywords, or none of whose keywords is
    known, have a null vector. dictionary: term, vector; vectors of another length than `size`, by default the
    dictionary's most frequent one, are as good as missing; of repeated terms the greatest vector counts.
    """
    size = size or dictionary.agg(F.mode(F.size("vector"), True)).first()[0] or 0
    terms = dictionary.where(F.col("term").isNotNull() & (F.size("vector") == size)).groupBy(F.lower("term").alias("word")).agg(F.max("vector").alias("vector"))
    most = BROADCAST_BYTES // (8 * max(size, 1) + 64)
    if dictionary.limit(most + 1).count() <= most:
        terms = F.broadcast(terms)
    words = (
        rows.where("id is not null")
        .select("id", F.size(keywords).alias("n"), F.explode(F.array_distinct(keywords)).alias("keyword"))
        .select("id", "n", F.split(F.lower("keyword"), r"\+").alias("words"))
        .select("id", F.explode("words").alias("word"), (1 / (F.col("n") * F.size("words"))).alias("share"))
        .groupBy("id", "word")
        .agg(F.sum("share").alias("share"))
    )
    # Sums by dimension combine on the map side, so a row with very many keywords stays small in the shuffle.
    weighted = words.join(terms, "word").select("id", F.posexplode(F.transform("vector", lambda x: x * F.col("share"))).alias("i", "x"))
    summed = weighted.groupBy("id", "i").agg(F.sum("x").alias("x")).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    vectors = summed.select("id", F.transform("v", lambda s: s["x"]).alias("vector"))
    return rows.select("id").where("id is not null").distinct().join(vectors, "id", "left")


