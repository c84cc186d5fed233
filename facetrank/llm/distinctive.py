"""How distinctive a token is for its record: residual inverse document frequency times record frequency.

With N records, a token held by df of them and occurring cf times in all, the observed idf is -log2(df / N); a token
strewn at random (Poisson) would have -log2(1 - exp(-cf / N)). The residual is their difference, high for tokens that
are concentrated in few records. It is multiplied by the token's frequency in the record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetrank.functions.runtime import cut
from facetrank.functions.skew import lookup
from facetrank.functions.text import all_clean_tokens, clean_tokens


def residual_idf(df: Column, cf: Column, n: Column) -> Column:
    """log2((1 - exp(-cf/N)) / (df/N)), by expm1, so that rare tokens of a large collection keep their differences."""
    return F.log2(-F.expm1(-cf / n) / (df / n))


def token_pairs(records: DataFrame) -> DataFrame:
    """(id, token, tf): each clean token of each id once, tf = 1.

    records: id STRING, tokens ARRAY<STRING>. Null ids are left out; null or empty arrays and null or blank tokens
    give nothing; repeated rows of an id count once, whichever spelling they use; other columns are ignored.
    """
    return (
        records.where("id is not null")
        .select("id", F.explode(clean_tokens(F.col("tokens"))).alias("token"))
        .distinct()
        .withColumn("tf", F.lit(1).cast("bigint"))
    )


def token_counts(records: DataFrame) -> DataFrame:
    """(id, token, tf): each clean token of each id, and how often the id's array has it.

    As `token_pairs`, but repetitions within an array count. Of several rows of an id the one with the greatest array
    of clean tokens, in order, counts.
    """
    arrays = records.where("id is not null").groupBy("id").agg(F.max(all_clean_tokens(F.col("tokens"))).alias("tokens"))
    return arrays.select("id", F.explode("tokens").alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))


def distinctiveness(pairs: DataFrame, n_records: int | None = None) -> DataFrame:
    """(id, token, tf, df, cf, score) of each pair (id, token, tf), one row a pair; ties keep equal scores.

    n_records defaults to the number of ids that hold a token. A collection without tokens gives no rows.
    With tf = 1 throughout, cf equals df and the score falls strictly as df grows, from nearly 0; a token that occurs
    more often than in as many records has a score above that, and above 0 if it is concentrated in few of them.
    """
    pairs = cut(pairs)
    n = n_records or pairs.select("id").distinct().count()
    stats = pairs.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    scored = lookup(pairs, "token", stats, "df", pairs.count())
    score = F.col("tf") * residual_idf(F.col("df"), F.col("cf"), F.lit(float(max(n, 1))))
    return scored.select("id", "token", "tf", "df", "cf", score.alias("score"))


def telling_tokens(records: DataFrame, least: int = 2, most: int = 3) -> DataFrame:
    """(id, token): the best-scored tokens of each id among those that at least `least` ids hold, all of them if tied;
    listed only if at most `most` ids hold them.

    As the score falls with df, tokens beyond `most` can only come first in an id that has none within it, which then
    has no row; so they are put aside before the comparison.
    """
    scored = distinctiveness(token_pairs(records)).where(F.col("df").between(least, most))
    scored = scored.select("id", "token", "score")
    best = scored.groupBy("id").agg(F.max("score").alias("best"))
    return scored.join(best, "id").where("score = best").select("id", "token")
