"""Columns for keyword sets and character n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_token(token: Column) -> Column:
    """Cut at the first `|` unless it is the first character, trim blanks, lower case."""
    at = F.instr(token, "|")
    cut = F.when(at > 1, F.substring(token, F.lit(1), at - 1)).otherwise(token)
    return F.lower(F.regexp_replace(cut, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def all_clean_tokens(tokens: Column) -> Column:
    """The sorted clean tokens of an array, as often as they occur; null and blank ones are left out."""
    kept = F.filter(F.transform(tokens, clean_token), lambda t: t.isNotNull() & (t != ""))
    return F.coalesce(F.array_sort(kept), F.array().cast("array<string>"))


def clean_tokens(tokens: Column) -> Column:
    """The sorted distinct clean tokens of an array; null and blank ones are left out, a null array gives an empty one."""
    cleaned = F.transform(tokens, clean_token)
    kept = F.filter(cleaned, lambda t: t.isNotNull() & (t != ""))
    return F.coalesce(F.array_sort(F.array_distinct(kept)), F.array().cast("array<string>"))


def split_tokens(text: Column, delimiter: str = ",", cut_counts: bool = True) -> Column:
    """Keyword set of a delimited string: outer quotes removed, blanks around tokens trimmed, duplicates removed.

    With `cut_counts` each token is then cut at its first `|` (unless that is the first character).
    """
    bare = F.regexp_replace(text, '^"|"$', "")
    parts = F.filter(
        F.transform(F.split(bare, f"\\Q{delimiter}\\E"), lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != "")
    )
    distinct = F.array_distinct(parts)
    if not cut_counts:
        return distinct
    return F.array_distinct(
        F.transform(
            distinct, lambda t: F.when(F.instr(t, "|") > 1, F.substring_index(t, "|", 1)).otherwise(t)
        )
    )


def qgrams(text: Column, q: int = 3) -> Column:
    """Distinct character n-grams of length `q`; a shorter text has none, a null text gives null."""
    n = F.length(text) - q + 1
    grams = F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(q))))
    return F.when(text.isNotNull(), F.coalesce(F.array_distinct(grams), F.array().cast("array<string>")))


def qgram_length(strings: DataFrame, column: str, threshold: float) -> int:
    """The greatest n-gram length with which strings of that similarity still share one: the shortest length times it."""
    shortest = strings.agg(F.min(F.length(column))).first()[0]
    return max(1, int((shortest or 0) * threshold))
