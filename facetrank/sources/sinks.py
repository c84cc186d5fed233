"""Results as nested rows, flat rows, JSON, CSV and text tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetrank.functions.values import shown


def nested(rows: DataFrame, names: Sequence[str], kinds: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """combo, rank, id, score, exact, attributes ARRAY<STRUCT<name, value, score>>, extra_attributes MAP."""
    facets = F.array(
        *(F.struct(F.lit(n).alias("name"), F.coalesce(shown(F.col(f"v{j}"), kinds[j]), F.lit("")).alias("value"), F.col(f"s{j}").alias("score")) for j, n in enumerate(names))
    )
    more = F.map_from_arrays(F.array(*(F.lit(e) for e in extra)).cast("array<string>"), F.array(*(F.col(f"x_{e}").cast("string") for e in extra)).cast("array<string>"))
    return rows.select("combo", F.col("rank").cast("int"), "id", "score", "exact", facets.alias("attributes"), more.alias("extra_attributes"))


def flat(rows: DataFrame, names: Sequence[str], kinds: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """combo, rank, score, id, then <name>Val and <name>Score of each attribute, then the extra columns."""
    facets = [c for j, n in enumerate(names) for c in (F.coalesce(shown(F.col(f"v{j}"), kinds[j]), F.lit("")).alias(f"{n}Val"), F.col(f"s{j}").alias(f"{n}Score"))]
    return rows.select("combo", "rank", F.col("score"), "id", *facets, *(F.col(f"x_{e}").cast("string").alias(e) for e in extra))


def weighted(flat_rows: DataFrame, weights: Sequence[Sequence[float]]) -> DataFrame:
    """Flat rows with their combination's weights (of each attribute, by combination) as a text in place of its number."""
    texts = ["[" + ", ".join("" if w[i] is None else number_text(w[i]) for w in weights) + "]" for i in range(len(weights[0]))]
    return flat_rows.select(F.get(F.array(*(F.lit(t) for t in texts)), F.col("combo")).alias("weights"), *(F.col(f"`{c}`") for c in flat_rows.columns if c != "combo"))


def write_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def write_csv(results: DataFrame, path: str, delimiter: str = ";", quote: str = '"', header: bool = True) -> None:
    results.write.mode("overwrite").options(sep=delimiter, quote=quote, header=header, emptyValue="").csv(path)


def as_json(results: DataFrame) -> str:
    """Pretty-printed; of at most some k rows a combination."""
    return json.dumps([r.asDict(recursive=True) for r in results.orderBy("combo", "rank").collect()], indent=2, default=str)


def number_text(x: float) -> str:
    """At least one and at most six decimals."""
    whole, _, part = f"{x:.6f}".partition(".")
    return f"{whole}.{part.rstrip('0') or '0'}"


def as_table(flat_rows: DataFrame, wrap: int = 40, weights: dict[str, Sequence[float]] | None = None) -> str:
    """A text table of at most some k rows a combination; long values are wrapped. With weights, those of an attribute
    (by combination) stand beside its name."""
    beside = {f"{a}Score": "".join(f" {number_text(w)}" for w in some if w is not None) for a, some in (weights or {}).items()}
    columns = [c + beside.get(c, "") for c in flat_rows.columns]
    rows = [["" if v is None else number_text(v) if isinstance(v, float) else str(v) for v in r] for r in flat_rows.orderBy("combo", "rank").collect()]
    pieces = [[[v[i : i + wrap] for i in range(0, len(v), wrap)] or [""] for v in r] for r in [columns, *rows]]
    widths = [max(len(p) for r in pieces for p in r[c]) for c in range(len(columns))]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    lines = [rule]
    for r in pieces:
        for line in range(max(map(len, r))):
            lines.append("|" + "|".join(f" {(cell[line] if line < len(cell) else ''):<{w}} " for cell, w in zip(r, widths)) + "|")
        lines.append(rule)
    return "\n".join(lines)
