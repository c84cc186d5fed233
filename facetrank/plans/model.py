"""Requests: what a mount, a search, a removal may say, with quoted numbers and flags accepted."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from facetrank.functions import measures

#: Operation of an attribute: the kind of its values, and whether a search may ask for it.
OPERATIONS = {
    "numerical_topk": ("number", True),
    "temporal_topk": ("date", True),
    "spatial_knn": ("point", True),
    "categorical_topk": ("keywords", True),
    "textual_topk": ("text", True),
    "pivot_based": ("vector", True),
    "name_dictionary": ("text", False),
    "keyword_dictionary": ("keywords", False),
    "vector_dictionary": ("vector", False),
}


def flag(value: Any, default: bool = False) -> bool:
    if value is None:
        return default
    return value if isinstance(value, bool) else str(value).strip().lower() in ("true", "yes", "1")


def whole(value: Any, default: int | None = None) -> int | None:
    return default if value in (None, "") else int(float(str(value).strip()))


def real(value: Any) -> float | None:
    return None if value in (None, "") else float(str(value).strip())


def listed(value: Any) -> list:
    return [] if value is None else list(value) if isinstance(value, (list, tuple)) else [value]


@dataclass(frozen=True)
class SourceSpec:
    name: str
    type: str = "csv"
    directory: str = ""
    url: str = ""
    driver: str | None = None
    username: str | None = None
    password: str | None = None
    encoding: str | None = None
    api_key: str | None = None

    @classmethod
    def of(cls, raw: dict) -> SourceSpec:
        return cls(**{k: v for k, v in raw.items() if k in cls.__dataclass_fields__})


@dataclass(frozen=True)
class AttributeSpec:
    source: str
    dataset: str
    operation: str
    column: str
    columns: tuple[str, ...]
    key: str | None = None
    separator: str = ";"
    header: bool = True
    token_delimiter: str = ","
    prefix_url: str = ""
    queryable: bool = True
    max_lines: int | None = None
    qgram: int = measures.QGRAM
    normalized: str | None = None
    metric: str | None = None
    transform_by: str | None = None
    unique_keys: bool = False

    @property
    def kind(self) -> str:
        return OPERATIONS[self.operation][0]

    @property
    def identity(self) -> tuple[str, str]:
        return self.column, self.operation

    @classmethod
    def of(cls, raw: dict) -> AttributeSpec:
        operation = str(raw.get("operation", "")).lower()
        if operation not in OPERATIONS:
            raise ValueError(f"unknown operation {raw.get('operation')}")
        columns = tuple(str(c) for c in listed(raw.get("search_column")))
        # A dictionary of vectors without a header may have one number a column: all after the key.
        spread = operation == "vector_dictionary" and not flag(raw.get("header"), True)
        if not columns and not spread:
            raise ValueError("search_column is missing")
        name = raw.get("transformed_to") or raw.get("alias_column") or (columns[0] if len(columns) == 1 else "_".join(columns) or "vector")
        return cls(
            source=raw.get("source", ""), dataset=raw.get("dataset", ""), operation=operation, column=name, columns=columns,
            key=raw.get("key_column"), separator=raw.get("separator") or ";", header=flag(raw.get("header"), True),
            token_delimiter=raw.get("token_delimiter") or ",", prefix_url=raw.get("prefixURL") or "",
            queryable=flag(raw.get("queryable"), True) and OPERATIONS[operation][1], max_lines=whole(raw.get("max_lines")),
            qgram=whole(raw.get("qgram"), measures.QGRAM), normalized=(raw.get("normalized") or "").lower() or None,
            metric=raw.get("metric"), transform_by=raw.get("transform_by"), unique_keys=flag(raw.get("unique_keys")),
        )


@dataclass(frozen=True)
class QuerySpec:
    column: str
    value: Any
    weights: tuple[float, ...] | None = None
    decay: float = measures.DECAY
    scale: float | None = None
    filter: Any = None

    @classmethod
    def of(cls, raw: dict) -> QuerySpec:
        if "column" not in raw:
            raise ValueError("a query lacks its column")
        weights = tuple(real(w) for w in listed(raw.get("weights"))) or None
        decay = real(raw.get("decay"))
        return cls(raw["column"], raw.get("value", raw.get("search_value")), weights, measures.DECAY if decay is None else decay, real(raw.get("scale")), raw.get("filter"))


@dataclass(frozen=True)
class SearchSpec:
    queries: tuple[QuerySpec, ...]
    k: int = measures.MOST_RESULTS
    algorithm: str = "threshold"
    extra: tuple[str, ...] = ()
    filter: str | None = None
    output: dict = field(default_factory=dict, compare=False)

    @classmethod
    def of(cls, raw: dict | str) -> SearchSpec:
        if isinstance(raw, str):
            raw = json.loads(raw)
        output = raw.get("output") or {}
        return cls(
            tuple(QuerySpec.of(q) for q in raw.get("queries") or ()),
            whole(raw.get("k"), measures.MOST_RESULTS),
            str(raw.get("algorithm") or "threshold").lower(),
            tuple(listed(output.get("extra_columns"))),
            raw.get("filter"),
            output,
        )
