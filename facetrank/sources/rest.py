"""Python data sources for services that answer over HTTP: search indices and other instances of this engine."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from facetrank.functions.runtime import ship


def post(url: str, body: Any | None, api_key: str | None = None, user: str | None = None, password: str | None = None, method: str | None = None) -> Any:
    import base64

    request = urllib.request.Request(url, None if body is None else json.dumps(body).encode(), {"Content-Type": "application/json"}, method=method)
    if api_key:
        request.add_header("api_key", api_key)
    if user:
        request.add_header("Authorization", "Basic " + base64.b64encode(f"{user}:{password or ''}".encode()).decode())
    with urllib.request.urlopen(request, timeout=120) as answer:
        return json.load(answer)


def flat(value: Any, prefix: str = "") -> dict[str, str]:
    """Nested objects as dotted names; arrays joined by commas; {lon, lat} objects as "lon,lat"."""
    if isinstance(value, dict):
        if set(value) == {"lon", "lat"}:
            return {prefix: f"{value['lon']},{value['lat']}"}
        return {k: v for name, part in value.items() for k, v in flat(part, f"{prefix}.{name}" if prefix else name).items()}
    if isinstance(value, list):
        return {prefix: ",".join(next(iter(flat(v, "").values()), "") if isinstance(v, (dict, list)) else str(v) for v in value)}
    return {} if value is None else {prefix: str(value)}


class Slice(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


class IndexReader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]) -> None:
        self.options, self.names = dict(options), names

    def partitions(self) -> list[Slice]:
        return [Slice(i) for i in range(int(self.options.get("slices", "1")))]

    def read(self, partition: Slice) -> Iterator[tuple]:
        """All hits, page by page in the order of the key field."""
        o = self.options
        key, page = o["key"], int(o.get("page", "10000"))
        query: dict = {"bool": {"must": [{"exists": {"field": n}} for n in self.names if n != "id"][:1]}}
        if o.get("filter"):
            query["bool"]["filter"] = json.loads(o["filter"])
        body = {"size": page, "query": query, "sort": [{key: "asc"}], "_source": [key, *(n for n in self.names if n != "id")]}
        slices = int(o.get("slices", "1"))
        if slices > 1:
            body["slice"] = {"id": partition.number, "max": slices}
        while True:
            hits = post(o["url"].rstrip("/") + "/_search", body, o.get("api_key"), o.get("user"), o.get("password"))["hits"]["hits"]
            for hit in hits:
                row = flat(hit["_source"])
                yield tuple(row.get(key if n == "id" else n) for n in self.names)
            if len(hits) < page:
                return
            body["search_after"] = hits[-1]["sort"]


class IndexSource(DataSource):
    """Format `search_index`. Options: url, key, fields (comma-separated), filter (JSON), page, slices, api_key, user, password."""

    @classmethod
    def name(cls) -> str:
        return "search_index"

    def schema(self) -> str:
        return ", ".join(["id string", *(f"`{f.strip()}` string" for f in self.options["fields"].split(","))])

    def reader(self, schema) -> DataSourceReader:
        return IndexReader(self.options, schema.names)


class InstanceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)

    def read(self, partition) -> Iterator[tuple]:
        """The ranked list of one attribute, as the other instance scores it."""
        o = self.options
        body = {"k": int(o["k"]), "queries": [{"column": o["column"], "value": json.loads(o["value"]), "weights": [1.0]}]}
        for answer in post(o["url"], body, o.get("api_key"))[:1]:
            for r in answer["rankedResults"]:
                found = next((a for a in r["attributes"] if a["name"] == o["column"]), {})
                yield (str(r["id"]), None if found.get("value") is None else str(found["value"]), float(r["score"]), int(r["rank"]))


class InstanceSource(DataSource):
    """Format `ranked_instance`. Options: url, column, value (JSON), k, api_key."""

    @classmethod
    def name(cls) -> str:
        return "ranked_instance"

    def schema(self) -> str:
        return "id string, value string, score double, rank int"

    def reader(self, schema) -> DataSourceReader:
        return InstanceReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(IndexSource)
    spark.dataSource.register(InstanceSource)


def most_results(url: str, default: int = 10_000, **access: str) -> int:
    """The longest list that an index gives, from its settings."""
    try:
        settings = post(url.rstrip("/") + "/_settings", None, method="GET", **access)
    except OSError:
        return default
    for index in settings.values():
        found = index.get("settings", {}).get("index", {}).get("max_result_window") if isinstance(index, dict) else None
        if found:
            return int(found)
    return int(settings.get("max_result_window", default))


def json_filter(condition: Any) -> Column:
    """A filter in JSON (range, term, match, exists, bool; a list is a conjunction) as a column."""
    if isinstance(condition, str):
        condition = json.loads(condition)
    if isinstance(condition, list):
        out = F.lit(True)
        for c in condition:
            out = out & json_filter(c)
        return out
    (kind, body), *more = condition.items()
    if more:
        return json_filter([{k: v} for k, v in condition.items()])
    if kind == "bool":
        out = json_filter(_listed(body.get("must"))) & json_filter(_listed(body.get("filter")))
        for c in _listed(body.get("must_not")):
            out = out & ~json_filter(c)
        either = [json_filter(c) for c in _listed(body.get("should"))]
        for i, c in enumerate(either):
            either[0] = c if i == 0 else either[0] | c
        return out & either[0] if either else out
    if kind == "exists":
        return F.col(body["field"]).isNotNull()
    (name, value), *_ = body.items()
    if kind == "range":
        checks = {"gte": "__ge__", "gt": "__gt__", "lte": "__le__", "lt": "__lt__"}
        return json_filter([]) & _all(getattr(F.col(name), checks[o])(F.lit(v)) for o, v in value.items() if o in checks)
    if kind in ("term", "match"):
        value = value.get("query", value.get("value")) if isinstance(value, dict) else value
        return F.lower(F.col(name).cast("string")) == str(value).lower() if kind == "match" else F.col(name) == F.lit(value)
    if kind == "terms":
        return F.col(name).isin(value)
    raise ValueError(f"unknown filter {kind}")


def _listed(x: Any) -> list:
    return [] if x is None else x if isinstance(x, list) else [x]


def _all(columns) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & c
    return out


ship(__name__)
