"""Mounted attributes and searches on them.

Attributes of the same table and key are columns of one scan. Those of different tables are brought together by a full
outer join on the key, which keeps entities that some tables lack. When a table is mounted, its keys are counted once: if
some repeat, the one row of each that counts is chosen then and kept, so that no search groups the table again. Pivot
attributes are embedded and stored as ranged files when they are first searched.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetrank.functions import measures, values
from facetrank.functions.runtime import cut, shared_folder, within
from facetrank.operators import pivot, ranking
from facetrank.operators.normalize import normalized
from facetrank.operators.vectors import keyword_vectors
from facetrank.plans import sqlfront
from facetrank.plans.model import AttributeSpec, QuerySpec, SearchSpec, SourceSpec
from facetrank.sources import readers, rest, sinks

#: Fixed value: how long a query may take, in milliseconds.
TIMEOUT = 10_000


@dataclass
class Response:
    """Results of one search: rows by combination and rank, and what goes with them."""

    rows: DataFrame
    names: tuple[str, ...]
    kinds: tuple[str, ...]
    extra: tuple[str, ...]
    k: int
    prepared: ranking.Prepared | None = None
    warnings: list[str] = field(default_factory=list)
    seconds: float = 0.0
    timeout: int = TIMEOUT

    @property
    def nested(self) -> DataFrame:
        return sinks.nested(self.rows, self.names, self.kinds, self.extra)

    @property
    def flat(self) -> DataFrame:
        return sinks.flat(self.rows, self.names, self.kinds, self.extra)

    @property
    def weighted(self) -> DataFrame:
        """Flat rows with the weights of their combination in front."""
        return sinks.weighted(self.flat, self.prepared.numbers) if self.prepared else self.flat

    @property
    def table(self) -> str:
        """A text table, with the weights beside the attributes' names."""
        return sinks.as_table(self.flat, weights=dict(zip(self.names, self.prepared.numbers)) if self.prepared else None)

    @property
    def matrix(self) -> DataFrame | None:
        return ranking.similarity_matrix(self.rows, self.prepared) if self.prepared else None

    def collect(self) -> list[dict]:
        """The nested rows; a search that takes longer than the time-out is cancelled and raises TimeoutError."""
        began = time.time()
        with within(self.rows.sparkSession, self.timeout):
            found = [r.asDict(recursive=True) for r in self.nested.collect()]
        self.seconds = time.time() - began
        found.sort(key=lambda r: (r["combo"], r["rank"]))
        for combo in sorted({r["combo"] for r in found} or {0}):
            n = sum(r["combo"] == combo for r in found)
            if n < self.k:
                self.warnings.append(f"inconclusive: only {n} of {self.k} results")
        return found


class Engine:
    def __init__(self, spark: SparkSession, name: str = "facetrank") -> None:
        self.spark, self.name = spark, name
        self.sources: dict[str, SourceSpec] = {}
        self.attributes: dict[tuple[str, str], AttributeSpec] = {}
        self.given: dict[str, DataFrame] = {}
        self.metrics: tuple[pivot.Metric, ...] = ()
        self.pivots = pivot.PIVOTS
        self.timeout = TIMEOUT
        self.created = datetime.now(timezone.utc)
        self.warnings: list[str] = []
        self._tables: dict[tuple, DataFrame] = {}
        self._rows: dict[tuple, DataFrame] = {}
        self._dates: dict[tuple[str, str], bool] = {}
        self._stored: DataFrame | None = None
        self._added: dict[tuple[str, str], list[DataFrame]] = {}

    # Catalog

    def mount(self, request: dict | str, tables: dict[str, DataFrame] | None = None) -> list[str]:
        """Replaces what is mounted. tables: DataFrames by dataset name, read instead of a source's files."""
        self.unmount()
        return self.append(request, tables)

    def append(self, request: dict | str, tables: dict[str, DataFrame] | None = None) -> list[str]:
        """Adds sources and attributes; what can't be mounted is left out and named in the warnings returned."""
        request = json.loads(request) if isinstance(request, str) else request
        said: list[str] = []
        self.given |= tables or {}
        self.pivots = int(request.get("numPivots") or self.pivots)
        for raw in request.get("sources") or ():
            spec = SourceSpec.of(raw)
            self.sources[spec.name] = spec
        for raw in request.get("search") or ():
            try:
                spec = AttributeSpec.of(raw)
                if spec.column == "id":
                    raise ValueError("an attribute can't be called id; give it a name by alias_column")
                if spec.identity in self.attributes:
                    raise ValueError(f"{spec.column} is mounted already for {spec.operation}")
                if spec.dataset not in self.given and spec.source not in self.sources:
                    raise ValueError(f"unknown source {spec.source}")
                table = self.table(spec)
                key = spec.key or table.columns[0]
                if not spec.columns:
                    spec = replace(spec, columns=tuple(c for c in table.columns if c != key))
                missing = [c for c in (*spec.columns, key) if c not in table.columns]
                if missing:
                    raise ValueError(f"{spec.dataset} has no column {', '.join(missing)}")
                self.rows(spec)
            except ValueError as e:
                said.append(str(e))
                continue
            self.attributes[spec.identity] = spec
        if any(a.operation == "pivot_based" for a in self.attributes.values()):
            self._forget_index()
        self.warnings += said
        return said

    def add_rows(self, column: str, operation: str, rows: DataFrame) -> None:
        """Further rows (id, value) of a mounted attribute, such as a stream's micro-batch brings."""
        self._added.setdefault((column, operation), []).append(rows.select("id", "value"))
        self._forget_index()

    def _forget_index(self) -> None:
        self.metrics, self._stored = (), None

    def delete(self, request: dict | str) -> list[str]:
        """Removes attributes. With one pivot attribute its whole index goes."""
        request = json.loads(request) if isinstance(request, str) else request
        said = []
        for r in request.get("remove") or ():
            found = [i for i in self.attributes if i[0] == r.get("column") and r.get("operation") in (None, i[1])]
            if not found:
                said.append(f"{r.get('column')} is not mounted")
            for i in found:
                self.attributes.pop(i, None)
                if i[1] == "pivot_based":
                    for other in [x for x in self.attributes if x[1] == "pivot_based"]:
                        self.attributes.pop(other)
                    self._forget_index()
        return said

    def unmount(self) -> None:
        for held in (self.sources, self.attributes, self._tables, self._rows, self._dates, self._added, self.given):
            held.clear()
        self._forget_index()

    def catalog(self, operation: str | None = None, column: str | None = None) -> DataFrame:
        """(column, operation, datatype, sample, queryable); sample is the value of the least id."""
        kinds = {"number": "NUMBER", "date": "DATE_TIME", "point": "GEOLOCATION", "keywords": "KEYWORD_SET", "text": "STRING", "vector": "NUMBER_ARRAY"}
        rows = []
        for a in self.attributes.values():
            if operation in (None, a.operation) and column in (None, a.column):
                value = self.attribute(a)
                one = value.where("value is not null").agg(F.min_by(values.shown(F.col("value"), a.kind), "id")).scalar()
                rows.append(self.spark.range(1).select(F.lit(a.column).alias("column"), F.lit(a.operation).alias("operation"), F.lit(kinds[a.kind]).alias("datatype"), one.alias("sample"), F.lit(a.queryable).alias("queryable")))
        if not rows:
            return self.spark.createDataFrame([], "column string, operation string, datatype string, sample string, queryable boolean")
        out = rows[0]
        for r in rows[1:]:
            out = out.unionAll(r)
        return out

    def settings(self) -> dict[str, Any]:
        return {
            "provided_name": self.name, "max_result_window": measures.MOST_RESULTS * measures.INFLATION,
            "creation_date": self.created.isoformat(), "query_timeout": self.timeout, "attributes": len(self.attributes),
        }

    # Data

    @staticmethod
    def _place(spec: AttributeSpec) -> tuple:
        return spec.source, spec.dataset, spec.separator, spec.header, spec.max_lines

    def _group(self, spec: AttributeSpec) -> tuple:
        """Attributes of one group are columns of the same rows."""
        return *self._place(spec), spec.key, spec.unique_keys

    def table(self, spec: AttributeSpec) -> DataFrame:
        """The dataset that an attribute belongs to, read once an engine."""
        place = self._place(spec)
        if place not in self._tables:
            self._tables[place] = self._read(spec)
        return self._tables[place]

    def _read(self, spec: AttributeSpec) -> DataFrame:
        if spec.dataset in self.given:
            return self.given[spec.dataset]
        source = self.sources[spec.source]
        kind = source.type.lower()
        if kind == "csv":
            return readers.delimited(self.spark, source.directory or source.url, spec.dataset, spec.separator, spec.header, max_lines=spec.max_lines)
        if kind == "parquet":
            rows = self.spark.read.parquet(f"{source.directory.rstrip('/')}/{spec.dataset}")
            return rows.limit(spec.max_lines) if spec.max_lines else rows
        if kind == "jdbc":
            return readers.database(self.spark, source.url, spec.dataset, source.driver, source.username, source.password)
        if kind == "restapi":
            rest.register(self.spark)
            options = {"url": source.url, "key": spec.key or "id", "fields": ",".join(spec.columns)}
            options |= {k: v for k, v in {"api_key": source.api_key, "user": source.username, "password": source.password}.items() if v}
            return self.spark.read.format("search_index").options(**options).load().withColumnRenamed("id", spec.key or "id")
        raise ValueError(f"unknown type of source {source.type}")

    def rows(self, spec: AttributeSpec) -> DataFrame:
        """_key and the columns of the attribute's table, one row a key, those without one left out.

        Keys that are said to be unique, and those of databases and services, are taken as such. Otherwise they are
        counted, once; only a table in which some repeat is written again, with the row of each that counts.
        """
        place = self._group(spec)
        if place not in self._rows:
            raw = self.table(spec)
            rows = raw.withColumn("_key", F.col(f"`{spec.key or raw.columns[0]}`").cast("string")).where("_key is not null and _key <> ''")
            source = self.sources.get(spec.source)
            in_place = spec.dataset not in self.given and source is not None and source.type.lower() in ("jdbc", "restapi")
            if not spec.unique_keys and not in_place:
                repeated = rows.groupBy("_key").count().where("count > 1").limit(1).count()
                rows = cut(readers.one_row_a_key(rows, "_key")) if repeated else rows
            self._rows[place] = rows
        return self._rows[place]

    def _value(self, spec: AttributeSpec, rows: DataFrame) -> Column:
        if spec.transform_by:
            return readers.attribute_value(rows, list(spec.columns), "keywords", spec.token_delimiter)
        return readers.attribute_value(rows, list(spec.columns), spec.kind, spec.token_delimiter)

    def attribute(self, spec: AttributeSpec) -> DataFrame:
        """(id, value) of one attribute."""
        rows = self._together([spec])
        return rows.select("id", F.col(f"`{spec.column}`").alias("value"))

    def _together(self, specs: list[AttributeSpec], condition: Column | str | None = None) -> DataFrame:
        """id and one column an attribute. Attributes of the same table are one scan."""
        groups: dict[tuple, list[AttributeSpec]] = {}
        for s in specs:
            groups.setdefault(self._group(s), []).append(s)
        joined: DataFrame | None = None
        for of_table in groups.values():
            raw = self.rows(of_table[0])
            if condition is not None and len(groups) == 1:
                raw = raw.where(condition)
            rows = raw.select(F.col("_key").alias("id"), *(self._value(s, raw).alias(s.column) for s in of_table))
            for s in of_table:
                for more in self._added.get(s.identity, ()):
                    kept = rows.select("id", *(F.col(f"`{o.column}`") for o in of_table if o is not s), F.col(f"`{s.column}`").alias("_old"))
                    rows = kept.join(more.withColumnRenamed("value", "_new"), "id", "full").withColumn(s.column, F.coalesce("_new", "_old")).drop("_new", "_old")
                if s.transform_by:
                    rows = self._transformed(rows, s)
                elif s.normalized and s.kind == "number":
                    rows = rows.withColumn(s.column, normalized(rows, s.column, s.normalized))
            joined = rows if joined is None else joined.join(rows, "id", "full")
        if joined is None:
            raise ValueError("no attribute")
        if condition is not None and len(groups) > 1:
            joined = joined.where(condition)
        return joined

    def _transformed(self, rows: DataFrame, s: AttributeSpec) -> DataFrame:
        of = next((a for a in self.attributes.values() if a.operation == "vector_dictionary" and s.transform_by in (a.column, *a.columns)), None)
        if of is None:
            raise ValueError(f"no vector dictionary {s.transform_by}")
        terms = self.attribute(of).selectExpr("id term", "value vector")
        vectors = keyword_vectors(rows.select("id", F.col(f"`{s.column}`").alias("keywords")), terms)
        return rows.drop(s.column).join(vectors.withColumnRenamed("vector", s.column), "id", "left")

    # Searches

    def _criterion(self, spec: AttributeSpec, q: QuerySpec) -> ranking.Criterion:
        value: Any = q.value
        if spec.kind == "number" and value != "max":
            value = values.parse_number(value)
        elif spec.kind == "date" and value != "max":
            value = values.parse_date(str(value)) if values.parse_date(str(value)) is not None else values.parse_number(value)
        elif spec.kind == "point":
            value = values.parse_point(value)
        elif spec.kind == "keywords":
            parsed = values.parse_value(value if not isinstance(value, str) else [t for t in value.strip().strip("[]").split(",")])
            value = parsed[1] or None
        elif spec.kind == "text":
            value = None if value in (None, "") else str(value)
        if value is None:
            raise ValueError(f"{q.value!r} is no value for {q.column}")
        return ranking.Criterion(spec.column, spec.kind, F.col(f"`{spec.column}`"), value, q.weights, q.decay, q.scale, spec.qgram, spec.metric)

    def search(self, request: dict | str | SearchSpec) -> Response:
        """Runs a search; errors in the request raise ValueError."""
        spec = request if isinstance(request, SearchSpec) else SearchSpec.of(request)
        if not spec.queries:
            raise ValueError("no attribute is queried")
        if spec.algorithm not in ranking.ALGORITHMS:
            raise ValueError(f"unknown algorithm {spec.algorithm}")
        by_pivot = spec.algorithm == "pivot_based"
        found = []
        for q in spec.queries:
            options = [a for a in self.attributes.values() if a.column == q.column and a.queryable and (a.operation == "pivot_based") == by_pivot]
            if not options:
                raise ValueError(f"{q.column} is not available to {spec.algorithm}")
            found.append(options[0])
        said: list[str] = []
        extra_specs = []
        for e in spec.extra:
            some = [a for a in self.attributes.values() if a.column == e and a.operation not in ("pivot_based", "vector_dictionary")] or [a for a in self.attributes.values() if a.column == e and a.operation == "pivot_based"]
            if some:
                extra_specs.append(some[0])
            else:
                said.append(f"unknown extra column {e} is left out")
        condition = self._condition(spec)
        if by_pivot:
            # Building is no part of a search.
            self.index()
        with within(self.spark, self.timeout):
            response = self._by_pivot(spec, found, extra_specs, condition) if by_pivot else self._by_rank(spec, found, extra_specs, condition)
        response.warnings, response.timeout = said, self.timeout
        return response

    def _condition(self, spec: SearchSpec) -> Column | None:
        parts = [F.expr(spec.filter)] if spec.filter else []
        for q in spec.queries:
            if q.filter:
                parts.append(rest.json_filter(q.filter) if not isinstance(q.filter, str) or values.is_json(q.filter) else F.expr(q.filter))
        out = None
        for p in parts:
            out = p if out is None else out & p
        return out

    def _extended(self, rows: DataFrame, extra: list[AttributeSpec]) -> DataFrame:
        """Extra columns of other tables meet the k results of each combination, not the entities."""
        if not extra:
            return rows
        rows = cut(rows)
        ids = F.broadcast(rows.select("id").distinct())
        for e in extra:
            more = self.attribute(e).select("id", values.shown(F.col("value"), e.kind).alias(f"x_{e.column}")).join(ids, "id")
            rows = rows.join(F.broadcast(more), "id", "left")
        return rows

    def _by_rank(self, spec: SearchSpec, found: list[AttributeSpec], extra: list[AttributeSpec], condition: Column | None) -> Response:
        queried = {f.column for f in found}
        extra = [e for e in extra if e.column not in queried]
        # Extra columns of the tables searched are read in the scan that scores them.
        groups = {self._group(f) for f in found}
        along = [e for e in extra if self._group(e) in groups and not e.transform_by]
        entities = self._together([*found, *along], condition)
        entities = entities.withColumns({e.column: values.shown(F.col(f"`{e.column}`"), e.kind) for e in along})
        criteria = [self._criterion(a, q) for a, q in zip(found, spec.queries)]
        rows, prepared = ranking.rank(entities, criteria, spec.k, spec.algorithm, extra=[e.column for e in along])
        rows = self._extended(rows, [e for e in extra if e not in along])
        names = self._names(rows, found)
        return Response(names, tuple(a.column for a in found), tuple(a.kind for a in found), tuple(e.column for e in extra), spec.k, prepared)

    def _names(self, rows: DataFrame, found: list[AttributeSpec]) -> DataFrame:
        """Ids with the address prefix of a name dictionary, if there is one: that of a table searched before others."""
        named = [a for a in self.attributes.values() if a.operation == "name_dictionary" and a.prefix_url]
        tables = {(f.source, f.dataset) for f in found}
        named.sort(key=lambda a: (a.source, a.dataset) not in tables)
        return rows.withColumn("id", F.concat(F.lit(named[0].prefix_url), "id")) if named else rows

    def index(self) -> tuple[pivot.Metric, ...]:
        """Fits the pivots of the mounted pivot attributes and stores the embedded rows, if that isn't done yet."""
        specs = [a for a in self.attributes.values() if a.operation == "pivot_based"]
        if not self.metrics and specs:
            rows = self._together(specs)
            self.metrics = pivot.fit(rows, [pivot.Metric(a.column, a.metric or "euclidean") for a in specs], self.pivots)
            self._stored = pivot.stored(rows, self.metrics, f"{shared_folder(self.spark)}/index-{uuid.uuid4()}")
        return self.metrics

    def _by_pivot(self, spec: SearchSpec, found: list[AttributeSpec], extra: list[AttributeSpec], condition: Column | None) -> Response:
        """By the stored index; a filter selects ids, which meet the index's rows in a semi-join."""
        wanted = [pivot.Wanted(a.column, self._vector(a, q), q.weights, q.scale, q.decay) for a, q in zip(found, spec.queries)]
        for w in wanted:
            ranking.check_weights([ranking.Criterion(w.name, "vector", F.lit(None), None, w.weights)])
        metrics = self.index()
        rows = self._stored
        if condition is not None:
            rows = rows.join(self._together(found, condition).select("id"), "id", "left_semi")
        rows = pivot.search(rows, metrics, wanted, spec.k, bound=True)
        others = [e for e in extra if e.column not in {f.column for f in found}]
        rows = self._extended(rows, others)
        return Response(self._names(rows, found), tuple(a.column for a in found), ("vector",) * len(found), tuple(e.column for e in others), spec.k)

    def _vector(self, a: AttributeSpec, q: QuerySpec) -> tuple[float, ...]:
        if a.transform_by:
            words = values.parse_value(q.value if not isinstance(q.value, str) else [t for t in q.value.split(",")])[1] or []
            of = self.spark.createDataFrame([("q", [str(w) for w in words])], "id string, keywords array<string>")
            dictionary = next(x for x in self.attributes.values() if x.operation == "vector_dictionary" and a.transform_by in (x.column, *x.columns))
            got = keyword_vectors(of, self.attribute(dictionary).selectExpr("id term", "value vector")).first()
            if got is None or got["vector"] is None:
                raise ValueError(f"none of {q.value!r} is in the dictionary")
            return tuple(got["vector"])
        kind, value = values.parse_value(q.value)
        if isinstance(q.value, (str, int)) and self._holds_dates(a):
            when = values.parse_date(str(q.value))
            if when is not None:
                return (when,)
        if kind == "point":
            return tuple(value)
        if kind == "vector":
            return tuple(value)
        if kind in ("number", "date"):
            return (float(value),)
        point = values.parse_point(q.value)
        if point is not None:
            return point
        raise ValueError(f"{q.value!r} is no value for {q.column}")

    def _holds_dates(self, a: AttributeSpec) -> bool:
        """Whether the attribute's values are read as dates: by its type, and of texts if more are dates than numbers."""
        if a.identity not in self._dates:
            raw = self.table(a)
            first = F.col(f"`{a.columns[0]}`")
            kind = raw.schema[a.columns[0]].dataType.simpleString()
            if kind.startswith("timestamp") or kind == "date":
                self._dates[a.identity] = True
            elif len(a.columns) > 1 or kind != "string":
                self._dates[a.identity] = False
            else:
                number = F.trim(first).try_cast("double").isNotNull()
                date = values.epoch_of(F.trim(first)).isNotNull() & ~number
                n = raw.agg(F.count_if(date).alias("dates"), F.count_if(number).alias("numbers")).first()
                self._dates[a.identity] = n["dates"] > n["numbers"]
        return self._dates[a.identity]

    def sql(self, statement: str) -> Response:
        return self.search(sqlfront.parse(statement))
