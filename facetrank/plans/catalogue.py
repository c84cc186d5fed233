"""Queries of the engine's own operators by name, each with its SQL.

The SQL is made from the same short descriptions as the plans, by text of its own: distances, scales, similarities and
ranks are spelled out for DuckDB, and share nothing with the Spark side but names and parameters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetrank.functions import measures, values
from facetrank.functions.runtime import spread, table
from facetrank.functions.text import qgrams
from facetrank.operators import analytics, pivot, points, ranking
from facetrank.operators.normalize import normalized
from facetrank.operators.ranking import Criterion
from facetrank.operators.vectors import keyword_vectors
from facetrank.plans import checks, sqlfront
from facetrank.plans.engine import Engine
from facetrank.sources import rest

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Facet:
    """One attribute of a query: for Spark (an expression, a query value) and for SQL (value and distance)."""

    name: str
    kind: str
    expression: str
    query: object
    sql_value: str
    sql_distance: str
    weights: tuple[float, ...] | None = None
    scale: float | None = None
    decay: float = measures.DECAY
    qgram: int = 3
    metric: str | None = None

    def criterion(self) -> Criterion:
        return Criterion(self.name, self.kind, F.expr(self.expression), self.query, self.weights, self.decay, self.scale, self.qgram, self.metric)


def number(name: str, column: str, query: object, **more) -> Facet:
    at = f"(select max({column})::double from e)" if query == "max" else repr(float(query))
    return Facet(name, "number", f"cast({column} as double)", query, f"{column}::double", f"abs({column}::double - {at})", **more)


def date(name: str, column: str, query: str, **more) -> Facet:
    epoch = values.parse_date(query)
    return Facet(
        name, "date", f"unix_micros(cast({column} as timestamp)) / 1e6", epoch, f"epoch_us({column}) / 1e6", f"abs(epoch_us({column}) / 1e6 - {epoch!r})", **more
    )


def point(name: str, x: str, y: str, query: tuple[float, float], **more) -> Facet:
    return Facet(
        name, "point", f"named_struct('x', cast({x} as double), 'y', cast({y} as double))", query, f"{x}::double",
        f"sqrt(({x}::double - {query[0]!r}) ** 2 + ({y}::double - {query[1]!r}) ** 2)", **more,
    )


def _jaccard(a: str, b: str) -> str:
    return f"(1 - len(list_intersect({a}, {b}))::double / len(list_distinct(list_concat({a}, {b}))))"


def keywords(name: str, spark_array: str, sql_list: str, query: list[str], **more) -> Facet:
    wanted = "[" + ", ".join(f"'{q}'" for q in query) + "]"
    return Facet(name, "keywords", spark_array, query, "null", _jaccard(sql_list, wanted), **more)


def text(name: str, column: str, query: str, q: int = 3, **more) -> Facet:
    def grams(s: str) -> str:
        return f"list_distinct(list_transform(range(1, greatest(len({s}) - {q - 2}, 1)), lambda i: {s}[i:i + {q - 1}]))"

    return Facet(name, "text", column, query, "null", _jaccard(grams(column), grams(f"'{query}'")), qgram=q, **more)


def vector(name: str, column: str, query: list[float], metric: str, **more) -> Facet:
    wanted = "[" + ", ".join(repr(float(x)) for x in query) + "]"
    gaps = f"list_transform(list_zip({column}::double[], {wanted}), lambda z: abs(z[1] - z[2]))"
    distance = {
        "manhattan": f"list_sum({gaps})",
        "euclidean": f"sqrt(list_sum(list_transform({gaps}, lambda g: g * g)))",
        "chebyshev": f"list_max({gaps})",
    }[metric]
    return Facet(name, "vector", f"cast({column} as array<double>)", query, "null", distance, metric=metric, **more)


@dataclass(frozen=True)
class Ranked:
    """A ranking query: entity table with an id, facets, k, and how lists are used."""

    source: str
    id: str
    facets: tuple[Facet, ...]
    k: int = 10
    algorithm: str = "threshold"
    filter: str | None = None
    sql_filter: str | None = None
    extra: tuple[str, ...] = ()
    length: int | None = None
    sql_source: str | None = None
    entities: Callable[[SparkSession, str], DataFrame] | None = None

    def rows(self, spark: SparkSession, folder: str) -> DataFrame:
        entities = self.entities(spark, folder) if self.entities else table(spark, folder, self.source)
        entities = entities.withColumn("id", F.col(self.id).cast("string"))
        if self.filter:
            entities = entities.where(self.filter)
        return entities

    def run(self, spark: SparkSession, folder: str) -> tuple[DataFrame, ranking.Prepared]:
        return ranking.rank(self.rows(spark, folder), [f.criterion() for f in self.facets], self.k, self.algorithm, self.extra, self.length)

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        found, _ = self.run(spark, folder)
        return found.select(
            F.col("combo").cast("int").alias("combo"), F.col("rank").cast("bigint").alias("rank"), "id", F.round("score", 6).alias("score"), "exact",
            *(F.round(f"s{j}", 6).alias(f"{f.name}_score") for j, f in enumerate(self.facets)),
            *(F.round(f"v{j}", 6).alias(f"{f.name}_value") for j, f in enumerate(self.facets) if f.kind in ("number", "date")),
            *(F.col(f"x_{x}").alias(x) for x in self.extra),
        )

    def sql(self) -> str:
        m, k = len(self.facets), self.k
        length = self.length or (k * 1000 if m > 1 else k)
        combos = max(len(f.weights or (1,)) for f in self.facets)
        where = f" where {self.sql_filter or self.filter}" if self.filter else ""
        extra = "".join(f", {x}" for x in self.extra)
        parts = [f"e as (select * from {self.sql_source or self.source}{where})"]
        parts.append(
            f"d as (select {self.id}::varchar id{extra}, " + ", ".join(f"{f.sql_distance} d{j}, {f.sql_value} v{j}" for j, f in enumerate(self.facets)) + " from e)"
        )
        for j, f in enumerate(self.facets):
            near = f"d{j} is not null" + (f" and d{j} < 1 - 1e-6" if f.kind in ("keywords", "text") else "")
            parts.append(f"l{j} as (select id, d{j} from d where {near} order by d{j}, id limit {length})")
            if f.scale:
                parts.append(f"c{j} as (select {f.scale!r} c)")
            else:
                kth = f"(select max(x) from (select d{j} x from d where {near} order by d{j} limit {k}))"
                parts.append(f"c{j} as (select coalesce(nullif({kth}, 0), (select min(d{j}) from d where {near} and d{j} > 0)) c)")

        def similar(j: int, d: str) -> str:
            f = self.facets[j]
            cut = f" when abs({d} - 1) < 1e-6 then 0" if f.kind in ("keywords", "text") else ""
            return f"coalesce(case{cut} when {d} = 0 then 1 else exp(-{f.decay!r} * {d} / (select c from c{j})) end, 0)"

        weights: list[list[str]] = []
        for j, f in enumerate(self.facets):
            if f.weights:
                weights.append([repr(w) for w in (f.weights if len(f.weights) > 1 else f.weights * combos)])
            elif m == 1:
                weights.append(["1.0"] * combos)
            else:
                parts.append(
                    f"""w{j} as (
  select case when n <= {k} or p >= n then s[n] when p < 1 then s[1] else s[floor(p)::int] + (p - floor(p)) * (s[floor(p)::int + 1] - s[floor(p)::int]) end w
  from (select list_sort(list(s)) s, count(*)::int n, (count(*) + 1) * (1 - {k}::double / count(*)) p from (select {similar(j, f'd{j}')} s from l{j})))"""
                )
                weights.append([f"(select w from w{j})"] * combos)
        mean = lambda i, part: "(" + " + ".join(f"{weights[j][i]} * {part(j)}" for j in range(m)) + ") / (" + " + ".join(weights[j][i] for j in range(m)) + ")"
        parts.append(f"s as (select *, {', '.join(f'{similar(j, f"d{j}")} s{j}' for j in range(m))} from d)")
        if m == 1:
            scored = f"select 0 combo, id, s0 score, d0 o, true exact from s join (select id from l0) using (id)"
            order = "o, id"
        else:
            order = "o desc, id"
            if self.algorithm == "threshold":
                each = [f"select {i} combo, id, {mean(i, lambda j: f's{j}')} score, true exact from s" for i in range(combos)]
            else:
                parts.append(
                    "t as (select id, " + ", ".join(f"t{j}.s t{j}" for j in range(m)) + " from (" + " union ".join(f"select id from l{j}" for j in range(m)) + ") u "
                    + " ".join(f"left join (select id, {similar(j, f'd{j}')} s from l{j}) t{j} using (id)" for j in range(m)) + ")"
                )
                low = lambda i: mean(i, lambda j: f"coalesce(t{j}, 0)")
                high = lambda i: mean(i, lambda j: f"coalesce(t{j}, (select coalesce(min(t{j}), 0) from t))")
                half = " + {high}" if self.algorithm == "partial_random_access" else " * 2"
                each = [f"select {i} combo, id, round({low(i)}, 9) low, round({high(i)}, 9) high, ({low(i)}{half.format(high=high(i))}) / 2 score from t" for i in range(combos)]
            scored = " union all ".join(f"select *, round(score, 9) o from ({x})" for x in each)
        if m == 1 or self.algorithm == "threshold":
            parts.append(f"r as (select *, row_number() over (partition by combo order by {order}) rank from ({scored}))")
        else:
            # A score is certain if the bounds agree; by lower bounds, nothing that follows may have a greater upper bound.
            after = f" and low >= coalesce(max(high) over (partition by combo order by {order} rows between 1 following and unbounded following), 0)"
            sure = "low = high" + (after if self.algorithm == "no_random_access" else "")
            parts.append(f"b as (select *, row_number() over (partition by combo order by {order}) rank, {sure} sure from ({scored}))")
            parts.append("r as (select combo, id, score, rank, bool_and(sure) over (partition by combo order by rank rows unbounded preceding) exact from b)")
        facets = "".join(f", round(s{j}, 6) {f.name}_score" for j, f in enumerate(self.facets))
        shown = "".join(f", round(v{j}, 6) {f.name}_value" for j, f in enumerate(self.facets) if f.kind in ("number", "date"))
        return f"with {', '.join(parts)}\nselect combo, rank, id, round(score, 6) score, exact{facets}{shown}{extra} from r join s using (id) where rank <= {k}"


_PART_TOKENS = "split(concat_ws(' ', p_name, p_type, p_brand), ' ')"
_PART_LIST = "string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ')"


def _customers(spark: SparkSession, folder: str, how: str) -> DataFrame:
    rows = table(spark, folder, "customer")
    return rows.withColumn("z", normalized(rows, "c_acctbal", how))


def _suppliers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").selectExpr("*", "cast(s_suppkey * 7 % 360 - 180 as double) lon", "cast(s_suppkey * 11 % 170 - 85 as double) lat")


def _customer_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their customer's balance: attributes of two sources, brought together by a key."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return orders.join(customers, "o_custkey", "left")


def _customer_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with the sum of their orders; most sums are there, some are not."""
    sums = table(spark, folder, "orders").where("o_custkey % 3 <> 0").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("total"))
    return table(spark, folder, "customer").join(sums, "c_custkey", "left")


_VECTOR = [round(((i * 37) % 21 - 10) / 10, 1) for i in range(64)]
_TWO = (number("price", "o_totalprice", 150000, weights=(0.8,)), date("day", "o_orderdate", "1996-06-01", weights=(0.4,)))
_COMBOS = (number("price", "o_totalprice", 150000, weights=(0.8, 0.1, 1.0)), date("day", "o_orderdate", "1996-06-01", weights=(0.4, 0.9, 0.0)))
_PART = (
    number("price", "p_retailprice", 1000, weights=(0.7,)),
    text("name", "p_name", "blue ivory", weights=(0.5,)),
    keywords("tags", _PART_TOKENS, _PART_LIST, ["STEEL", "Brand#11", "PROMO"], weights=(0.9,)),
)

_NORMAL = {"z": "stddev_samp(c_acctbal)", "unity": "(max(c_acctbal) - min(c_acctbal))"}


def _normal(how: str) -> Ranked:
    return Ranked(
        "customer", "c_custkey", (number("z", "z", 0.25),), entities=lambda s, f: _customers(s, f, how),
        sql_source=f"(select *, (c_acctbal - (select avg(c_acctbal) from customer)) / (select {_NORMAL[how]} from customer) z from customer)",
    )


RANKED: dict[str, Ranked] = {
    "num_knn": Ranked("customer", "c_custkey", (number("balance", "c_acctbal", 1000),)),
    "num_knn_max": Ranked("customer", "c_custkey", (number("balance", "c_acctbal", "max"),)),
    "num_knn_zero_scale": Ranked("part", "p_partkey", (number("size", "p_size", 10),)),
    "num_knn_z": _normal("z"),
    "num_knn_unity": _normal("unity"),
    "temporal_knn": Ranked("orders", "o_orderkey", (date("day", "o_orderdate", "1995-03-15 12:00:00"),)),
    "temporal_knn_events": Ranked("events", "event_id", (date("at", "ts", "2024-01-15T08:30:00"),)),
    "spatial_knn": Ranked("part", "p_partkey", (point("place", "p_retailprice", "p_size", (1200.0, 25.0)),)),
    "cat_topk": Ranked("part", "p_partkey", (keywords("tags", _PART_TOKENS, _PART_LIST, ["blue", "STEEL", "Brand#23"]),)),
    "text_topk": Ranked("part", "p_partkey", (text("name", "p_name", "small green ring"),)),
    "text_topk_q2": Ranked("customer", "c_custkey", (text("name", "c_name", "Customer#000000042", q=2),)),
    "metric_l1": Ranked("embeddings", "vec_id", (vector("v", "embedding", _VECTOR, "manhattan"),)),
    "metric_l2": Ranked("embeddings", "vec_id", (vector("v", "embedding", _VECTOR, "euclidean"),)),
    "metric_linf": Ranked("embeddings", "vec_id", (vector("v", "embedding", _VECTOR, "chebyshev"),)),
    "ta_two": Ranked("orders", "o_orderkey", _TWO),
    "ta_three_types": Ranked("part", "p_partkey", _PART),
    "ta_combos": Ranked("orders", "o_orderkey", _COMBOS),
    "ta_cross_source": Ranked(
        "orders", "o_orderkey", (number("price", "o_totalprice", 90000, weights=(0.6,)), number("balance", "c_acctbal", 5000, weights=(0.9,))),
        entities=_customer_orders, sql_source="(select o_orderkey, o_totalprice, c_acctbal from orders left join customer on o_custkey = c_custkey)",
    ),
    "ta_missing": Ranked(
        "customer", "c_custkey", (number("balance", "c_acctbal", 2500, weights=(1.0,)), number("total", "total", 1500000, weights=(0.7,))),
        entities=_customer_sums,
        sql_source="(select c.*, total from customer c left join (select o_custkey, sum(o_totalprice) total from orders where o_custkey % 3 <> 0 group by 1) on o_custkey = c_custkey)",
    ),
    "ta_filter": Ranked("orders", "o_orderkey", _TWO, filter="o_orderpriority = '1-URGENT' and o_totalprice between 50000 and 400000"),
    "ta_extra": Ranked("orders", "o_orderkey", _TWO, extra=("o_orderstatus", "o_custkey")),
    "ta_user_scale_decay": Ranked(
        "orders", "o_orderkey",
        (number("price", "o_totalprice", 150000, weights=(0.8,), scale=20000.0, decay=0.5), date("day", "o_orderdate", "1996-06-01", weights=(0.4,), scale=864000.0, decay=0.1)),
    ),
    "auto_weights": Ranked("orders", "o_orderkey", (number("price", "o_totalprice", 150000), date("day", "o_orderdate", "1996-06-01"))),
    "pra": Ranked("orders", "o_orderkey", _TWO, algorithm="partial_random_access", length=2500),
    "nra": Ranked("orders", "o_orderkey", _TWO, algorithm="no_random_access", length=2500),
    "nra_combos": Ranked("orders", "o_orderkey", _COMBOS, algorithm="no_random_access"),
}


def spatial_haversine(spark: SparkSession, folder: str) -> DataFrame:
    here = F.struct(F.lit(12.5).alias("x"), F.lit(41.9).alias("y"))
    rows = _suppliers(spark, folder).select(F.col("s_suppkey").cast("string").alias("id"), F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")).alias("p"))
    d = rows.select("id", F.round(measures.haversine(F.col("p"), here), 6).alias("degrees"))
    return d.orderBy("degrees", "id").limit(10)


def list_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """One attribute's candidate list, as the list-based algorithms see it."""
    entities = RANKED["ta_two"].rows(spark, folder)
    return ranking.listed(entities, _TWO[0].criterion(), 500).select("id", F.round("d", 6).alias("d"))


_PRICES = (10_000, 120_000.5, 450_000)


def batch_knn(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest orders of several prices and a date at once."""
    entities = RANKED["ta_two"].rows(spark, folder)
    asked = [replace(_TWO[0], name=str(x), query=x, weights=None).criterion() for x in _PRICES] + [_TWO[1].criterion()]
    return ranking.batch(entities, asked, 7).select("query", "rank", "id", F.round("d", 6).alias("d"))


def sim_matrix(spark: SparkSession, folder: str) -> DataFrame:
    rows, prepared = RANKED["ta_two"].run(spark, folder)
    return ranking.similarity_matrix(rows, prepared).select("id_l", "id_r", F.round("score", 6).alias("score"))


def _sim_matrix_sql() -> str:
    one = RANKED["ta_two"]
    inner = one.sql().replace("with ", "", 1)
    ctes, select = inner.rsplit("\nselect ", 1)
    return f"""with {ctes},
top as (select r.id, v0, v1 from r join s using (id) where rank <= {one.k})
select a.id id_l, b.id id_r, round((
  0.8 * case when a.v0 = b.v0 then 1 else exp(-0.05 * abs(a.v0 - b.v0) / (select c from c0)) end
  + 0.4 * case when a.v1 = b.v1 then 1 else exp(-0.05 * abs(a.v1 - b.v1) / (select c from c1)) end) / (0.8 + 0.4), 6) score
from top a, top b"""


#: Milliseconds that a search of these queries may take: they are run over whole tables of any size, not by a user who waits.
PATIENCE = 3_600_000


def _order_engine(spark: SparkSession, folder: str) -> Engine:
    engine = Engine(spark)
    engine.timeout = PATIENCE
    engine.mount(
        {
            "sources": [{"name": "files", "type": "parquet", "directory": folder}],
            "search": [
                {"source": "files", "dataset": "orders.parquet", "key_column": "o_orderkey", "unique_keys": True, "operation": "numerical_topk", "search_column": "o_totalprice"},
                {"source": "files", "dataset": "orders.parquet", "key_column": "o_orderkey", "unique_keys": True, "operation": "temporal_topk", "search_column": "o_orderdate"},
                {"source": "files", "dataset": "orders.parquet", "key_column": "o_orderkey", "unique_keys": True, "operation": "categorical_topk", "search_column": "o_orderpriority"},
            ],
        }
    )
    return engine


def _answer(engine: Engine, statement: str) -> DataFrame:
    found = engine.sql(statement)
    return found.rows.select(F.col("rank").cast("bigint").alias("rank"), "id", F.round("score", 6).alias("score"), *(F.round(f"s{j}", 6).alias(f"{n}_score") for j, n in enumerate(found.names)))


def sql_q1(spark: SparkSession, folder: str) -> DataFrame:
    statement = "SELECT * FROM orders WHERE o_totalprice ~= '150000' AND o_orderdate ~= '1996-06-01' WEIGHTS 0.8, 0.4 ALGORITHM threshold LIMIT 10;"
    return _answer(_order_engine(spark, folder), statement)


def sql_between_filter(spark: SparkSession, folder: str) -> DataFrame:
    statement = "SELECT * FROM orders WHERE o_totalprice ~= 150000 AND o_orderdate ~= '1996-06-01' AND o_totalprice BETWEEN 160000 AND 300000 AND o_orderstatus <> 'F' WEIGHTS 0.8, 0.4 LIMIT 10"
    return _answer(_order_engine(spark, folder), statement)


def json_filter(spark: SparkSession, folder: str) -> DataFrame:
    statement = """SELECT * WHERE o_totalprice ~= 150000 AND jsonfilter('[{"range": {"o_totalprice": {"gte": 100000, "lt": 140000}}}, {"match": {"o_orderstatus": "o"}}]') LIMIT 10"""
    return _answer(_order_engine(spark, folder), statement)


def _named(one: Ranked, names: tuple[str, ...]) -> str:
    columns = ", ".join(f"{f.name}_score {n}_score" for f, n in zip(one.facets, names))
    return f"select rank, id, score, {columns} from ({one.sql()})"


_SQL_NAMES = ("o_totalprice", "o_orderdate")
_PIVOTS = (tuple(_VECTOR), tuple(-x for x in _VECTOR), (0.0,) * 64, tuple(0.5 if i % 2 else -0.5 for i in range(64)))
_METRICS = (
    pivot.Metric("v", "euclidean", 4.0, _PIVOTS[:3], ("pd_v_0", "pd_v_1", "pd_v_2")),
    pivot.Metric("label", "manhattan", 2.0, ((0.0,), (9.0,)), ("pd_label_0", "pd_label_1")),
)
_WANTED = (pivot.Wanted("v", tuple(_VECTOR), (0.9, 0.2)), pivot.Wanted("label", (3.0,), (0.5, 1.0)))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Every seventh vector lacks its label."""
    return table(spark, folder, "embeddings").selectExpr(
        "cast(vec_id as string) id", "cast(embedding as array<double>) v", "case when vec_id % 7 <> 0 then array(cast(label as double)) end label"
    )


def pivot_embed(spark: SparkSession, folder: str) -> DataFrame:
    rows = pivot.embedded(_vectors(spark, folder), _METRICS)
    return rows.select("id", *(F.round(c, 6).alias(c) for m in _METRICS for c in m.columns))


def _pivot_rows(found: DataFrame) -> DataFrame:
    return found.select(F.col("combo").cast("int").alias("combo"), F.col("rank").cast("bigint").alias("rank"), "id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


def pivot_search(spark: SparkSession, folder: str) -> DataFrame:
    return _pivot_rows(pivot.search(pivot.embedded(_vectors(spark, folder), _METRICS), _METRICS, _WANTED, 10))


def pivot_search_bounded(spark: SparkSession, folder: str) -> DataFrame:
    """The same, with rows bounded by their pivot distances."""
    return _pivot_rows(pivot.search(pivot.embedded(_vectors(spark, folder), _METRICS), _METRICS, _WANTED, 10, bound=True))


def pivot_auto(spark: SparkSession, folder: str) -> DataFrame:
    """Pivots and scales from a sample."""
    rows = _vectors(spark, folder)
    fitted = pivot.fit(rows, [pivot.Metric("v", "euclidean"), pivot.Metric("label", "manhattan")])
    return _pivot_rows(pivot.search(pivot.embedded(rows, fitted), fitted, _WANTED, 10, bound=True))


def _sql_vector(v: tuple[float, ...]) -> str:
    return "[" + ", ".join(repr(float(x)) for x in v) + "]"


_SQL_VECTORS = "e as (select vec_id::varchar id, embedding::double[] v, case when vec_id % 7 <> 0 then label::double end label from embeddings)"


def _pivot_search_sql() -> str:
    each = []
    for i in range(2):
        w, u = _WANTED[0].weights[i], _WANTED[1].weights[i]
        each.append(
            f"""select {i} combo, *, ({w} * dv / 4.0 + coalesce({u} * dl / 2.0, 0)) / ({w} + {u}) distance,
  ({w} * exp(-0.05 * dv / 4.0) + coalesce({u} * exp(-0.05 * dl / 2.0), 0)) / ({w} + {u}) score from d"""
        )
    return f"""with {_SQL_VECTORS},
d as (select id, list_distance(v, {_sql_vector(tuple(_VECTOR))}::double[]) dv, abs(label - 3.0) dl from e),
n as (select *, row_number() over (partition by combo order by round(distance, 12), id) place from ({" union all ".join(each)}))
select combo, row_number() over (partition by combo order by round(score, 9) desc, id) as rank, id, round(distance, 6) distance, round(score, 6) score
from n where place <= 10"""


def word2vec(spark: SparkSession, folder: str) -> DataFrame:
    """Part names as the mean of their words' vectors; the i-th distinct word has the vector of number i, the rest none."""
    parts = table(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("id"), F.split("p_name", " ").alias("keywords"))
    words = parts.select(F.explode("keywords").alias("term")).distinct()
    from pyspark.sql import Window

    numbered = words.withColumn("n", F.row_number().over(Window.orderBy("term")) - 1)
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("n"), F.col("embedding").cast("array<double>").alias("vector"))
    dictionary = numbered.where("n % 5 <> 4").join(vectors, "n").select("term", "vector")
    made = keyword_vectors(parts, dictionary, size=64)
    return made.select("id", F.posexplode("vector").alias("i", "x")).groupBy("id").agg(F.round(F.sum("x"), 5).alias("total"), F.round(F.max("x"), 5).alias("most"))


def doc_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose sets of words are most like that of a given text."""
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"[^\p{L}\p{N}]+"))
    docs = spread(table(spark, folder, "documents").select("doc_id", "text")).where("text is not null and text <> ''")
    wanted = "fix the pending resolver in cache and update the tests of the nested worker".split()
    entities = docs.select(F.col("doc_id").cast("string").alias("id"), F.array_remove(words(F.col("text")), "").alias("words"))
    found = ranking.singleton(entities, Criterion("words", "keywords", F.col("words"), wanted), 20)
    return found.select("rank", "id", F.round("score", 6).alias("score"), F.round("d0", 6).alias("distance"))


def keyword_freq(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select(F.split("p_name", " ").alias("keywords"))
    return analytics.frequent(analytics.keyword_frequency(parts))


def keyword_share(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").select(F.split("p_name", " ").alias("keywords"))
    return analytics.keyword_frequency(parts, share=True).select("keyword", F.round("share", 6).alias("share"))


def _two_rankings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    a, _ = RANKED["ta_two"].run(spark, folder)
    b, _ = replace(RANKED["ta_combos"], facets=tuple(replace(f, weights=(w,)) for f, w in zip(_TWO, (0.6, 0.6)))).run(spark, folder)
    return a.select("id", F.round("score", 9).alias("score")), b.select("id", F.round("score", 9).alias("score"))


def rank_align(spark: SparkSession, folder: str) -> DataFrame:
    both = analytics.aligned(*_two_rankings(spark, folder))
    return both.select("id", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


def rank_compare(spark: SparkSession, folder: str) -> DataFrame:
    row = analytics.correlations(*_two_rankings(spark, folder))
    return row.select(*(F.round(c, 6).alias(c) for c in ("pearson", "spearman", "kendall")))


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    return _order_engine(spark, folder).catalog()


def bounding_box(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "companies").select(values.point_of(F.col("geometry")).alias("point"))
    return analytics.bounding_box(rows)


def histogram(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.histogram(table(spark, folder, "orders"), "o_totalprice", 0, 500000, 10)


def qgram_sets(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("id"), F.explode(qgrams(F.col("p_name"), 3)).alias("gram"))
    return rows.groupBy("gram").agg(F.count("*").alias("n"))


def number_statistics(spark: SparkSession, folder: str) -> DataFrame:
    from facetrank.operators.normalize import statistics

    return statistics(table(spark, folder, "customer"), "c_acctbal").select(*(F.round(c, 6).alias(c) for c in ("min", "max", "avg", "stdev")), "n")


def filter_json(spark: SparkSession, folder: str) -> DataFrame:
    condition = [{"bool": {"must_not": {"term": {"o_orderstatus": "F"}}, "should": [{"range": {"o_totalprice": {"gt": 400000}}}, {"terms": {"o_orderpriority": ["1-URGENT"]}}]}}]
    return table(spark, folder, "orders").where(rest.json_filter(condition)).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def score_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Scores in the attributes' lists, and the weights by their deviations."""
    one = RANKED["ta_two"]
    entities = one.rows(spark, folder)
    stats = ranking.score_statistics(entities, ranking.prepare(entities, [f.criterion() for f in one.facets], one.k))
    both = stats.join(ranking.deviation_weights(stats), "name")
    return both.select("name", "n", *(F.round(c, 6).alias(c) for c in ("min", "max", "avg", "stdev", "weight")))


def nra_rescored(spark: SparkSession, folder: str) -> DataFrame:
    found, prepared = RANKED["nra"].run(spark, folder)
    return ranking.rescored(found, prepared).select("rank", "id", F.round("score", 6).alias("score"), F.round("exact_score", 6).alias("exact_score"))


def _part_points(spark: SparkSession, folder: str) -> DataFrame:
    place = F.struct(F.col("p_retailprice").cast("double").alias("x"), F.col("p_size").cast("double").alias("y"))
    return table(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("id"), place.alias("place"))


def points_in_box(spark: SparkSession, folder: str) -> DataFrame:
    return points.in_box(_part_points(spark, folder), "place", (920, 10), (960, 20)).select("id")


def points_nearest(spark: SparkSession, folder: str) -> DataFrame:
    near = points.nearest(_part_points(spark, folder), "place", (950.0, 30.0), 25.0, 40)
    return near.select("id", F.round("distance", 6).alias("distance"))


NEWS = {
    "sources": [{"name": "files", "type": "parquet", "directory": ""}],
    "search": [
        {"source": "files", "dataset": "articles.parquet", "key_column": "article_id", "operation": "spatial_knn", "search_column": ["longitude", "latitude"], "alias_column": "position"},
        {"source": "files", "dataset": "articles.parquet", "key_column": "article_id", "operation": "categorical_topk", "search_column": "persons", "token_delimiter": ";"},
        {"source": "files", "dataset": "articles.parquet", "key_column": "article_id", "operation": "temporal_topk", "search_column": "article_ts"},
        {"source": "files", "dataset": "articles.parquet", "key_column": "article_id", "operation": "numerical_topk", "search_column": "positive_sentiment"},
        {"source": "files", "dataset": "articles.parquet", "key_column": "article_id", "operation": "numerical_topk", "search_column": "negative_sentiment"},
        {"source": "files", "dataset": "lda_dictionary.parquet", "key_column": "term", "operation": "vector_dictionary", "search_column": "lda_vector"},
        {"source": "files", "dataset": "articles.parquet", "key_column": "article_id", "operation": "pivot_based", "metric": "Euclidean", "search_column": ["longitude", "latitude"], "alias_column": "position"},
        {"source": "files", "dataset": "articles.parquet", "key_column": "article_id", "operation": "pivot_based", "metric": "Manhattan", "search_column": "positive_sentiment"},
        {"source": "files", "dataset": "articles.parquet", "key_column": "article_id", "operation": "pivot_based", "metric": "Euclidean", "search_column": "organizations", "token_delimiter": ";", "transform_by": "lda_vector"},
    ],
}


def news_engine(spark: SparkSession, folder: str) -> Engine:
    engine = Engine(spark)
    engine.timeout = PATIENCE
    engine.mount(NEWS | {"sources": [{"name": "files", "type": "parquet", "directory": folder}]})
    return engine


def _flat(found) -> DataFrame:
    return found.rows.select("combo", "rank", "id", F.round("score", 6).alias("score"), *(F.round(f"s{j}", 6).alias(f"{n}_score") for j, n in enumerate(found.names)), *(F.col(f"x_{e}").alias(e) for e in found.extra))


_WORLD = {"persons": (0.9, 0.3), "position": (0.5, 0.8), "positive_sentiment": (0.2, 0.6)}
_PEOPLE = ["rhosyn jifakalu", "zaro fisekeha"]


def news_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """Articles by persons, place and sentiment, with two combinations of weights and an extra column."""
    asked = {"persons": _PEOPLE, "position": "POINT(11.5 48.25)", "positive_sentiment": 1.25}
    request = {
        "k": "5", "algorithm": "threshold", "output": {"extra_columns": ["negative_sentiment"]},
        "queries": [{"column": c, "value": v, "weights": [str(w) for w in _WORLD[c]]} for c, v in asked.items()],
    }
    return _flat(news_engine(spark, folder).search(request))


_PERSONS = """list_distinct(list_transform(list_filter(list_transform(string_split(regexp_replace(persons, '^"|"$', '', 'g'), ';'), lambda t: trim(t)), lambda t: t <> ''),
  lambda t: case when instr(t, '|') > 1 then t[:instr(t, '|') - 1] else t end))"""
_NEWS_COLUMNS = "article_ts longitude latitude place_id persons organizations location_names positive_sentiment negative_sentiment loaded_at".split()
#: The same for SQL: of the rows of an article, the greatest as a whole counts.
_NEWS = Ranked(
    "articles", "article_id",
    (
        keywords("persons", "", f"nullif({_PERSONS}, [])", _PEOPLE, weights=_WORLD["persons"]),
        point("position", "longitude", "latitude", (11.5, 48.25), weights=_WORLD["position"]),
        number("positive_sentiment", "positive_sentiment", 1.25, weights=_WORLD["positive_sentiment"]),
    ),
    k=5, extra=("negative_sentiment",),
    sql_source="(select * from (select *, row_number() over (partition by article_id order by " + ", ".join(f"{c} desc nulls last" for c in _NEWS_COLUMNS)
    + ") place from articles where article_id <> '') where place = 1)",
)


def news_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Articles by organizations (as vectors), place and sentiment, by pivots; the weight of the last one isn't given."""
    terms = table(spark, folder, "lda_dictionary").where("lda_vector is not null").orderBy("term").limit(3).collect()
    request = {
        "k": 5, "algorithm": "pivot_based",
        "queries": [
            {"column": "organizations", "value": [t["term"] for t in terms], "weights": ["0.4", "0.9"], "scale": 2},
            {"column": "position", "value": "POINT(11.5 48.25)", "weights": ["0.6", "0.2"], "scale": 20},
            {"column": "positive_sentiment", "value": 1.25, "scale": 0.5},
        ],
    }
    return _flat(news_engine(spark, folder).search(request))


def results_flat(spark: SparkSession, folder: str) -> DataFrame:
    """Nested results as one row a result and attribute."""
    found = _order_engine(spark, folder).sql("SELECT * WHERE o_totalprice ~= 150000 AND o_orderdate ~= '1996-06-01' WEIGHTS 0.8, 0.4 LIMIT 10")
    rows = analytics.flattened(found.nested)
    return rows.select("rank", "id", "name", F.round("score", 6).alias("score"), F.round("attribute_score", 6).alias("attribute_score"))


_PLAIN = (
    spatial_haversine, list_prefix, batch_knn, sim_matrix, sql_q1, sql_between_filter, json_filter, pivot_embed, pivot_search, pivot_search_bounded,
    pivot_auto, word2vec, doc_similarity, keyword_freq, keyword_share, rank_align, rank_compare, catalog, bounding_box, histogram, qgram_sets,
    number_statistics, filter_json, score_stats, nra_rescored, points_in_box, points_nearest, news_threshold, news_pivot, results_flat,
)

QUERIES: dict[str, Query] = RANKED | {f.__name__: f for f in _PLAIN}

_MIXED = replace(RANKED["ta_two"], facets=tuple(replace(f, weights=(w,)) for f, w in zip(_TWO, (0.6, 0.6))))
_ALIGNED = f"""select id, coalesce(x.score, 0) a, coalesce(y.score, 0) b
from (select id, score from ({RANKED["ta_two"].sql().replace("round(score, 6)", "round(score, 9)")})) x
full join (select id, score from ({_MIXED.sql().replace("round(score, 6)", "round(score, 9)")})) y using (id)"""

ORACLE: dict[str, str] = {name: one.sql() for name, one in RANKED.items()} | {
    "news_threshold": f"select combo, rank, id, score, persons_score, position_score, positive_sentiment_score, negative_sentiment::varchar negative_sentiment from ({_NEWS.sql()})",
    "batch_knn": " union all ".join(
        f"""select '{name}' as query, row_number() over (order by d, id) as rank, id, round(d, 6) d
from (select o_orderkey::varchar id, {f.sql_distance} d from orders order by d, id limit 7)"""
        for name, f in [(str(x), number("", "o_totalprice", x)) for x in _PRICES] + [("day", _TWO[1])]
    ),
    "results_flat": " union all ".join(
        f"select rank, id, '{n}' as name, score, {f.name}_score attribute_score from ({RANKED['ta_two'].sql()})" for n, f in zip(_SQL_NAMES, _TWO)
    ),
    "catalog": """
with o as (select * from orders order by o_orderkey::varchar limit 1)
select 'o_totalprice' as "column", 'numerical_topk' operation, 'NUMBER' datatype, o_totalprice::varchar sample, true queryable from o
union all select 'o_orderdate', 'temporal_topk', 'DATE_TIME', strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z'), true from o
union all select 'o_orderpriority', 'categorical_topk', 'KEYWORD_SET', '[' || o_orderpriority || ']', true from o""",
    "bounding_box": f"with {checks.POINTS} select min(x) min_x, min(y) min_y, max(x) max_x, max(y) max_y from points",
    "spatial_haversine": """
with p as (select s_suppkey::varchar id, radians(s_suppkey * 7 % 360 - 180) lon, radians(s_suppkey * 11 % 170 - 85) lat from supplier)
select id, round(degrees(2 * asin(sqrt(sin((radians(41.9) - lat) / 2) ** 2 + cos(lat) * cos(radians(41.9)) * sin((radians(12.5) - lon) / 2) ** 2))), 6) degrees
from p order by degrees, id limit 10""",
    "list_prefix": "select o_orderkey::varchar id, round(abs(o_totalprice - 150000), 6) d from orders order by abs(o_totalprice - 150000), id limit 500",
    "sim_matrix": _sim_matrix_sql(),
    "sql_q1": _named(RANKED["ta_two"], _SQL_NAMES),
    "sql_between_filter": _named(replace(RANKED["ta_two"], filter="o_totalprice between 160000 and 300000 and o_orderstatus <> 'F'"), _SQL_NAMES),
    "json_filter": _named(Ranked("orders", "o_orderkey", (number("price", "o_totalprice", 150000),), filter="o_totalprice >= 100000 and o_totalprice < 140000 and o_orderstatus = 'O'"), _SQL_NAMES[:1]),
    "pivot_embed": f"with {_SQL_VECTORS} select id, "
    + ", ".join(f"round(list_distance(v, {_sql_vector(p)}::double[]), 6) pd_v_{i}" for i, p in enumerate(_PIVOTS[:3]))
    + ", round(abs(label - 0), 6) pd_label_0, round(abs(label - 9), 6) pd_label_1 from e",
    "pivot_search": _pivot_search_sql(),
    "pivot_search_bounded": _pivot_search_sql(),
    "word2vec": """
with parts as (select p_partkey::varchar id, string_split(p_name, ' ') k from part),
words as (select term, row_number() over (order by term) - 1 n from (select distinct unnest(k) term from parts)),
dict as (select term, embedding::double[] v from words join embeddings on n = vec_id where n % 5 <> 4),
shares as (select id, w.term, count(*) / any_value(len(k))::double share from (select id, list_distinct(k) k, unnest(list_distinct(k)) term from parts) w group by 1, 2),
cells as (select id, i, sum(v[i] * share) x from shares join dict using (term), (select unnest(range(1, 65)) i) group by id, i)
select id, round(sum(x), 5) total, round(max(x), 5) most from cells group by id""",
    "doc_similarity": """
with d as (
  select doc_id::varchar id, list_filter(list_distinct(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')), lambda w: w <> '') w
  from documents where text is not null and text <> ''
),
q as (select list_distinct(string_split('fix the pending resolver in cache and update the tests of the nested worker', ' ')) q),
j as (select id, 1 - len(list_intersect(w, q))::double / len(list_distinct(list_concat(w, q))) d from d, q),
l as (select *, row_number() over (order by d, id) as rank from j where d < 1 - 1e-6),
c as (select max(d) c from l where rank <= 20)
select rank, id, round(exp(-0.05 * d / c), 6) score, round(d, 6) distance from l, c where rank <= 20""",
    "keyword_freq": """
with f as (select keyword, count(*) n from (select unnest(string_split(p_name, ' ')) keyword from part) group by 1)
select keyword, n from f where n > (select median(n) from f)""",
    "keyword_share": """
with f as (select keyword, count(*) n from (select unnest(string_split(p_name, ' ')) keyword from part) group by 1)
select keyword, round(n / (select sum(n) from f)::double, 6) share from f""",
    "rank_align": f"select id, round(a, 6) a, round(b, 6) b from ({_ALIGNED})",
    "rank_compare": f"""
with z as ({_ALIGNED}),
r as (
  select *, rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 rb
  from z
),
t as (
  select sum(sign(x.a - y.a) * sign(x.b - y.b)) / sqrt(sum(abs(sign(x.a - y.a))) * sum(abs(sign(x.b - y.b)))) kendall
  from z x join z y on x.id < y.id
)
select round(corr(a, b), 6) pearson, round(corr(ra, rb), 6) spearman, round(any_value(kendall), 6) kendall from r, t""",
    "score_stats": f"""
with {RANKED["ta_two"].sql().replace("with ", "", 1).rsplit(chr(10) + "select ", 1)[0]},
x as (
  select 'price' as name, case when d0 = 0 then 1 else exp(-0.05 * d0 / (select c from c0)) end s from l0
  union all select 'day', case when d1 = 0 then 1 else exp(-0.05 * d1 / (select c from c1)) end from l1
),
y as (select name, count(*) n, min(s) a, max(s) b, avg(s) m, stddev_samp(s) sd from x group by name)
select name, n, round(a, 6) "min", round(b, 6) "max", round(m, 6) "avg", round(sd, 6) stdev, round(sd / (select sum(sd) from y), 6) weight from y""",
    "nra_rescored": f"""
select rank, id, score, round((0.8 * price_score + 0.4 * day_score) / (0.8 + 0.4), 6) exact_score
from ({RANKED["nra"].sql().replace("round(s0, 6)", "s0").replace("round(s1, 6)", "s1")})""",
    "points_in_box": "select p_partkey::varchar id from part where p_retailprice between 920 and 960 and p_size between 10 and 20",
    "points_nearest": """
select p_partkey::varchar id, round(sqrt((p_retailprice - 950) ** 2 + (p_size - 30) ** 2), 6) distance from part
where sqrt((p_retailprice - 950) ** 2 + (p_size - 30) ** 2) <= 25 order by sqrt((p_retailprice - 950) ** 2 + (p_size - 30) ** 2), id limit 40""",
    "histogram": """
select case when o_totalprice < 0 then 0 when o_totalprice >= 500000 then 11 else floor(o_totalprice / 50000) + 1 end::bigint bucket, count(*) n
from orders where o_totalprice is not null group by 1""",
    "qgram_sets": """
select gram, count(*) n from (
  select p_partkey, unnest(list_distinct(list_transform(range(1, greatest(len(p_name) - 1, 1)), lambda i: p_name[i:i + 2]))) gram from part
) group by 1""",
    "number_statistics": "select round(min(c_acctbal), 6) \"min\", round(max(c_acctbal), 6) \"max\", round(avg(c_acctbal), 6) \"avg\", round(stddev_samp(c_acctbal), 6) stdev, count(c_acctbal) n from customer",
    "filter_json": "select o_orderpriority, count(*) n from orders where o_orderstatus <> 'F' and (o_totalprice > 400000 or o_orderpriority = '1-URGENT') group by 1",
}
