import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetrank.operators import pivot
from facetrank.operators.normalize import normalized
from facetrank.operators.vectors import keyword_vectors
from facetrank.plans import cli, sqlfront
from facetrank.plans.engine import Engine
from facetrank.sources import readers, rest, sinks
from facetrank.streaming.append import append_stream, appended

CSV = """key,lon,lat,day,words,price,note
e1,10,50,2019-11-04,"a;b",1.5,one
e2,11,51,04/11/2019,b;c|3,2.5,two
e3,12,,2019-11-06,,x,three
,1,1,2019-11-04,a,1,none
e4,13,53,never,a;a;b,3.5,four
"""


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")
    (folder / "rows.csv").write_text(CSV)
    (folder / "dict.csv").write_text("term;vector\na;1,0\nb;0,1\nc;1,1\n")
    engine = Engine(spark)
    base = {"source": "here", "dataset": "rows.csv", "separator": ",", "header": "true", "key_column": "key", "token_delimiter": ";"}
    said = engine.mount(
        json.dumps(
            {
                "sources": [{"name": "here", "type": "csv", "directory": str(folder)}],
                "search": [
                    base | {"operation": "spatial_knn", "search_column": ["lon", "lat"], "alias_column": "place"},
                    base | {"operation": "temporal_topk", "search_column": "day"},
                    base | {"operation": "categorical_topk", "search_column": "words"},
                    base | {"operation": "numerical_topk", "search_column": "price"},
                    base | {"operation": "textual_topk", "search_column": "note", "qgram": "2"},
                    base | {"operation": "pivot_based", "metric": "Euclidean", "search_column": ["lon", "lat"], "alias_column": "place"},
                    base | {"operation": "pivot_based", "metric": "Manhattan", "search_column": "price"},
                    base | {"operation": "pivot_based", "metric": "Euclidean", "search_column": "words", "transform_by": "vector", "transformed_to": "wordvec"},
                    {"source": "here", "dataset": "dict.csv", "key_column": "term", "search_column": "vector", "operation": "vector_dictionary", "token_delimiter": ","},
                    base | {"operation": "numerical_topk", "search_column": "price"},
                    base | {"operation": "numerical_topk", "search_column": "missing"},
                    base | {"operation": "numerical_topk", "source": "nowhere", "dataset": "z.csv", "search_column": "price2"},
                    base | {"operation": "guess", "search_column": "price"},
                ],
            }
        )
    )
    assert len(said) == 4
    return engine


def test_catalog(engine):
    rows = {(r["column"], r["operation"]): r for r in engine.catalog().collect()}
    assert len(rows) == 9 and rows["price", "numerical_topk"]["sample"] == "1.5" and rows["words", "categorical_topk"]["sample"] == "[a,b]"
    assert rows["day", "temporal_topk"]["sample"].startswith("2019-11-04T00:00:00") and not rows["vector", "vector_dictionary"]["queryable"]
    assert engine.catalog("spatial_knn").count() == 1 and engine.catalog(column="none").count() == 0
    assert engine.settings()["max_result_window"] == 50_000


def test_search_from_json(engine):
    answer = engine.search(
        {
            "k": "2", "output": {"extra_columns": ["price", "unknown"]},
            "queries": [
                {"column": "words", "value": ["a", "b"], "weights": ["1.0", "0.5"]},
                {"column": "day", "value": "2019-11-04 00:00:00", "weights": ["1.0", "0.4"]},
                {"column": "place", "value": "POINT(10 50)", "weights": ["1.0", "1"]},
            ],
        }
    )
    found = answer.collect()
    assert [(r["combo"], r["rank"], r["id"]) for r in found][:1] == [(0, 1, "e1")] and len(found) == 4
    assert found[0]["score"] == pytest.approx(1.0) and found[0]["extra_attributes"] == {"price": "1.5"} and len(answer.warnings) == 1
    assert [a["value"] for a in found[0]["attributes"]] == ["[a,b]", "2019-11-04T00:00:00.000Z", "POINT (10.0 50.0)"]
    assert answer.matrix.where("combo = 0").count() == 4
    assert "e1" in sinks.as_table(answer.flat) and json.loads(sinks.as_json(answer.nested))[0]["id"] == "e1"


def test_inconclusive(engine):
    answer = engine.search({"k": 9, "queries": [{"column": "price", "value": "max"}]})
    assert [r["id"] for r in answer.collect()] == ["e4", "e2", "e1"] and "inconclusive" in answer.warnings[0]


@pytest.mark.parametrize(
    "request_",
    [
        {"queries": []}, {"queries": [{"column": "none", "value": 1}]}, {"queries": [{"column": "price", "value": "x"}]}, {"k": 0, "queries": [{"column": "price", "value": 1}]},
        {"algorithm": "magic", "queries": [{"column": "price", "value": 1}]}, {"algorithm": "pivot_based", "queries": [{"column": "day", "value": 1}]}, {"queries": [{"value": 1}]},
    ],
)
def test_refused(engine, request_):
    with pytest.raises(ValueError):
        engine.search(request_)


def test_pivot_search(engine):
    request = {
        "k": 2, "algorithm": "pivot_based",
        "queries": [{"column": "place", "value": "11,51", "scale": 1}, {"column": "price", "value": 2.5, "scale": 1}, {"column": "wordvec", "value": ["b", "c"], "scale": 1}],
    }
    found = engine.search(request).collect()
    assert found[0]["id"] == "e2" and found[0]["score"] == pytest.approx(1.0)


def test_statements(engine):
    answer = engine.sql("SELECT *, note WHERE price ~= 2 AND place ~= 'POINT (10 50))' WEIGHTS 0.5, 0.5 LIMIT 2;")
    assert [r["id"] for r in answer.collect()] == ["e1", "e2"]
    said = []
    cli.run(engine, ["\\d\n", "SET query_timeout 20000;\n", "SELECT * WHERE\n", "price ~= 2 LIMIT 1;\n", "SELECT 1;\n", "\\q\n", "never"], said.append)
    assert engine.timeout == 20000 and "numerical_topk" in said[0] and "e1" in said[1] and said[-1].startswith("error")


@pytest.mark.parametrize(
    "bad",
    ["SELECT * WHERE a > 1", "SELECT * WHERE a ~= 1 WEIGHTS 1, 2", "SELECT * WHERE a ~= 1 ALGORITHM x", "SELECT * WHERE a ~= 1 LIMIT 0", "UPDATE x", "SELECT * WHERE a ~= 1 OR b ~= 2",
     "SELECT * WHERE a ~= 1 LIMIT 1 WEIGHTS 1", "SELECT * WHERE a ~= 1 AND b IN (SELECT 1)", "SELECT * WHERE a ~= 'x", "SELECT * WHERE a ~= 1 AND"],
)
def test_statements_that_are_refused(bad):
    with pytest.raises(sqlfront.SqlError):
        sqlfront.parse(bad)


def test_parsed_statement():
    spec = sqlfront.parse("select *, x from m where a ~= 'it''s' and b between 1 and 2 and (c = 1 or d like 'u%') and e ~= -4.5 weights 0.6, 1 algorithm no_random_access limit 7 -- end")
    assert [(q.column, q.value, q.weights) for q in spec.queries] == [("a", "it's", (0.6,)), ("e", -4.5, (1.0,))]
    assert spec.filter == "(b between 1 and 2) AND ((c = 1 or d like 'u%'))" and spec.k == 7 and spec.extra == ("x",) and spec.algorithm == "no_random_access"


def test_delete_and_unmount(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0)], "id string, x double, y double")
    engine = Engine(spark)
    spec = {"dataset": "t", "key_column": "id"}
    engine.mount({"search": [spec | {"operation": "numerical_topk", "search_column": "x"}, spec | {"operation": "pivot_based", "search_column": "x"}, spec | {"operation": "pivot_based", "search_column": "y"}]}, {"t": rows})
    assert engine.delete({"remove": [{"column": "y", "operation": "pivot_based"}, {"column": "q"}]}) == ["q is not mounted"]
    assert set(engine.attributes) == {("x", "numerical_topk")}
    engine.unmount()
    assert not engine.attributes


def test_repeated_and_missing_keys_of_several_tables(spark):
    a = spark.createDataFrame([("k1", 1.0), ("k1", 3.0), ("k2", 2.0), ("", 9.0), (None, 9.0)], "id string, x double")
    b = spark.createDataFrame([("k2", "2020-01-01"), ("k3", "2020-01-01")], "id string, d string")
    engine = Engine(spark)
    engine.mount({"search": [{"dataset": "a", "operation": "numerical_topk", "search_column": "x"}, {"dataset": "b", "operation": "temporal_topk", "search_column": "d"}]}, {"a": a, "b": b})
    found = engine.search({"k": 5, "queries": [{"column": "x", "value": 3, "weights": [1]}, {"column": "d", "value": "2020-01-01", "weights": [1]}]}).collect()
    assert {r["id"] for r in found} == {"k1", "k2", "k3"} and found[0]["id"] == "k2"
    engine.add_rows("x", "numerical_topk", spark.createDataFrame([("k4", 3.0)], "id string, value double"))
    assert engine.search({"k": 1, "queries": [{"column": "x", "value": 3}]}).collect()[0]["id"] == "k1"
    assert engine.search({"k": 4, "queries": [{"column": "x", "value": 3}]}).rows.count() == 3


def test_vectors(spark):
    rows = spark.createDataFrame([("r1", ["A", "b+c"]), ("r2", ["zz"]), ("r3", []), ("r4", None), ("r5", ["a", "zz"])], "id string, keywords array<string>")
    terms = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [2.0, 0.0]), ("a", None)], "term string, vector array<double>")
    got = {r["id"]: r["vector"] for r in keyword_vectors(rows, terms).collect()}
    assert got == {"r1": [1.0, 0.5], "r2": None, "r3": None, "r4": None, "r5": [0.5, 0.0]}


def test_normalized(spark):
    rows = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (None,)], "x double")
    assert [r[0] for r in rows.select(normalized(rows, "x", "z")).collect()] == [-1, 0, 1, None]
    assert [r[0] for r in rows.select(normalized(rows, "x", "unity")).collect()] == [-0.5, 0, 0.5, None]
    with pytest.raises(ValueError):
        normalized(rows, "x", "other")


def test_pivot_bound_loses_nothing(spark):
    rng = np.random.default_rng(3)
    data = [(f"v{i:03}", rng.normal(size=3).tolist(), [float(i % 9)] if i % 5 else None) for i in range(700)]
    rows = spark.createDataFrame(data, "id string, a array<double>, b array<double>")
    fitted = pivot.fit(rows, [pivot.Metric("a"), pivot.Metric("b", "manhattan")])
    assert sum(len(m.pivots) for m in fitted) == pivot.PIVOTS and all(m.scale > 0 for m in fitted)
    wanted = [pivot.Wanted("a", (0.1, 0.2, 0.3), (1.0, 0.3)), pivot.Wanted("b", (4.0,), (0.2, 0.9))]
    inside = pivot.embedded(rows, fitted)
    found = [sorted(tuple(r) for r in pivot.search(inside, fitted, wanted, 10, bound=b).select("combo", "rank", "id").collect()) for b in (False, True)]
    assert found[0] == found[1] and len(found[0]) == 20


def test_stored_index_skips_by_range(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), [float(i)]) for i in range(50)], "id string, a array<double>")
    fitted = pivot.fit(rows, [pivot.Metric("a", "manhattan")], 2)
    stored = pivot.stored(rows, fitted, str(tmp_path / "index"))
    found = pivot.search(stored, fitted, [pivot.Wanted("a", (7.2,))], 3, bound=True)
    assert [r["id"] for r in found.orderBy("rank").collect()] == ["7", "8", "6"]


class Service(BaseHTTPRequestHandler):
    def log_message(self, *_):
        pass

    def do_GET(self):
        self.answer({"i": {"settings": {"index": {"max_result_window": "77"}}}})

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path.endswith("_search"):
            hits = [{"_source": {"id": f"h{i}", "place": {"lon": i, "lat": 2}, "n": {"x": i}}, "sort": [i]} for i in range(5)]
            hits = [h for h in hits if h["sort"] > body.get("search_after", [-1])][: body["size"]]
            self.answer({"hits": {"hits": hits}})
        else:
            self.answer([{"rankedResults": [{"id": "r", "rank": 1, "score": 0.5, "attributes": [{"name": body["queries"][0]["column"], "value": "v"}]}]}])

    def answer(self, value):
        data = json.dumps(value).encode()
        self.send_response(200)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)


def test_services(spark):
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    rest.register(spark)
    rows = spark.read.format("search_index").options(url=url, key="id", fields="place,n.x", page="2").load().collect()
    assert [(r["id"], r["place"], r["n.x"]) for r in rows] == [(f"h{i}", f"{i},2", str(i)) for i in range(5)]
    ranked = spark.read.format("ranked_instance").options(url=url + "/search", column="c", value="1", k="1").load().collect()
    assert [tuple(r) for r in ranked] == [("r", "v", 0.5, 1)]
    assert rest.most_results(url) == 77 and rest.most_results("http://127.0.0.1:9", 5) == 5
    server.shutdown()


def test_streamed_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 3.0)], "id string, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for value in (None, 5.0):
        if value:
            spark.createDataFrame([("a", value)], "id string, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id string, value double").parquet(str(tmp_path / "in"))
        append_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert {tuple(r) for r in appended(spark, str(tmp_path / "out")).collect()} == {("a", 5.0), ("b", 2.0)}


def test_written_results(spark, engine, tmp_path):
    answer = engine.search({"k": 2, "queries": [{"column": "price", "value": 1}]})
    sinks.write_csv(answer.flat, str(tmp_path / "csv"))
    sinks.write_json(answer.nested, str(tmp_path / "json"))
    assert spark.read.options(sep=";", header=True).csv(str(tmp_path / "csv")).columns == ["combo", "rank", "score", "id", "priceVal", "priceScore"]
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_file_without_header_and_line_limit(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a;1\nb;2\nc\n")
    rows = readers.delimited(spark, str(tmp_path), "f.csv", header=False, max_lines=2)
    assert rows.columns == ["0", "1"] and rows.count() == 2
    kept = readers.one_row_a_key(rows.select(F.col("0").alias("id"), readers.attribute_value(rows, ["1"], "number").alias("x")))
    assert {tuple(r) for r in kept.collect()} == {("a", 1.0), ("b", 2.0)}


def test_one_whole_row_of_a_repeated_key_counts(spark):
    rows = spark.createDataFrame([("k1", 1.0, 9.0, "u"), ("k1", 3.0, 2.0, "v"), ("k2", 2.0, 5.0, "w"), ("k2", 2.0, 5.0, "w")], "k string, x double, y double, id string")
    engine = Engine(spark)
    base = {"dataset": "t", "key_column": "k", "operation": "numerical_topk"}
    engine.mount({"search": [base | {"search_column": "x"}, base | {"search_column": "y"}, base | {"operation": "textual_topk", "search_column": "id", "alias_column": "name"}]}, {"t": rows})
    assert len(engine.append({"search": [base | {"operation": "textual_topk", "search_column": "id"}]})) == 1
    found = engine.search({"k": 2, "queries": [{"column": "x", "value": 3, "weights": [1]}, {"column": "y", "value": 9, "weights": [1]}], "output": {"extra_columns": ["name"]}}).rows
    assert {(r["id"], r["v0"], r["v1"], r["x_name"]) for r in found.collect()} == {("k1", 3.0, 2.0, "v"), ("k2", 2.0, 5.0, "w")}
    assert "hashpartitioning(_key" not in found._jdf.queryExecution().executedPlan().toString()
    assert engine.search({"k": 9, "filter": "id = 'u'", "queries": [{"column": "x", "value": 1}]}).rows.count() == 0


def test_pivot_search_reads_ranges_of_the_stored_index(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(f"r{i:04}", float(rng.normal() * 100), float(i % 7)) for i in range(3000)], "id string, x double, y double")
    engine = Engine(spark)
    base = {"dataset": "t", "key_column": "id", "operation": "pivot_based", "metric": "Manhattan"}
    engine.mount({"search": [base | {"search_column": "x"}, base | {"search_column": "y"}]}, {"t": rows})
    request = {"k": 5, "algorithm": "pivot_based", "queries": [{"column": "x", "value": 20.0, "scale": 1, "weights": [1]}, {"column": "y", "value": 3, "scale": 1, "weights": [1]}]}
    answer = engine.search(request)
    assert "PushedFilters: [Or(IsNull(pd_x_0),And(GreaterThanOrEqual(pd_x_0" in answer.rows._jdf.queryExecution().executedPlan().toString()
    best = sorted((abs(r["x"] - 20) + abs(r["y"] - 3), r["id"]) for r in rows.collect())[:5]
    assert {r["id"] for r in answer.rows.collect()} == {i for _, i in best}
    filtered = engine.search(request | {"filter": "y < 2"}).rows.collect()
    best = sorted((abs(r["x"] - 20) + abs(r["y"] - 3), r["id"]) for r in rows.where("y < 2").collect())[:5]
    assert {r["id"] for r in filtered} == {i for _, i in best}


def test_pivot_weights_that_are_not_given_come_from_the_sample(spark):
    rows = spark.createDataFrame([(f"r{i:02}", float(i), float(i * i)) for i in range(40)], "id string, x double, y double")
    engine = Engine(spark)
    base = {"dataset": "t", "key_column": "id", "operation": "pivot_based", "metric": "Manhattan"}
    engine.mount({"search": [base | {"search_column": "x"}, base | {"search_column": "y"}]}, {"t": rows})
    k = 3
    answer = engine.search({"k": k, "algorithm": "pivot_based", "queries": [{"column": "x", "value": 5.0, "scale": 10}, {"column": "y", "value": 50.0, "scale": 100, "weights": [0.5]}]})

    def weight(scores):
        scores, n = sorted(scores), len(scores)
        at = (n + 1) * (1 - k / n)
        return scores[int(at) - 1] + (at - int(at)) * (scores[int(at)] - scores[int(at) - 1])

    w = weight([np.exp(-0.05 * abs(i - 5) / 10) for i in range(40)])
    d = sorted(((w * abs(i - 5) / 10 + 0.5 * abs(i * i - 50) / 100) / (w + 0.5), f"r{i:02}") for i in range(40))[:k]
    assert {r["id"]: pytest.approx(r["distance"]) for r in answer.rows.collect()} == {i: x for x, i in d}


def test_dates_are_told_by_all_values_not_by_the_first(spark):
    rows = spark.createDataFrame([("a", "12"), ("b", "2020-01-02"), ("c", "2020-01-03"), ("d", None)], "id string, day string")
    for table in (rows, rows.orderBy(F.desc("id"))):
        engine = Engine(spark)
        engine.mount({"search": [{"dataset": "t", "operation": "pivot_based", "metric": "Manhattan", "search_column": "day"}]}, {"t": table.coalesce(1)})
        found = engine.search({"k": 1, "algorithm": "pivot_based", "queries": [{"column": "day", "value": "2020-01-02"}]}).collect()
        assert found[0]["id"] == "b"


def test_dictionary_of_one_number_a_column(spark, tmp_path):
    (tmp_path / "d.csv").write_text("a;1;0\nb;0;1\nc;x;1\n")
    engine = Engine(spark)
    engine.mount({"sources": [{"name": "f", "type": "csv", "directory": str(tmp_path)}], "search": [{"source": "f", "dataset": "d.csv", "header": "false", "key_column": "0", "operation": "vector_dictionary"}]})
    (spec,) = engine.attributes.values()
    assert {r["id"]: r["value"] for r in engine.attribute(spec).collect()} == {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": None}


def test_file_at_an_address_is_shared(spark, tmp_path):
    import functools
    from http.server import SimpleHTTPRequestHandler

    (tmp_path / "far.csv").write_text("k;x\na;1\n")
    handler = functools.partial(SimpleHTTPRequestHandler, directory=str(tmp_path))
    server = HTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rows = readers.delimited(spark, f"http://127.0.0.1:{server.server_port}", "far.csv")
    assert [tuple(r) for r in rows.collect()] == [("a", "1")] and spark.sparkContext.getCheckpointDir().split(":")[-1] in rows.inputFiles()[0]
    server.shutdown()


def test_a_search_that_takes_too_long_is_cancelled(spark):
    import time

    @F.udf("double")
    def slow(x):
        time.sleep(3)
        return x

    engine = Engine(spark)
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, x double")
    engine.mount({"search": [{"dataset": "t", "operation": "numerical_topk", "search_column": "x", "unique_keys": True}]}, {"t": rows.withColumn("x", slow("x"))})
    engine.timeout = 500
    with pytest.raises(TimeoutError):
        engine.search({"k": 1, "queries": [{"column": "x", "value": 3}]})


def test_weights_beside_results_and_exported_embedding(spark, engine, tmp_path):
    queries = [{"column": "price", "value": 1, "weights": [0.5, 0.25]}, {"column": "words", "value": ["a"], "weights": [1, 0.75]}]
    answer = engine.search({"k": 1, "queries": queries})
    assert answer.weighted.columns == ["weights", "rank", "score", "id", "priceVal", "priceScore", "wordsVal", "wordsScore"]
    assert {r["weights"] for r in answer.weighted.collect()} == {"[0.5, 1.0]", "[0.25, 0.75]"} and "priceScore 0.5 0.25" in answer.table
    rows = spark.createDataFrame([("a", [3.0]), ("b", None)], "id string, v array<double>")
    metric = pivot.Metric("v", "manhattan", 1.0, ((0.0,), (9.0,)), ("pd_v_0", "pd_v_1"))
    pivot.exported(rows, [metric], str(tmp_path / "e"))
    assert {tuple(r) for r in spark.read.options(sep=";", header=True).csv(str(tmp_path / "e")).collect()} == {("a", "3.0,6.0"), ("b", ",")}
