import pytest

from facetrank.sources import rejects

GOOD = "nw0000000001,20200229235959,a;b|2;a,1.5"
CASES = [
    (GOOD, None), ('"nw0000000001","20200229235959","a, ""x"";b","-1.2e+01"', None), ("nw0000000001,20200229235959,a,", None), ('nw0000000001,20200229235959,"a\nb",3', None),
    ('nw0000000001,20200229235959,a"b,1', "quoting"), ('nw0000000001,20200229235959,"a,1', "quoting"), ('nw0000000001,20200229235959,""a"",1', "quoting"), ('"', "quoting"),
    ('a"b', "quoting"), ("", "columns"), (None, "columns"), ("a,b,c", "columns"), ("a,b,c,d,e", "columns"), ("x\ty", "columns"), ("a\nb", "columns"), ("nw0000000001,20200229235959,a,1,2", "columns"),
    ("id,article_ts,tokens,positive_sentiment", "value"), ("nw1,20200229235959,a,1", "value"), ("nw0000000001,20190229000000,a,1", "value"), ("nw0000000001,20200101240000,a,1", "value"),
    ("nw0000000001,00000000000000,a,1", "value"), ("nw0000000001,20200229235959, ; ;,1", "value"), ("nw0000000001,20200229235959,,1", "value"), ('nw0000000001,20200229235959,"",1', "value"),
    ("nw0000000001,20200229235959,a,.", "value"), ("nw0000000001,20200229235959,a,1.2.3", "value"), ("nw0000000001,20200229235959,a,NaN", "value"), ("nw0000000001,20200229235959,a, 1", "value"),
    ("nw0000000001\n,20200229235959,a,1", "value"), ("NW0000000001,20200229235959,a,1", "value"), (GOOD + "\r", "value"),
    ("nw0000000001,20200229235959," + "long token;" * 200_000 + ",1", None),
]


def test_reasons_and_fields(spark):
    lines = spark.createDataFrame([(i, t, "clash") for i, (t, _) in enumerate(CASES)] + [(None, GOOD, ""), (0, GOOD, "")], "line_id long, raw_line string, reason string")
    rows = rejects.read_lines(lines).collect()
    assert len(rows) == len(CASES) + 2
    got = {r["line_id"]: r for r in rows}
    assert {i: got[i]["reason"] for i in range(len(CASES))} == {i: r for i, (_, r) in enumerate(CASES)}
    assert got[0]["tokens"] == ["a", "b|2"] and got[0]["positive_sentiment"] == 1.5
    assert got[1]["tokens"] == ['a, "x"', "b"] and got[1]["positive_sentiment"] == -12.0
    assert got[2]["positive_sentiment"] is None and got[3]["tokens"] == ["a\nb"]
    assert got[12]["detail"] == "5 fields" and got[10]["detail"] == "0 fields" and got[16]["detail"] == "id article_ts positive_sentiment"
    assert got[16]["id"] is None


def test_small_blocks(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(rejects, "BLOCK", 64)
    reason, _, fields = rejects.parse(pa.array([t for t, _ in CASES], pa.string()))
    assert list(reason) == [r for _, r in CASES] and fields[0][0].as_py() == "nw0000000001"


def test_empty_table(spark):
    lines = spark.createDataFrame([], "line_id long, raw_line string")
    assert rejects.read_lines(lines).count() == 0
    assert rejects.rejected(lines).columns == ["line_id", "reason", "detail"]


@pytest.mark.parametrize("text", ["nw0000000001,20200229235959,a,1", None])
def test_loaded(spark, text):
    lines = spark.createDataFrame([(1, text)], "line_id long, raw_line string")
    assert rejects.loaded(lines).count() == (1 if text else 0)


def test_lines_of_another_kind(spark):
    fields = (rejects.Field("code", pattern=r"\A[A-Z]{2}\z"), rejects.Field("size", "number"), rejects.Field("at", "time"), rejects.Field("note"))
    texts = ["AB;1.5;20200101000000;x, y", "AB;;20200101000000;", "ab;1;20200101000000;", "AB;one;20200101000000;", "AB;1", 'AB;"1"";20200101000000;', "AB;+2e1;20200101000000;z", "AB;1e999;20200101000000;z"]
    lines = spark.createDataFrame(list(enumerate(texts)), "n int, line string")
    got = {r["line_id"]: r for r in rejects.read_lines(lines, "n", "line", fields, ";").collect()}
    assert [got[i]["reason"] for i in range(8)] == [None, None, "value", "value", "columns", "quoting", None, None]
    assert [got[i]["detail"] for i in (2, 3, 4)] == ["code", "size", "2 fields"]
    assert [got[i]["size"] for i in (0, 1, 6, 7)] == [1.5, None, 20.0, float("inf")] and got[0]["note"] == "x, y"
    assert rejects.loaded(lines, key="n", text="line", fields=fields, separator=";").columns == ["line_id", "code", "size", "at", "note"]
