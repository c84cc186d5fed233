import random

import pytest
from pyspark.sql import functions as F

from facetrank.llm import truncation as t

SCHEMA = "doc_id long, text string, source string"
WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima".split()


def sentence(rng):
    return f"The {rng.choice(WORDS)} report was read before the {rng.choice(WORDS)} table had been filled, so nothing came out."


def text(rng, n):
    return "\n".join(sentence(rng) for _ in range(n))


@pytest.fixture(scope="module")
def made():
    """(rows, ids of cut texts): prose cut at 300 characters or anywhere, closed mails, diffs, copies."""
    rng = random.Random(2)
    rows, cut = [], set()
    for i in range(400):
        rows.append((i, text(rng, rng.randrange(1, 7)), "prose"))
    for i in range(400, 460):
        rows.append((i, (text(rng, 9) + str(i))[:300], "prose"))
        cut.add(i)
    for i in range(460, 480):
        whole = text(rng, 3)
        at = whole.index(" read before", rng.randrange(150)) + rng.choice([8, 10])
        rows.append((i, whole[:at], "prose"))
        cut.add(i)
    for i in range(480, 560):
        rows.append((i, text(rng, 2) + "\n-- \n2.3", "mail"))
    rows.append((560, text(rng, 2), "mail"))
    cut.add(560)
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@\n one;\n+two;\n three;\n"
    rows += [(561, diff, "diff"), (562, diff[:-8], "diff"), (563, diff[:-8], None)]
    cut |= {562, 563}
    rows += [(570, "", "prose"), (571, " \n\t", "prose"), (572, None, "prose"), (573, rows[405][1], "mail"), (574, (text(rng, 9) + "x")[:300] + "...", "prose"), (575, "We go on...", "prose")]
    cut |= {573, 574}
    return rows, cut


def test_finds_cut_texts_and_few_others(spark, made):
    rows, cut = made
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"a": F.lit(1), "key": F.lit(2), "limit": F.lit(3)})
    got = {r["doc_id"] for r in t.truncated(frame).collect()}
    assert len(cut - got) <= 0.03 * len(cut) and len(got - cut) <= 0.05 * len(cut)
    assert not got & {570, 571, 572, 575, 561} and {560, 562, 563, 574} <= got


def test_report(spark, made):
    rows, _ = made
    report = {r["source"]: r for r in t.truncation_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert report["mail"]["documents"] == 82 and report["prose"]["cut"] >= 78 and 0 < report["prose"]["share"] < 0.3 and "" in report


def test_evidence_has_one_row_a_document(spark, made):
    rows, _ = made
    found = t.evidence(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows) - 3 == len({r["doc_id"] for r in found})


def test_very_long_and_empty(spark):
    docs = spark.createDataFrame([(1, "word " * 200_000, "s"), (2, "x" * 500_000, None), (3, "one", "s")], SCHEMA)
    assert t.evidence(docs).count() == 3
    assert t.truncated(docs.limit(0)).count() == 0 and t.truncation_report(docs.limit(0)).count() == 0


def test_escaped_object_is_resolved(spark):
    text = '{"message": "a\\nb \\"c\\""}'
    got = spark.range(1).select(t.plain(F.lit(text)).alias("p")).first()["p"]
    assert got == '{"message": "a\nb "c""}'


def cut_at_line_ends(rng, n, size):
    """Different texts of this length that end with a whole sentence."""
    closes = (f"\nThe {a} report was for {b} and {c}." for a, b, c in (rng.sample(WORDS, 3) for _ in range(n)))
    return [text(rng, 9)[: size - len(x)] + x for x in closes]


def test_limits_hold_without_a_source_and_for_copies(spark):
    rng = random.Random(5)
    rows = [(i, text(rng, rng.randrange(1, 7)), "prose" if i % 2 else "notes") for i in range(600)]
    rows += [(1000 + i, x, "prose") for i, x in enumerate(cut_at_line_ends(rng, 60, 300))]
    rows += [(2000 + i, x, None) for i, x in enumerate(cut_at_line_ends(rng, 3, 300))]
    rows += [(3000, rows[610][1], "notes"), (3001, rows[611][1], None), (3002, cut_at_line_ends(rng, 1, 300)[0] + "...", None)]
    rows += [(4000 + i, text(rng, 3), None) for i in range(20)]
    got = {r["doc_id"] for r in t.evidence(spark.createDataFrame(rows, SCHEMA)).where("limit or mark").collect()}
    assert set(range(1000, 1060)) | {2000, 2001, 2002, 3000, 3001, 3002} <= got
    assert not got & set(range(4000, 4020))


def test_closing_holds_for_copies_and_texts_without_any_source(spark):
    rng = random.Random(6)
    mails = [text(rng, 2) + "\n-- \n2.3" for _ in range(60)] + [text(rng, 2)]
    frame = spark.createDataFrame([(i, x, "mail") for i, x in enumerate(mails)] + [(100, mails[-1], None)], SCHEMA)
    assert {r["doc_id"] for r in t.evidence(frame).where("closing").collect()} == {60, 100}
    bare = spark.createDataFrame([(i, x, None) for i, x in enumerate(mails)], SCHEMA)
    assert {r["doc_id"] for r in t.evidence(bare).where("closing").collect()} == {60}


def test_texts_of_one_or_two_tokens_are_judged(spark):
    rng = random.Random(7)
    rows = [(i, text(rng, 2) + "\n-- \n2.3", "mail") for i in range(60)] + [(60, "The", "mail"), (61, "Alpha report", "mail")]
    rows += [(100 + i, "\n".join(f"Released the {rng.choice(WORDS)} version." for _ in range(4)), "notes") for i in range(40)]
    rows += [(200, "Rele", "notes"), (201, "Released t", "notes"), (202, "Done.", "misc")]
    found = {r["doc_id"]: r for r in t.evidence(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[60]["closing"] and found[61]["closing"] and found[200]["word"] and found[201]["word"]
    assert not any(found[202][k] for k in t.KINDS)


def test_long_lines_without_blanks_are_words_unless_data(spark):
    rng = random.Random(8)
    clauses = ["本周报告已经完成", "所有测试均已通过", "下一步将更新文档", "缓存模块需要重写"]
    line = lambda n: "。".join("，".join(clauses[i:] + clauses[:i]) for i in (rng.randrange(4) for _ in range(n))) + "。"
    rows = [(i, line(rng.randrange(3, 9)), "notes") for i in range(100)]
    rows += [(200, line(4) + "本周报告已经完成，所有测试均", "notes"), (201, line(4) + "所有测试均已通过，下一步将更", "notes")]
    data = "".join(rng.choice("0123456789abcdefXYZ+/") for _ in range(60))
    rows += [(300 + i, f"sum of {data} matched", "sums") for i in range(30)] + [(400, f"sum of {data[:50]}", "sums")]
    found = {r["doc_id"]: r for r in t.evidence(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[200]["word"] and found[201]["word"] and not any(found[i]["word"] or found[i]["phrase"] for i in range(100))
    assert not found[400]["word"] and not found[400]["phrase"]
