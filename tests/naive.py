"""

Naive: the scale of each attribute by a sort of all its distances, then all rows scored, sorted and cut; of pivot search a
scan of all rows. local[4], one warm-up, five runs, median (and least to greatest).
"""

import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def ranked(one, spark, folder):
    from pyspark.sql import functions as F

    from facetrank.operators import ranking

    entities = one.rows(spark, folder)
    criteria = [f.criterion() for f in one.facets]
    scales = []
    for c in criteria:
        d = ranking.distances(entities, c).where(ranking._counts(c, F.col("d")))
        kth = d.select(F.row_number().over(__import__("pyspark").sql.Window.orderBy("d", "id")).alias("i"), "d").where(F.col("i") <= one.k).agg(F.max("d")).first()[0]
        scales.append(c.scale or kth or d.where("d > 0").agg(F.min("d")).first()[0])
    p = ranking.Prepared(tuple(criteria), tuple(F.lit(float(s)) for s in scales), tuple(tuple(F.lit(w) for w in (c.weights or (1.0,))) for c in criteria), 0)
    rows = ranking._scored(entities, p)
    out = None
    for i in range(len(p.weights[0])):
        by = rows.select("id", ranking._mean(p, i, lambda j: F.col(f"s{j}")).alias("score")).orderBy(F.desc("score"), "id").withColumn("n", F.monotonically_increasing_id()).limit(one.k)
        out = by if out is None else out.unionAll(by)
    return out


def main():
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from facetrank.operators import pivot
    from facetrank.operators.ranking import Criterion, distances
    from facetrank.plans import catalogue

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    print(f"Spark {spark.version}, local[4], {folder}")

    def naive_pivot(spark, folder):
        return catalogue._pivot_rows(pivot.search(catalogue._vectors(spark, folder), catalogue._METRICS, catalogue._WANTED, 10))

    def naive_documents(spark, folder):
        words = F.array_remove(F.array_distinct(F.split(F.lower("text"), "[^a-z]+")), "")
        docs = catalogue.table(spark, folder, "documents").where("text is not null and text <> ''").select(F.col("doc_id").cast("string").alias("id"), words.alias("words"))
        wanted = "fix the pending resolver in cache and update the tests of the nested worker".split()
        return distances(docs, Criterion("words", "keywords", F.col("words"), wanted)).where("d < 1").orderBy("d", "id").withColumn("n", F.monotonically_increasing_id()).limit(20)

    for name in ("num_knn", "ta_two", "ta_three_types", "ta_combos", "text_topk", "metric_l2", "pivot_search", "doc_similarity"):
        naive = {"pivot_search": naive_pivot, "doc_similarity": naive_documents}.get(name) or (lambda s, f, one=catalogue.RANKED[name]: ranked(one, s, f))
        took = []
        for query in (naive, catalogue.QUERIES[name]):
            each = []
            for _ in range(6):
                began = time.perf_counter()
                query(spark, folder).write.format("noop").mode("overwrite").save()
                each.append(time.perf_counter() - began)
            took.append(f"{median(each[1:]):.2f} ({min(each[1:]):.2f} to {max(each[1:]):.2f})")
        print(f"| {name} | {took[0]} | {took[1]} |", flush=True)


if __name__ == "__main__":
    main()
