"""Runs queries and their SQL side by side, as the driver does. python tests/oracle.py [NAME...]"""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def compare(spark, name, query, sql, folder):
    """What differs between the two results, or an empty text."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    got = query(spark, folder).toPandas()
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"

    def rows(frame):
        frame = frame[sorted(frame.columns)]
        return sorted(tuple("" if pd.isna(v) else (repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)) for v in r) for r in frame.itertuples(index=False))

    differing = [(a, b) for a, b in zip(rows(got), rows(want)) if a != b]
    return f"{len(differing)} rows differ, first {differing[0]}" if differing else ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = "/root/testdata/sf0.01"
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in sys.argv[1:] or queries:
        began = time.time()
        try:
            said = compare(spark, name, queries[name], sql[name], folder) if name in sql else f"no SQL; {queries[name](spark, folder).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:500]}"
        print(f"{name}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)
