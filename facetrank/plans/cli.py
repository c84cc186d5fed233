"""A terminal for SELECT statements: python -m facetrank.plans.cli MOUNT.json"""

from __future__ import annotations

import sys

from facetrank.plans.engine import Engine
from facetrank.sources import sinks


def run(engine: Engine, lines, write=print) -> None:
    r"""Statements end with `;`. `--` starts a comment, \d lists attributes, \q ends, SET query_timeout N; sets it."""
    pending = ""
    for line in lines:
        line = line.split("--")[0] if "'" not in line else line
        text = line.strip()
        if not pending and text == r"\q":
            return
        if not pending and text == r"\d":
            write("\n".join(f"{a.column}\t{a.operation}\t{a.kind}" for a in engine.attributes.values()))
            continue
        pending += line if line.endswith("\n") else line + "\n"
        if not text.endswith(";"):
            continue
        statement, pending = pending.strip(), ""
        words = statement.rstrip(";").split()
        if len(words) == 3 and [w.lower() for w in words[:2]] == ["set", "query_timeout"] and words[2].isdigit():
            engine.timeout = int(words[2])
            continue
        try:
            answer = engine.sql(statement)
            write(sinks.as_table(answer.flat))
            for w in answer.warnings:
                write(w)
        except ValueError as e:
            write(f"error: {e}")


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    made = Engine(spark)
    with open(sys.argv[1]) as f:
        for said in made.mount(f.read()):
            print(said)
    run(made, sys.stdin)
