"""Tables of sources: delimited files, Parquet, databases; and the columns of attributes in them."""

from __future__ import annotations

import shutil
import tempfile
import urllib.request
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetrank.functions.runtime import shared_folder
from facetrank.functions.text import split_tokens
from facetrank.functions.values import epoch_of, epoch_of_timestamp, point_of


def delimited(spark: SparkSession, location: str, dataset: str, separator: str = ";", header: bool = True, quote: str = '"', max_lines: int | None = None) -> DataFrame:
    """All columns as texts. A file at an http or ftp address is fetched once, into the session's shared folder.

    Without a header, columns are called by their numbers from 0. Short rows have nulls.
    """
    path = location.rstrip("/") + "/" + dataset if location else dataset
    if path.startswith(("http://", "https://", "ftp://")):
        path = fetched(spark, path)
    rows = spark.read.options(sep=separator, header=header, quote=quote, escape=quote, mode="PERMISSIVE", multiLine=False).csv(path)
    if not header:
        rows = rows.toDF(*(str(i) for i in range(len(rows.columns))))
    return rows.limit(max_lines) if max_lines else rows


def fetched(spark: SparkSession, address: str) -> str:
    """Path of a copy of the file in the session's shared folder, written through that folder's file system."""
    name = Path(urllib.request.url2pathname(address)).name
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/fetched-{uuid.uuid4()}/{name}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    with urllib.request.urlopen(address, timeout=60) as given, tempfile.NamedTemporaryFile() as local:
        shutil.copyfileobj(given, local)
        local.flush()
        # The driver's own temporary file; what executors read is the copy.
        files.copyFromLocalFile(False, True, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{local.name}"), path)
    return path.toString()


def database(spark: SparkSession, url: str, table: str, driver: str | None = None, user: str | None = None, password: str | None = None, part: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A table or a query in brackets. part: (number column, lowest, highest, partitions) for parallel reading.

    Filters, columns and limits go to the database. Of Avatica drivers, which give missing texts as `None`, these are
    null again.
    """
    options = {"url": url, "dbtable": table, "pushDownPredicate": "true", "pushDownLimit": "true", "pushDownOffset": "true", "fetchsize": "10000"}
    options |= {k: v for k, v in {"driver": driver, "user": user, "password": password}.items() if v}
    if part:
        options |= dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, part)))
    rows = spark.read.format("jdbc").options(**options).load()
    if not url.startswith("jdbc:avatica"):
        return rows
    texts = {f.name for f in rows.schema if f.dataType.simpleString() == "string"}
    return rows.select(*(F.nullif(F.col(f"`{c}`"), F.lit("None")).alias(c) if c in texts else F.col(f"`{c}`") for c in rows.columns))


def attribute_value(rows: DataFrame, columns: list[str], kind: str, token_delimiter: str = ",") -> Column:
    """An attribute of that kind from one or several columns, null where they can't be read.

    number: DOUBLE. date: epoch seconds. point: a location text, or two columns (x, y). keywords: an array, or a text
    split at `token_delimiter`. text: STRING. vector: an array, several columns, or a delimited text; dates in it
    become epoch seconds.
    """
    types = {c: rows.schema[c].dataType.simpleString() for c in columns}
    first = F.col(f"`{columns[0]}`")
    kind_of = types[columns[0]]

    def number(c: str) -> Column:
        if types[c].startswith("timestamp") or types[c] == "date":
            return epoch_of_timestamp(F.col(f"`{c}`"))
        plain = F.col(f"`{c}`").try_cast("double")
        return F.when(~F.isnan(plain), plain)

    if kind == "number":
        return number(columns[0])
    if kind == "date":
        if kind_of.startswith("timestamp") or kind_of == "date":
            return epoch_of_timestamp(first)
        return epoch_of(F.trim(first.cast("string")))
    if kind == "point":
        if len(columns) == 2:
            x, y = number(columns[0]), number(columns[1])
            return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))
        return first if kind_of.startswith("struct") else point_of(first)
    if kind == "keywords":
        tokens = F.array_distinct(F.filter(first, lambda t: t.isNotNull() & (t != ""))) if kind_of.startswith("array") else split_tokens(first, token_delimiter)
        return F.when(F.size(tokens) > 0, tokens)
    if kind == "text":
        return F.nullif(first.cast("string"), F.lit(""))
    if kind != "vector":
        raise ValueError(f"unknown kind of attribute {kind}")
    if len(columns) > 1:
        parts = [number(c) for c in columns]
        present = parts[0].isNotNull()
        for p in parts[1:]:
            present = present & p.isNotNull()
        return F.when(present, F.array(*parts))
    if kind_of.startswith("array"):
        vector = first.cast("array<double>")
    elif kind_of == "string":
        point = point_of(first)
        bare = F.regexp_replace(first, r"[\[\]\s]", "")
        listed = F.transform(F.split(bare, f"\\Q{token_delimiter}\\E"), lambda t: t.try_cast("double"))
        when = epoch_of(F.trim(first))
        vector = F.when(point.isNotNull(), F.array(point["x"], point["y"])).otherwise(F.when(F.forall(listed, lambda x: x.isNotNull()), listed).otherwise(F.when(when.isNotNull(), F.array(when))))
    else:
        vector = F.array(number(columns[0]))
    return F.when(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)), vector)


def one_row_a_key(rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows with a null or empty key are left out; of rows of the same key the greatest one is kept, as a whole, its
    columns compared from left to right (those that have an order)."""
    names = [c for c in rows.columns if c != key]
    there = rows.where(F.col(key).isNotNull() & (F.col(key) != ""))
    if not names:
        return there.distinct()
    whole = F.struct(*(F.col(f"`{c}`") for c in names))
    ordered = [F.col(f"`{c}`") for c in names if "map<" not in rows.schema[c].dataType.simpleString()]
    best = F.max_by(whole, F.struct(*ordered)) if len(ordered) < len(names) else F.max(whole)
    return there.groupBy(key).agg(best.alias("_row")).select(key, "_row.*")
