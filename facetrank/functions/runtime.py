"""Session-level helpers: lineage cuts, shipping of worker code, table access."""

from __future__ import annotations

import sys
import tempfile
import threading
import time
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def ship(module_name: str) -> None:
    """Pickle a module's functions by value, so that executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def on_one_machine(spark: SparkSession) -> bool:
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, where this application keeps what it writes for itself. Where that is
    unset, a temporary folder is used on one machine; elsewhere that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not on_one_machine(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="facetrank-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write `df` once to the session's shared folder and read it back from there.

    Checkpoints are files that every executor can read, so that a lost executor costs a retry of its tasks and
    nothing else.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def within(spark: SparkSession, milliseconds: int):
    """What is run inside is cancelled after that time, and TimeoutError raised."""
    context = spark.sparkContext
    tag = f"facetrank-{threading.get_ident()}-{time.time_ns()}"
    late = threading.Event()

    def cancel() -> None:
        late.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(milliseconds / 1000, cancel)
    context.addJobTag(tag)
    timer.start()
    try:
        yield
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"it took more than {milliseconds} ms") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def width(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def wide(df: DataFrame, *columns: str) -> DataFrame:
    """Hash partitioning by `columns` for a CPU-heavy step: adaptive execution would merge its small shuffle blocks
    into few tasks, going by bytes, where the work is in the cores."""
    return df.repartition(width(df.sparkSession), *columns)


def spread(scan: DataFrame) -> DataFrame:
    """The rows of a table as read, dealt out to more tasks if its files make fewer than there are cores."""
    spark = scan.sparkSession
    if scan.rdd.getNumPartitions() * 2 > spark.sparkContext.defaultParallelism:
        return scan
    return scan.repartition(width(spark))
