"""Durable cuts between the rounds of an iterative job."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# what a task of a shuffle holds in memory at once, sorted or as groups, and how many tasks
# the driver keeps account of
ROWS_PER_TASK = 1 << 20
MOST_TASKS = 1 << 12
# of a join, what a task looks up in memory, in bytes as shuffled; larger parts are sorted
HASHED_PART = "16m"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or one below a warehouse that was set.

    Both are seen by the driver and by all executors. The warehouse that Spark falls back on is
    a folder of each machine: it serves where driver and executors are one process, and
    without either setting a cluster is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        given = spark.sparkContext.getConf().get("spark.sql.warehouse.dir")
        if not given and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tagweave"
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` out once and read it from there from now on.

    Later rounds neither replan nor recompute earlier ones, a lost executor
    costs only its tasks of the current round, and columns not needed are not
    read. As files have a known size, the planner decides on broadcasts by real
    numbers; estimates carried along by a checkpoint would multiply with every
    join until they mean nothing.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tagweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    settled = spark.read.schema(df.schema).parquet(path)
    settled.settled_path = path
    return settled


@contextmanager
def shuffles_of(spark: SparkSession, rows: float) -> Iterator[None]:
    """Within, actions shuffle into so many tasks that each gets about ``ROWS_PER_TASK`` of ``rows``.

    The session's number of shuffle partitions stays where it is enough; otherwise it is raised
    and tasks are not merged again, so a task's memory does not grow with the input. Only
    what runs within is meant: a lazy result has to be settled there.

    Joins there look up a side whose parts are all small (``HASHED_PART``) instead of sorting both.
    """
    partitions = min(math.ceil(rows / ROWS_PER_TASK), MOST_TASKS)
    # joins are hashed where no part to look up is larger, which has to be no less than what parts are merged to
    wanted = dict.fromkeys(
        ("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes"),
        HASHED_PART,
    )
    if partitions > int(spark.conf.get("spark.sql.shuffle.partitions")):
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
        wanted["spark.sql.adaptive.coalescePartitions.enabled"] = "false"
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that no later step reads."""
    for df in tables:
        path = getattr(df, "settled_path", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
