"""Lineage cuts in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a temporary one, but only if driver and executors are one
    process: the executors of a cluster would each write to a disk of their own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"{tempfile.gettempdir()}/tokenloom-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of an Arrow batch. Rows hold whole texts, so batches of 10000, the default, take much memory on either side.
BATCH_ROWS = 1000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def _batches_of_whole_texts(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(BATCH)
    if 0 < int(before) <= BATCH_ROWS:
        yield
        return
    spark.conf.set(BATCH, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


_collectors: list[list[Scratch]] = []


class Scratch:
    """Tables written under one run's folder: ``cut`` writes and reads back, ``drop`` deletes one that is no longer needed, ``clear``
    all of them.

    A table read back has its own size in its statistics, so the planner chooses broadcasts from a measured size, and a lost
    executor costs a reread instead of the whole lineage. A result that is read from such tables needs them until it is written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        for made in _collectors:
            made.append(self)

    def cut(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        with _batches_of_whole_texts(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        _delete(self.spark, df._scratch_path)

    def clear(self) -> None:
        _delete(self.spark, self.root)


@contextmanager
def collected() -> Iterator[list[Scratch]]:
    """The list of all Scratch made inside: who has written the results clears them."""
    made: list[Scratch] = []
    _collectors.append(made)
    try:
        yield made
    finally:
        _collectors.remove(made)
