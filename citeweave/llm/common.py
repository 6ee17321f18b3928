"""What several operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: space, and tab to carriage return.
GAP = r"[\x20\x09-\x0D]+"
NOT_GAP = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(value: Column, f) -> Column:
    """f(value) with value computed once a row, however often f refers to it."""
    return F.transform(F.array(value), f)[0]


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where that is unset and all work is in this process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


#: Folders of the tables that stored() wrote while a scope was open; None outside of any.
_scope: list[str] | None = None


@contextmanager
def scope():
    """Collects the folders of the tables stored meanwhile, for drop() once everything read from them is written."""
    global _scope
    before, _scope = _scope, []
    try:
        yield _scope
    finally:
        _scope = before


def drop(spark: SparkSession, folders: list[str]) -> None:
    """Delete stored tables, and let Spark delete the shuffles that nothing refers to any more."""
    jvm = spark.sparkContext._jvm
    for f in folders:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    forget(spark)


def forget(spark: SparkSession) -> None:
    """Shuffles are deleted when their plans are garbage, which a large driver heap may not find for hours. The last
    execution stays known to Spark, so one without shuffles comes first."""
    spark.range(1).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Spark deletes an execution's shuffles at its end where this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """df written as a table to the shared folder and read again: the lineage is cut, and columns are encoded. The
    shuffles that made it go when it is written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    if _scope is not None:
        _scope.append(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder, partitions and all."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def in_batches(rows, size, most_bytes: int):
    """Lists of successive rows; a list ends when its rows' sizes reach most_bytes."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= most_bytes:
            yield held
            held, total = [], 0
    if held:
        yield held
