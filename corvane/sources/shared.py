"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Without one a temporary folder is set where the driver is the only machine, as in tests; on a
    cluster, whose executors would each write to a disk of their own, that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="corvane-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        at = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df and reads it back, which cuts its lineage. The table is there until discard(), release() or the end of the program."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _MADE[path] = df.sparkSession
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._corvane_path = path
    return back


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores if it comes in far fewer splits than there are cores, as a table of a single row group does. Such a table holds a few
    splits' bytes, so this exchange is small; a large one has splits enough and is left alone. Plans with an exchange are too."""
    plan = df._jdf.queryExecution().executedPlan()
    if "Exchange" in plan.toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 4 * plan.execute().getNumPartitions() <= cores else df


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _MADE.pop(path, None)


def discard(df: DataFrame) -> None:
    """Removes the table of a DataFrame that materialize() gave and that nothing reads any more."""
    _remove(df.sparkSession, df._corvane_path)


def release(spark: SparkSession) -> None:
    """Removes all tables that materialize() wrote; results built on them can't be read afterwards."""
    for path in list(_MADE):
        _remove(spark, path)


@atexit.register
def _at_exit() -> None:
    for path, spark in list(_MADE.items()):
        try:
            _remove(spark, path)
        except Exception:  # the session is gone already, or the folder
            return
