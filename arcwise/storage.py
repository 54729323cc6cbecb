"""Tables in the folder that driver and executors share; they cut the lineage of iterative plans."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex
_TABLES: list[tuple[str, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder, which only a local master can share."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="arcwise-")
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir(f"file://{own}")
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/arcwise/{_RUN}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _shuffles_removed(spark: SparkSession):
    """The shuffle files of what runs within go when it ends, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back: computed once, without lineage, safe when an executor is lost."""
    path = new_path(df.sparkSession, name)
    with _shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, path: str, *by: str) -> None:
    """df written as Parquet to `path`, a folder for each value of `by`, for tasks that read it by themselves."""
    with _shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes what lies at a path that nothing reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored_by(df: DataFrame, name: str, key: str, *order: str) -> DataFrame:
    """stored, with the rows of a key in one of as many buckets as a shuffle has partitions, sorted by key and order:
    joins and groups by the key then move no row of the table. df is repartitioned by the key into as many before, or
    each task writes many files. The table lies in the shared folder; the session's catalog has its name."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"arcwise_{name}_{uuid.uuid4().hex}"
    with _shuffles_removed(spark):
        df.write.format("parquet").option("compression", "zstd").option("path", new_path(spark, name)).bucketBy(n, key).sortBy(key, *order).saveAsTable(table)
    _TABLES.append((spark.sparkContext.applicationId, table))
    return spark.table(table)


def clean(spark: SparkSession) -> None:
    """Deletes what this process has stored; results that weren't consumed can't be read afterwards."""
    for app, table in _TABLES:
        if app == spark.sparkContext.applicationId:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
    _TABLES.clear()
    dropped(spark, f"{shared_dir(spark)}/arcwise/{_RUN}")
