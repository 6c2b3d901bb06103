"""Tables that several parts of a plan read, written once to the folder that all executors share.

The folder is ``spark.checkpoint.dir``. Only a session on a local master may go
without it: there driver and executors are one process and a temporary folder
will do. Everything an application saves lies under one folder of its own, which
``release`` deletes; it runs by itself when the driver's process ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
_folders: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application's saved tables."""
    where = spark.conf.get(KEY, None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{KEY} is not set: on a cluster, executors need a folder that they share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(KEY, where)
    folder = f"{where}/lithic-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders[folder] = spark
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage for good."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def drop_saved(*frames: DataFrame) -> None:
    """Delete the files of tables made by ``save`` that nothing needs any more."""
    for df in frames:
        for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(df.sparkSession, parent)


def release() -> None:
    """Delete all that running applications have saved; results that still read it are void afterwards."""
    for folder, spark in list(_folders.items()):
        if spark.sparkContext._jsc is not None and spark.sparkContext.applicationId in folder:
            delete(spark, folder)
        del _folders[folder]


atexit.register(release)
