"""Lineage cuts as written tables.

A staged table survives the loss of executors and fixes values that a recomputation could change (range bounds,
partition numbers). It lives in the shared folder that the cluster names in ``spark.checkpoint.dir``, below one
sub-folder per application, so a finished application's tables can be dropped together.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders that executors have been seen to share with the driver, by application.
_SHARED: set[tuple[str, str]] = set()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder: that of ``spark.checkpoint.dir``, else one in the warehouse; a temporary one in local runs.

    A path without a scheme on a cluster whose default file system is the machines' own may be a mount that all of them
    share or a folder that each has for itself. The name does not tell, so it is tried once.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    local, named = context.master.startswith("local"), bool(folder)
    if not named:
        folder = tempfile.mkdtemp(prefix="assayloom-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_assayloom"
    if not local and not (named and ":" in folder) and _scheme(spark, folder) == "file":
        _require_shared(spark, folder)
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def _scheme(spark: SparkSession, folder: str) -> str:
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    return spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(hadoop).getUri().getScheme()


def _require_shared(spark: SparkSession, folder: str) -> None:
    """Raise unless what tasks write into the folder is found there."""
    context = spark.sparkContext
    if (context.applicationId, folder) in _SHARED:
        return
    path, files = f"{folder}/{context.applicationId}/trial-{uuid.uuid4().hex}", max(16, 2 * context.defaultParallelism)
    spark.range(0, files, 1, files).write.parquet(path)
    try:
        found = spark.read.schema("id long").parquet(path).count()
    except Exception as error:
        raise RuntimeError(_not_shared(folder)) from error
    if found != files:
        raise RuntimeError(_not_shared(folder))
    _SHARED.add((context.applicationId, folder))


def _not_shared(folder: str) -> str:
    return f"{folder} is a folder of each machine; name one that the driver and every executor share in spark.checkpoint.dir"


def drop_staged(spark: SparkSession) -> None:
    """Delete everything that this application has staged; for the end of a job, when its results are read or written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and go on from the written table."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
