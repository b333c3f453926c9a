"""The folder that the driver and all executors share, and results that are cut from their lineage there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only a local master may go without that setting; there a temporary
    folder stands in. On a cluster its absence is an error, as a machine-local folder would lose data.
    """
    context = spark.sparkContext
    if (found := context._jsc.sc().getCheckpointDir()).isDefined():
        return found.get()
    path = context.getConf().get("spark.checkpoint.dir")
    if not path:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="larkspur-")
    context.setCheckpointDir(path)
    return context._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Computes ``df`` once into the shared folder; what follows reads that and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder that :func:`scratch_path` named."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(df: DataFrame) -> None:
    """Deletes what :func:`cut` wrote for ``df``, once nothing will read it any more, not even to replace a lost executor's work:
    all that was made from it has been cut itself."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        drop_path(df.sparkSession, file.get())
