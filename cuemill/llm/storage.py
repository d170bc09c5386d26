"""Working tables in the folder that the cluster shares.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir``; a lost
executor then costs a re-read, never a recomputation of what came before.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The setting by which Spark removes the shuffle files of an execution at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Temporary folders of local sessions that name none, by application.
_OWN: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local master may go without that setting (tests, a laptop): a temporary
    folder is then made. On a cluster a missing setting is an error, since a
    machine-local folder would not be seen by the other machines.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="cuemill-")
            context.setCheckpointDir(_OWN[context.applicationId])
        root = _OWN[context.applicationId]
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name of its own below the shared root (not created yet)."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder, in folders by ``partition_by`` columns, and read it back; columns keep their order.

    The shuffle files of the write go when it is done: nothing needs them beside the table,
    and else they lie on the executors' disks until the driver happens to collect garbage.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    table = spark.read.schema(df.schema).parquet(path)
    return table.select(*df.columns) if partition_by else table


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a working folder that ``new_folder`` named and that no result reads any more."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def remove_table(table: DataFrame) -> None:
    """Delete the folder of a table as ``materialise`` returned it, once nothing reads it any more."""
    folders = {file.rsplit("/", 1)[0] for file in table.inputFiles()}
    for folder in folders:
        remove(table.sparkSession, folder)
