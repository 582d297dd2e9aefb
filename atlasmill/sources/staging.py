"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder serves a local session, where there are no other machines;
    on a cluster it is the warehouse, if that is in a shared store. A machine's own folder is an error.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        master = spark.sparkContext.master
        local = master == "local" or master.startswith("local[")
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if not local and (warehouse.startswith("file:") or ":/" not in warehouse):
            raise ValueError("spark.checkpoint.dir is not set, and the warehouse is a machine's own folder: name a shared folder in spark.checkpoint.dir")
        there = tempfile.mkdtemp(prefix="spark-staged-") if local else f"{warehouse}/_staged"
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes `df` as Parquet to the shared folder and reads it back.

    The written table cuts the lineage: what reads it does not repeat the work before it, and the
    loss of an executor costs only the tasks that run at that time.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)
