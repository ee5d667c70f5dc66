"""Staged tables: intermediate results written to the shared checkpoint folder and
read back.  Used where a table feeds many steps: it is computed once, survives lost
executors, and later plans start from a scan instead of its whole history."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else, on one machine, a
    temporary one; a cluster needs a folder that all executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="gleaner-"))
    return context.getCheckpointDir().get()


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/gleaner-stage-{spark.sparkContext.applicationId}"


def unstage(spark: SparkSession) -> None:
    """Delete all staged tables of this application, once nothing lazy reads them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table of its own."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
