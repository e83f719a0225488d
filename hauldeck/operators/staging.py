"""Where intermediate tables are kept: the cluster's checkpoint folder."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it.

    On a cluster it must be set: a folder of one machine would lose data.
    Only in local mode, where one machine is all there is, a temporary folder stands in.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if sc.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="hauldeck-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder, read back: later passes start at a scan, and a lost executor costs a re-read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
