"""Stage tables: results that several later steps read are written once to the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names. A folder of our own is used only where none is set and one machine runs
    all (tests); a cluster must name a folder that the driver and all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def stage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back, so that what follows has a short plan and a lost executor costs a file read."""
    path = f"{shared_root(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
