"""Cut a DataFrame from its history: a written table in the shared folder, which outlives executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder name in spark.checkpoint.dir, which driver and executors share. Where that is unset, one machine's temp folder does if all runs on that
    machine; on a cluster it is an error."""
    sc = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = os.path.join(tempfile.gettempdir(), "tabulon-cut")
    return f"{top.rstrip('/')}/c-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
