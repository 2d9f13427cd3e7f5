"""Tables written to the folder that all executors share, to cut lineage and to read a costly result more than once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, on a single machine only, a new folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset, and executors on several machines need a shared folder")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyfold-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df``, computed once, as a table; it outlives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
