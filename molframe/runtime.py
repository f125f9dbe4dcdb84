"""Session helpers: the checkpoint folder and cutting lineage."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder in `spark.checkpoint.dir`. Where that is unset a local session gets a temporary one; on a cluster it is an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if sc.getCheckpointDir() is None:
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='molframe-')}")
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint. The columns are new ones, so the result joins with what it was made from."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint().select(*[F.col(f"`{c}`").alias(c) for c in df.columns])
