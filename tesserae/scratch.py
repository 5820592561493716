"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``; under a temporary folder only in local mode, where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tesserae-")
    return f"{root.rstrip('/')}/table-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once and read from there, so that several uses and lost executors do not run its plan again."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a bucket in which a document's or another key's rows lie together, about.
BUCKET_ROWS = 60_000


def buckets(rows: int) -> int:
    """How many buckets so many rows ask for, so that a bucket's size does not grow with them."""
    return max(1, -(-rows // BUCKET_ROWS))
