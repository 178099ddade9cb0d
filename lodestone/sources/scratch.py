"""A folder that driver and executors share, for indexes and states that a query builds on its way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``; where that is unset and Spark runs in one process, below the local temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(root or 'file://' + tempfile.mkdtemp(prefix='lodestone-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"
