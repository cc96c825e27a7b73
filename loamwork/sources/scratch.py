"""New paths in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


@cache
def _own(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix=f"loamwork-{application}-")


def path(spark: SparkSession, name: str) -> str:
    """In spark.checkpoint.dir; only where that is unset and Spark is local, in a folder of this session's own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own(spark.sparkContext.applicationId)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
