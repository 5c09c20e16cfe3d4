"""Python workers must find this package too."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def reachable(spark: SparkSession) -> None:
    """Put the folder of the package on the workers' PYTHONPATH; on a cluster it must be installed there, or shipped with addPyFile."""
    env = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[1])
    now = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in now:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, now)])
