"""Memory of Python workers, which Spark keeps for later tasks."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import SparkSession


def give_back() -> None:
    """Return what a finished task has freed to the system, so that workers at rest stay small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library, which has its own ways


def release(spark: SparkSession) -> None:
    """Let Spark drop what no DataFrame refers to any more: shuffle files, checkpoints and broadcasts of finished steps.

    Spark does that whenever the driver collects garbage, which a driver with little to do puts off for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
