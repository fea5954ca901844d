"""Readers and writers for panels, draw tables and reports."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidewave.operators.sizing import shared_folder

# Checkpoint folders that a workspace went back to, with the folder they are in.
BASES: dict[str, str] = {}


def read_panel(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """Panel with a declared schema; Parquet, or CSV with a header line."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.parquet(path)


def read_draws(spark: SparkSession, path: str, outcome: str | None = None) -> DataFrame:
    """Draw table of one outcome (only its partition is read) or of all of them."""
    df = spark.read.parquet(path)
    return df if outcome is None else df.where(df["outcome"] == outcome)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def write_draws(df: DataFrame, path: str) -> None:
    """One job for all outcomes, one folder per outcome."""
    df.write.mode("errorifexists").partitionBy("outcome").parquet(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header; ``one_file`` is for finished report tables only."""
    out = df.coalesce(1) if one_file else df
    out.write.mode("errorifexists").option("header", True).csv(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder of the session."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is in."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """A folder for all that queries write between their steps: checkpoints, lookup tables, stages.

    Results are read from it, so write or collect them before it ends. It is removed at the end, also when a query fails.
    Workspaces may be nested; each is removed by the one who opened it.
    """
    sc = spark.sparkContext
    outer = shared_folder(spark)
    base = BASES.get(outer, outer)
    folder = new_folder(spark, "workspace")
    sc.setCheckpointDir(folder)
    try:
        yield folder
    finally:
        # Spark makes a new folder below the one it is given: the next workspace starts from the same base
        sc.setCheckpointDir(base)
        now = sc.getCheckpointDir() or base
        BASES.pop(outer, None)
        BASES[now] = base
        for path in (folder, now, *([outer] if outer != base else [])):
            remove(spark, path)
