"""Rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair draws one number from its MD5 digest, and the shard with the smallest
weighted draw owns the record. A new shard can only win records for itself, and changing one
weight moves records to or from that shard only.

Defined results: a null key is the key ``\\N``; a null text has no bytes (its CRC is that of an
empty text); records with equal keys share a shard; equal rows get neighbouring slots (they are counted as one and unfold from one number
of copies in one task, a few bytes each); an empty
table gives an empty one. Columns of the input other than those named are kept by
``assign`` and are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewave.operators.sizing import cut_lineage, slots_of

ROWS_PER_RUN = 100_000
HEX_DIGITS = 13  # 52 bits, exact in a double
NULL_KEY = "\\N"


def draw(key: Column, shard: int) -> Column:
    """Number in (0, 1) that depends on the key and the shard alone."""
    digest = F.md5(F.concat(key, F.lit(f":{shard}")))
    whole = F.conv(F.substring(digest, 1, HEX_DIGITS), 16, 10).cast("double")
    return (whole + 0.5) / float(16**HEX_DIGITS)


def best_of(key: Column, weights: list[float], first: int = 0) -> Column:
    """(score, shard) of the winner among the shards ``first``, ``first + 1``, ..."""
    return F.array_min(F.array(*(
        F.struct((-F.log(draw(key, first + i)) / w).alias("score"), F.lit(first + i).alias("shard"))
        for i, w in enumerate(weights) if w > 0
    )))


def record_key(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(NULL_KEY))


def assign(
    df: DataFrame, key: str, weights: list[float], grown_by: list[float] | None = None,
    shard_column: str = "shard", grown_column: str = "grown_shard",
) -> DataFrame:
    """Add the shard of each record, and with ``grown_by`` its shard after more are appended.

    Columns of the same name in the input are replaced.
    """
    if not any(w > 0 for w in weights):
        raise ValueError("at least one shard needs a positive weight")
    best = best_of(record_key(F.col(f"`{key}`")), weights)
    if grown_by is None:
        return df.withColumn(shard_column, best["shard"])
    more = best_of(record_key(F.col(f"`{key}`")), grown_by, len(weights))
    placed = df.withColumn("_best", best).withColumn("_more", more)
    return (
        placed.withColumn(shard_column, F.col("_best.shard"))
        .withColumn(grown_column, F.least("_best", "_more")["shard"])
        .drop("_best", "_more")
    )


def number_within(df: DataFrame, shard: str, order: list[str], n_shards: int, slot: str = "slot") -> DataFrame:
    """Gapless numbers from 0 within each shard, in the order of a digest of ``order``.

    Equal rows are counted before they are shuffled. A shard is cut into runs of digest
    ranges; runs are numbered apart and shifted by the totals of the runs before them, so
    no task holds a shard.
    """
    columns = df.columns
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    place = F.md5(F.concat_ws(":", *(record_key(F.col(c)) for c in order)))
    counted = cut_lineage(counted.withColumn("_place", place))
    n = counted.agg(F.sum("_copies")).first()[0] or 0
    runs = max(1, math.ceil(n / n_shards / ROWS_PER_RUN), math.ceil(2 * slots_of(df.sparkSession) / n_shards))
    start = F.conv(F.substring("_place", 1, 8), 16, 10).cast("long")
    counted = counted.withColumn("_run", F.floor(start * runs / F.lit(16**8)).cast("int"))
    totals = counted.groupBy(shard, "_run").agg(F.sum("_copies").alias("_n"))
    before = W.partitionBy(shard).orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    shifts = totals.select(shard, "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = (
        W.partitionBy(shard, "_run").orderBy("_place", *(F.col(c) for c in columns if c != shard))
        .rowsBetween(W.unboundedPreceding, -1)
    )
    numbered = counted.withColumn("_before", F.coalesce(F.sum("_copies").over(inside), F.lit(0)))
    first = F.col("_shift") + F.col("_before")
    return (
        numbered.join(shifts, [shard, "_run"])
        .withColumn(slot, F.explode(F.sequence(first, first + F.col("_copies") - 1)))
        .select(*columns, slot)
    )


def write_shards(df: DataFrame, path: str, shard: str = "shard", salts: int = 1) -> None:
    """One folder per shard; ``salts`` tasks write each shard."""
    salt = F.pmod(F.xxhash64(*(c for c in df.columns if c != shard)), F.lit(salts))
    df.repartition(slots_of(df.sparkSession), shard, salt).write.partitionBy(shard).parquet(path)
