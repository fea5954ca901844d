"""Row numbers, dense indices and neighbour rows that hold for groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewave.operators import sizing


def in_order(df: DataFrame, by: list[str], order: list[str], slots: int | None = None) -> DataFrame:
    """Range-partition by (group, order) and note the slot of each row.

    A large group spans many neighbouring slots, as many as keep a slot within the rows
    that one task may hold. The rows are written out, because
    slot sizes and positions must refer to one and the same placement.
    """
    if slots is None:
        rows = df.count()
        slots = max(sizing.slots_of(df.sparkSession), -(-rows // sizing.GROUP_ROWS))
    placed = df.repartitionByRange(slots, *by, *order)
    return sizing.cut_lineage(placed.withColumn("_slot", F.spark_partition_id()))


def slot_offsets(placed: DataFrame, by: list[str], weight: str | None, name: str) -> DataFrame:
    """Total weight of the earlier slots of the same group, one row per (group, slot)."""
    total = F.sum(weight) if weight else F.count(F.lit(1))
    sizes = placed.groupBy(*by, "_slot").agg(total.alias("_n"))
    # at most one row per slot in a group, so these windows stay small
    before = W.partitionBy(*by).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    return sizes.select(
        *by, "_slot", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(name)
    )


def row_index(
    df: DataFrame,
    by: list[str],
    order: list[str],
    name: str = "ii",
    bound: int | None = None,
    limit: int | None = None,
    slots: int | None = None,
) -> DataFrame:
    """Number the rows 1..n inside each group.

    Groups that fit one task use a window. Larger ones are range-partitioned: number
    the rows inside each slot and add the sizes of the slots before it. ``order``
    must identify a row inside its group. The offsets are a row per group and slot: broadcast, as counted, so that
    rows whose number nobody reads are not dealt once more.
    """
    if sizing.fits_one_task(df, by, bound, limit):
        w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
        return df.withColumn(name, F.row_number().over(w.orderBy(*order)).cast("bigint"))
    keys = by or ["_all"]
    if not by:
        df = df.withColumn("_all", F.lit(0))
    placed = in_order(df, keys, order, slots)
    offsets = sizing.small(slot_offsets(placed, keys, None, "_before"))
    inside = W.partitionBy(*keys, "_slot").orderBy(*order)
    numbered = placed.withColumn("_rn", F.row_number().over(inside)).join(
        offsets, keys + ["_slot"]
    )
    out = numbered.withColumn(name, F.col("_rn") + F.col("_before"))
    return out.select(*[c for c in df.columns if c != "_all"], name)


def dense_index(
    df: DataFrame,
    key: str,
    name: str,
    by: list[str] | None = None,
    bound: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Number the distinct key values 1..K in key order, per group; null stays null.

    Only the distinct keys are ranked; the rows get their number back by a join. Few keys, as
    counted, are broadcast, so that rows with a common key are not sent to one task.
    """
    by = by or []
    keys = df.select(*by, key).where(F.col(key).isNotNull()).distinct()
    ranked = row_index(keys, by, [key], name, bound=bound, limit=limit)
    if by or bound is None or bound > sizing.BROADCAST_KEYS:
        ranked = sizing.cut_lineage(ranked)
        bound = ranked.count()
    if bound <= sizing.BROADCAST_KEYS:
        ranked = F.broadcast(ranked)
    return df.join(ranked, by + [key], "left").select(*df.columns, name)


def previous_row(
    df: DataFrame, by: list[str], position: str, value: str, name: str, block: int = 100_000
) -> DataFrame:
    """Value of the row before, for rows already numbered by ``position``.

    Each group is cut into blocks of positions; the last row of a block is also sent
    to the next block, so a window never holds more than one block.
    """
    own = F.floor((F.col(position) - 1) / block)
    last = F.col(position) % block == 0
    homes = F.when(last, F.array(own, own + 1)).otherwise(F.array(own))
    cut = df.withColumn("_home", own).withColumn("_block", F.explode(homes))
    w = W.partitionBy(*by, "_block").orderBy(position)
    lagged = cut.withColumn(name, F.lag(value).over(w))
    return lagged.where(F.col("_block") == F.col("_home")).drop("_block", "_home")
