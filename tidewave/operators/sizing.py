"""Size checks, lineage cuts and the block-keyed product of units and draws."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A group up to this many rows may be held by one task (sorted or buffered).
GROUP_ROWS = 1_000_000
# A draws table up to this many rows may be broadcast (about 64 doubles a row).
BROADCAST_DRAWS = 20_000
# A table of keys and numbers up to this many rows may be broadcast.
BROADCAST_KEYS = 200_000
DRAWS_PER_BLOCK = 1024
UNITS_PER_TILE = 200_000


def largest_group(df: DataFrame, by: list[str]) -> int:
    """Rows of the largest group; one pre-aggregated pass, one number to the driver."""
    sizes = df.groupBy(*by).count() if by else df.groupBy().count()
    return sizes.agg(F.max("count")).first()[0] or 0


def fits_one_task(df: DataFrame, by: list[str], bound: int | None, limit: int | None) -> bool:
    """Whether every group is small enough for one task.

    ``bound`` is an upper bound on group rows that the caller has already proved,
    such as the row count of the source; without it the groups are measured.
    """
    limit = GROUP_ROWS if limit is None else limit
    if bound is not None and bound <= limit:
        return True
    return largest_group(df, by) <= limit


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; in local mode, where none is set, one that ends with the program."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="tidewave-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir() or named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder, so that later steps all see the same ones."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """A lookup table, written and counted: broadcast if it is within the limit."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= limit else df


def numbers(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(max(n, 1) - 1))


def slots_of(spark: SparkSession) -> int:
    """Number of shuffle partitions the session is set up for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dealt_by(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Rows dealt by a key over as many partitions as keep ``rows`` of them within what a task holds; as they are if the session's do."""
    needed = math.ceil(rows / GROUP_ROWS)
    return df.repartition(needed, key) if needed > slots_of(df.sparkSession) else df


def spread_out(df: DataFrame, keys: list[str]) -> DataFrame:
    """Even out rows that are about to unfold into many more, over all shuffle slots.

    The count is explicit, so that a small input is not merged into a few tasks. The hash of the keys stands in for them: rows
    that a grouping has just dealt by the same keys would count as dealt, and that shuffle is merged.
    """
    return df.repartition(slots_of(df.sparkSession), F.xxhash64(*keys))


def with_every_draw(
    units: DataFrame,
    draws: DataFrame,
    n_draws: int,
    unit_key: list[str],
    on: tuple[str, str] | None = None,
    n_units: int | None = None,
    broadcast_limit: int | None = None,
    units_per_tile: int | None = None,
    broadcast_rows: int | None = None,
) -> DataFrame:
    """Give each unit row all draws; the smaller side is broadcast, as counted.

    A draws table within the checked bound is broadcast to the units, which are spread
    over all slots first, since each of them unfolds into one row per draw. Beyond it few units (cells, as a rule) are
    written, counted and broadcast to the draws, which are spread in their turn. Where both sides are large they are cut into
    blocks and tiles and joined on (block, tile), so no task meets more than one block of draws with one tile of units, whatever
    the units look like. The result has units x draws rows by its nature: callers collapse
    equal units to weighted cells first. ``on`` names a further pair of columns that must
    match, such as the outcome of a response and of a draw. ``n_draws`` sets the number of blocks;
    the table that would be broadcast is counted by itself (``broadcast_rows``, where the caller knows it), as it has a row per draw
    and outcome. A ``broadcast_limit`` of 0 asks for tiles.
    """
    limit = BROADCAST_DRAWS if broadcast_limit is None else broadcast_limit
    slots = slots_of(units.sparkSession)
    n_blocks = max(1, math.ceil(n_draws / DRAWS_PER_BLOCK))
    draws = draws.withColumnRenamed(on[1], on[0]) if on else draws
    shared = [on[0]] if on else []
    if broadcast_rows is None:
        broadcast_rows = draws.count() if on else n_draws
    if broadcast_rows > limit:
        # counted, then read by the join: written once
        units = cut_lineage(units)
        if n_units is None:
            n_units = units.count()
    block = F.pmod(F.xxhash64("draw"), F.lit(n_blocks)).cast("int")
    if broadcast_rows > limit and 0 < limit and n_units <= BROADCAST_KEYS:
        spread = draws.repartition(slots, *shared, "draw")
        few = F.broadcast(units)
        both = few.join(spread, shared) if shared else spread.crossJoin(few)
        return both.select(*units.columns, *[c for c in draws.columns if c not in shared])
    # units are shuffled once each and copied for the blocks where they have arrived
    spread = spread_out(units, unit_key).withColumn("_block", F.explode(numbers(n_blocks)))
    keys = ["_block", *shared]
    blocks = draws.withColumn("_block", block)
    if broadcast_rows <= limit:
        return spread.join(F.broadcast(blocks), keys).drop("_block")
    per_tile = UNITS_PER_TILE if units_per_tile is None else units_per_tile
    n_tiles = max(1, math.ceil(n_units / per_tile))
    tile = F.pmod(F.xxhash64(*unit_key), F.lit(n_tiles)).cast("int")
    keys.append("_tile")
    # the count is explicit on both sides: few bytes meet here, but many rows come of them
    left = units.withColumn("_tile", tile).withColumn("_block", F.explode(numbers(n_blocks))).repartition(slots, *keys)
    right = blocks.withColumn("_tile", F.explode(numbers(n_tiles))).repartition(slots, *keys)
    return left.join(right, keys).drop("_block", "_tile")
