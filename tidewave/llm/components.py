"""Connected components of links, as joins and aggregates over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.sources.io import new_folder

BROADCAST_ROWS = 200_000
FEW_TASKS = 8


def lookup(df: DataFrame, limit: int | None = None) -> DataFrame:
    """A written table of a few columns as one side of joins: broadcast if its count is within the limit."""
    limit = BROADCAST_ROWS if limit is None else limit
    return F.broadcast(df) if df.count() <= limit else df


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder. Unlike a checkpoint, it forgets what the optimizer
    knows of the columns, which grows from round to round."""
    path = new_folder(df.sparkSession, "labels")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node each linked node can reach. ``links``: columns a, b.

    Labels spread along links and then jump to the label's own label, so the number of rounds
    grows with the logarithm of the longest path. Hot nodes are combined before each shuffle. Labels
    are broadcast while they are few; joins of more are shuffled, and split by adaptive execution where a node is hot.
    """
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a"))
    edges = written(both.distinct())
    first = edges.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("x")).alias("label"))
    spread = written(first)
    few = spread.count() <= BROADCAST_ROWS
    side = F.broadcast if few else (lambda df: df)
    while True:
        # a label's own label is known, being a node as well
        of = spread.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = spread.join(side(of), "label").select("node", F.col("next").alias("label"))
        if not few:
            labels = written(labels)
        near = (
            edges.join(side(labels.select(F.col("node").alias("y"), "label")), "y")
            .groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        )
        joined = near.join(side(labels), "node")
        spread = joined.select("node", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved"))
        spread = written(spread.coalesce(FEW_TASKS) if few else spread)
        if not spread.where("moved").limit(1).count():
            return spread.select("node", "label")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` as ``components`` gives them, after further links: these are walked between labels, those that made the labels aren't walked again."""
    of = labels.select(F.col("node").alias("a"), F.col("label").alias("_la"))
    to = labels.select(F.col("node").alias("b"), F.col("label").alias("_lb"))
    between = links.join(of, "a", "left").join(to, "b", "left").select(F.coalesce("_la", "a").alias("a"), F.coalesce("_lb", "b").alias("b"))
    moved = lookup(components(between.where("a != b")))
    known = labels.join(moved.select(F.col("node").alias("label"), F.col("label").alias("_to")), "label", "left").select("node", F.coalesce("_to", "label").alias("label"))
    return written(known.union(moved.join(labels.select("node"), "node", "left_anti").select("node", "label")))
