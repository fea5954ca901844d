"""Line dedup by overlapping windows of three lines.

Lines with a word are trimmed; every window of three consecutive ones is hashed (128 bits). Of
the documents and places that hold a window, ordered by doc_id and place, the first keeps it;
in all others its lines are covered, and the union of covered lines is removed. Where one
window is common to very many documents, its place in the join is split by adaptive
execution; before the shuffle that finds first places, rows are combined per task.

Defined results: texts of fewer than three such lines have no window and stay as they are;
null texts stay null; a null doc_id comes before all others; rows equal in doc_id and text are
one document; lines without a word are kept where they are; an empty table gives an empty one;
further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.operators.sizing import cut_lineage

SPACES = " \t\n\x0b\f\r"
WINDOW = 3
BROADCAST_PLACES = 500_000


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def lines_of(text: Column) -> Column:
    """(number in the text, trimmed line) of the lines with a word."""
    every = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x, i: F.struct(i.alias("at"), strip(x).alias("line")))
    return F.filter(every, lambda s: s["line"] != "")


def windows_of(docs: DataFrame, doc_id: str, text: str, window: int) -> DataFrame:
    """(_doc, _text, _place, _h1, _h2) of every window."""
    lines = docs.select(
        F.col(doc_id).alias("_doc"), F.xxhash64(text).alias("_text"),
        F.transform(lines_of(F.col(text)), lambda s: s["line"]).alias("_lines"),
    ).where(F.size("_lines") >= window)

    def hashed(i: Column) -> Column:
        part = [F.col("_lines")[i + k] for k in range(window)]
        return F.struct(F.xxhash64(*part).alias("h1"), F.xxhash64(F.lit("second"), *part[::-1]).alias("h2"))

    hashes = F.transform(F.sequence(F.lit(0), F.size("_lines") - window), hashed)
    return lines.select("_doc", "_text", F.posexplode(hashes).alias("_place", "_w")).select(
        "_doc", "_text", "_place", F.col("_w.h1").alias("_h1"), F.col("_w.h2").alias("_h2"))


def repeated_places(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(_key, _hash, _places): per document that has any, the places of windows that came before."""
    windows = windows_of(docs, doc_id, text, window)
    here = F.struct("_doc", "_text", "_place")
    firsts = cut_lineage(
        windows.groupBy("_h1", "_h2").agg(F.min(here).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1").select("_h1", "_h2", "_first"))
    return (
        windows.join(firsts, ["_h1", "_h2"]).where(~here.eqNullSafe(F.col("_first")))
        .groupBy(F.col("_doc").alias("_key"), F.col("_text").alias("_hash"))
        .agg(F.collect_set("_place").alias("_places"))
    )


def dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, broadcast_places: int = BROADCAST_PLACES,
) -> DataFrame:
    """The rows without repeated lines, plus ``n_lines`` (with a word) and ``n_removed``.

    The covered places are broadcast if they are few, as measured; else they are joined by document.
    """
    covered = cut_lineage(repeated_places(docs, doc_id, text, window))
    n = covered.agg(F.sum(F.size("_places"))).first()[0] or 0
    if n <= broadcast_places:
        covered = F.broadcast(covered)
    rows = docs.withColumn("_hash_here", F.xxhash64(text))
    joined = rows.join(
        covered, F.col(doc_id).eqNullSafe(F.col("_key")) & (F.col("_hash_here") == F.col("_hash")), "left"
    ).withColumn("_lines", lines_of(F.col(text)))
    gone = F.transform(
        F.array_distinct(F.flatten(F.transform("_places", lambda p: F.array(*(p + k for k in range(window)))))),
        lambda k: F.col("_lines")[k]["at"],
    )
    joined = joined.withColumn("_gone", gone)
    rest = F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains("_gone", i))
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(
        *(F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(rest, "\n")).alias(text) if c == text else F.col(f"`{c}`") for c in keep),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
