"""Quality rules with cross-document line frequency, built from column functions alone.

Lines are trimmed, lower-cased and freed of runs of white space, then hashed. A line is
boilerplate on its host when it stands in at least ``min_docs`` of its documents, however many the host
has. Boilerplate lines are removed; a document that loses more than ``max_loss`` of its words is rejected, as is one that fails the
base rules.

While the boilerplate lines are few, by count and per host, each host's travel as an array in a broadcast and documents are
never unfolded. Beyond that the hashes of the documents' lines are unfolded and joined on (host, line), and each row gets those of its own lines that
are boilerplate; a line that many documents of a host have is one row on the side of the lookup, and its documents are split by adaptive execution.

Defined results: a null text has no words and fails; each row is a document, also when
another row has its doc_id, and a line counts once per row; a null host is a host of its own; an empty table gives an empty
one; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.operators.sizing import cut_lineage, largest_group

SPACES = " \t\n\x0b\f\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 3
MIN_WORDS = 50
MIN_DOCS = 10
MAX_LOSS = 0.5
BROADCAST_HASHES = 500_000  # 8 bytes each
ARRAY_HASHES = 2_000  # of one host, looked through for each line


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def words_of(text: Column) -> Column:
    return F.when(strip(text) == "", F.array().cast("array<string>")).otherwise(F.split(strip(text), SPACE_RUN))


def normal_line(line: Column) -> Column:
    return F.lower(F.regexp_replace(strip(line), SPACE_RUN, " "))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: strip(x) != "")


def repeated_words(words: Column, hashes: Column) -> Column:
    """Words covered by the 3-word windows (given by hash) that a text holds twice or more."""
    n = F.size(hashes)
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = F.filter(
        F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(
            F.col("_pairs")[k]["i"].alias("i"),
            (
                ((k > 0) & (F.col("_pairs")[F.greatest(k - 1, F.lit(0))]["h"] == F.col("_pairs")[k]["h"]))
                | ((k < n - 1) & (F.col("_pairs")[F.least(k + 1, n - 1)]["h"] == F.col("_pairs")[k]["h"]))
            ).alias("twice"),
        )),
        lambda s: s["twice"],
    )
    return pairs, F.size(F.array_distinct(F.flatten(F.transform(
        same, lambda s: F.array(*(s["i"] + j for j in range(WINDOW)))))))


def measures(df: DataFrame, text: str, host: str) -> DataFrame:
    """The row without its text, plus the base counts and the line hashes and word counts."""
    base = (
        df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
        .withColumn("_words", words_of(F.col("_text")))
        .withColumn("_lines", lines_with_words(F.col("_text")))
        .withColumn("_each", F.transform("_words", lambda w: F.xxhash64(w)))
    )
    window = F.transform(
        F.slice(F.col("_each"), F.lit(1), F.greatest(F.size("_each") - (WINDOW - 1), F.lit(0))),
        lambda h, i: F.xxhash64(h, *(F.col("_each")[i + j] for j in range(1, WINDOW))),
    )
    base = base.withColumn("_windows", window).withColumn(
        "_twice", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    pairs, covered = repeated_words(F.col("_words"), F.col("_windows"))
    base = base.withColumn("_pairs", F.when(F.col("_twice"), pairs))
    normal = F.transform("_lines", normal_line)
    return base.withColumn("_normal", normal).select(
        *(F.col(f"`{c}`") for c in df.columns if c != text),
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(F.col("_text"), F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_twice"), covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.transform("_normal", lambda x: F.xxhash64(x)).alias("_line_hashes"),
        F.transform("_normal", lambda x: F.size(F.split(x, " "))).alias("_line_words"),
    )


def boilerplate(df: DataFrame, text: str, host: str, min_docs: int) -> DataFrame:
    """(_at, _line): the boilerplate lines of each host. A line counts once per document. Checkpointed."""
    lines = F.transform(lines_with_words(F.coalesce(F.col(text), F.lit(""))), normal_line)
    own = F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))
    counts = df.select(F.col(host).alias("_at"), F.explode(own).alias("_line")).groupBy("_at", "_line").agg(F.count(F.lit(1)).alias("_docs"))
    return cut_lineage(counts.where(F.col("_docs") >= min_docs).select("_at", "_line"))


def with_boilerplate(
    rows: DataFrame, often: DataFrame, host: str, lines: str, broadcast_hashes: int, array_hashes: int,
) -> DataFrame:
    """Add ``_boilerplate`` to rows that have the hashes of their lines: an array that holds those of them that are
    boilerplate on the row's host (and maybe others of the host), or null."""
    total = often.count()
    few = total <= broadcast_hashes
    if few and largest_group(often, ["_at"]) <= array_hashes:
        arrays = F.broadcast(often.groupBy("_at").agg(F.collect_list("_line").alias("_boilerplate")))
        return rows.join(arrays, F.col(host).eqNullSafe(F.col("_at")), "left").drop("_at")
    # rows are numbered where they are written, as they are met again by number
    rows = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    each = rows.select("_row", F.col(host).alias("_host"), F.explode(F.array_distinct(lines)).alias("_own"))
    same = (F.col("_own") == F.col("_line")) & F.col("_host").eqNullSafe(F.col("_at"))
    met = each.join(F.broadcast(often) if few else often, same).groupBy("_row").agg(F.collect_list("_line").alias("_boilerplate"))
    return rows.join(met, "_row", "left").drop("_row")


def judge(
    df: DataFrame, text: str = "text", host: str = "source", min_words: int = MIN_WORDS,
    min_docs: int = MIN_DOCS, max_loss: float = MAX_LOSS,
    broadcast_hashes: int = BROADCAST_HASHES, array_hashes: int = ARRAY_HASHES,
) -> DataFrame:
    """Add the counts, ``n_removed_words``, ``base_failed`` and ``kept``; the text is dropped."""
    often = boilerplate(df, text, host, min_docs)
    joined = with_boilerplate(measures(df, text, host), often, host, "_line_hashes", broadcast_hashes, array_hashes)
    lost = F.aggregate(
        F.arrays_zip("_line_hashes", "_line_words"), F.lit(0).cast("long"),
        lambda s, x: s + F.when(F.array_contains(F.col("_boilerplate"), x["_line_hashes"]), x["_line_words"]).otherwise(0),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        joined.withColumn("n_removed_words", F.when(F.col("_boilerplate").isNull(), F.lit(0)).otherwise(lost).cast("long"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("n_removed_words") <= F.lit(max_loss) * F.col("n_words")))
        .drop("_line_hashes", "_line_words", "_boilerplate")
    )


def without_boilerplate(
    df: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS,
    broadcast_hashes: int = BROADCAST_HASHES, array_hashes: int = ARRAY_HASHES,
) -> DataFrame:
    """The rows with their boilerplate lines taken out of the text; null texts stay null."""
    often = boilerplate(df, text, host, min_docs)
    normal = F.transform(lines_with_words(F.coalesce(F.col(text), F.lit(""))), normal_line)
    hashed = df.withColumn("_own_lines", F.transform(normal, lambda x: F.xxhash64(x)))
    joined = with_boilerplate(hashed, often, host, "_own_lines", broadcast_hashes, array_hashes)
    own = F.filter(F.split(F.col(text), "\n", -1), lambda x: (strip(x) == "") | ~F.array_contains(
        F.col("_boilerplate"), F.xxhash64(normal_line(x))))
    return joined.withColumn(
        text, F.when(F.col("_boilerplate").isNull(), F.col(text)).otherwise(F.array_join(own, "\n"))).select(*df.columns)
