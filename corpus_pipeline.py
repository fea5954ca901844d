"""Corpus pipeline: language, repeated lines, near duplicates, benchmark passages, tokens.

Every stage takes (spark, docs, sf_dir) and returns the documents that go on; all but the last keep
the columns of ``documents``. Stages are written as Parquet in the shared folder and read again,
so that a lost executor costs at most the stage that runs. Rows with nulls, empty texts and ties are
treated as the operators' docstrings say; columns beyond those of ``documents`` pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm import bpe, decontaminate, language, line_windows, parity_join
from tidewave.llm.memory import release
from tidewave.llm.queries import held_out, table, vocabulary
from tidewave.sources.io import new_folder

# A text whose most likely language is less probable than this is in none of the known languages.
LEAST_SCORE = 0.3
# Rows that go to a Python worker at once; texts of some thousand bytes make a few megabytes, several of which an executor holds outside its heap.
ROWS_PER_BATCH = 2000


def begin(spark: SparkSession) -> None:
    """Drop what earlier stages left, and keep the batches of this one small. The setting stays, as stages run when their rows are written."""
    release(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages. Null texts and texts without a letter go.

    Held-out documents are not learned from.
    """
    begin(spark)
    model = language.fit(docs.where(~held_out()))
    judged = language.predict(docs, model, lang_column="_pred", score_column="_score")
    return judged.where((F.col("_pred") != language.UNKNOWN) & (F.col("_score") >= LEAST_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without line windows seen before; those with nothing left go.

    ``n_chars`` follows the text where lines were removed.
    """
    begin(spark)
    rest = line_windows.dedup(docs.withColumnsRenamed({c: f"_{c}" for c in docs.columns if c in ("n_lines", "n_removed")}))
    rest = rest.where((F.col("n_removed") == 0) | (F.col("n_lines") > F.col("n_removed")))
    if "n_chars" in docs.columns:
        rest = rest.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    rest = rest.drop("n_lines", "n_removed")
    return rest.withColumnsRenamed({f"_{c}": c for c in docs.columns if c in ("n_lines", "n_removed")}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id."""
    begin(spark)
    return parity_join.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    begin(spark)
    found = decontaminate.find_passages(docs.select(*docs.columns, *(F.col(c).alias(f"_{c}") for c in docs.columns if c in decontaminate.OUTPUTS)), table(spark, sf_dir, "benchmark"))
    clean = found.where(~decontaminate.contaminated())
    return clean.select(*(F.col(f"_{c}").alias(c) if c in decontaminate.OUTPUTS else F.col(c) for c in docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids, with what decoding them gives: digests of both."""
    begin(spark)
    return bpe.encode(docs.select("doc_id", "text"), vocabulary(), decoded="decoded").select(
        "doc_id", "ids",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("tokens", tokens),
]
# A trained network and a word list stand between the input and the rows; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each on the written rows of the one before."""
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "corpus")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
